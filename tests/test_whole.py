"""Queries that do the whole job: nothing that they are asked about is left out."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.plans import bindings as B
from siltstone.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_signals_of_every_user_turn(spark):
    asked = B.table(spark, SF, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), "text")
    every = sorted(r["task_id"] for r in asked.collect())
    assert sorted(r["task_id"] for r in plans.QUERIES["low_information_tasks"](spark, SF).collect()) == every
    worded = {r["task_id"] for r in asked.filter(r"text rlike '[\\p{L}\\p{N}]'").collect()}
    assert {r["task_id"] for r in plans.QUERIES["task_signals"](spark, SF).select("task_id").distinct().collect()} >= worded
