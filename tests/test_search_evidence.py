"""The search plans look for symbols and imports; words are verified and owned by symbols."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence as E
from siltstone.operators import scoring
from siltstone.operators import signals as S
from siltstone.plans import queries as plans
from siltstone.plans import search

SF = "/root/testdata/sf0.001"


def test_search_finds_a_file_by_its_symbol_or_import_alone(spark):
    tasks = spark.createDataFrame([(1, "parseLedger"), (2, "leftpad")], "task_id long, text string")
    files = spark.createDataFrame([("src/a.ts", "x", "source"), ("src/b.ts", "y", "source")], "path string, text string, category string")
    symbols = spark.createDataFrame([("src/a.ts", "s1", "parseLedger", "A.parseLedger", 1, 1)], "path string, symbol_id string, name string, qualified_name string, start_line int, end_line int")
    imports = spark.createDataFrame([("src/b.ts", "leftpad")], "path string, specifier string")
    got = {(r["task_id"], r["path"]) for r in search.search(tasks, files, symbols, imports).collect()}
    assert got == {(1, "src/a.ts"), (2, "src/b.ts")}


def test_words_are_verified_and_owned(spark):
    tasks = spark.createDataFrame([(1, "ledger")], "task_id long, text string")
    files = spark.createDataFrame([("a.ts", "top\nledger ledger\nx\nledger\nledger")], "path string, text string")
    symbols = spark.createDataFrame([("a.ts", "wide", "w", "w", 1, 5), ("a.ts", "two", "t", "t", 2, 3), ("a.ts", "four", "f", "f", 4, 4), ("a.ts", "five", "v", "v", 5, 5)], "path string, symbol_id string, name string, qualified_name string, start_line int, end_line int")
    got = E.verified(S.signals(tasks).withColumn("ambiguity_factor", F.lit(1.0)), files, symbols)
    rows = sorted((r["kind"], r["family"], r["symbol"] or "", r["weight"]) for r in got.collect())
    # the first three places are two on line 2 and one on line 4; a plain word weighs 30, and 0.24 more if it occurs three times
    assert rows == [("LEXICAL_SYMBOL_OWNERSHIP", "SYMBOL", "four", 18.6), ("LEXICAL_SYMBOL_OWNERSHIP", "SYMBOL", "two", 18.6), ("VERIFIED_LEXICAL", "LEXICAL", "", 37.2)]
    assert scoring.fold_score(got.withColumn("id", F.concat("kind", "target"))).first()["tier"] == 2


def test_weights_of_the_second_scorer(spark):
    """Names by kind, provenance and ambiguity; a plain word that names a symbol is ambiguous."""
    asked = spark.createDataFrame([(1, "IDENTIFIER", "parseLedger", "parseledger", "EXPLICIT", False, 1.0), (1, "NATURAL_TERM", "ledger", "ledger", "EXPLICIT", False, 0.5), (1, "IDENTIFIER", "parse", "parse", "DERIVED", False, 1.0)], "task_id int, kind string, value string, normalized string, origin string, low_value boolean, ambiguity_factor double")
    files = spark.createDataFrame([("src/ledger.ts", "x")], "path string, text string")
    symbols = spark.createDataFrame([("src/ledger.ts", "s1", "parseLedger", "A.parseLedger", 1, 1), ("src/ledger.ts", "s2", "ledger", "ledger", 2, 2)], "path string, symbol_id string, name string, qualified_name string, start_line int, end_line int")
    imports = spark.createDataFrame([], "path string, specifier string")
    got = sorted((r["kind"], r["signal"], r["symbol"], r["weight"]) for r in E.identity_2(asked, files, symbols, imports).collect())
    assert got == [
        ("AMBIGUOUS_SYMBOL", "ledger", "s2", 15.0), ("EXACT_QUALIFIED_SYMBOL", "ledger", "s2", 90.0), ("EXACT_SYMBOL", "parseLedger", "s1", 150.0), ("PATH_COMPONENT", "ledger", None, 12.0),
        ("SYMBOL_COMPONENT", "ledger", "s1", 16.0), ("SYMBOL_COMPONENT", "ledger", "s2", 16.0), ("SYMBOL_COMPONENT", "parse", "s1", 23.04), ("SYMBOL_COMPONENT", "parseLedger", "s1", 32.0),
    ]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_second_scorer_reads_every_kind(spark):
    kinds = {r["kind"] for r in plans._second(spark, SF).select("kind").distinct().collect()}
    assert {"EXACT_SYMBOL", "SYMBOL_COMPONENT", "VERIFIED_LEXICAL", "LEXICAL_SYMBOL_OWNERSHIP"} <= kinds


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_plans_find_a_file_by_its_import(spark, monkeypatch):
    monkeypatch.setattr(plans.B, "tasks", lambda spark, sf: spark.createDataFrame([(1, "react")], "task_id long, text string"))
    assert {r["kind"] for r in plans._second(spark, SF).collect()} == {"IMPORT_MODULE"}
    assert plans.QUERIES["search_v1"](spark, SF).count() == 20
