"""Every licence name is confirmed in every frame; other lines with the same words are not."""

import os

import pytest

from siltstone.llm import license_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_name_in_every_frame(spark):
    names = [(name, family) for family, x in license_scan.FAMILIES.items() for name in x["names"]]
    lines = [(frame.format(name), family) for name, family in names for frame in license_scan.FRAMES]
    lines += [("// SPDX-License-Identifier: MIT", "MIT"), ("# License: GPLv3", "GPL")]
    alone = {name for name, _ in names if len(license_scan._words(name)) == 1}  # the classifier says `none` to some of them
    scanner = license_scan.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = [(i, text) for i, (text, _) in enumerate(lines)] + [(20_000, "She studied at MIT in the spring"), (20_001, "Released under the Harbour License.")]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert [(text, family, got[i]) for i, (text, family) in enumerate(lines) if got[i] != family and not (text in alone and got[i] is None)] == []
    assert got[20_000] in (None, "unknown") and got[20_001] == "unknown"
