"""Rounds of stars that the classes of near-duplicates take."""

from siltstone.llm import components as stars
from siltstone.llm import near_dedup
from tests.llm.test_dedup import docs, near_rows, plain_classes


def test_classes_are_not_found_from_scratch_again(spark, monkeypatch):
    rounds, star, found = [], stars._star, near_dedup.components
    monkeypatch.setattr(stars, "_star", lambda *a, **b: rounds.__setitem__(-1, rounds[-1] + 1) or star(*a, **b))
    monkeypatch.setattr(near_dedup, "components", lambda links: rounds.append(0) or found(links))
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain_classes(rows)
    assert len(rounds) == 2 and rounds[1] < rounds[0]
