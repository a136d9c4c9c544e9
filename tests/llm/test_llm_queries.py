"""Queries of the subpackage: those with SQL agree with it, the others run with their columns."""

import pytest
from oracle import connect, same

from marlstone.llm.queries import ORACLES, QUERIES

FOUND = {
    "p1_found": {"case_id", "defect"}, "p2_found": {"duplicate_group_id", "question_id"}, "p3_found": {"source", "record_id", "kind"}, "p4_found": {"rater_id"},
    "p5_found": {"source", "case_id_1", "case_id_2"}, "p6_found": {"source", "id_1", "id_2"}, "p7_found": {"doc_id", "passage_id"}, "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, connect(sf), QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    if name in FOUND:
        assert set(df.columns) == FOUND[name] and df.count() == df.distinct().count()


def test_the_core_does_not_import_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "marlstone"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "marlstone.llm" in p.read_text()]
    assert not users
