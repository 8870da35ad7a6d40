"""Queries of the subpackage on the test tables, against DuckDB where SQL can express them."""

from __future__ import annotations

import pytest

from parchemin.llm.oracle import ORACLE
from parchemin.llm.queries import QUERIES
from tests import duck

COLUMNS = {
    "p1_found": ["chunk_id"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p3_found": ["query_id", "defect_type"], "p4_found": ["page_id", "line_no"], "p5_found": ["chunk_id", "line_no"], "p6_found": ["record_type", "record_id"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, tables)
    rows = df.collect()
    assert rows or name == "p8_mix"
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)
    if name in ORACLE:
        duck.same(df, duck.connection(tables), ORACLE[name])


def test_core_does_not_import_the_subpackage():
    import pathlib

    import parchemin

    root = pathlib.Path(parchemin.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
