from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_package():
    for p in (ROOT / "docmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "docmill").parts:
            assert not re.search(r"docmill\.llm|from \.llm|import llm", p.read_text()), p


def test_no_local_checkpoints_or_cross_joins():
    for p in (ROOT / "docmill").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", p.read_text()), p


def test_queries_are_registered():
    names = entry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_columns(spark):
    d = "/root/testdata/sf0.001"
    q = entry.queries()
    want = {"p1_found": "chunk_id bigint, start_char bigint, end_char bigint", "p2_found": "id_a string, id_b string", "p3_found": "page_id bigint, line_no bigint", "p4_found": "id string, line_no bigint", "p5_found": "id_a string, id_b string", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint, kind string"}
    for name, columns in want.items():
        df = q[name](spark, d)
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == columns, name
        assert df.count() == df.distinct().count() > 0, name
