"""Queries against their SQL on rows at the edges of their gates, which the given tables have few of."""

from __future__ import annotations

import duckdb

from gleanwork.plans import queries as _registered  # noqa: F401  registers the queries
from gleanwork.plans.registry import ORACLE_SQL, QUERIES


def test_pdf_cascade_judges_the_text_itself(spark, tmp_path):
    """Texts of just under and just at the least lengths, and of just under and at the share of unreadable characters."""
    texts = ["a" * n for n in (0, 147, 148, 149, 150, 151, 298, 299, 300)] + ["é" * n + "a " * 100 for n in (9, 10, 11, 12)] + ["1" * n for n in (297, 298, 299, 300)]
    rows = [(i * 3 + j, t, source) for i, t in enumerate(texts) for j, source in enumerate(("src0", "src9", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r["doc_id"], r["step"]) for r in QUERIES["pdf_cascade"](spark, str(tmp_path)).collect()}
    assert got == set(db.sql(ORACLE_SQL["pdf_cascade"]).fetchall())
    assert {step for _, step in got} == {"markdown", "plain", "pages"}
