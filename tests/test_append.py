"""Appends that count once, killed and repeated jobs among them."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from hindsail.sources import ingest

SCHEMA = "id long, series_id string, attempt_no int"


def test_killed_and_repeated_appends(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    one, two = (spark.createDataFrame([(i, f"s{i % 3}", 1) for i in range(lo, lo + 10)], SCHEMA) for lo in (0, 10))
    plain = DataFrameWriter.parquet

    def killed(self, to, *a, **b):
        if to.endswith("/commits"):
            raise RuntimeError("lost before the commit")
        return plain(self, to, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", killed)
    with pytest.raises(RuntimeError):
        ingest.append_once(one, path, "a")
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    assert ingest.committed(spark, path, SCHEMA).count() == 0  # written, not committed
    assert [ingest.append_once(df, path, b) for df, b in ((one, "a"), (one, "a"), (two, "b"), (two, "b"), (one, "a"))] == [True, False, True, False, False]
    rows = ingest.committed(spark, path, SCHEMA).collect()
    assert sorted(r.id for r in rows) == list(range(20)) and rows[0].series_id.startswith("s")


def test_two_jobs_at_once(spark, tmp_path, monkeypatch):
    """Both saw no commit and both committed: the first counts."""
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    ingest.append_once(df, path, "x")
    real = ingest._commits
    monkeypatch.setattr(ingest, "_commits", lambda s, p: real(s, p).limit(0))
    assert ingest.append_once(df, path, "x")
    monkeypatch.setattr(ingest, "_commits", real)
    assert sorted(r.id for r in ingest.committed(spark, path, SCHEMA).collect()) == [1, 2]
