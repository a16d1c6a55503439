"""The history stream against a batch rollup of the same log."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from doclattice import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def test_all_weeks_are_there(spark):
    got = sorted(tuple(r) for r in catalogue.queries()["history_stream"](spark, str(SF)).collect())
    want = duckdb.sql(f"""SELECT CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS date) AS week, event_type,
        CAST(floor(avg(CAST(least(100.0, floor(value)) AS int)) + 0.5) AS int), max(CAST(least(100.0, floor(value)) AS int)), count(*)
        FROM '{SF}/events.parquet' WHERE ts IS NOT NULL GROUP BY 1, 2""").fetchall()
    assert got == sorted(want)
    assert sum(r[4] for r in got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/events.parquet'").fetchall()[0][0]
