"""Every query against its SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from strandline import feature_queries, kernel_queries, queries  # noqa: F401

SF = Path("/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)
    return sorted(map(str, ([plain(x) for x in r] for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(queries.QUERIES[name](spark, str(SF)).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_search_finds_planted_passages(spark):
    assert {"query", "sgenome", "pident"} <= set((df := queries.QUERIES["search_hsps"](spark, str(SF))).columns)
    found = df.toPandas()
    assert len(found) and (found.pident >= 70).all() and (found.hsp >= 1).all()
