"""Spark plans against their DuckDB SQL twins on the sf0.001 tables, plus non-empty results."""

import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from hearsay.plans import catalog
from hearsay.sources.tables import TABLES

from .conftest import SMOKE

KEYS = sorted(set(catalog.PLANS) - catalog.ROWS_ONLY)
#: Keys without a row on the smallest tables.
EMPTY = {"alerts_dedupe", "anomaly_volume", "notify_candidates", "rolling_anomaly"}


def canon(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        if isinstance(v, (list, tuple)):
            return [norm(x) for x in v]
        if hasattr(v, "asDict"):
            return norm(v.asDict(recursive=True))
        if isinstance(v, dict):
            return {k: norm(x) for k, x in sorted(v.items())}
        return v if isinstance(v, (str, int, bool, type(None))) else str(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(json.dumps([norm(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    df = E.queries()[key](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert canon(df.columns, rows) == canon(dcols, res.fetchall())
    assert rows or key in EMPTY


def test_every_query_has_sql_or_is_rows_only():
    missing = set(catalog.PLANS) - set(E.oracle_sql())
    assert missing == catalog.ROWS_ONLY and set(E.queries()) >= set(catalog.PLANS)


def test_no_event_is_left_out(spark):
    """Every event is a message, with or without a document; what has none is a title-only post."""
    from hearsay.sources import adapter, tables
    log = adapter.landing(spark, SMOKE)
    events, docs = (tables.read(spark, SMOKE, t) for t in ("events", "documents"))
    assert log.select("id").distinct().count() == events.select("event_id").distinct().count()
    bare = log.where("selftext IS NULL").select("id").distinct().count()
    assert bare == events.join(docs.where("text IS NOT NULL"), events.event_id == docs.doc_id, "left_anti").count() > 0


def test_entry_returns_rows(spark):
    assert E.entry(spark).count() > 0
