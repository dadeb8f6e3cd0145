"""Queries against their SQL on graphs that are larger, denser or more alike than those of the smallest tables."""

import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lattica.operators import iterative, meetings
from tests.test_queries import plain


def agree(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.table(rows), folder / f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, sql = entry.queries()[name](spark, f"file://{folder}"), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [sql.columns.index(c) for c in columns]
    got = sorted((plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    assert got == sorted((plain([r[i] for i in at]) for r in sql.fetchall()), key=repr)
    return got


@pytest.mark.parametrize("name", ["parse_json_arrays", "parse_pace"])
def test_formats_keep_graphs_of_any_size(spark, tmp_path, name):
    nation = np.array([7] * 2100 + [11] * 3, np.int32)
    supplier = {"s_suppkey": np.arange(2103), "s_nationkey": nation}
    lineitem = {"l_orderkey": np.arange(4000) // 4, "l_suppkey": np.arange(4000) * 37 % 2103}
    assert len(agree(spark, tmp_path, name, supplier=supplier, lineitem=lineitem)) > 2103


@pytest.mark.parametrize("name", ["graph_stats_users", "triangle_count_users"])
def test_places_full_of_users_list_no_pairs(spark, tmp_path, name):
    k = np.arange(900)
    ts = (np.datetime64("2024-01-01T00:00:00", "us") + (k % 4 * 3600 + k % 3 * 86400).astype("timedelta64[s]")).astype("datetime64[us]")
    # a user met by nobody has no number; some events repeat
    events = {"ts": ts, "user_id": np.where(k == 5, -1, k * 7 % 150), "event_type": np.where(k == 5, "alone", np.where(k % 5 > 0, "a", "b"))}
    assert agree(spark, tmp_path, name, events=events)
    plan = entry.queries()[name](spark, f"file://{tmp_path}")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_betweenness_of_a_graph_goes_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(iterative, "SHARE", 500)
    k = np.arange(120)
    part = {"p_partkey": np.arange(40), "p_brand": np.where(np.arange(40) < 34, "Brand#12", "Brand#31")}
    got = agree(spark, tmp_path, "betweenness", part=part, lineitem={"l_orderkey": k // 2, "l_partkey": (k * k * 7 + k * 13) % 36})
    assert len(got) == 40 and len({repr(x) for x in got}) > 20


def test_triangles_come_from_places_as_from_bits(monkeypatch):
    rng = np.random.default_rng(5)
    for n, places, events, block in [(30, 3, 40, 1), (60, 12, 250, 7), (400, 30, 1100, 1 << 19), (9, 9, 70, 3), (1, 1, 1, 1)]:
        monkeypatch.setattr(meetings, "BLOCK", block)
        rows = pd.DataFrame({"graph_id": 1, "key": rng.integers(0, n, events), "place": rng.integers(0, places, events).astype(str)}).drop_duplicates()
        _, place, bits, at, k = meetings._of(rows)
        got, want = meetings._by_places(place, at, k), meetings._by_bits(place, bits, at, k)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        monkeypatch.setattr(meetings, "PAIRS", 0)
        assert events < 2 or meetings._by_places(place, at, k) is None
        monkeypatch.undo()


def test_triangles_of_places_full_of_users_take_no_row_of_bits_a_link():
    k = np.arange(40_000)
    rows = pd.DataFrame({"graph_id": 1, "key": k // 2, "place": np.where(k % 2, k * 7919 % 60, k * 104_729 % 61 + 60)})
    began = time.perf_counter()
    got = meetings._triangles(rows)
    assert time.perf_counter() - began < 20 and len(got) == 20_000
