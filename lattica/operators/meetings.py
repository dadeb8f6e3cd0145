"""Graphs whose links are meetings in places, counted without listing links: a place with k nodes has k * k / 2 of them.

A day's graph is a bit matrix in a task: places by nodes, and from those each node's neighbours as a row of bits. Triangles
come from the places alone where few nodes share two or more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lattica.session import ship

#: Bytes of neighbour rows that are held at once.
HELD = 1 << 28
#: Kinds that share two places, counted once for each two: in all, and at once. Steps from those to those that are never too many.
PAIRS, BLOCK, WALKS = 1 << 25, 1 << 19, 1 << 27


def _rows(own: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the nodes in each place, and where each node's places begin; own is sorted."""
    words, k = (n + 63) // 64, int(place.max()) + 1
    bits = np.zeros((k, words), np.uint64)
    np.bitwise_or.at(bits, (place, own // 64), np.uint64(1) << (own % 64).astype(np.uint64))
    return bits, np.searchsorted(own, np.arange(n + 1))


def _near(bits: np.ndarray, place: np.ndarray, at: np.ndarray, v: int) -> np.ndarray:
    """Whom v meets, without v."""
    row = np.bitwise_or.reduce(bits[place[at[v] : at[v + 1]]], axis=0)
    row[v // 64] &= ~(np.uint64(1) << np.uint64(v % 64))
    return row


def _of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    keys, own = np.unique(rows["key"].to_numpy(), return_inverse=True)
    place = pd.factorize(rows["place"])[0]
    order = np.lexsort((place, own))
    own, place = own[order], place[order]
    return keys, place, *_rows(own, place, len(keys)), len(keys)


def _sizes(rows: pd.DataFrame) -> pd.DataFrame:
    _, place, bits, at, n = _of(rows)
    d = np.array([int(np.bitwise_count(_near(bits, place, at, v)).sum(dtype=np.int64)) for v in range(n)], np.int64)
    if not d.any():
        return pd.DataFrame({"graph_id": [], "n_nodes": [], "n_edges": []})
    return pd.DataFrame({"graph_id": [rows["graph_id"].iloc[0]], "n_nodes": [int((d > 0).sum())], "n_edges": [int(d.sum()) // 2]})


def _ragged(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first, first + 1, ... as often as times says, one after another."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - times), times)


def _by_bits(place: np.ndarray, bits: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice the triangles of each node, and whether it meets anybody: links times the nodes' bits."""
    step = max(1, HELD // (8 * bits.shape[1]))
    twice, linked = np.zeros(n, np.int64), np.zeros(n, bool)
    for s in range(0, n, step):  # blocks of neighbours whose rows are held
        held = np.stack([_near(bits, place, at, u) for u in range(s, min(n, s + step))])
        for v in range(n):
            row = held[v - s] if s <= v < s + len(held) else _near(bits, place, at, v)
            linked[v] |= bool(row.any())
            near = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little")[s : s + len(held)])
            twice[v] += int(np.bitwise_count(held[near] & row).sum(dtype=np.int64))
    return twice, linked


def _by_places(place: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The same without links; None where too many nodes share two places or more.

    Nodes of the same places are one kind, with a weight m. With B as places by kinds, two kinds meet where B'B - E is 1
    and not 0: E holds the places beyond the first that they share, for few pairs. A kind's closed walks of three steps
    come from that sum: twice the triangles, three times the neighbours, and one that stays.
    """
    p = int(place.max()) + 1
    if n * p > 8 * HELD:
        return None
    own = np.zeros((n, -(-p // 8)), np.uint8)
    np.bitwise_or.at(own, (np.repeat(np.arange(n), np.diff(at)), place // 8), np.uint8(1) << (place % 8).astype(np.uint8))
    _, first, kind, m = np.unique(own.view(f"V{own.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    k, each = np.diff(at)[first], len(first)
    at, place = np.concatenate(([0], np.cumsum(k))), place[_ragged(at[first], k)]
    if each * p > HELD // 8 or (k * (k - 1)).sum() > PAIRS:
        return None
    x = np.repeat(np.arange(each), k)
    behind = at[x + 1] - np.arange(len(x)) - 1  # a place is paired with those after it
    two = np.unique(np.repeat(place, behind) * p + place[_ragged(np.arange(len(x)) + 1, behind)], return_inverse=True)[1]
    x = np.repeat(x, behind)
    size = np.bincount(two, minlength=1)
    near = np.bincount(x, size[two], each)
    met = np.bincount(place, np.repeat(m, k))
    if near.sum() > PAIRS or (near * near).sum() > WALKS + (met * met).sum() * n / 512:  # a step costs about eight words of bits
        return None
    with_two, begin = x[np.argsort(two, kind="stable")], np.cumsum(size) - size
    cuts = np.searchsorted(np.cumsum(near), np.arange(BLOCK, near.sum() + BLOCK, BLOCK)).tolist()
    cuts = sorted({0, each, *(min(c + 1, each) for c in cuts)})
    cols, vals, rows = [], [], np.zeros(each, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        t = two[np.searchsorted(x, a) : np.searchsorted(x, b)]
        key, c = np.unique(np.repeat(x[np.searchsorted(x, a) : np.searchsorted(x, b)], size[t]) * each + with_two[_ragged(begin[t], size[t])], return_counts=True)
        rows += np.bincount(key // each, minlength=each)
        cols.append((key % each).astype(np.int32))
        vals.append(((np.sqrt(8.0 * c + 1) - 1) / 2).round().astype(np.int32))  # c pairs of places: this many beyond the first
    col, val, start = np.concatenate(cols), np.concatenate(vals), np.concatenate(([0], np.cumsum(rows)))
    b_t = np.zeros((each, p))
    b_t[np.repeat(np.arange(each), k), place] = 1
    e_b, cross = np.zeros((each, p)), np.zeros(each)  # E, weighted, times B
    for a, b in zip(cuts, cuts[1:]):
        y, w = col[start[a] : start[b]], val[start[a] : start[b]] * m[col[start[a] : start[b]]]
        r = np.repeat(np.arange(b - a), rows[a:b])
        e_b[a:b] = np.bincount(np.repeat(r, k[y]) * p + place[_ragged(at[y], k[y])], np.repeat(w, k[y]), (b - a) * p).reshape(-1, p)
    for a, b in zip(cuts, cuts[1:]):
        y, w = col[start[a] : start[b]].astype(np.int64), val[start[a] : start[b]] * m[col[start[a] : start[b]]]
        r = np.repeat(np.arange(a, b), rows[a:b])
        cross[a:b] = np.bincount(np.repeat(r - a, k[r]), np.repeat(w, k[r]) * e_b.ravel()[np.repeat(y, k[r]) * p + place[_ragged(at[r], k[r])]], b - a)
    shared, around = b_t.T @ (m[:, None] * b_t), b_t.T @ (m[:, None] * e_b)
    walks = ((b_t @ (shared @ shared - around)) * b_t).sum(axis=1) - 2 * ((b_t @ shared) * e_b).sum(axis=1) + 2 * cross + (e_b * e_b).sum(axis=1)
    z, less = np.zeros(each), np.zeros(each)
    for v in np.flatnonzero(rows).tolist():
        y = col[start[v] : start[v + 1]]
        w = val[start[v] : start[v + 1]] * m[y]
        z[y] = w
        some = _ragged(start[y], rows[y])
        walks[v] -= np.dot(np.repeat(w, rows[y]) * val[some], z[col[some]])
        z[y] = 0
        less[v] = w.sum()
    d = (b_t @ (b_t.T @ m) - less - 1).round().astype(np.int64)
    return (walks.round().astype(np.int64) - 3 * d - 1)[kind], (d > 0)[kind]


def _triangles(rows: pd.DataFrame) -> pd.DataFrame:
    _, place, bits, at, n = _of(rows)
    twice, linked = _by_places(place, at, n) or _by_bits(place, bits, at, n)
    node = np.cumsum(linked) - 1  # nodes that meet nobody have no number
    some = twice > 0
    return pd.DataFrame({"graph_id": np.full(int(some.sum()), rows["graph_id"].iloc[0]), "node_id": node[some], "triangles": twice[some] // 2})


def _by_graph(met: DataFrame, work, schema: str) -> DataFrame:
    ship(met.sparkSession)
    n = max(8 * met.sparkSession.sparkContext.defaultParallelism, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(n, "graph_id").groupBy("graph_id").applyInPandas(work, schema)  # stated, so few graphs meet in a task


def sizes(met: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges) of met(graph_id, key, place); nodes that meet nobody do not count."""
    return _by_graph(met, _sizes, "graph_id long, n_nodes long, n_edges long")


def triangles(met: DataFrame) -> DataFrame:
    """(graph_id, node_id, triangles) of nodes that have any; node ids count those with links in the order of key."""
    return _by_graph(met, _triangles, "graph_id long, node_id long, triangles long")
