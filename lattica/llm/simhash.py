"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints are made distinct first, so copies of one text meet as one row. A pair within the error
budget of k bits agrees wholly on one of k+1 blocks of bits, so each distinct fingerprint is sent to
k+1 keys (block, value). A key with more than max_group fingerprints is split again: among those that
share a block, a pair within k bits agrees on one of k+1 blocks of the remaining bits, and so on until
every group is small or, after four splits, the shared bits leave at most 2^16 values. No pair is lost, no
group is unbounded. Inside a task the sorted fingerprints form a binary trie: pairs of nodes are traversed
together level by level, differing bits add up, and a pair is dropped as soon as it exceeds the budget.
Linked groups leave a task as stars, never as all pairs; components() joins the stars.

Ids are whole numbers. Fingerprints, not ids, are linked: rows that share an id but not their text stay apart.

Defined cases: null or empty text (no words) has fingerprint zero and links like any other; null ids
get a fingerprint but take no part in grouping, their component is null; repeated rows get equal
results; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import map_batches, map_rows, replaced, written
from lattica.llm.components import components

SEED, SPACES = 42, b" \t\n\x0b\x0c\r"
#: A-Z to a-z and every ASCII space to one of them: what bytes.translate needs.
FOLD = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.fromiter((digest(line[a:z], SEED) for a, z in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = 3) -> int:
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("fp", T.LongType())])
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return map_rows(rows, schema, ["__text"], lambda texts: {"fp": [_signed(fingerprint(t, width)) for t in texts]}).withColumnRenamed("__id", id_col)


def marked(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with fp."""
    return map_rows(docs, replaced(docs.schema, T.StructField("fp", T.LongType())), [text_col], lambda texts: {"fp": [_signed(fingerprint(t, width)) for t in texts]})


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def trie_components(fps: np.ndarray, group: np.ndarray, budget: int, leaf: int = 24, width: int = 1 << 18) -> np.ndarray:
    """For rows sorted by (group, fp): the smallest row that each row reaches by links within its group.

    The trie's upper part is the group (it must agree), its lower 64 levels are the bits of fp. Each entry of
    the frontier is a pair of nodes (row ranges) with the differing bits so far. A slice of the frontier
    is worked on at a time, deepest first, which bounds memory whatever the pairs' number.
    """
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > width:
            for i in range(0, len(alo), width):
                stack.append((depth, *(x[i : i + width] for x in (alo, ahi, blo, bhi, err))))
            continue
        work = (ahi - alo) * (bhi - blo)
        done = (work <= leaf) | (depth == 64)
        if done.any():
            sizes = work[done]
            la, lb, wb = alo[done], blo[done], (bhi - blo)[done]
            ends = np.cumsum(sizes)
            for first in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
                k = np.arange(first, min(first + (1 << 20), int(ends[-1])))
                at = np.searchsorted(ends, k, side="right")
                off = k - (ends[at] - sizes[at])
                a, b = la[at] + off // wb[at], lb[at] + off % wb[at]
                ok = a < b
                a, b = a[ok], b[ok]
                near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
                parent = _unite(parent, a[near], b[near])
        go = ~done
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = alo[go], ahi[go], blo[go], bhi[go], err[go]
        if depth not in ones:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = (alo == blo) & (ahi == bhi)
        new = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        new.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*new, strict=True))
        live = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi == bhi) & (ahi - alo == 1))
        if live.any():
            stack.append((depth + 1, alo[live], ahi[live], blo[live], bhi[live], err[live]))
    return _roots(parent)


def _stars(budget: int):
    """Batches sorted by (key, fp), each key whole in its partition, to (u, v) links of ids."""

    def links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        root = trie_components(fp.view(np.uint64), key, budget)
        moved = root != np.arange(len(root))
        if not moved.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # rows before it are of keys that have ended
            if last:
                held.append([x[:last] for x in now])
                if out := links(*(np.concatenate(x) for x in zip(*held, strict=True))):
                    yield out
                held = []
            elif held and held[-1][0][-1] != now[0][-1]:
                if out := links(*(np.concatenate(x) for x in zip(*held, strict=True))):
                    yield out
                held = []
            held.append([x[last:] for x in now])
        if held and (out := links(*(np.concatenate(x) for x in zip(*held, strict=True)))):
            yield out

    return run


def _blocks(free: list[tuple[int, int]], parts: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Ways to fix one of `parts` runs of the free bits: (bits fixed, bits still free); bits are (position, 1)."""
    size, extra, at, out = len(free) // parts, len(free) % parts, 0, []
    for i in range(parts):
        n = size + (i < extra)
        out.append((free[at : at + n], free[:at] + free[at + n :]))
        at += n
    return out


def _bits_key(fp, bits: list[int]):
    """The named bits of fp as a long; neighbouring bits move together."""
    key, i = F.lit(0).cast("long"), 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = F.shiftrightunsigned(fp, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
        key, i = key.bitwiseOR(F.shiftleft(run, i)), j + 1
    return key


def near_links(distinct: DataFrame, budget: int = 3, max_group: int = 20_000) -> DataFrame:
    """(u, v) links that connect all reps of distinct(fp, rep) within budget bits of each other."""
    parts, paths = budget + 1, [([], list(range(64)))]
    run, schema = _stars(budget), "u long, v long"
    level, rest, found = 0, distinct.select("fp", "rep", F.lit(0).alias("path")), []
    while True:
        ways, nxt = [], []
        for p, (fixed, free) in enumerate(paths):
            for bits, left in _blocks(free, parts):
                ways.append((p, len(nxt), fixed + bits))
                nxt.append((fixed + bits, left))
        by_path: dict[int, list] = {}
        for p, q, bits in ways:
            by_path.setdefault(p, []).append(F.struct(F.lit(q).alias("path"), F.xxhash64(F.lit(q), _bits_key(F.col("fp"), sorted(bits))).alias("key")))
        choice = None
        for p, structs in by_path.items():
            arr = F.array(*structs)
            choice = F.when(F.col("path") == p, arr) if choice is None else choice.when(F.col("path") == p, arr)
        keyed = rest.select("fp", "rep", F.explode(choice).alias("k")).select("k.key", "fp", "rep", "k.path")
        free_bits = min(len(left) for _, left in nxt)
        if free_bits > 12 and level < 4:
            sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > max_group)
            hot = written(sizes, "simhash-hot")
            n_hot = hot.count()
        else:
            n_hot = 0
        small = keyed if not n_hot else keyed.join(hot, "key", "left_anti")
        found.append(map_batches(small.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", F.shiftrightunsigned("fp", 1), "fp"), run, schema))
        if not n_hot:
            break
        rest, paths, level = written(keyed.join(hot, "key", "left_semi").select("fp", "rep", "path").distinct(), "simhash-rest"), nxt, level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_group: int = 20_000) -> DataFrame:
    """(id_col, fp, root, component_id) for every row of docs: root is the least fingerprint reachable, component_id the least id."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = written(prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    merged = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), budget, max_group))
    rooted = distinct.join(merged, distinct["fp"] == merged["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    label = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    found, known = prints.join(label, "fp", "left"), F.col(id_col).isNotNull()
    return found.select(id_col, "fp", F.when(known, F.col("root")).alias("root"), F.when(known, F.col("component_id")).alias("component_id"))


def op8(docs: DataFrame) -> DataFrame:
    return near_dups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
