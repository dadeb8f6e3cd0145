"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised items are joined in one automaton; each document streams through it, the longest match
that ends at each word is tracked, and a window of `width` item words (or a whole shorter item) that
occurs is a hit. Items are cut into blocks of at most block_words words (a longer item into overlapping pieces,
which have its windows). One block, as any benchmark of that size is, goes through one pass. Of more blocks
one at a time is on the driver and on the workers: its pass writes the hits of the documents that have any,
its broadcast is destroyed, and the hits of all blocks are joined to the documents by row at the end.
Memory per task is one portion of an Arrow batch and one automaton.

Defined cases: null text has no words; null or empty items have none either and are never found; a
null item_id is left out; item ids of any type stay as they are; repeated rows get equal results; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import ascii_lower, held, map_rows, replaced, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


class Automaton:
    """Suffix automaton of all items; at each state the items whose window ends there."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.ids = width, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        words = [(item, [self.ids.setdefault(w, len(self.ids)) for w in WORD.findall(folded(text))]) for item, text in items]
        words = [(item, ws) for item, ws in words if ws]
        for _, ws in words:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        n = len(self.next)
        #: the state of the suffix of `width` words, for states with matches that long
        self.window = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= width:
                self.window[s] = s if self.length[up] < width else self.window[up]
        self.items: dict[int, set] = {}
        own: dict[int, list] = {}
        for item, ws in words:
            s = 0
            for i, w in enumerate(ws):
                s = self.next[s][w]
                if i + 1 >= width:
                    self.items.setdefault(self.window[s], set()).add(item)
            if len(ws) < width:
                own.setdefault(s, []).append((len(ws), item))
        #: short items that are suffixes of what a state has matched: (words, item)
        self.short = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.short[s] = (*own.get(s, ()), *self.short[self.link[s]])
        self.least = min([width, *(len(ws) for _, ws in words)]) if words else 0

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words as (first, end), and the items found."""
        if not self.least or len(words) < self.least:
            return [], set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        nxt, link, length, window, short, width = self.next, self.link, self.length, self.window, self.short, self.width
        runs: list[tuple[int, int]] = []
        found: set = set()
        seen: set[int] = set()
        for first, end in edge[edge[:, 1] - edge[:, 0] >= self.least].tolist():
            s = n = 0
            for i, w in enumerate(ids[first:end].tolist(), first):
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                s, n = (nxt[s][w], n + 1) if w in nxt[s] else (0, 0)
                reach = 0
                if n >= width:
                    reach = width
                    seen.add(window[s])
                for m, item in short[s]:
                    if m <= n:
                        found.add(item)
                        reach = max(reach, m)
                if reach:
                    a = i + 1 - reach
                    while runs and runs[-1][1] >= a:
                        a = min(a, runs.pop()[0])
                    runs.append((a, i + 1))
        for s in seen:
            found |= self.items[s]
        return runs, found


def _automaton(items: tuple, width: int) -> Automaton:
    return held(("automaton", items, width), lambda: Automaton(list(items), width))


def pieces(text: str, block_words: int, width: int) -> Iterator[tuple[str, int]]:
    """(text, words) of an item: as it is if it has at most block_words, otherwise pieces that share width - 1 words."""
    words = WORD.findall(folded(text))
    if len(words) <= block_words:
        yield text, len(words)
        return
    step = max(block_words - width + 1, 1)
    for i in range(0, len(words) - width + 1, step):
        own = words[i : i + step + width - 1]
        yield b" ".join(own).decode("utf-8", "surrogatepass"), len(own)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, width: int = 10) -> Iterator[tuple]:
    """Tuples of (item, text) of at most block_words words each (or one piece), in item order; never none."""
    block, words, any_yet = [], 0, False
    rows = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).distinct().orderBy(item_col, text_col)
    for item, text in rows.toLocalIterator():
        for piece, n in pieces(text, block_words, width):
            if block and words + n > block_words:
                yield tuple(block)
                block, words, any_yet = [], 0, True
            block.append((item, piece))
            words += n
    if block or not any_yet:
        yield tuple(block)


def hits_of(item: T.DataType) -> list[T.StructField]:
    return [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("item_ids", T.ArrayType(item))]


def _scanner(sent, width: int):
    """texts to their words, runs and items."""

    def scan(texts: list) -> dict[str, list]:
        automaton = _automaton(sent.value, width)
        n_words, runs, items = [], [], []
        for text in texts:
            words = WORD.findall(folded(text))
            got, found = automaton.scan(words)
            n_words.append(len(words))
            runs.append([[int(a), int(z)] for a, z in got])
            items.append(sorted(found))
        return {"n_words": n_words, "hit_runs": runs, "item_ids": items}

    return scan


def merged_runs(runs: list) -> list:
    out: list = []
    for a, z in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _joined(rows: DataFrame, blocks: Iterator[tuple], text_col: str, fields: list[T.StructField], width: int) -> DataFrame:
    """rows with the hits of all blocks: each block's hits are written, and joined at the end."""
    spark = rows.sparkSession
    # the rows are written with their numbers, so every pass sees the same ones
    numbered = written(rows.withColumn("__row", F.monotonically_increasing_id()), "benchmark-rows")
    narrow, schema, hits = numbered.select("__row", F.col(text_col).alias("__text")), T.StructType([T.StructField("__row", T.LongType()), *fields]), None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        found = written(map_rows(narrow, schema, ["__text"], _scanner(sent, width)).filter("size(item_ids) > 0").select("__row", "hit_runs", "item_ids"), "benchmark-hits")
        sent.destroy()
        hits = found if hits is None else hits.union(found)
    # a row has one entry a block at most
    per = hits.groupBy("__row").agg(F.flatten(F.collect_list("hit_runs")).alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    per = map_rows(per, T.StructType([schema["__row"], *fields[1:]]), ["__runs"], lambda runs: {"hit_runs": [merged_runs(r) for r in runs]})
    n_words = F.size(F.filter(F.split(text_of(text_col), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    clean = numbered.drop(*(f.name for f in fields)).withColumn("n_words", n_words).join(per, "__row", "left").drop("__row")
    return clean.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in fields[1:]})


def text_of(column: str):
    return ascii_lower(F.coalesce(F.col(column), F.lit("")))


def _first_blocks(benchmark: DataFrame, item_col: str, item_text: str, width: int, block_words: int) -> tuple[tuple, Iterator[tuple] | None]:
    """The only block, or an iterator over all if there are more."""
    blocks = item_blocks(benchmark, item_col, item_text, block_words, width)
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_words: int = 200_000) -> DataFrame:
    """docs with n_words, hit_runs (word positions [first, end) of merged hits) and item_ids (sorted)."""
    fields = hits_of(benchmark.schema[item_col].dataType)
    only, many = _first_blocks(benchmark, item_col, item_text, width, block_words)
    if many is not None:
        return _joined(docs, many, text_col, fields, width).select(*(f.name for f in replaced(docs.schema, *fields)))
    sent = docs.sparkSession.sparkContext.broadcast(only)
    return map_rows(docs, replaced(docs.schema, *fields), [text_col], _scanner(sent, width))


def cut(text: str | None, runs: list) -> str | None:
    """text without the hit words of each run and what lies between them."""
    if not runs:
        return text
    raw, spans = text.encode("utf-8", "surrogatepass"), [m.span() for m in WORD.finditer(folded(text))]
    parts, at = [], 0
    for a, z in runs:
        parts.append(raw[at : spans[a][0]])
        at = spans[z - 1][1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = 0.5, item_col: str = "item_id", item_text: str = "text", width: int = 10, block_words: int = 200_000) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage of the words are hit go whole.

    With one block the scan also cuts, so texts go through Python once.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text_col).alias("__text"))
    fields = hits_of(benchmark.schema[item_col].dataType)
    only, many = _first_blocks(benchmark, item_col, item_text, width, block_words)
    scan = None if many is not None else _scanner(docs.sparkSession.sparkContext.broadcast(only), width)

    def finish(texts: list, n_words: list | None = None, hit_runs: list | None = None) -> dict[str, list]:
        hits = scan(texts) if scan else {"n_words": n_words, "hit_runs": hit_runs}
        keep = [sum(z - a for a, z in runs) <= n * max_coverage for n, runs in zip(hits["n_words"], hits["hit_runs"], strict=True)]
        return {"__keep": keep, "__text": [cut(t, r) if k else None for t, r, k in zip(texts, hits["hit_runs"], keep, strict=True)]}

    schema = T.StructType([packed.schema["__doc"], packed.schema["__text"], T.StructField("__keep", T.BooleanType())])
    rows, inputs = (packed, ["__text"]) if scan else (_joined(packed, many, "__text", fields, width), ["__text", "n_words", "hit_runs"])
    kept = map_rows(rows, schema, inputs, finish).filter("__keep")
    return kept.select(*(F.col("__text").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
dg AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
found AS (SELECT dg.doc_id, dg.i, dg.m, windows.item_id FROM dg JOIN windows ON dg.k = windows.k AND dg.m = windows.m),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
