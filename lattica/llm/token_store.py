"""Token ids in a content-addressed store.

Texts are encoded once; a rolling hash over the last ids cuts each document's id stream into chunks
(cuts follow content, so copies and shared passages give equal chunks), each distinct chunk is stored
once under its SHA-256, a recipe lists a document's chunks in order, and Merkle manifests (a root per
document, per block of consecutive documents and for the whole store) verify what is read back.

Layout under the store's path, all Parquet, so any file system that Spark reads will do:
  chunks/    hash (32 bytes), ids (little-endian unsigned; 16 bits each, or 32 when the ids need it)
  recipes/   shard, at, id, n_tokens, chunks (list of hashes), root; shards are ranges of ids, sorted
  manifest/  shard, block, n_docs, n_tokens, start, root: BLOCK consecutive documents of a shard a row
  head/      width of ids in bytes, n_docs, n_tokens, root of the whole store

Defined cases: null or empty text is the end id alone; repeated ids are stored as separate documents
next to each other (ordered by their roots); null ids come first; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import held, map_rows, shared_dir, written

#: Chunks: about `mean` ids (a power of two), at most `longest`; the rolling hash covers `reach` ids.
MEAN, LONGEST, REACH = 512, 8192, 8
#: Entries of a generation of the word cache; words that the library gets in one string.
CACHE, TOGETHER = 300_000, 256
#: Hashes of chunks a task remembers at least.
SEEN = 200_000
#: Characters that are worked on at once.
GROUP = 1 << 21
#: Consecutive documents under one row of the manifest, and rows under one node of its tree.
BLOCK, FAN = 4096, 1024

#: Letters that neither compose nor change length in lower case, and ASCII marks that may follow them (no apostrophe).
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of such letters with such marks after it, for Arrow's expressions.
PLAIN = f"^[{LETTERS}]+[{re.escape(MARKS)}]*$"
CORE = re.compile(f"[{LETTERS}]+").fullmatch
#: Characters beyond Latin-1, within which nothing composes and lower case goes letter by letter.
BEYOND = re.compile("[^\x00-\xff]").search


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Words:
    """Ids of words, by number, in two generations of about size entries; words in use move to the new one."""

    def __init__(self, size: int, kind: np.dtype):
        self.size, self.kind, self.old = size, kind, None
        self._clear()

    def _clear(self) -> None:
        self.known, self.weight = {}, 0
        self.flat, self.starts, self.lengths = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.weight += sum(map(len, words)) + flat.nbytes
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, flat))

    def numbers(self, words: list[str], make) -> np.ndarray:
        """Numbers of distinct words, good until the next call; make gives (all ids, ids of each) of a list of new ones."""
        at = self._found(words)
        gaps = np.flatnonzero(at < 0)
        if len(gaps) and (len(self.known) + len(gaps) > self.size or self.weight > 64 * self.size):
            self.old = (self.known, self.flat, self.starts, self.lengths)
            self._clear()
            gaps = np.arange(len(words))
        if not len(gaps):
            return at
        new = [words[i] for i in gaps.tolist()]
        if self.old:
            known, flat, starts, lengths = self.old
            was = np.fromiter(map(known.get, new, repeat(-1)), np.int64, len(new))
            if len(kept := np.flatnonzero(was >= 0)):
                own = was[kept]
                self._add([new[i] for i in kept.tolist()], gathered(flat, starts[own], lengths[own]), lengths[own])
                new = [new[i] for i in np.flatnonzero(was < 0).tolist()]
        if new:
            self._add(new, *make(new))
        at[gaps] = self._found([words[i] for i in gaps.tolist()])
        return at

    def _found(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))


class Encoder:
    """A tokenizer of the library with a word cache of bounded size.

    Its pieces never span a space or a line feed, so what stands between those is a word. The words of
    many texts are told apart with Arrow's dictionary encoding; the library encodes each distinct one once and
    NumPy lays the ids out. If the tokenizer is of the known kind, a plain word's letters are one piece
    and the marks after it others; letters in lower case go to the same model without the normaliser and the
    splitting pattern, which would leave them as they are, many words in one string: the model closes each
    with a piece that has the suffix for ends of words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.bare = Words(CACHE, self.kind), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and "[\\p{L}]+" in splits[0]["pattern"]["Regex"]
        if known and (suffix := spec["model"].get("end_of_word_suffix")):
            spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, splits[1]]}}))
            self.closes = np.zeros(self.whole.get_vocab_size() + 1, bool)
            self.closes[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True

    def _made(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of new words, cores first in new's order, and how many each has."""
        kept = [self.bare is not None and CORE(w) is not None for w in new]
        cores, is_core = list(compress(new, kept)), np.array(kept, bool)
        out, sizes = np.zeros(0, self.kind), np.zeros(len(new), np.int64)
        groups = [" ".join(cores[i : i + TOGETHER]) for i in range(0, len(cores), TOGETHER)]
        first = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(groups, add_special_tokens=False)), self.kind) if cores else out
        ends = np.flatnonzero(self.closes[first]) + 1 if cores else np.zeros(0, np.int64)
        if len(ends) != len(cores):
            raise ValueError("the tokenizer does not close each word once")
        sizes[is_core] = np.diff(ends, prepend=0)
        others = [w for w, c in zip(new, is_core.tolist(), strict=True) if not c]
        own = [e.ids for e in self.whole.encode_batch_fast(others, add_special_tokens=False)] if others else []
        sizes[~is_core] = [len(x) for x in own]
        rest = np.fromiter(chain.from_iterable(own), self.kind)
        starts = np.zeros(len(new), np.int64)
        starts[is_core] = ends - sizes[is_core]
        starts[~is_core] = len(first) + np.cumsum(sizes[~is_core]) - sizes[~is_core]
        return gathered(np.concatenate((first, rest)), starts, sizes), sizes

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of distinct words."""
        plain = pc.match_substring_regex(words, PLAIN) if self.bare is not None else pa.array([False] * len(words), pa.bool_())
        own = words.filter(plain)
        cores = pc.utf8_lower(pc.utf8_rtrim(own, MARKS)).dictionary_encode()
        marks = pa.concat_arrays([pc.utf8_ltrim(own, LETTERS), words.filter(pc.invert(plain)), pa.array([""], words.type)]).dictionary_encode()
        n = len(cores.dictionary)
        numbers = self.words.numbers([*cores.dictionary.to_numpy(zero_copy_only=False).tolist(), *marks.dictionary.to_numpy(zero_copy_only=False).tolist()], self._made)
        mark = numbers[n:][marks.indices.to_numpy()]
        plain = plain.to_numpy(zero_copy_only=False)
        both = np.full((len(words), 2), mark[-1])
        both[plain, 0] = numbers[:n][cores.indices.to_numpy()]
        both[plain, 1] = mark[: len(own)]
        both[~plain, 1] = mark[len(own) : -1]
        sizes = self.words.lengths[both]
        return gathered(self.words.flat, self.words.starts[both].ravel(), sizes.ravel()), sizes.sum(1)

    def encode(self, texts: list, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of about GROUP characters: all ids of the group's texts, with end_id after each, and each text's end."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if self.bare is not None and "<|" not in text and not BEYOND(text):
                text = text.lower()  # as the tokenizer will; fewer words to look up
            group.append(text.replace("\n", " "))
            size += len(text)
            if size >= GROUP:
                yield self._group(group, end_id)
                group, size = [], 0
        if group:
            yield self._group(group, end_id)

    def _group(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        flat, sizes = self._distinct(coded.dictionary)
        starts, bounds = np.cumsum(sizes) - sizes, split.offsets.to_numpy()
        codes = coded.indices.to_numpy()
        if end_id is not None:  # one more word, at the end of every text
            codes = np.insert(codes, bounds[1:], len(sizes))
            flat, starts, sizes = np.append(flat, np.array([end_id], self.kind)), np.append(starts, len(flat)), np.append(sizes, 1)
            bounds = bounds + np.arange(len(bounds))
        own = sizes[codes]
        return gathered(flat, starts[codes], own), np.cumsum(own)[bounds[1:] - 1]


def _encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def encode(text: str | None, path: str) -> bytes:
    """The ids of text, little-endian."""
    return next(_encoder(path).encode([text]))[0].tobytes()


@lru_cache(maxsize=1)
def _gear(size: int) -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each id."""
    x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of chunks wherever the hash of the last REACH ids says so; streams may follow each other in ids."""
    gear = _gear(1 << 16)[ids & 0xFFFF]
    roll = gear.copy()
    for j in range(1, min(REACH, len(ids))):
        roll[j:] += gear[: len(ids) - j] << np.uint32(j)
    return np.flatnonzero((roll >> np.uint32(REACH - 1)) & np.uint32(mean - 1) == 0) + 1


def ends_of(found: np.ndarray, start: int, end: int, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of one stream within ids: none before REACH ids, none longer than longest."""
    out, last = [], start
    for c in [*found[np.searchsorted(found, start + REACH) : np.searchsorted(found, end)].tolist(), end]:
        while c - last > longest:
            last += longest
            out.append(last)
        out.append(c)
        last = c
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream."""
    return ends_of(cuts(ids), 0, len(ids))


def merkle(hashes: list[bytes]) -> bytes:
    """Root over pairs; leaves and nodes are told apart, an odd one moves up."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _chunked(path: str, end_id: int):
    seen: set[bytes] = set()  # chunks that this task has given out, or the last of them

    def run(texts: list) -> dict[str, list]:
        n_tokens, hashes, fresh, roots = [], [], [], []
        if len(seen) > SEEN:
            seen.clear()
        for ids, ends in _encoder(path).encode(texts, end_id):
            found, size, at, raw = cuts(ids), ids.itemsize, 0, memoryview(np.ascontiguousarray(ids)).cast("B")
            for end in ends.tolist():
                own, new, first = [], [], at
                for cut in ends_of(found, first, end):
                    part = raw[at * size : cut * size]
                    own.append(h := hashlib.sha256(part).digest())
                    if h not in seen:
                        seen.add(h)
                        new.append({"hash": h, "ids": bytes(part)})
                    at = cut
                n_tokens.append(end - first)
                hashes.append(own)
                fresh.append(new)
                roots.append(merkle(own))
        return {"n_tokens": n_tokens, "chunks": hashes, "fresh": fresh, "root": roots}

    return run


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _joined(at: str, value) -> Column:
    """The SHA-256 of a bounded group's hex hashes, in order of at."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(at, value.alias("h")))), lambda x: x["h"])), 256)


def _blocks(recipes: DataFrame) -> DataFrame:
    """(shard, block, n_docs, n_tokens, root) from recipes: the hash over ids, counts and roots of BLOCK documents at most."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("\0")), "n_tokens", F.hex("root")), 256)
    return recipes.groupBy("shard", F.floor((F.col("at") - 1) / BLOCK).cast("int").alias("block")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _joined("at", leaf).alias("root"))


def _root(rows: DataFrame) -> tuple[int, int, str]:
    """(documents, tokens, root) of the manifest's rows: a tree of FAN children a node, of as many rounds as it takes."""
    # within shards first, then over the shards, which are as many as the partitions
    own = rows.select("shard", "block", "n_docs", "n_tokens", F.sha2(F.concat_ws(":", "shard", "block", "n_docs", "n_tokens", "start", "root"), 256).alias("root"))
    for column in ("block", "shard"):
        top = own.agg(F.max(column)).first()[0] or 0
        while True:
            keys = {"shard": F.col("shard"), "block": F.floor(F.col("block") / FAN)} if column == "block" else {"shard": F.floor(F.col("shard") / FAN), "block": F.col("block")}
            own = own.groupBy(*(v.cast("int").alias("next_" + k) for k, v in keys.items())).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _joined(column, F.col("root")).alias("root")).withColumnsRenamed({"next_shard": "shard", "next_block": "block"})
            top //= FAN
            if not top:
                break
    found = own.select("n_docs", "n_tokens", "root").collect()
    return tuple(found[0]) if found else (0, 0, hashlib.sha256(b"").hexdigest())


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> str:
    """Write the store; its root, by which a reader can tell that the whole of it is meant."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType()), T.StructField("fresh", T.ArrayType(T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("ids", T.BinaryType())])))])
    staged = f"{path}/staging"
    map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, ["text"], _chunked(tokenizer, end_id)).write.option("compression", "zstd").parquet(staged)
    stage = spark.read.schema(schema).parquet(staged)
    stage.select(F.inline("fresh")).dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = stage.select("id", "n_tokens", "chunks", "root").repartitionByRange(F.col("id").asc(), F.col("root").asc())
    within = W.partitionBy("shard").orderBy(F.col("id").asc_nulls_first(), "root")
    recipes.withColumn("shard", F.spark_partition_id()).withColumn("at", F.row_number().over(within)).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _delete(spark, staged)
    blocks = written(_blocks(spark.read.parquet(f"{path}/recipes")), "token-blocks")
    # a window over the shards, which are as many as the partitions, and one over a shard's blocks
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("all")).select("shard", F.coalesce(F.sum("all").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    earlier = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks.join(shards, "shard").withColumn("start", (F.col("before") + earlier).cast("long")).select(*MANIFEST).write.parquet(f"{path}/manifest")
    n_docs, n_tokens, root = _root(spark.read.parquet(f"{path}/manifest"))
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    spark.createDataFrame([(width, n_docs, n_tokens, root)], HEAD).coalesce(1).write.parquet(f"{path}/head")
    return root


MANIFEST = ("shard", "block", "n_docs", "n_tokens", "start", "root")
HEAD = "width int, n_docs long, n_tokens long, root string"


def checked(spark: SparkSession, path: str, root: str | None = None) -> tuple[DataFrame, int]:
    """The manifest and the width of ids, once manifest and recipes agree with the store's root (root, if given); ValueError if not.

    Recipes that were deleted, added, moved or changed, and rows of the manifest likewise, are found here;
    chunks are verified where they are read.
    """
    manifest, head = spark.read.parquet(f"{path}/manifest"), spark.read.schema(HEAD).parquet(f"{path}/head").collect()
    if len(head) != 1 or _root(manifest) != (head[0].n_docs, head[0].n_tokens, head[0].root) or root not in (None, head[0].root):
        raise ValueError("the store's manifest does not verify")
    found = _blocks(spark.read.parquet(f"{path}/recipes")).select("shard", "block", *(F.col(c).alias(f"own_{c}") for c in ("n_docs", "n_tokens", "root")))
    same = F.lit(True)
    for c in ("n_docs", "n_tokens", "root"):
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    if not manifest.join(found, ["shard", "block"], "full").filter(~same).isEmpty():
        raise ValueError("the store's recipes do not verify")
    return manifest, head[0].width


POLY = 0xEDB88320


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """Products modulo the CRC's polynomial (bit 31 is x^0)."""
    out, a, m = np.zeros_like(a), a.copy(), 1 << 31
    while m:
        if b & m:
            out ^= a
        a = np.where(a & 1, (a >> 1) ^ POLY, a >> 1)
        m >>= 1
    return out


@lru_cache(maxsize=64)
def _byte_power(k: int) -> int:
    """x^(8 * 2^k)"""
    p = np.array([1 << 23], np.int64)
    for _ in range(k):
        p = _times(p, int(p[0]))
    return int(p[0])


def crc_shift(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC-32 becomes when so many bytes follow."""
    out, k = crcs.astype(np.int64), 0
    while (zeros >> k).any():
        on = np.flatnonzero((zeros >> k) & 1)
        out[on] = _times(out[on], _byte_power(k))
        k += 1
    return out


def _chunk_digests(width: int):
    def run(hashes: list, ids: list) -> dict[str, list]:
        crcs, counts, sound = [], [], []
        for h, raw in zip(hashes, ids, strict=True):
            x = np.frombuffer(raw, f"<u{width}")
            crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
            counts.append(len(x))
            sound.append(hashlib.sha256(raw).digest() == h)
        return {"crc": crcs, "n": counts, "sound": sound}

    return run


def _document_digests(chunks: list, roots: list, parts: list) -> dict[str, list]:
    """CRC of a document from its chunks' (at, crc, n), in order; the recipe must match its root and every chunk must be there."""
    per, good = [sorted(p or []) for p in parts], []
    for own, p, root in zip(chunks, per, roots, strict=True):
        good.append(len(own) == len(p) and all(x[3] for x in p) and merkle(own) == root)
    if not per:
        return {"ids_crc32": [], "read_tokens": [], "verified": []}
    sizes = np.array([len(p) for p in per])
    flat = [x for p in per for x in p]
    crcs, counts = np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat], np.int64)
    ends = np.cumsum(counts)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    last = np.concatenate(([0], ends))[bounds[1:]]
    moved = crc_shift(crcs, (np.repeat(last, sizes) - ends) * 4)
    acc = np.concatenate(([0], np.bitwise_xor.accumulate(moved))) if len(moved) else np.zeros(1, np.int64)
    total = np.concatenate(([0], ends))
    return {"ids_crc32": (acc[bounds[1:]] ^ acc[bounds[:-1]]).tolist(), "read_tokens": (total[bounds[1:]] - total[bounds[:-1]]).tolist(), "verified": good}


def read_store(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, computed from the stored bytes.

    Every chunk is read and hashed once; CRCs of chunks are joined to the recipes and combined, so ids
    of chunks that many documents share are not copied. Manifest and recipes are verified first; a chunk or
    document that doesn't verify fails the query that reads it.
    """
    manifest, width = checked(spark, path, root)
    chunks = map_rows(spark.read.parquet(f"{path}/chunks"), T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("crc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sound", T.BooleanType())]), ["hash", "ids"], _chunk_digests(width))
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = manifest.select("shard", "block", F.col("start").alias("block_start"))
    parts = recipes.select("shard", "at", F.posexplode("chunks").alias("pos", "hash")).join(chunks, "hash").groupBy("shard", "at").agg(F.collect_list(F.struct("pos", "crc", "n", "sound")).alias("parts"))
    whole = recipes.join(parts, ["shard", "at"], "left")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("at", T.IntegerType()), recipes.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("read_tokens", T.LongType()), T.StructField("verified", T.BooleanType())])
    tuples = whole.withColumn("parts", F.transform("parts", lambda x: F.array(x["pos"].cast("long"), x["crc"], x["n"], x["sound"].cast("long"))))
    read = map_rows(tuples, schema, ["chunks", "root", "parts"], _document_digests)
    sound = F.when(F.col("verified") & (F.col("read_tokens") == F.col("n_tokens")), F.col("read_tokens")).otherwise(F.raise_error(F.lit("a document does not verify")).cast("long"))
    read = read.withColumn("block", F.floor((F.col("at") - 1) / BLOCK).cast("int"))
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = read.select("shard", "block", "id", "ids_crc32", before.alias("own"), sound.alias("n_tokens"))
    return placed.join(manifest, ["shard", "block"], "left").select("id", (F.col("own") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, ids): the documents' id streams as bytes, for readers that want the ids themselves; the manifest is verified."""
    checked(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("shard", "at", "id", F.posexplode("chunks").alias("pos", "hash")).join(chunks, "hash")
    whole = parts.groupBy("shard", "at", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return whole.select("id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def store_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica/token-store-{uuid.uuid4().hex}"


def op4(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = store_path(spark)
    root = write_store(docs, path, tokenizer)
    return read_store(spark, path, root).withColumnRenamed("id", "doc_id")
