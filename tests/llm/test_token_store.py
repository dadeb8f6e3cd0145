import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, SF, docs_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import WhitespaceSplit

from lattica.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODDER = [*ODD, "It's 2023! don't <|endoftext|> stop<|startoftext|>it", "ﬁ ΑΣ Σ\tʼn\x85x y\x1cz", "́a é b", "q" * 5000]


def plain(rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, {}
    for doc, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_round_trip(spark, table):
    docs = docs_of(spark, ODDER) if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.op4(docs).collect()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("size", [40, 3000, 300_000])
def test_words_leave_the_cache(monkeypatch, size):
    """The ids are the library's, however often a generation of the word cache ends."""
    monkeypatch.setattr(ts, "CACHE", size)
    rng, encoder = random.Random(7), ts.Encoder(PATH)
    parts = [*"aB zÉß'’.,-<|>1\n\t é", "\u0301", "ﬁ", "İ", "word", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        (ids, ends), = encoder.encode(part, 1)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [[*encoder.whole.encode(x, add_special_tokens=False).ids, 1] for x in part]
    assert (encoder.words.old is not None) == (size < 300_000)


def test_stored_ids_and_shared_chunks(spark):
    text = " ".join(f"word{i} thing" for i in range(4000))
    docs = docs_of(spark, [text, "a start " + text, text, None])
    path = ts.store_path(spark)
    ts.write_store(docs, path, PATH)
    tok = Tokenizer.from_file(PATH)
    got = {r.id: np.frombuffer(r.ids, "<u2").tolist() for r in ts.read_ids(spark, path).collect()}
    assert got == {r.doc_id: [*tok.encode(r.text or "").ids, 1] for r in docs.collect()}
    stored = spark.read.parquet(f"{path}/chunks").selectExpr("sum(length(ids)) n").first().n
    assert stored < 1.3 * 2 * len(got[0])
    recipe = spark.read.parquet(f"{path}/recipes")
    assert all(ts.merkle(list(r.chunks)) == r.root for r in recipe.collect())


def changed(spark, path, part, how):
    how(spark.read.parquet(f"{path}/{part}")).write.parquet(f"{path}/bad")
    ts._delete(spark, f"{path}/{part}")
    spark.read.parquet(f"{path}/bad").write.parquet(f"{path}/{part}")
    return ts.read_store(spark, path).collect()


@pytest.mark.parametrize(
    ("part", "how"),
    [
        ("chunks", lambda x: x.selectExpr("hash", "concat(ids, ids) ids")),
        ("chunks", lambda x: x.limit(2)),
        ("recipes", lambda x: x.filter("id != 1")),
        ("recipes", lambda x: x.union(x.filter("id = 1"))),
        ("recipes", lambda x: x.withColumn("id", F.lit(2) - F.col("id"))),
        ("recipes", lambda x: x.withColumn("at", F.lit(4) - F.col("at"))),
        ("recipes", lambda x: x.limit(0)),
        ("manifest", lambda x: x.limit(0)),
        ("manifest", lambda x: x.withColumn("start", F.col("start") + 1)),
        ("head", lambda x: x.withColumn("n_docs", F.col("n_docs") + 1)),
    ],
)
def test_what_was_changed_is_found(spark, part, how):
    path = ts.store_path(spark)
    ts.write_store(docs_of(spark, ["one two", "three", "four five six"]), path, PATH)
    assert len(ts.read_store(spark, path).collect()) == 3
    with pytest.raises(Exception, match="verify"):
        changed(spark, path, part, how)


def test_another_store_is_not_this_one(spark):
    paths = [ts.store_path(spark), ts.store_path(spark)]
    roots = [ts.write_store(docs_of(spark, texts), p, PATH) for p, texts in zip(paths, (["a"], ["b"]), strict=True)]
    assert ts.read_store(spark, paths[0], roots[0]).count() == 1
    with pytest.raises(ValueError, match="verify"):
        ts.read_store(spark, paths[0], roots[1])


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 3)
    monkeypatch.setattr(ts, "FAN", 2)
    rows = [(i, f"text {i % 7} " * (i % 5)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.op4(docs).collect()}
    assert got == plain(rows)


def test_ids_beyond_16_bits(spark, tmp_path):
    words = {f"w{i}": i for i in range(70_000)}
    tok = Tokenizer(WordLevel(words, unk_token="w0"))
    tok.pre_tokenizer = WhitespaceSplit()
    tok.save(str(tmp_path / "wide.json"))
    rows = [(0, "w1 w69999"), (1, "w65536 w65537\nw5"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = ts.store_path(spark)
    ts.write_store(docs, path, str(tmp_path / "wide.json"))
    assert {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in ts.read_ids(spark, path).collect()} == {0: [1, 69999, 1], 1: [65536, 65537, 5, 1], 2: [1]}
    assert [(r.start, r.n_tokens) for r in ts.read_store(spark, path).orderBy("id").collect()] == [(0, 3), (3, 4), (7, 1)]


def test_encoder_equals_the_library():
    rng, tok = random.Random(5), Tokenizer.from_file(PATH)
    bits = ["a", "B", "the", "tion", "É", "ß", "'s", "'", "don't", "'LL", "12", "3", ",", ".", "-", "<|", "|>", "<|endoftext|>", "é", "e\u0301", "\u0301", "ﬁ", "Σ", "ς", "İ", "\t", "\x85", "\xa0", " ", "  ", "\n", "\x1c", "\u3000", "日本", "🙂", "µ", "ª", "\x00", "_", "`", "Å", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(20_000)]
    encoder = ts.Encoder(PATH)
    encoder.words.size = 3000  # so that generations change
    got = []
    for ids, ends in (x for i in range(0, len(texts), 700) for x in encoder.encode(texts[i : i + 700])):
        got += np.split(ids, ends)[:-1]
    want = tok.encode_batch_fast(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [e.ids for e in want]


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (None, "c d"), (1, None)], "doc_id long, text string")
    got = [tuple(r)[:3] for r in ts.op4(docs).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, 1, 5, 5] and [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]
    assert ts.op4(docs.limit(0)).count() == 0


def test_crc_shift():
    a, b = b"hello", b"x" * 1000
    got = ts.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert got == zlib.crc32(a + b)


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 40000, 60_000).astype("<u2")
    cuts = ts.cut_points(ids)
    moved = [c - 100 for c in ts.cut_points(np.concatenate([np.full(100, 7, "<u2"), ids]))]
    assert cuts[-1] == len(ids) and len(set(cuts) & set(moved)) > 0.9 * len(cuts)
    assert ts.cut_points(np.zeros(30_000, "<u2"))[0] <= ts.LONGEST
