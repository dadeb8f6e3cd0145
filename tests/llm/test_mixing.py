import hashlib

import numpy as np
import pytest
from helpers import ODD, SF, docs_of

from lattica.llm import mixing as mx
from lattica.llm.common import written


def ready(docs):
    """docs as mix() takes them."""
    return mx.with_topics(written(mx.profiled(docs), "test-mixing"))


def test_raked_marginals_agree():
    rng = np.random.default_rng(0)
    codes = [c.ravel() for c in np.meshgrid(range(5), range(3), range(4), indexing="ij")]
    tokens = rng.integers(1, 1000, 60).astype(float)
    targets = [rng.dirichlet(np.ones(n) * 5) for n in (5, 3, 4)]
    w = mx.rake(tokens, codes, targets, 200)
    for c, t in zip(codes, targets, strict=True):
        assert np.bincount(c, w) / w.sum() == pytest.approx(t, abs=1e-9)


@pytest.mark.parametrize("keep", [0.05, 0.5, 0.9, 0.999, 1.0])
def test_calibrated_probabilities(keep):
    rng = np.random.default_rng(1)
    tokens, weights = rng.integers(0, 500, 80).astype(float), rng.random(80) * 100 + 1
    weights[tokens == 0] = 0
    p = mx.calibrated(tokens, weights, keep)
    assert ((p >= 0) & (p <= 1)).all() and (tokens * p).sum() == pytest.approx(keep * tokens.sum())
    inside = (p < 1) & (tokens > 0)
    ratio = p[inside] * tokens[inside] / weights[inside]
    assert not inside.any() or ratio == pytest.approx(np.full(inside.sum(), ratio[0]))


def test_both_ways_agree_and_tokens_are_met(spark):
    docs = ready(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).drop("text").cache()
    a, b = ({r.doc_id: r.probability for r in mx.mix(docs, max_cells=n, rounds=2).collect()} for n in (mx.MAX_CELLS, 3))
    assert a == pytest.approx(b, abs=1e-6)
    few = mx.mix(docs)
    stats = few.selectExpr("sum(n_tokens * probability) e", "sum(n_tokens) t", "sum(if(kept, n_tokens, 0)) k").first()
    assert stats.e == pytest.approx(mx.KEEP * stats.t) and stats.k == pytest.approx(stats.e, rel=0.1)


def test_given_targets(spark):
    docs = docs_of(spark, ["alpha beta gamma"] * 400).selectExpr("doc_id", "text", "if(doc_id % 4 = 0, 'a', 'b') source", "lang")
    out = mx.mix(ready(docs), given={"source": {"a": 0.5, "b": 0.5, "absent": 3.0}}, keep=0.4)
    got = {r.source: r.p for r in out.groupBy("source").agg({"probability": "max"}).toDF("source", "p").collect()}
    assert got == pytest.approx({"a": 0.8, "b": 0.8 / 3})


def test_odd_rows(spark):
    docs = docs_of(spark, ODD, "probability string, kept int, topic string, n_tokens string", ("p", 1, "t", "n")).selectExpr("*", "cast(null as string) other")
    docs = docs.selectExpr("if(doc_id = 1, null, doc_id) doc_id", "text", "if(doc_id = 2, null, lang) lang", "if(doc_id = 3, null, source) source", "probability", "kept", "other")
    out = mx.mix(ready(docs)).collect()
    assert len(out) == len(ODD) and all(0 <= r.probability <= 1 and r.kept is not None for r in out)
    assert mx.op7(docs.limit(0)).count() == 0
    assert mx.profile_text("Apple apple, Grape fig") == (4, mx.profile_text("apple grape")[1])


def test_topics_are_those_of_plain_k_means(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.topic for r in mx.op7(docs).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    v = np.array([np.frombuffer(mx.profile_text(r.text)[1], np.int8) for r in rows]).astype(float)
    lang = np.array([r.lang or "" for r in rows])
    for own in set(lang.tolist()):
        v[lang == own] -= np.where(v[lang == own].any(1)[:, None], v[lang == own].sum(0) / (lang == own).sum(), 0)
    v = np.round(v * 127 / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None])
    mean = v.sum(0) / len(v)
    own = {x.tobytes(): hashlib.md5(x.astype(np.int8).tobytes()).hexdigest() for x in v}
    first = np.array([np.frombuffer(x) for x in sorted(own, key=own.get)[: mx.SEEDS]])
    c = mx.seeds(first, mean, mx.TOPICS)
    for _ in range(mx.PASSES):
        to = np.where(v.any(1), ((v - mean) @ c.T).argmax(1), 0)
        sums = np.array([v[to == k].sum(0) - (to == k).sum() * mean for k in range(mx.TOPICS)])
        c = np.where(np.linalg.norm(sums, axis=1)[:, None] > 1e-9, sums / np.maximum(np.linalg.norm(sums, axis=1)[:, None], 1e-9), c)
    to = np.where(v.any(1), ((v - mean) @ c.T).argmax(1), 0)
    assert got == {r.doc_id: f"t{k}" for r, k in zip(rows, to.tolist(), strict=True)} and len(set(got.values())) > 3


def test_a_given_topic_is_used_and_a_null_one_is_not(spark):
    texts = ["alpha words beta gamma", None, "delta epsilon zeta words"] * 4
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "lang", "source", "if(doc_id % 2 = 0, 'given', null) Topic")
    got = {r.doc_id: r.topic for r in mx.op7(docs).collect()}
    assert all((got[i] == "given") == (i % 2 == 0) for i in got) and {got[i] for i in got if i % 2} <= {f"t{k}" for k in range(mx.TOPICS)}


@pytest.mark.parametrize("max_cells", [mx.MAX_CELLS, 1])
def test_null_topics_count_as_empty_ones(spark, max_cells):
    docs = spark.createDataFrame([(0, "s", "en", 700, None), (1, "s", "en", 300, "a"), (2, "s", "en", 500, "")], "doc_id long, source string, lang string, n_tokens long, topic string")
    got = {r.doc_id: r.probability for r in mx.mix(docs, temper={"topic": 0}, keep=0.4, max_cells=max_cells).collect()}
    assert got == pytest.approx({0: 0.25, 1: 1.0, 2: 0.25})


def shares_of(rows, margin, weight):
    out = {}
    for r in rows:
        out[r[margin]] = out.get(r[margin], 0.0) + weight(r)
    return {k: x / sum(out.values()) for k, x in out.items()}


@pytest.mark.parametrize("max_cells", [mx.MAX_CELLS, 1])
def test_marginals_are_met_after_cells_are_full(spark, max_cells):
    # a cell (a, en) of few tokens is full at once: the other cells have to make up for it in both margins
    rows = [("a", "en", 100), ("a", "es", 900), ("b", "en", 900), ("b", "es", 300), ("b", "fr", 800)]
    docs = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, source string, lang string, n_tokens long, topic int")
    given = {"source": {"a": 0.38, "b": 0.62}, "lang": {"en": 0.45, "es": 0.35, "fr": 0.2}}
    got = mx.mix(docs, given=given, rounds=2, keep=0.7, max_cells=max_cells).collect()
    assert sum(r.probability * r.n_tokens for r in got) == pytest.approx(0.7 * 3000, rel=1e-6) and max(r.probability for r in got) == pytest.approx(1)
    for m, want in given.items():
        assert shares_of(got, m, lambda r: r.probability * r.n_tokens) == pytest.approx(want, abs=2e-5)
    assert {r.unmet for r in got} == {""}


@pytest.mark.parametrize("max_cells", [mx.MAX_CELLS, 1])
def test_targets_beyond_the_tokens_are_reported(spark, max_cells):
    docs = spark.createDataFrame([(0, "s", "en", 700, 0), (1, "s", "es", 100, 0), (2, "s", "fr", 200, 0)], "doc_id long, source string, lang string, n_tokens long, topic int")
    with pytest.warns(UserWarning, match="3 targets are not met: lang es 0.1250 of 0.3000"):
        got = {r.lang: r for r in mx.mix(docs, given={"lang": {"en": 0.6, "es": 0.3, "fr": 0.1}}, rounds=2, keep=0.8, max_cells=max_cells).collect()}
    # es is kept whole, en and fr share the other 700 tokens as 6 to 1
    assert [got[k].probability for k in ("en", "es", "fr")] == pytest.approx([6 / 7, 1, 0.5], rel=1e-4)
    assert {r.unmet for r in got.values()} == {"lang"}


def test_op7_reaches_what_can_be_reached(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    own = {r.doc_id: r for r in docs.select("doc_id", "source", "lang").collect()}
    rows = [{**own[r.doc_id].asDict(), **r.asDict()} for r in mx.op7(docs).collect()]
    for m, temper in mx.TEMPER.items():
        tokens = {}
        for r in rows:
            tokens[r[m]] = tokens.get(r[m], 0) + r["n_tokens"]
        total, full = sum(tokens.values()), set()
        while True:  # levels that fall short are whole, the others share the rest
            rest = sum(t**temper for k, t in tokens.items() if k not in full)
            want = {k: t if k in full else (mx.KEEP * total - sum(tokens[f] for f in full)) * t**temper / rest for k, t in tokens.items()}
            if not (more := {k for k in want if want[k] > tokens[k]}):
                break
            full |= more
        got = shares_of(rows, m, lambda r: r["probability"] * r["n_tokens"])
        assert got == pytest.approx({k: x / mx.KEEP / total for k, x in want.items()}, abs=2e-5)
