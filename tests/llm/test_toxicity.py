import math

import pytest
from helpers import ODD, SF, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import toxicity as tx


def all_maximal(scores):
    """By definition: the best run, then the same on both sides of it."""
    best, at = 1e-9, None
    for a in range(len(scores)):
        run = 0.0
        for z in range(a, len(scores)):
            run += scores[z]
            if run > best + 1e-9:
                best, at = run, (a, z + 1)
    if at is None:
        return []
    left, right = all_maximal(scores[: at[0]]), all_maximal(scores[at[1] :])
    return [*left, (*at, best), *((a + at[1], z + at[1], s) for a, z, s in right)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 40)), max_size=30))
def test_segments_match_their_definition(marks):
    drift = -0.7
    scores = [drift if m is None else m * 0.0917 + 0.01 for m in marks]
    got = tx.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], drift)
    want = all_maximal(scores)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def planted(spark):
    """Toxic texts hold inflected stems; clean ones the same filler."""
    texts, rows = [], []
    for i in range(600):
        bad = i % 5 == 0
        filler = [f"word{(i * 7 + k * k) % 97}" for k in range(60)]
        if bad:
            filler[10:10] = [f"grumbl{('ing', 'ed', 'y')[i % 3]}", "filth"]
        texts.append(" ".join(filler))
        rows.append((i, int(bad)))
    return docs_of(spark, texts), spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy_and_passages(spark):
    docs, labels = planted(spark)
    out = tx.score(docs, tx.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in out if r.held_out) and sum(r.held_out for r in out) > 60
    assert all("grumbl" in r.text[r.passages[0].start : r.passages[0].end] for r in out if r.toxic)


def test_held_out_labels_are_not_used(spark):
    docs, labels = planted(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    assert tx.fit(docs, labels).weights == tx.fit(docs, turned).weights


def test_sample_table(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = tx.op6(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) > 0.9 * len(out)


def test_odd_rows(spark):
    _, labels = planted(spark)
    docs = docs_of(spark, ODD, "score string, passages int", ("s", 1))
    for own in (labels, labels.limit(0), spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")):
        out = tx.score(docs, tx.fit(docs, own)).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in out)
    assert tx.op6(docs.limit(0), labels).count() == 0


def test_more_words_than_the_cache_holds(monkeypatch):
    model = tx.Model(weights={f"bad{i}": 3.0 for i in range(50)})
    monkeypatch.setattr(tx, "SEEN", 7)
    words = [w for i in range(50) for w in (f"bad{i}", f"good{i}")]
    assert len(model.segments(words)) == 1 and len(model.seen) <= 8


def test_copies_of_a_toxic_text_do_not_spread(spark):
    docs, labels = planted(spark)
    words = " ".join(f"harmless{i}" for i in range(40))
    more = [(1000 + i, f"{words} grumbling filth {i}", "en", "src0", 9) for i in range(60)] + [(2000 + i, f"{words} kind words {i}", "en", "src0", 9) for i in range(5)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    labels = labels.union(spark.createDataFrame([(r[0], int(r[0] < 2000)) for r in more], "doc_id long, toxic int"))
    out = {r.doc_id: r.predicted for r in tx.op6(docs, labels).collect()}
    assert all(out[r[0]] == int(r[0] < 2000) for r in more)
