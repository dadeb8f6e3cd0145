"""Each stage of the pipeline against a plain computation over its own input, on a whole small table."""

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from helpers import ODD, SF, docs_of
from test_decontaminate import brute
from test_simhash import brute_components, plain_print
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp

from lattica.llm import decontaminate, mixing, toxicity
from lattica.llm.common import table, written


def cleaned(text, items):
    """The text without hit words and what lies between them; None if most of its words are hit."""
    spans = [m.span() for m in decontaminate.WORD.finditer(decontaminate.folded(text))]
    raw = text.encode()
    words = [decontaminate.folded(text)[a:z] for a, z in spans]
    hit, _ = brute(words, items, 10)
    if len(hit) > 0.5 * len(words):
        return None
    out, at = b"", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += raw[at : spans[p][0]]
        at = spans[p][1]
    return (out + raw[at:]).decode()


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    before, frames = {r.doc_id: r for r in docs.collect()}, []
    now = docs
    for i, (_, stage) in enumerate(cp.STAGES):
        now = written(stage(spark, now, SF), f"test-{i}")
        frames.append(now)
        assert i == len(names) - 1 or now.columns == columns
    kept = [{r.doc_id: r for r in f.collect()} for f in frames]
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5}
    assert set(kept[0]) == set(before) - bad
    groups = brute_components({i: plain_print(r.text) for i, r in kept[0].items()})
    assert set(kept[1]) == set(groups.values())
    items = [(r.item_id, [w for w in decontaminate.WORD.findall(decontaminate.folded(r.text))]) for r in table(spark, SF, "benchmark").collect()]
    known = {w for _, ws in items for w in ws}
    for i, r in kept[1].items():
        quick = not re.search(b"", b"") or sum(w in known for w in decontaminate.WORD.findall(decontaminate.folded(r.text))) < 10
        want = r.text if quick else cleaned(r.text, items)
        assert (kept[2][i].text, kept[2][i].n_chars) == (want, len(want)) if want is not None else i not in kept[2]
    rates = {r.doc_id: r.probability for r in mixing.mix(mixing.with_topics(written(mixing.profiled(frames[2]), "test-profile"))).collect()}
    draws = {r.doc_id: r.u for r in frames[2].select("doc_id", mixing.draw().alias("u")).collect()}
    assert set(kept[3]) == {i for i in kept[2] if draws[i] < rates[i]}
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i in sorted(kept[3]):
        ids = [*tok.encode(kept[3][i].text, add_special_tokens=False).ids, 1]
        r = kept[4][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, frames[4].collect()))


def test_stages_take_odd_rows(spark):
    odd = docs_of(spark, [*ODD, *ODD]).selectExpr("if(doc_id = 3, null, doc_id % 9) doc_id", "text", "if(doc_id = 2, null, lang) lang", "if(doc_id = 4, null, source) source", "n_chars")
    for docs in (odd, odd.limit(0)):
        now = docs
        for _, stage in cp.STAGES:
            now = written(stage(spark, now, SF), "test-odd")
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert docs is odd or now.count() == 0


def test_columns_with_the_operators_names_pass_through(spark):
    names = ("score", "predicted", "passages", "held_out", "fp", "component_id", "hit_runs", "item_ids", "topic", "n_tokens", "probability", "kept")
    docs = docs_of(spark, [f"plain words number {i} with more and more of them {i * 7}" for i in range(20)], ", ".join(f"{n} string" for n in names), names)
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-names")
        assert docs.columns[-len(names) :] == list(names) and {tuple(r) for r in docs.select(*names).collect()} == {names}
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


def test_unlike_texts_that_share_an_id_both_stay(spark):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i * i}" for i in range(60))
    rows = [(1, long, "a"), (1, other, "a"), (1, other, "a"), (2, long, "b"), (3, other, "c"), (None, long, "d"), (4, "alone " + other[:200], "e")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in cp.STAGES[1][1](spark, docs, SF).collect())
    assert got == sorted([(0, long), (1, long), (1, other), (4, "alone " + other[:200])])
