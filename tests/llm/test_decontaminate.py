import hashlib

from helpers import ODD, SF, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import decontaminate as dc


def brute(words, items, width):
    hit, found = set(), set()
    for item, ws in items:
        m = min(width, len(ws))
        for j in range(len(ws) - m + 1) if ws else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == ws[j : j + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=6), st.text("abcx", max_size=40), st.integers(1, 5))
def test_automaton_matches_brute_force(items, doc, width):
    pairs = [(i, " ".join(t)) for i, t in enumerate(items)]
    runs, found = dc.Automaton(pairs, width).scan([c.encode() for c in doc])
    hit, want = brute(list(doc), [(i, list(t)) for i, t in enumerate(items)], width)
    assert {p for a, z in runs for p in range(a, z)} == hit and found == want
    assert all(x[1] < y[0] for x, y in zip(runs, runs[1:], strict=False))


def test_tables_and_blocks(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {r.doc_id: tuple(r) for r in dc.op5(docs, bench).collect()}
    assert sum(r[5] for r in one.values()) > 0
    blocks = dc.find_hits(docs, bench, block_words=100)
    assert {r.doc_id: (len(r.item_ids), sum(z - a for a, z in r.hit_runs)) for r in blocks.collect()} == {k: (r[3], r[2]) for k, r in one.items()}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, "..."), (None, "a b c"), (5, "Same TEXT here"), (5, "Same TEXT here")], "item_id long, text string")
    docs = docs_of(spark, ODD, "hit_runs string, item_id int", ("h", 3))
    out = {r.doc_id: r for r in dc.op5(docs, bench).collect()}
    assert out[0].n_words == 0 and not out[0].contaminated and out[6].n_hit == 3 and out[6].n_items == 1
    assert out[6].items_sha256 == hashlib.sha256(b"5").hexdigest()
    kept = {r.doc_id: r for r in dc.decontaminate(docs, bench, max_coverage=0.6).collect()}
    assert kept[6].text == " again\nand a line of it" and kept[6].hit_runs == "h" and len(kept) == len(ODD)
    assert dc.decontaminate(docs, bench, max_coverage=0.3).count() == len(ODD) - 2
    assert dc.op5(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.op5(docs.limit(0), bench).count() == 0
