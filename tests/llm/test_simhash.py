import numpy as np
import pytest
import xxhash
from helpers import ODD, SF, docs_of

from lattica.llm import simhash
from lattica.llm.components import components


def plain_print(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(fold)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget=3):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints(spark):
    texts = [*ODD, "One two three four", "one TWO\tthree\nfour", "one two"]
    got = {r.doc_id: r.fingerprint for r in simhash.op8(docs_of(spark, texts)).collect()}
    assert got == {i: f"{plain_print(t):016x}" for i, t in enumerate(texts)}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.op8(docs).collect()}
    assert got == brute_components(prints)


@pytest.mark.parametrize("max_group", [20_000, 20, 3])
def test_links_of_planted_prints(spark, max_group):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in prints[:8]:  # chains and dense balls
        for _ in range(25):
            prints.append(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 2).tolist())))
        for _ in range(10):
            prints.append(prints[-1] ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3).tolist())))
    prints = list(dict.fromkeys(prints))
    rows = [(simhash._signed(p), i) for i, p in enumerate(prints)]
    found = components(simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), 3, max_group))
    got = {i: i for i in range(len(prints))} | {r.node: r.component for r in found.collect()}
    assert got == brute_components(dict(enumerate(prints)))


def test_trie_matches_all_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64) << np.uint64(20))
    got = simhash.trie_components(fps, np.zeros(len(fps), np.int64), 2, leaf=4, width=50)
    assert got.tolist() == list(brute_components(dict(enumerate(fps.tolist())), 2).values())


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, None), (2, ""), (2, ""), (9, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.op8(docs).collect() if r.doc_id is not None)
    assert got == [(2, 2), (2, 2), (4, 2), (9, 9)]
    assert simhash.op8(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(159, 300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 160), 300]}
