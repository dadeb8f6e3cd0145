from collections import Counter

import public_tokenizers
from helpers import ODD, SF, docs_of
from tokenizers import Tokenizer

from lattica.llm import token_counts as tc


def brute(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)


def check(docs):
    sizes = brute([r.text for r in docs.collect()])
    counts, rows = Counter(sizes), tc.op10(docs).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == counts
    for r in rows:
        n = r.n_tokens
        assert (r.docs_at_least, r.tokens_at_least) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(sizes), sum(sizes), sum(min(s, n) for s in sizes))
        assert abs(r.share_at_most - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    return sizes


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows_limits_and_quantiles(spark):
    docs = docs_of(spark, [*ODD, "<|endoftext|>", "word " * 700, "^" * 20_000, " " * 20_000], "n_tokens string", ("x",))
    sizes = check(docs)
    rows = tc.op10(docs).cache()
    limits = [0, 1, 3, 500, 10**6]
    assert {r.context: r.truncated_total for r in tc.at_limits(rows, limits).collect()} == {x: sum(min(s, x) for s in sizes) for x in limits}
    assert tc.quantile(rows, 0.5).first().n_tokens == sizes[(len(sizes) + 1) // 2 - 1]
    assert tc.op10(docs.limit(0)).count() == 0
