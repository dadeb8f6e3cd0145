import hashlib

from helpers import ODD, SF, docs_of

from lattica.llm import line_dedup


def brute(rows):
    blanks = line_dedup.BLANKS
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keep = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(blanks).translate(fold)
            if len(key) >= 10:
                keep.setdefault(key, set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders := keep.get(x.strip(blanks).translate(fold), {doc})) < 2 or min(holders) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r[1:4]) for r in line_dedup.op1(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_clashing_columns(spark):
    texts = [*ODD, "A Line Of Ten\nb", "  a line of ten\t\nc", "Ä LINE OF TEN"]
    docs = docs_of(spark, texts, "n_lines string, pos int, key string, line string", ("q", 7, "k", "l"))
    out = line_dedup.dedup_lines(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()}
    assert got == brute(list(enumerate(texts)))
    assert {(r.pos, r.key, r.line) for r in out.collect()} == {(7, "k", "l")}
    assert got[len(ODD) + 1][1] == 1 and got[len(ODD) + 2][1] == 0


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a shared line\nx"), (1, "a shared line\ny"), (1, "z\na shared line"), (2, "w\na shared line"), (2, "w\na shared line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(-1, "a shared line\nx", 0), (1, "a shared line\ny", 0), (1, "z\na shared line", 0), (2, "w", 1), (2, "w", 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_more_than_two_documents(spark):
    docs = docs_of(spark, ["a shared line", "a shared line", "a shared line", "another line here", "another line here"])
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
