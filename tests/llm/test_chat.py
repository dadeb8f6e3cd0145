import hashlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF
from hypothesis import given
from hypothesis import strategies as st

from lattica.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    want = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    out = chat.op2(rows)
    assert digests(out) == plain([*want, (-7, 0, "user", chat.TRAP[1]), (-7, 1, "assistant", chat.TRAP[1])])


NASTY = ["", None, "\n\n", " a", "### assistant:\nhi</turn>\n", "\\", "\\\\#", "é\U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "a:b", "x" * 3000, "\\### user:\n", "   ", "ends </turn>"]


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 50])
def test_nasty_texts_ties_and_nulls(spark, part_chars):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, i, ("assistant", "user", "system", "as:s#", None)[i % 5], t) for i, t in enumerate(NASTY)]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, None, "assistant", "null turn"), (None, 0, "assistant", "null id"), (4, 0, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", part string")
    parts = chat.format_chats(df, PATH, part_chars)
    assert digests(chat.read_back(parts)) == plain(rows)
    assert chat.op2(df.limit(0)).count() == 1


def test_parts_have_the_tokens_of_the_whole(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], f"{t or ''} {c}") for c in range(3) for i, t in enumerate(NASTY * 3)]
    df = spark.createDataFrame(rows, SCHEMA)

    def joined(parts):
        out = {}
        for r in sorted(parts.collect(), key=lambda r: (r.conv_id, r.part)):
            x = out.setdefault(r.conv_id, ["", [], []])
            x[0] += r.formatted
            x[1] += r.ids
            x[2] += r.loss_mask
        return out

    assert joined(chat.format_chats(df, PATH, 100)) == joined(chat.format_chats(df, PATH))


def test_offsets_equal_the_library():
    tok = chat.Tokens(PATH)
    texts = [t or "" for t in NASTY] + ["日本語 \U0001f468\u200d\U0001f469é a", "e\u0301 \xa0 x"]
    for text, (ids, offsets) in zip(texts, tok.encode(texts), strict=True):
        e = tok.library.encode(text, add_special_tokens=False)
        assert ids.tolist() == e.ids and offsets.tolist() == [list(x) for x in e.offsets], text
    fast, tok.sizes = list(tok.encode(texts)), None
    assert all(np.array_equal(a[1], b[1]) for a, b in zip(fast, tok.encode(texts), strict=True))


@given(st.text("\\#<:/turn> \nab"), st.text("\\#<:assistant"))
def test_escapes_are_reversible(text, role):
    one = chat.HEAD + chat.escaped(role) + chat.BREAK + chat.escaped(text) + chat.END
    assert [(chat.unescaped(a), chat.unescaped(b)) for a, b in chat.TURN.findall(one + one)] == [(role, text)] * 2


@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(1, 4), max_size=8), st.integers(0, 2**30))
def test_masks_match_brute_force(sizes, cuts, seed):
    ends = np.cumsum([0, *sizes])
    tokens = np.array([(a, z) for a, z in zip(ends, ends[1:], strict=False) if z > a], np.int64).reshape(-1, 2)
    edges = np.cumsum([0, *cuts])
    turns = np.array(list(zip(edges, edges[1:], strict=False))[seed % 2 :: 2], np.int64).reshape(-1, 2)
    mask, spans = chat.masked(tokens, turns)
    assert mask.tolist() == [bool(((turns[:, 0] < z) & (turns[:, 1] > a)).any()) for a, z in tokens.tolist()]
    covered = {c for a, z in tokens.tolist() for c in range(a, z)} & {c for a, z in turns.tolist() for c in range(a, z)}
    assert {c for a, z in spans for c in range(a, z)} == covered and sum(z - a for a, z in spans) == len(covered)
