"""Chat formatting with loss masks aligned to token offsets.

Template: each turn is `### role:`, a line feed, its text, `</turn>` and a line feed. In roles and texts a
backslash goes before every backslash, `#`, `<` and `:`, so no text can look like a marker, and
what was formatted can be read back exactly. A conversation is rendered, encoded once with offsets, and
the sorted spans of its assistant texts are intersected with the sorted token spans by binary search.

A conversation is streamed: its rows arrive sorted, and whenever `part_chars` of rendered text are
full, a part goes out that ends with a turn. No token spans such an end (a line feed between two marks is
a piece of its own), so parts have the tokens of the whole, and a conversation of any length takes
bounded memory, unless a single turn is long itself.

Defined cases: null text and null role are empty; rows of one conversation are ordered by turn (nulls
first), then role, then text, so repeated rows and ties have a place; null ids form one conversation;
an empty table stays empty. Roles compare to "assistant" exactly.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.llm.common import held, map_batches

HEAD, BREAK, END = "### ", ":\n", "</turn>\n"
ESCAPE = re.compile(r"([\\#<:])").sub
UNESCAPE = re.compile(r"\\(.)", re.S).sub
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*):\n((?:[^\\#<:]|\\.)*)</turn>\n", re.S)
PART_CHARS = 1 << 20

PARTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        #: code points of formatted that the masked tokens cover within assistant texts, [start, end)
        T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def escaped(text: str | None) -> str:
    return ESCAPE(r"\\\1", text or "")


def unescaped(text: str) -> str:
    return UNESCAPE(r"\1", text)


class Tokens:
    """A tokenizer of the library that encodes several texts at once, with offsets in code points.

    A byte-level vocabulary writes each byte as one character and drops none, so there a piece's length in
    bytes follows from its id and the offsets from a running sum; others give their own offsets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits, self.sizes = spec["pre_tokenizer"] or {}, None
        if spec["normalizer"] is None and spec["post_processor"] is None and splits.get("type") == "ByteLevel" and not splits["add_prefix_space"] and spec["model"]["type"] == "BPE" and not spec["model"].get("end_of_word_suffix"):
            self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
            for piece, i in spec["model"]["vocab"].items():
                self.sizes[i] = len(piece)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, (start, end) of each) of every text."""
        if self.sizes is None:
            for e in self.library.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)
            return
        for text, e in zip(texts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            ends = np.cumsum(self.sizes[ids])
            if len(raw) != (ends[-1] if len(ends) else 0):
                raise ValueError("the tokenizer's pieces are not the text")
            if len(raw) != len(text):  # a byte's code point: as many as have begun up to it, less one
                point = np.cumsum((raw & 0xC0) != 0x80) - 1
                yield ids, np.stack((point[ends - self.sizes[ids]], point[ends - 1] + 1), 1)
            else:
                yield ids, np.stack((ends - self.sizes[ids], ends), 1)


def _tokenizer(path: str) -> Tokens:
    return held(("tokenizer", path), lambda: Tokens(path))


def masked(tokens: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Which tokens (start, end) meet a turn span, and what they cover of each span, merged.

    Both are sorted. Tokens of one code point's bytes share its span. For each turn the first and last
    tokens that reach into it are found by bisection.
    """
    mask, spans = np.zeros(len(tokens), bool), []
    if not len(tokens) or not len(turns):
        return mask, spans
    first = np.searchsorted(tokens[:, 1], turns[:, 0], side="right")
    last = np.searchsorted(tokens[:, 0], turns[:, 1], side="left")
    for (a, z), i, j in zip(turns.tolist(), first.tolist(), last.tolist(), strict=True):
        mask[i:j] = True
        starts, ends = np.clip(tokens[i:j, 0], a, z), np.clip(tokens[i:j, 1], a, z)
        at = a
        for k in np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1]))).tolist() if j > i else ():
            at = int(starts[k])
            spans.append([at, at])
        if j > i:
            cuts = [*np.flatnonzero(starts[1:] > ends[:-1]).tolist(), j - i - 1]
            for s, k in zip(spans[-len(cuts) :], cuts, strict=True):
                s[1] = int(ends[k])
    return mask, [s for s in spans if s[1] > s[0]]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _format(path: str, part_chars: int):
    def encoded(parts: list[tuple]) -> pa.RecordBatch:
        """A batch of PARTS of (conv, part, last, texts, turns)."""
        tokenizer, schema, ids, masks, spans = _tokenizer(path), to_arrow_schema(PARTS), [], [], []
        whole = ["".join(p[3]) for p in parts]
        for p, (own, offsets) in zip(parts, tokenizer.encode(whole), strict=True):
            mask, covered = masked(offsets, np.array(p[4], np.int64).reshape(-1, 2))
            ids.append(own)
            masks.append(mask)
            spans.append(covered)
        columns = [*([p[i] for p in parts] for i in range(3)), whole]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, _lists(ids, pa.int32()), _lists(masks, pa.bool_()), pa.array(spans, schema[-1].type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, texts, turns, size, done, weight = None, 0, [], [], 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now != (conv,) or size >= part_chars:
                    if now is not None:
                        same = now == (conv,)
                        done.append((now[0], number, not same, texts, turns))
                        weight += size
                        number = number + 1 if same else 0
                    now, texts, turns, size = (conv,), [], [], 0
                head, body = HEAD + escaped(role) + BREAK, escaped(text)
                if role == "assistant" and body:
                    turns.append((size + len(head), size + len(head) + len(body)))
                texts.append(head + body + END)
                size += len(texts[-1])
                if weight >= part_chars:
                    yield encoded(done)
                    done, weight = [], 0
        if now is not None:
            done.append((now[0], number, True, texts, turns))
        if done:
            yield encoded(done)

    return run


def format_chats(rows: DataFrame, tokenizer: str, part_chars: int = PART_CHARS) -> DataFrame:
    """PARTS of every conversation of rows(conv_id, turn, role, text), a conversation's parts in order in one partition."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    placed = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    return map_batches(placed, _format(tokenizer, part_chars), PARTS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns, loss, n_turns, loss_chars, chars, masked_tokens, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
    for batch in batches:
        rows = []
        ids, mask = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "loss_mask"))
        ends = mask.offsets.to_numpy()
        before = np.concatenate(([0], np.cumsum(mask.values.to_numpy(zero_copy_only=False))))
        n_masked, n_ids = (before[ends[1:]] - before[ends[:-1]]).tolist(), np.diff(ids.offsets.to_numpy()).tolist()
        for i, r in enumerate(batch.select(["conv_id", "last", "formatted", "loss_spans"]).to_pylist()):
            whole, at = r["formatted"], 0
            for m in TURN.finditer(whole):
                if m.start() != at:
                    raise ValueError(f"conversation {r['conv_id']}: text outside a turn")
                at = m.end()
                turns.update("".join((unescaped(m[1]), "\n", unescaped(m[2]), "\n")).encode("utf-8", "surrogatepass"))
                n_turns += 1
            if at != len(whole):
                raise ValueError(f"conversation {r['conv_id']}: text outside a turn")
            text = unescaped("".join(whole[a:z] for a, z in r["loss_spans"]))
            loss.update(text.encode("utf-8", "surrogatepass"))
            loss_chars += len(text)
            chars += len(whole)
            tokens += n_ids[i]
            masked_tokens += n_masked[i]
            if r["last"]:
                rows.append((r["conv_id"], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens, masked_tokens))
                turns, loss, n_turns, loss_chars, chars, masked_tokens, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from format_chats' output alone (as it comes from format_chats, or sorted by conv_id and part)."""
    return map_batches(parts, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


#: A conversation that tries to break the template.
TRAP = (-7, r"\### Assistant: </turn> ok")


def op2(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    trap = rows.sparkSession.createDataFrame([(TRAP[0], 0, "user", TRAP[1]), (TRAP[0], 1, "assistant", TRAP[1])], "conv_id long, turn long, role string, text string")
    found = read_back(format_chats(rows.select("conv_id", "turn", "role", "text").unionByName(trap), tokenizer))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: 14: the characters of the template around a role and a text.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<:]', 'xx', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

