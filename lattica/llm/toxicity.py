"""Toxicity by maximum-scoring segments over token log-odds.

Fit: on at most about fit_rows labelled rows (a documented bound; taken by a hash of the id, none of the
held-out ones, one row of near copies) count, for words and word stems (prefixes of 4 to 6 letters, so that inflected and
compounded words count together), the toxic and the clean documents that have them. A feature's weight
is its log-odds under a Dirichlet prior; features that chance alone would throw up among so many
are left out. Score: each word weighs the most of its features, or `drift` (below zero); one
linear scan finds every maximal segment (Ruzzo and Tompa). A segment's score is held against the
extreme-value law for texts of that length: lambda solves sum p e^(lambda s) = 1 over clean words,
E = n e^(-lambda s) is the number of such segments that a clean text would show. The evidence of
all significant segments goes through a logistic curve fitted on labelled rows that the weights
have not seen. Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have no segments and get the curve's value there; labels that are
null, or whose document is missing, are not used; with no toxic label all scores are the base rate;
repeated rows get equal results; columns of the input called held_out, score, predicted and passages
are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import map_batches, map_rows, replaced, total, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEMS = (4, 5, 6)
FIT_ROWS = 20_000
#: Features counted, and words remembered, before the counts go out or the words are forgotten.
FLUSH, SEEN = 150_000, 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word and its stems; stems end in an asterisk, which no word contains."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """Weights of the features that tell, and the laws that turn segments into a probability."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.1
    rate: float = 0.5
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    max_e: float = 0.05
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        if (w := self.seen.get(word)) is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            w = self.seen[word] = max((self.weights[f] for f in features(word) if f in self.weights), default=self.drift)
        return w

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal scoring segment, as (first word, end, score)."""
        high = {w: x for w in set(words) if (x := self.weight(w)) > 0}
        if not high:
            return []
        return maximal_segments([(i, high[w]) for i, w in enumerate(words) if w in high], self.drift)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[list[tuple[int, int, float, float]], float, float]:
        """Significant segments with their E-values; the most and the total evidence in nats."""
        found = [(a, z, s, n * math.exp(-min(self.rate * s, 700.0))) for a, z, s in segments]
        found = [x for x in found if x[3] <= self.max_e]
        nats = [-math.log(max(x[3], 1e-300)) for x in found]
        return found, max(nats, default=0.0), sum(nats)

    def probability(self, most: float, total: float) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(most) + c * math.log1p(total)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's scan over the words with positive scores; the gaps between weigh drift a word.

    Kept for each candidate: the sum before it, the sum to its end, and the nearest earlier candidate
    that begins at a lower sum, so every candidate is looked at a constant number of times.
    """
    stack: list[tuple[float, float, int, int, int]] = []
    sum_to, at = 0.0, 0
    for i, s in scored:
        sum_to += drift * (i - at)
        left, right, first = sum_to, sum_to + s, i
        sum_to, at = right, i + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append((left, right, first, i + 1, j))
    return [(first, end, right - left) for left, right, first, end, _ in stack]


def sketch(text: str | None) -> int:
    """The least hash over three-word runs: near copies of a text mostly share it."""
    words = [w.encode("utf-8", "surrogatepass") for w in words_of(text)]
    digest = xxhash.xxh64_intdigest
    return min((digest(b" ".join(x)) for x in zip(words, words[1:], words[2:], strict=False)), default=digest(b" ".join(words))) >> 1


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _count(batches):
    """Documents that have each feature, by label; flushed whenever many are held."""
    counts: Counter = Counter()

    def flush():
        keys = list(dict.fromkeys(k for _, k in counts))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1, k] for k in keys], pa.int64()), pa.array([counts[0, k] for k in keys], pa.int64())], names=["feature", "n1", "n0"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts.update((toxic, f) for f in {f for w in set(words_of(text)) for f in features(w)})
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
    yield flush()


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p), summed upwards from k."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    out = 0.0
    while k <= n and term > out * 1e-12:
        out += term
        term *= (n - k) / (k + 1) * p / (1 - p)
        k += 1
    return out


def _rate(weights: list[tuple[float, int]], n: int, drift: float) -> float:
    """The positive root of sum p e^(rate * s) = 1; weights: (score, clean words that have it)."""

    def excess(x: float) -> float:
        hit = sum(c for _, c in weights)
        return sum(c / n * math.exp(min(x * s, 600.0)) for s, c in weights) + (1 - hit / n) * math.exp(x * drift) - 1

    lo, hi = 0.0, 1.0
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(lo, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    own = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > fit_rows:  # by hash, so the sample is the same at every run and no order is needed
        own = own.filter(F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # at most about fit_rows ids: small enough to broadcast by that bound
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own.select(F.col(id_col).alias("id"), "toxic")), "id")
    schema = T.StructType([*sample.schema.fields, T.StructField("sketch", T.LongType())])
    sample = written(map_rows(sample, schema, ["text"], lambda texts: {"sketch": [sketch(t) for t in texts]}), "toxicity-sample")
    # of near copies the one with the smallest id counts, or whatever a toxic text says would look toxic
    first = sample.groupBy("sketch").agg(F.min_by(F.struct("id", "text", "toxic"), F.struct("id", "toxic", "text")).alias("r"))
    rows = written(first.select("r.id", "r.text", "r.toxic"), "toxicity-fit")
    part = rows.withColumn("curve", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4)) == 0)
    weigh, calibrate = part.filter("not curve"), part.filter("curve")
    sizes = {r.toxic: r.n for r in weigh.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model, n1, n0 = Model(), sizes.get(1, 0), sizes.get(0, 0)
    base = min(max(n1 / max(n1 + n0, 1), 1e-3), 1 - 1e-3)
    if not n1 or not n0:
        model.curve = (math.log(base / (1 - base)), 0.0, 0.0)
        return model
    counts = written(map_batches(weigh.select("text", "toxic"), _count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter("n1 + n0 >= 3"), "toxicity-counts")
    tried = counts.count()
    # enriched features only; their number is bounded by the sample's words
    rich = counts.filter((F.col("n1") >= 3) & (F.col("n1") > 2 * base * (F.col("n1") + F.col("n0")))).collect()
    clean = []
    for f, k1, k0 in rich:
        if _tail(k1, k1 + k0, base) * tried > 1:
            continue
        prior = 0.5 + 0.01 * (k1 + k0)
        odds = math.log((k1 + prior) / (n1 - k1 + prior + 1)) - math.log((k0 + prior) / (n0 - k0 + prior + 1))
        if odds > 0:
            model.weights[f] = odds
            clean.append((odds, k0 + 0.5))
    n_words = total(weigh.filter("toxic = 0").select(F.size(F.split("text", " ")).alias("n")), "n")
    model.rate = _rate(clean, max(n_words, 1), model.drift) if clean else 0.5
    # the curve: (most, total) evidence of the rows kept apart, at most about fit_rows / 4 of them
    seen = np.array([(r.most, r.total, r.toxic) for r in _evidence(calibrate, model).select("most", "total", "toxic").collect()] or [(0.0, 0.0, 0)])
    x = np.column_stack([np.ones(len(seen)), np.log1p(seen[:, 0]), np.log1p(seen[:, 1])])
    model.curve = tuple(float(b) for b in _logistic(x, seen[:, 2]))
    model.seen = {}
    return model


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    def run(texts):
        most, sums = [], []
        for t in texts:
            words = words_of(t)
            _, a, b = model.evidence(len(words), model.segments(words))
            most.append(a)
            sums.append(b)
        return {"most": most, "total": sums}

    return map_rows(rows, T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("most", T.DoubleType()), T.StructField("total", T.DoubleType())]), ["text"], run)


PASSAGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score, predicted and passages (code points of the lower-cased text, significant ones only)."""
    schema = replaced(docs.schema, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE)))

    def run(texts):
        scores, passages = [], []
        for t in texts:
            words = words_of(t)
            found, most, sums = model.evidence(len(words), model.segments(words))
            scores.append(model.probability(most, sums))
            spans = [m.span() for m in WORD.finditer(t.lower())] if found else []
            passages.append([{"start": spans[a][0], "end": spans[z - 1][1], "score": s, "e_value": e} for a, z, s, e in found])
        return {"score": scores, "passages": passages}

    out = map_rows(docs, schema, [text_col], run)
    return out.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return score(rows, fit(rows, labels)).select("doc_id", "held_out", "score", "predicted")
