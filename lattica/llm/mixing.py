"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic); the cells' weights are raked in turn to the three
marginals until they agree; then they are raked again under the bound that no cell can give more tokens than
it has, until the marginals of what is kept agree; each document is kept with its cell's calibrated
probability, min(1, scale * weight / tokens), where the scale makes the expected tokens equal the wanted
share. Whether a document stays depends on a hash of its id alone, so runs and retries agree.

A level with fewer tokens than its share of the kept ones cannot meet its target: it is kept whole, and the
others share the rest in proportion to theirs. `unmet` names the margins in which a document's level misses
its target by more than MET of the kept tokens, whether for that reason, because the margins exclude each
other or because raking made no more headway; a warning lists these levels with what they reach.

Marginal targets are shares of tokens: given, or the measured shares to the power `temper` (1 keeps
them, 0 makes all levels equal). A document's topic is the one it comes with (column topic); where that is
absent or null, it is its cluster: the distinct words of five bytes or more are hashed with signs into a
vector of DIM counts, scaled to one length; the mean of the document's language is taken off, so that topics
are not languages again, and what remains is scaled once more; k-means around the mean of all documents finds
TOPICS directions, each named t0, t1 and so on. Every document moves the clusters in every round; only their
seeds come from the SEEDS documents with the least digests. Sums are of whole numbers, so the order of
tasks does not matter.

The cells are as many as the combinations of levels, whatever the documents: up to max_cells they are
raked on the driver, beyond that by joins on the cluster, to the same result.

Defined cases: null text has no tokens; a null source, language or topic counts as the empty one; null ids
share one draw; a text without long words has topic t0; a target for a level that has no tokens is spread over
the others; documents without tokens are kept with their cell's probability (1 if the whole cell is empty);
an empty table stays empty.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import portions, written
from lattica.session import ship

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.8, "lang": 0.7, "topic": 0.5}
KEEP, MAX_CELLS = 0.8, 200_000
#: Most rounds of either raking, gap of a margin at which it ends, and gap that counts as a missed target; gaps in shares of the tokens (of the kept ones, under the bound).
ROUNDS, AGREE, MET = 200, 1e-5, 1e-3
#: Clusters, coordinates of a text's vector, documents from which seeds are drawn, and rounds of k-means.
TOPICS, DIM, SEEDS, PASSES = 8, 64, 1024, 8


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row as signed bytes with a length of 127; rows of zeros stay."""
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.round(vectors * (127 / np.where(size > 0, size, 1))).astype(np.int8)


def profile_text(text: str | None) -> tuple[int, bytes]:
    """Words of a text, and its vector as signed bytes."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(FOLD))
    long = [w for w in set(words) if len(w) > 4]
    h = np.fromiter(map(zlib.crc32, long), np.uint32, len(long))
    v = np.bincount(h % DIM, ((h >> np.uint32(16)) & np.uint32(1)) * 2.0 - 1.0, DIM)
    return len(words), scaled(v[None])[0].tobytes()


PROFILE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("vector", T.BinaryType())])


def profiled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (words) and vector; only the text goes through Python."""
    ship(docs.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("vector", pa.binary())])

    @F.arrow_udf(PROFILE)
    def profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = []
            for at, n in portions([texts]):
                own += [profile_text(t) for t in texts.slice(at, n).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([v for _, v in own], pa.binary())], fields=list(kind))

    return docs.withColumn("__profile", profile(F.col(text_col))).withColumns({"n_tokens": F.col("__profile.n_tokens"), "vector": F.col("__profile.vector")}).drop("__profile")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int8).reshape(-1, DIM).astype(np.float64)


def nearest(vectors: np.ndarray, mean: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cluster with the direction closest to each vector's from the mean; vectors of nothing go to the first."""
    return np.where(vectors.any(1), ((vectors - mean) @ centres.T).argmax(1), 0)


def seeds(vectors: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """Directions of k of the vectors, each far from those before it with a probability by its squared distance."""
    rng, own = np.random.default_rng(0), vectors - mean
    own /= np.maximum(np.sqrt((own * own).sum(1, keepdims=True)), 1e-9)
    out = [own[0]]
    while len(out) < k:
        far = np.maximum(1 - (own @ np.array(out).T).max(1), 0)
        out.append(own[rng.choice(len(own), p=far / far.sum())] if far.sum() > 1e-9 else own[len(out) % len(own)])
    return np.array(out)


def _sums(rows: DataFrame, mean: np.ndarray | None, centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, sums of vectors) of each cluster: whole numbers, added on the cluster; k * DIM rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 1 if centres is None else len(centres)
        count, total = np.zeros(k, np.int64), np.zeros((k, DIM))
        for batch in batches:
            for at, n in portions([batch.column(0)]):
                own = _matrix(batch.column(0).slice(at, n))
                to = np.zeros(len(own), np.int64) if centres is None else nearest(own, mean, centres)
                count += np.bincount(to, minlength=k)
                np.add.at(total, to, own)
        size = DIM + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * size)), pa.array(np.column_stack((count, total)).astype(np.int64).ravel())], names=["at", "x"])

    k = 1 if centres is None else len(centres)
    out = np.zeros(k * (DIM + 1))
    for r in rows.select("vector").mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    out = out.reshape(k, DIM + 1)
    return out[:, 0], out[:, 1:]


def clusters(rows: DataFrame, k: int = TOPICS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions) of k-means over the vectors of all rows, which should be a written table."""
    count, total = _sums(rows, None, None)
    mean = total[0] / max(count[0], 1)
    first = rows.select("vector").distinct().orderBy(F.md5("vector"), "vector").limit(SEEDS).toArrow()["vector"].combine_chunks()
    if not len(first):
        return mean, np.zeros((k, DIM))
    centres = seeds(_matrix(first), mean, k)
    for _ in range(passes):
        count, total = _sums(rows, mean, centres)
        now = total - count[:, None] * mean
        size = np.sqrt((now * now).sum(1, keepdims=True))
        after = np.where(size > 1e-9, now / np.maximum(size, 1e-9), centres)
        if np.array_equal(after, centres):
            break
        centres = after
    return mean, centres


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, at, x): documents (at 0) and sums of vectors of each language in a batch."""
    for batch in batches:
        codes, own = batch.column(0).dictionary_encode(), _matrix(batch.column(1))
        total = np.zeros((len(codes.dictionary), DIM + 1))
        np.add.at(total, codes.indices.to_numpy(), np.column_stack((np.ones(len(own)), own)))
        at = np.tile(np.arange(DIM + 1), len(total))
        yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(np.repeat(np.arange(len(total)), DIM + 1))), pa.array(at), pa.array(total.astype(np.int64).ravel())], names=["lang", "at", "x"])


#: Languages whose means are broadcast at most: 5 MB; beyond that they are joined.
MAX_LANGS = 10_000


def centred(rows: DataFrame) -> DataFrame:
    """rows with the mean of their language taken off vector."""
    sums = rows.select(level("lang").alias("lang"), "vector").mapInArrow(_language_sums, "lang string, at long, x long").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    own = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))  # DIM + 1 entries
    mean = F.transform(F.slice("s", 2, DIM), lambda x: x["x"] / F.col("s")[0]["x"])
    means = written(own.select(F.col("lang").alias("__lang"), mean.alias("__mean")), "mixing-means")
    few = means.limit(MAX_LANGS + 1).count() <= MAX_LANGS

    @F.arrow_udf(T.BinaryType())
    def apart(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, mean in batches:
            own = _matrix(vectors)
            out = scaled(np.where(own.any(1, keepdims=True), own - mean.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM), 0))
            yield pa.array([v.tobytes() for v in out], pa.binary())

    joined = rows.join(F.broadcast(means) if few else means, level("lang") == F.col("__lang"))
    return joined.withColumn("vector", apart("vector", "__mean")).drop("__lang", "__mean")


def with_topics(rows: DataFrame, k: int = TOPICS) -> DataFrame:
    """rows (a written table with lang, vector, and topic or not) with topic; vector goes."""
    ship(rows.sparkSession)
    apart = centred(rows)
    mean, centres = clusters(written(apart.select("vector"), "mixing-vectors"), k)

    @F.arrow_udf(T.StringType())
    def cluster(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield pa.array([f"t{i}" for i in nearest(_matrix(vectors), mean, centres).tolist()], pa.string())

    own = cluster(F.col("vector"))
    given = next((c for c in rows.columns if c.lower() == "topic"), None)
    return apart.withColumn("topic", F.coalesce(F.col(given).cast("string"), own) if given else own).drop("vector")


def level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def cells_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*(level(m).alias(m) for m in MARGINS)).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def shares(tokens: np.ndarray, codes: np.ndarray, names: list, temper: float, given: dict | None) -> np.ndarray:
    """Target share of each level; levels without tokens get none."""
    own = np.bincount(codes, tokens, len(names))
    out = np.array([float(given.get(n, 0)) for n in names]) if given else np.where(own > 0, own, 1) ** temper
    out = np.where(own > 0, out, 0)
    return out / out.sum() if out.sum() else out


class Ends:
    """Whether raking has ended: the gap is small enough, or less than a hundredth smaller than at the last look."""

    def __init__(self, enough: float):
        self.enough, self.last = enough, np.inf

    def __call__(self, gap: float) -> bool:
        done = gap <= self.enough or gap > 0.99 * self.last
        self.last = gap
        return done


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, agree: float = 1e-10) -> np.ndarray:
    """Weights whose marginals are the targets: raked in turn until they agree, or for the most rounds."""
    weights, whole = tokens.astype(float), tokens.sum()
    ends = Ends(agree * whole)
    for i in range(rounds):
        if i % 5 == 0 and ends(max(np.abs(np.bincount(c, weights, len(share)) - share * whole).max(initial=0) for c, share in zip(codes, targets, strict=True))):
            break
        for c, share in zip(codes, targets, strict=True):
            now = np.bincount(c, weights, len(share))
            weights = weights * np.divide(share * whole, now, out=np.zeros(len(share)), where=now > 0)[c]
    return weights


def rake_bounded(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Weights whose min(weight, tokens) sum to the goals: full cells stay, the others make up for them.

    A factor never carries a level past its goal: upwards cells may only become full, downwards full cells
    may only be freed. Cells that were cut keep their weight, so they can be freed again.
    """
    ends = Ends(AGREE * sum(goals[0]))
    for i in range(ROUNDS):
        for c, goal in zip(codes, goals, strict=True):
            full = weights >= tokens
            have, free = np.bincount(c, np.where(full, tokens, 0), len(goal)), np.bincount(c, np.where(full, 0, weights), len(goal))
            up = goal >= have + free
            over = np.where(up, free, have + free)
            weights = weights * np.divide(np.where(up, goal - have, goal), over, out=np.ones(len(goal)), where=over > 0)[c]
        cut = np.minimum(weights, tokens)
        if i % 5 == 4 and ends(max(np.abs(np.bincount(c, cut, len(g)) - g).max(initial=0) for c, g in zip(codes, goals, strict=True))):
            break
    return weights


def calibrated(tokens: np.ndarray, weights: np.ndarray, keep: float) -> np.ndarray:
    """min(1, scale * weight / tokens), scaled so that keep of all tokens are expected to stay."""
    rate = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    order = np.argsort(-rate, kind="stable")
    w, t = weights[order], tokens[order]
    left_w, left_t = w[::-1].cumsum()[::-1], keep * t.sum() - (t.cumsum() - t)
    scale = np.divide(left_t, left_w, out=np.full(len(w), np.inf), where=left_w > 0)
    # cells before the k-th are kept whole; the first k at which the k-th is not over 1 is the answer
    with np.errstate(invalid="ignore"):
        fits = np.flatnonzero(scale * rate[order] <= 1)
    k = fits[0] if len(fits) else len(w)
    out = np.ones(len(w))
    if k < len(w):
        out[order[k:]] = np.clip(scale[k] * rate[order[k:]], 0, 1)
    out[(rate == 0) & (tokens > 0)] = 0.0  # levels that are wanted nowhere
    return np.where(tokens > 0, out, 1.0)


def rates_local(cells: DataFrame, temper: dict, given: dict, rounds: int, keep: float) -> DataFrame:
    own = cells.orderBy(*MARGINS).toArrow()
    tokens = own["tokens"].to_numpy()
    codes, names = [], []
    for m in MARGINS:
        d = own[m].combine_chunks().dictionary_encode()
        codes.append(d.indices.to_numpy())
        names.append(d.dictionary.to_pylist())
    targets = [shares(tokens, c, n, temper[m], given.get(m)) for m, c, n in zip(MARGINS, codes, names, strict=True)]
    weights = rake(tokens, codes, targets, rounds)
    sizes = [np.bincount(c, tokens, len(n)) for c, n in zip(codes, names, strict=True)]
    goals = [t * calibrated(t, share * tokens.sum(), keep) for t, share in zip(sizes, targets, strict=True)]
    p = calibrated(tokens, rake_bounded(tokens, codes, goals, keep * weights), keep)
    kept, unmet, missed = p * tokens, [[] for _ in tokens], []
    for m, c, n, share in zip(MARGINS, codes, names, targets, strict=True):
        got = np.bincount(c, kept, len(n)) / (kept.sum() or 1.0)
        off = np.abs(got - share) > MET
        missed += [(m, n[i], share[i], got[i]) for i in np.flatnonzero(off)]
        for i in np.flatnonzero(off[c]):
            unmet[i].append(m)
    report(missed)
    rows = list(zip(*(own[m].to_pylist() for m in MARGINS), p.tolist(), map(",".join, unmet), strict=True))
    return cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, probability double, unmet string")


def report(missed: list[tuple]) -> None:
    """Warn of (margin, level, target, reached) that differ; the largest gaps first."""
    if missed:
        worst = sorted(missed, key=lambda x: -abs(x[2] - x[3]))[:10]
        warnings.warn(f"mixing: {len(missed)} targets are not met: " + ", ".join(f"{m} {n} {a:.4f} of {b:.4f}" for m, n, b, a in worst), stacklevel=3)


def scale_of(cells: DataFrame, goal: float) -> float:
    """The scale at which the sum of min(tokens, scale * w) is goal."""
    lo, hi = 0.0, 1e12
    for first in range(14):  # 16 scales at a time: at first by magnitude, then evenly
        tries = [10.0**i for i in range(-3, 13)] if not first else [lo + (hi - lo) * i / 16 for i in range(1, 17)]
        sums = cells.agg(*(F.sum(F.least("tokens", F.col("w") * F.lit(s))).alias(f"s{i}") for i, s in enumerate(tries))).first()
        under = [s for s, x in zip(tries, sums, strict=True) if (x or 0.0) < goal]
        lo, hi = max([lo, *under]), min([hi, *(s for s in tries if s not in under)])
    return hi


def gap_of(cells: DataFrame, goals: dict[str, DataFrame], value: Column) -> float:
    """The largest difference of a level's sum from its goal."""
    gaps = [cells.groupBy(m).agg(F.sum(value).alias("x")).join(goals[m], m).select(F.abs(F.col("x") - F.col("goal")).alias("gap")) for m in MARGINS]
    return gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).first()[0] or 0.0


def written_cells(df: DataFrame) -> DataFrame:
    return written(df, "mixing-cells")


def rates_spread(cells: DataFrame, temper: dict, given: dict, rounds: int, keep: float) -> DataFrame:
    """The same by joins and aggregates, for more cells than the driver should hold.

    Every step is read back from Parquet: a checkpoint keeps its plan's size estimate, which joins multiply round by round.
    """
    spark = cells.sparkSession
    now = written_cells(cells.withColumn("w", F.col("tokens")))
    whole = now.agg(F.sum("tokens")).first()[0] or 0.0
    targets = {}
    for m in MARGINS:
        own = now.groupBy(m).agg(F.sum("tokens").alias("t")).filter("t > 0")
        if given.get(m):
            raw = own.join(spark.createDataFrame([(k, float(v)) for k, v in given[m].items()], f"{m} string, s double"), m, "left").select(m, F.coalesce("s", F.lit(0.0)).alias("s"))
        else:
            raw = own.select(m, F.pow("t", F.lit(float(temper[m]))).alias("s"))
        total = raw.agg(F.sum("s")).first()[0] or 1.0
        targets[m] = written_cells(raw.select(m, (F.col("s") / total * whole).alias("goal")))
    ends = Ends(1e-10 * whole)
    for i in range(rounds):
        if i % 5 == 0 and ends(gap_of(now, targets, F.col("w"))):
            break
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum("w").alias("have")).join(targets[m], m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("f"))
            now = now.join(factor, m).select(*MARGINS, "tokens", (F.col("w") * F.col("f")).alias("w"))
        now = written_cells(now)
    goals = {}
    for m in MARGINS:
        own = written_cells(now.groupBy(m).agg(F.sum("tokens").alias("tokens")).join(targets[m], m).withColumnRenamed("goal", "w"))
        goals[m] = written_cells(own.select(m, F.least("tokens", F.col("w") * F.lit(scale_of(own, keep * whole))).alias("goal")))
    now, cut, ends = now.withColumn("w", F.col("w") * F.lit(keep)), F.least("w", "tokens"), Ends(AGREE * keep * whole)
    for i in range(ROUNDS):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum(F.when(F.col("w") >= F.col("tokens"), F.col("tokens")).otherwise(0.0)).alias("have"), F.sum(F.when(F.col("w") >= F.col("tokens"), 0.0).otherwise(F.col("w"))).alias("free"))
            up = F.col("goal") >= F.col("have") + F.col("free")
            factor = sums.join(goals[m], m, "left").select(m, F.when(up & (F.col("free") > 0), (F.col("goal") - F.col("have")) / F.col("free")).when(~up & (F.col("have") + F.col("free") > 0), F.col("goal") / (F.col("have") + F.col("free"))).otherwise(1.0).alias("f"))
            now = now.join(factor, m).select(*MARGINS, "tokens", (F.col("w") * F.col("f")).alias("w"))
        now = written_cells(now)
        if i % 5 < 4:
            continue
        if ends(gap_of(now, goals, cut)):
            break
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(scale_of(now, keep * whole)) / F.col("tokens"))).otherwise(1.0)
    out = written_cells(now.select(*MARGINS, "tokens", p.alias("probability")).withColumn("unmet", F.array().cast("array<string>")))
    kept, missed = out.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0, []
    for m in MARGINS:
        got = out.groupBy(m).agg((F.sum(F.col("tokens") * F.col("probability")) / kept).alias("got")).join(targets[m], m)
        off = written_cells(got.select(m, (F.col("goal") / (whole or 1.0)).alias("share"), "got").filter(F.abs(F.col("got") - F.col("share")) > MET))
        missed += [(m, *r) for r in off.collect()]  # at most 2 / MET levels are off by so much
        out = out.join(off.select(m, F.lit(m).alias("off")), m, "left").withColumn("unmet", F.when(F.col("off").isNull(), F.col("unmet")).otherwise(F.concat("unmet", F.array("off")))).drop("off")
    report(missed)
    return out.select(*MARGINS, "probability", F.array_join("unmet", ",").alias("unmet"))


def draw(id_col: str = "doc_id"):
    """A number in [0, 1) for each id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", temper: dict | None = None, given: dict | None = None, rounds: int = ROUNDS, keep: float = KEEP, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs (with source, lang, topic and n_tokens) with probability, unmet and kept."""
    cells = written(cells_of(docs), "mixing-cells")
    few = cells.limit(max_cells + 1).count() <= max_cells
    wanted = {m: {str(k): v for k, v in levels.items()} for m, levels in (given or {}).items() if levels}
    rates = (rates_local if few else rates_spread)(cells, {**TEMPER, **(temper or {})}, wanted, rounds, keep)
    rates = rates.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), "probability", "unmet")
    on = [level(m) == F.col(f"__{m}") for m in MARGINS]
    # at most max_cells rows when broadcast
    return docs.drop("probability", "unmet", "kept").join(F.broadcast(rates) if few else rates, on, "left").drop(*(f"__{m}" for m in MARGINS)).withColumn("kept", draw(id_col) < F.col("probability"))


def op7(docs: DataFrame) -> DataFrame:
    given = [c for c in docs.columns if c.lower() == "topic"]
    own = profiled(docs.select("doc_id", "text", "source", "lang", *given)).drop("text")
    out = mix(with_topics(written(own, "mixing")))
    return out.select("doc_id", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept", "unmet")
