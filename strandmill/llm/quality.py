"""Quality classifier: random Fourier features over document statistics, ridge regression from summed
normal equations, isotonic calibration.

Statistics are made once for each text, in tasks. The random features approximate a Gaussian kernel over
the standardised statistics; each task adds up the normal equations of its labelled rows and Spark sums
those matrices, whose size depends on the number of features only. Raw scores are calibrated by pooling
adjacent violators over a fixed number of score bins, on a part of the labelled rows that the regression
has not seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import lean, materialize, named, partitions, pieces, table

#: Random features, ridge penalty, kernel width over standardised statistics, bins of the calibration.
FEATURES, PENALTY, WIDTH, BINS, SEED = 192, 1e-3, 4.0, 256, 7
#: The classifier is fitted on about this many labelled identifiers at most, those with the smallest hashes.
MAX_TRAIN_ROWS = 200_000
#: One of so many labelled rows is kept for the calibration.
CALIBRATION = 4
THRESHOLD = 0.3

_GROUPS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "stop": b".?!", "comma": b",;:",
    "bang": b"!", "pipe": b"|", "sign": b"#$%&*@^~+=<>", "bracket": b"()[]{}", "quote": b"'\"", "slash": b"/\\_-", "high": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
_MEMBERS = np.zeros((256, len(_GROUPS)))
for _k, _bytes in enumerate(_GROUPS.values()):
    _MEMBERS[list(_bytes), _k] = 1
_WORDY = re.compile(rb"[A-Za-z\x80-\xff]+[.,;:?!]?")
STATISTICS = (*_GROUPS, "log_bytes", "word_bytes", "spread", "variety", "repeated_lines", "repeated_words", "short", "wordy", "words_a_line", "entropy")


def statistics(text: bytes) -> np.ndarray:
    """Numbers that describe a text; an empty one has zeros."""
    out = np.zeros(len(STATISTICS))
    words = text.split()
    if not words:
        return out
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    g = len(_GROUPS)
    out[:g] = np.sqrt(counts @ _MEMBERS / n)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    unique = set(words)
    share = counts[counts > 0] / n
    plain = sum(map(_is_wordy, unique)) / len(unique)
    out[g:] = (
        math.log1p(n), math.log1p(sizes.mean()), math.log1p(sizes.std()), math.log1p(len(unique)) / math.log1p(len(words)), 1 - len(set(lines)) / len(lines),
        1 - len(unique) / len(words), (sizes <= 3).mean(), plain, math.log1p(len(words) / len(lines)), -(share * np.log(share)).sum(),
    )
    return out


def _is_wordy(word: bytes) -> bool:
    return _WORDY.fullmatch(word) is not None


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    @lean
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(x or b"") for part in pieces(batch) for x in part.cast(pa.binary()).to_pylist()]
            flat = np.concatenate(rows).astype(np.float32) if rows else np.empty(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat, pa.float32()))

    return stats(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    levels: np.ndarray = field(default_factory=lambda: np.full(BINS, 0.5))

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        directions = rng.standard_normal((d, FEATURES)) / WIDTH
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ directions + phases) * math.sqrt(2 / FEATURES), np.ones(len(rows))])

    def bins(self, rows: np.ndarray) -> np.ndarray:
        """Raw scores from -0.5 to 1.5 in BINS steps."""
        raw = self.features(rows) @ self.weights
        return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.full(len(rows), self.levels[0]) if self.weights is None else self.levels[self.bins(rows)]


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of positives by bin, pooling adjacent violators; bins without rows lie on the
    line between their neighbours. One positive and one negative row are added to each pool."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(total):
        pools.append([total[k], positive[k], k, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, p, _, last = pools.pop()
            pools[-1][0] += n
            pools[-1][1] += p
            pools[-1][3] = last
    if not pools:
        return np.full(len(total), 0.5)
    at = [x for p in pools for x in (p[2], p[3])]
    level = np.maximum.accumulate([x for p in pools for x in [(p[1] + 1) / (p[0] + 2)] * 2])
    return np.interp(np.arange(len(total)), at, level)


def held_out(id_col: Column) -> Column:
    """Documents that the model must not learn from (a null identifier has no label either)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def known_labels(labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, n and positive: how often each document to learn from is labelled, and how often with 1. Labels
    other than 0 and 1 count as none. At most about max_rows rows, so that they may be broadcast."""
    rows = labels.filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("quality").cast("double").alias("positive")), "labels")
    total = known.count()
    return known if total <= max_rows else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / total)))


def train(described: DataFrame, known: DataFrame) -> Model:
    """described: doc_id, stats; known: as of known_labels. Without any labelled row all scores are 0.5.
    Repeated labels and repeated rows count each."""
    spark = described.sparkSession
    rows = described.select("doc_id", "stats").join(F.broadcast(known), "doc_id")  # bounded by known_labels
    rows = materialize(rows.select("stats", "n", "positive", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) != 0).alias("fit")), "quality-train")
    d = len(STATISTICS)
    sums = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("stats")[k].cast("double")) for k in range(d)], *[F.stddev_pop(F.col("stats")[k].cast("double")) for k in range(d)], F.sum(F.col("fit").cast("int"))).first()
    if not sums[0]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.array(sums[1 : d + 1]), np.maximum(np.array(sums[d + 1 : -1]), 1e-6))
    split = 0 < sums[-1] < sums[0]  # else all rows serve both ends

    def stacked(frame: pd.DataFrame) -> np.ndarray:
        return np.stack(frame["stats"].to_numpy()).astype(np.float64)

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            if len(frame):
                x, n = model.features(stacked(frame)), frame["n"].to_numpy()
                total += x.T @ np.column_stack([x * n[:, None], frame["positive"].to_numpy()])
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(np.stack(frame["row"].to_numpy()), axis=0)]})

    few = rows.coalesce(partitions(spark))
    seen, unseen = (few.filter("fit"), few.filter("NOT fit")) if split else (few, few)
    kind = "i int, row array<double>"
    found = seen.mapInPandas(equations, kind).groupBy("i").applyInPandas(added, kind).toPandas().sort_values("i")
    both = np.stack(found["row"].to_numpy())
    model.weights = np.linalg.solve(both[:, :-1] + PENALTY * np.eye(len(both)) * both[-1, -2] / len(both), both[:, -1])  # the constant's sum is the number of labels

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, positive = np.zeros(BINS), np.zeros(BINS)
        for frame in frames:
            if len(frame):
                k = model.bins(stacked(frame))
                total += np.bincount(k, frame["n"].to_numpy(), minlength=BINS)
                positive += np.bincount(k, frame["positive"].to_numpy(), minlength=BINS)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"bin": k, "n": total[k], "p": positive[k]})

    hist = unseen.mapInPandas(binned, "bin int, n double, p double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toPandas()
    total, positive = np.zeros(BINS), np.zeros(BINS)
    total[hist["bin"]], positive[hist["bin"]] = hist["n"], hist["p"]
    model.levels = isotonic(total, positive)
    return model


def score_column(spark: SparkSession, model: Model, stats: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)
            yield pa.array(shared.value.score(rows) if len(rows) else np.empty(0), pa.float64())

    return score(stats)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each text, written once; null counts as empty."""
    return materialize(docs.select(named(id_col).alias("doc_id"), statistics_column(named(text_col)).alias("stats")), "statistics")


def text_score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Scores straight from texts, for those whose statistics serve nothing else."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(x or b"") for part in pieces(batch) for x in part.cast(pa.binary()).to_pylist()]
            yield pa.array(shared.value.score(np.stack(rows).astype(np.float32).astype(np.float64)) if rows else np.empty(0), pa.float64())

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that score at least threshold. Only labelled texts are described
    to learn from them; then all are scored in one pass."""
    known = known_labels(labels)
    ids = F.broadcast(known.select(F.col("doc_id").alias("known_id")))  # bounded by known_labels
    labelled = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).join(ids, F.col("doc_id") == F.col("known_id"), "left_semi")
    model = train(describe(labelled), known)
    return docs.filter(text_score_column(docs.sparkSession, model, named(text_col)) >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document. Null texts count as empty, null identifiers are held out, repeated rows
    are scored each, an empty table gives no rows."""
    described = describe(table(spark, sf_dir, "documents"))
    model = train(described, known_labels(table(spark, sf_dir, "labels")))
    scored = described.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(spark, model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
