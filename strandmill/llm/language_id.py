"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are made in tasks (one row for each language and bucket that a task has seen, summed by Spark) and
become a matrix of log probabilities, languages x buckets, which is broadcast: its size depends on the
number of languages and buckets only. Texts are scored in batches with array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, named, pieces, table

#: Buckets of the hash, n-gram lengths, and added count of each bucket.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: The classifier is fitted on about this many labelled rows at most, those with the smallest hashes.
MAX_TRAIN_ROWS = 60_000
#: More languages than this are refused: the matrix is BUCKETS float32 for each.
MAX_LANGUAGES = 256
#: N-grams of a text count as this many at most in the score that is told, as they are not independent. The
#: language is chosen by all of them.
EVIDENCE = 200.0
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased texts, and the number of a text's for each order; grams
    of one order follow those of another, texts in order within."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    own = np.repeat(np.arange(len(lower)), sizes)
    found, counts, code = [], [], np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            code = code[:0]
        else:
            code = code[: len(points) - n + 1] * np.uint32(0x01000193) ^ points[n - 1 :]
        if n in ORDERS:
            inside = own[: len(code)] == own[n - 1 :][: len(code)]
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            found.append((mixed[inside] >> np.uint32(17)).astype(np.int32) % BUCKETS)
            counts.append(np.maximum(sizes - n + 1, 0))
    return np.concatenate(found), np.array(counts)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and the number of its n-grams."""
        buckets, counts = grams(texts)
        out = np.empty((len(texts), len(self.languages)))
        owner = np.concatenate([np.repeat(np.arange(len(texts)), c) for c in counts])
        for k, row in enumerate(self.log):
            out[:, k] = np.bincount(owner, row[buckets], minlength=len(texts))
        return out, counts.sum(axis=0)

    def choose(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text, the first by name of equals, and its tempered posterior."""
        logs, n = self.score(texts)
        best = (logs + self.prior).argmax(axis=1)
        told = logs * (np.minimum(1, EVIDENCE / np.maximum(n, 1)))[:, None] + self.prior
        of_best = told[np.arange(len(texts)), best][:, None]
        return best, 1 / np.exp(np.minimum(told - of_best, 700)).sum(axis=1)


def held_out(id_col: Column) -> Column:
    """Documents that the model must not learn from. A null identifier has none, so it isn't learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(True))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Null texts and languages are not learned from; without any labelled row there are no languages."""
    rows = labelled.select(named(lang_col).alias("lang"), named(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                seen = np.flatnonzero(n)
                yield pa.record_batch({"lang": pa.array([lang] * (len(seen) + 1), pa.string()), "bucket": pa.array(np.append(seen, -1).astype(np.int32)), "n": pa.array(np.append(n[seen], texts[lang]).astype(np.int64))})
            sums.clear()
            texts.clear()

        for batch in batches:
            at = 0
            for part in pieces(batch.column("text")):
                langs = batch.column("lang").slice(at, len(part)).to_pylist()
                at += len(part)
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs, part.to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams(own)[0], minlength=BUCKETS)
                    texts[lang] = texts.get(lang, 0) + len(own)
                    if len(sums) > MAX_LANGUAGES:
                        yield from told()
        yield from told()

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "language-counts")
    if sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    frame = sums.toPandas()
    languages = sorted(frame["lang"].unique())
    row = {lang: k for k, lang in enumerate(languages)}
    counts, texts = np.full((len(languages), BUCKETS), SMOOTHING), np.ones(len(languages))
    which, bucket, n = frame["lang"].map(row).to_numpy(int), frame["bucket"].to_numpy(int), frame["n"].to_numpy(float)
    is_total = bucket < 0
    counts[which[~is_total], bucket[~is_total]] += n[~is_total]
    texts[which[is_total]] += n[is_total]
    return Model(languages, np.log(texts / texts.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of lang_pred and score, the posterior of that language.

    Null texts, texts without a letter, and all texts if nothing was learned, are UNDETERMINED with
    score 0. Of equally likely languages the first by name is taken.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for part in pieces(batch):
                texts = [t or "" for t in part.to_pylist()]
                if not m.languages:
                    names += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                best, odds = m.choose(texts)
                for t, k, p in zip(texts, best.tolist(), odds.tolist(), strict=True):
                    known = _LETTER.search(t) is not None
                    names.append(m.languages[k] if known else UNDETERMINED)
                    scores.append(p if known else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return language(text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Null and letterless texts are UNDETERMINED with score 0; null
    identifiers count as held out; repeated rows are predicted each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter(~F.col("held_out")))
    return docs.select("doc_id", "held_out", predict(spark, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
