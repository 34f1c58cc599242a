"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Words, hash_runs, mix, records, slices, stage

#: Features are hashed into so many buckets, which bounds the model.
BUCKETS = 1 << 18
#: At most so many labelled rows are used, the smallest by a hash of doc_id: a documented bound.
SAMPLE = 20_000
#: The sample is dealt to so many learners, whose models are averaged after each round.
LEARNERS, ROUNDS = 8, 5
ALPHA, BETA, L1, L2 = 3.0, 0.1, 1e-3, 1e-3
_FEATURES = "doc_id long, label int, slot long, packed binary"


_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[128:] = 4


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of several texts, one text after the other, and where each text begins.

    Features are words, word pairs, word endings and runs of three word shapes, as often as they occur,
    and a bias once for each text. The last bytes of a word and its shape (which kinds of characters it
    has) are features of their own, so that marks which a corpus hangs on many different words are seen
    as one.
    """
    words = Words(texts)
    start, end, data = words.start, words.end, words.data
    ends = mix(hash_runs(data, np.maximum(start, end - 3), end) + np.uint64(1))
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    shape = np.zeros(len(start), np.uint64)
    for kind in range(5):
        seen = np.concatenate([[0], np.cumsum(kinds == kind)])
        shape += np.uint64(1 << kind) * (seen[end] > seen[start]).astype(np.uint64)
    pairs, pair_at = words.grams(words.hash, 2)
    runs, run_at = words.grams(mix(shape + np.uint64(1 << 40)), 3)
    every = np.concatenate([words.hash, ends, pairs, runs]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    n = np.arange(len(start))
    text = np.searchsorted(words.first, np.concatenate([n, n, pair_at, run_at]), side="right") - 1
    every = np.concatenate([np.zeros(len(texts), np.int64), every.astype(np.int64)])
    text = np.concatenate([np.arange(len(texts)), text])
    order = np.argsort(text, kind="stable")
    return every[order], np.searchsorted(text[order], np.arange(len(texts)))


class Ftrl:
    """Follow-the-regularised-leader (proximal) with a learning rate for each feature."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS) if z is None else z
        self.n = np.zeros(BUCKETS) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, count: np.ndarray, label: int) -> None:
        """One example; a feature's value is its count by the root of the number of all."""
        value = count / math.sqrt(count.sum())
        w = self.weights(at)
        g = (logistic(w @ value) - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))


def pack(at: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted buckets as steps, and counts, byte plane by byte plane: a third of what arrays take in the shuffle of each round."""
    both = np.concatenate([np.diff(at, prepend=0), count]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(stream):
        every, first = features(batch.column("text").to_pylist())
        packed = [pack(*np.unique(x, return_counts=True)) for x in np.split(every, first[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "label", "slot")), pa.array(packed, pa.binary())], names=["doc_id", "label", "slot", "packed"])


def _learn(model: dict):
    """One learner for each slot of a stream that is sorted by slot."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            some = np.flatnonzero(learner.n)
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array(learner.z[some]), pa.array(learner.n[some])], names=["at", "z", "n"])

        learner, slot = None, None
        for row in records(stream):
            if row["slot"] != slot:
                if learner is not None:
                    yield result()
                learner, slot = Ftrl(*(model[k].copy() for k in "zn")), row["slot"]
            learner.learn(*unpack(row["packed"]), row["label"])
        if learner is not None:
            yield result()

    return run


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of BUCKETS features from docs(doc_id, text) and labels(doc_id, label 0/1).

    Rows with a null doc_id or a label other than 0 and 1 are left out; of repeated doc_ids each pair
    counts. Of the labelled rows the SAMPLE first by a hash are used. Without any the weights are 0.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    sample = labels.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    # at most SAMPLE small rows: the bound of the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = stage(rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(LEARNERS))).mapInArrow(_extract, _FEATURES))
    model = {"z": np.zeros(BUCKETS), "n": np.zeros(BUCKETS)}
    for turn in range(ROUNDS):
        # in an order that the rows alone decide, whatever partitions they come from
        order = found.withColumn("turn", F.xxhash64("doc_id", F.lit(turn))).repartition(LEARNERS, "slot").sortWithinPartitions("slot", "turn", "doc_id", "label", F.xxhash64("packed"))
        parts = order.select("slot", "label", "packed").mapInArrow(_learn(model), "at long, z double, n double")
        averaged = parts.groupBy("at").agg((F.sum("z")).alias("z"), (F.sum("n")).alias("n"), F.count("*").alias("k")).toArrow()
        model = {"z": np.zeros(BUCKETS), "n": np.zeros(BUCKETS)}
        for k in "zn":
            model[k][averaged["at"].to_numpy()] = averaged[k].to_numpy() / averaged["k"].to_numpy()
    return Ftrl(model["z"], model["n"]).weights(np.arange(BUCKETS))


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """docs(text, keep...) -> keep..., quality_score: the logistic of a sparse dot product."""
    some = np.flatnonzero(weights)
    sparse = docs.sparkSession.sparkContext.broadcast((some, weights[some]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BUCKETS)
        dense[sparse.value[0]] = sparse.value[1]
        for batch in slices(stream):
            every, first = features(batch.column("text").to_pylist())
            sums = np.add.reduceat(dense[every], first) / np.sqrt(np.diff(np.append(first, len(every))))
            out = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.float64())], names=[*keep, "quality_score"])

    docs = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.mapInArrow(run, f"{types}, quality_score double")


def held_out(doc_id=None):
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as held out."""
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted.

    The model learns from labelled rows that aren't held out and sees the words alone. One row for each
    row of docs. Null, empty and wordless texts get the score of the bias. A null doc_id is held out.
    Null or odd labels are left out, of contradictory labels of one doc_id each counts. Very long texts
    are scored whole. Empty docs give an empty result; without labels every score is 0.5.
    """
    learn = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    weights = train(docs, learn)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), weights, "doc_id", "held_out")
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= cutoff).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score cutoff or more; learning as in quality_scores.

    Each row is judged by its own text, also those with a null doc_id and repeated ones; null and empty
    texts get the score of the bias, very long ones are scored whole. A column of docs may be called like
    the score. An empty table gives an empty result.
    """
    weights = train(docs, labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()))
    clash = "quality_score" in docs.columns
    free = next(f"_{i}" for i in range(len(docs.columns) + 1) if f"_{i}" not in docs.columns)
    rows = docs.withColumnRenamed("quality_score", free) if clash else docs
    kept = score(rows, weights, *rows.columns).where(F.col("quality_score") >= cutoff).drop("quality_score")
    return kept.withColumnRenamed(free, "quality_score") if clash else kept
