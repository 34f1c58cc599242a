"""Hard-negative mining: blocks of anchors times blocks of candidates, positives first, then the negatives in their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow
from trackloom.operators.staging import row_numbers, scratch

POSITIVES, NEGATIVES = 5, 3
#: Components become whole numbers floor(SCALE * x).
SCALE = 256
#: Vectors with a component of this size or more take no part, so that all scores are exact in 64 bits.
FAR = 1 << 16
#: The anchors of one pass, which every task holds: so many bytes in double precision.
BLOCK_BYTES = 16 << 20
#: A product of so many anchors and candidates is in memory at a time.
TILE, CANDIDATES = 1024, 4096


def _numbers(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Lengths, and for each length the rows that have it with their whole numbers."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = column.value_lengths().to_numpy()
    ends = np.cumsum(lengths)
    out = []
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        out.append((int(length), own, flat[(ends[own] - length)[:, None] + np.arange(length)]))
    return lengths, out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision where that is exact."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The first k of each slot by score, higher first, then id, null last; what two of these hold can be merged."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        #: What a score must reach.
        self.least = np.full(slots, np.iinfo(np.int64).min, np.int64)

    def offer(self, scores: np.ndarray, wanted: np.ndarray, slots: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """A matrix of scores, a row for each of slots and a column for each of ids; where wanted is false, it doesn't count."""
        wanted = wanted & (scores >= self.least[slots][:, None])
        if np.count_nonzero(wanted) > 16 * self.k * len(slots) and scores.shape[1] > self.k:
            # so many that the k-th best of each row comes first
            held = np.where(wanted, scores, -np.inf)
            wanted &= held >= np.partition(held, -self.k, axis=1)[:, -self.k][:, None]
        row, column = np.nonzero(wanted)
        if len(row):
            self.add(slots[row], scores[row, column].astype(np.int64), ids[column], null[column])

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        keep = order[place < self.k]
        self.slot, self.score, self.id, self.null = slot[place < self.k], score[keep], ids[keep], null[keep]
        full = place[place < self.k] == self.k - 1
        self.least[self.slot[full]] = self.score[full]


class Anchors:
    """A block of anchors; of each one's positives the scores."""

    def __init__(self, table: pa.Table):
        self.id = table["vec_id"].to_numpy()
        self.labels = pc.unique(table["label"].combine_chunks())
        self.label = pc.index_in(table["label"].combine_chunks(), value_set=self.labels).to_numpy()
        lengths, groups = _numbers(table["v"].combine_chunks())
        self.groups = {length: (own, x) for length, own, x in groups}
        self.positive = np.zeros((len(self.id), 0), np.int64)
        self.n_positive = np.zeros(len(self.id), np.int64)
        self.positive_id = pa.nulls(0, pa.int64())

    def own_scores(self) -> np.ndarray:
        out = np.zeros(len(self.id), np.int64)
        for own, x in self.groups.values():
            for i, row in zip(own.tolist(), x, strict=True):
                out[i] = int(_scores(row[None], row[None])[0, 0])
        return out

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, scores, whether labels are the same, ids, which ids are null) of the pairs of equal length."""
        label = pc.fill_null(pc.index_in(batch.column("label"), value_set=self.labels), -1).to_numpy(zero_copy_only=False)
        null = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("vec_id"), 0).to_numpy(zero_copy_only=False)
        for length, rows, x in _numbers(batch.column("v"))[1]:
            own, anchors = self.groups.get(length, ((), None))
            for i in range(0, len(own), TILE):
                some = own[i : i + TILE]
                yield some, _scores(anchors[i : i + TILE], x), self.label[some][:, None] == label[rows], ids[rows], null[rows]


def _rows(best: Best) -> pa.RecordBatch:
    ids = pa.array(best.id, pa.int64(), mask=best.null)
    return pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), ids], names=["slot", "score", "id"])


def _slices(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for i in range(0, batch.num_rows, CANDIDATES):
            yield batch.slice(i, CANDIDATES)


def _positives(sent, k: int):
    """One more than k for each anchor, as the anchor itself is among them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors.id), k + 1)
        for batch in _slices(stream):
            for some, scores, same, ids, null in anchors.tiles(batch):
                best.offer(scores, same, some, ids, null)
        yield _rows(best)

    return run


def window(score: np.ndarray, low: int = 50, high: int = 95) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest n with low * score <= 100 * n <= high * score, without products that overflow."""
    whole, rest = score // 100, score % 100
    return whole * low - ((-rest * low) // 100), whole * high + (rest * high) // 100


def _negatives(sent, k: int, low: int, high: int):
    """For each anchor and positive, the slot anchor * positives + place, the first k of another label in the window."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        width = anchors.positive.shape[1]
        best = Best(len(anchors.id) * width, k)
        least, most = window(anchors.positive, low, high)
        for batch in _slices(stream):
            for some, scores, same, ids, null in anchors.tiles(batch):
                for place in range(width):
                    has = anchors.n_positive[some] > place
                    if not has.any():
                        break
                    own, by, alike = (some, scores, same) if has.all() else (some[has], scores[has], same[has])
                    inside = ~alike & (by >= least[own, place][:, None]) & (by <= most[own, place][:, None])
                    best.offer(by, inside, own * width + place, ids, null)
        found = _rows(best)
        anchor, place = best.slot // max(width, 1), best.slot % max(width, 1)
        more = [pa.array(anchors.id[anchor], pa.int64()), anchors.positive_id.take(pa.array(best.slot)), pa.array(anchors.positive[anchor, place])]
        yield pa.RecordBatch.from_arrays([*found.columns, *more], names=[*found.schema.names, "anchor_id", "positive_id", "positive_score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each slot over all tasks, of which each gave so many at most."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_positives(anchors: Anchors, found: pa.Table, k: int) -> Anchors:
    """found: (slot, score, id, rank) of at most k + 1 for each anchor, from which one equal to the anchor itself is taken."""
    found = found.sort_by([("slot", "ascending"), ("rank", "ascending")])
    slot, score = found["slot"].to_numpy(), found["score"].to_numpy()
    ids, null = pc.fill_null(found["id"], 0).to_numpy(), found["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    itself = ~null & (ids == anchors.id[slot]) & (score == anchors.own_scores()[slot])
    seen = np.zeros(len(anchors.id), bool)
    keep = np.ones(len(slot), bool)
    for i in np.flatnonzero(itself):
        if not seen[slot[i]]:
            seen[slot[i]], keep[i] = True, False
    slot, score, ids, null = slot[keep], score[keep], ids[keep], null[keep]
    begin = np.searchsorted(slot, np.arange(len(anchors.id)))
    place = np.arange(len(slot)) - begin[slot]
    slot, score, ids, null, place = (x[place < k] for x in (slot, score, ids, null, place))
    anchors.positive = np.zeros((len(anchors.id), k), np.int64)
    anchors.positive[slot, place] = score
    anchors.n_positive = np.bincount(slot, minlength=len(anchors.id))
    held, none = np.zeros(len(anchors.id) * k, np.int64), np.ones(len(anchors.id) * k, bool)
    held[slot * k + place], none[slot * k + place] = ids, null
    anchors.positive_id = pa.array(held, pa.int64(), mask=none)
    return anchors


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """vectors -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor after each component x has become floor(256 * x);
    higher scores come first, ties by smaller id, a null id last. An anchor's positives are its first
    `positives` other rows of its label; for each, its first `negatives` rows of another label come out
    whose score is between low % and high % of the positive's, both included.

    Rows with a null label or vector, with null or non-finite components or one of 65536 or more take no
    part; vectors are compared with those of their own length. Rows without id are no anchors, but
    candidates like others. Rows that share an id, or are equal, are different rows: each is an anchor of
    its own and a candidate of the others. An anchor without positives, or without negatives in a window,
    has no rows. Other columns are ignored. An empty table gives an empty result.

    Anchors go in blocks of bounded bytes, each broadcast in turn; every task multiplies it with its
    candidates, tile by tile in double precision (exact below 2^53, else in 64-bit whole numbers), and gives
    the few best of each anchor, which are merged by Spark. The windows of the block's positives go out
    with it for the second pass. The work is anchors times rows, as the result asks for; a task holds one
    block and one tile.
    """
    spark = vectors.sparkSession
    double = not vectors.schema[vector_col].dataType.simpleString().startswith("array<float")
    of = "double" if double else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{of}>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.expr(f"label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {FAR})"))
    chosen = rows.where("anchor and vec_id is not null").select("vec_id", "label", "v")
    size = chosen.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.n:
        return spark.createDataFrame([], schema)
    per = max(1, BLOCK_BYTES // (8 * size.width))
    numbered = row_numbers(chosen, [F.col("vec_id"), F.col("v")]).withColumn("block", F.floor((F.col("number") - 1) / per))
    blocks = scratch(spark, "anchors")
    numbered.select("vec_id", "label", "v", "block").write.partitionBy("block").parquet(blocks)
    every, candidates = spark.read.parquet(blocks), rows.select("vec_id", "label", "v")
    out = []
    for block in range(-(-size.n // per)):
        anchors = Anchors(every.where(F.col("block") == block).select("vec_id", "label", "v").toArrow())
        sent = spark.sparkContext.broadcast(anchors)
        found = _first(map_arrow(candidates, _positives(sent, positives), "slot long, score long, id long"), positives + 1).toArrow()
        sent.unpersist()
        sent = spark.sparkContext.broadcast(_with_positives(anchors, found, positives))
        found = map_arrow(candidates, _negatives(sent, negatives, low, high), "slot long, score long, id long, anchor_id long, positive_id long, positive_score long")
        done = _first(found, negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(scratch(spark, "negatives"))
        done.write.parquet(out[-1])
        sent.unpersist()
    return spark.read.schema(schema).parquet(*out)
