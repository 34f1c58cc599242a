"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import n_words, stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: Size classes in each doubling, and rows that a slice of a class has on average at most.
CLASSES, ROWS = 4, 8_000


def sums_before(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with the sum of each value over all rows before it in a total order, without a window over all rows.

    The rows are sorted by range into partitions, sums run within each, and those of the partitions
    before, one row for each partition of the sort, are added.
    """
    placed = stage(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()).withColumns({f"{k}_value": v for k, v in values.items()}))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(*(F.sum(f"{k}_value").alias(k) for k in values))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_parts") for k in values))
    # as many rows as the sort has partitions: the bound of the broadcast
    out = placed.join(F.broadcast(parts), "part")
    return out.select(*df.columns, *((F.coalesce(F.sum(f"{k}_value").over(within), F.lit(0)) + F.col(f"{k}_parts")).alias(k) for k in values))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, size) -> source, source_size, n_docs, target; one row for each source.

    Sources by code point, null last, take the weights in turn. The targets sum to `share` of all
    words; a target stops at `most` times its source's words, what it leaves is shared by the others by
    weight until none is above. That is one water level: sources sorted by words per weight are full as
    long as the level, computed from what the full ones before leave, is above them. However many
    sources there are, no task sorts them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = F.col("source").cast("binary").asc_nulls_last()
    per = sums_before(per, [by_name], turn=F.lit(1))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))).drop("turn")
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = sums_before(per, [F.col("cap") / F.col("weight"), by_name], full=F.col("cap"), used=F.col("weight"))
    every = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    per = per.withColumn("level", (F.lit(float(share) * (every["size"] or 0)) - F.col("full")) / (F.lit(float(every["weight"] or 0)) - F.col("used")))
    # the level of the first source that isn't full, of equally full ones the highest; with none, every source is full
    found = per.where(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), (-F.col("level")).alias("low"))).alias("first")).first()["first"]
    target = F.least("cap", F.lit(-found["low"]) * F.col("weight")) if found else F.col("cap")
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def systematic_copies(docs: DataFrame, seed: int = 0, text: Column | None = None, keep: tuple = (), **targets) -> DataFrame:
    """docs(doc_id, source, text, keep..., ...) -> doc_id, source, keep..., size, source_size, target, copies, taken.

    Every document of a source is expected target / source_size times. Documents are put in order of
    size class within their source, the expected copies are summed along that order, one offset is
    added for each source, and a document is taken once for each integer that its stretch crosses:
    at most twice. As the order goes by size, the words taken come near the target. The offset and the
    order come from hashes, so that reruns agree.

    A null text has size 0; a null source is a source of its own; null doc_ids and repeated rows are
    documents like others. Ties of the order's hash go by doc_id, size and keep; rows that are equal in
    all of these are exchangeable. Very long texts are counted whole. Without any words all targets
    are 0 and nothing is taken. Extra columns are ignored. An empty table gives an empty result.

    The order is made of groups (source, size class, slice of a hash), with so many slices that a group
    has ROWS rows on average at most, whatever the table's size; each row's place is its place in its
    group plus the sum over the groups before, which come pre-aggregated. Rows equal in doc_id, text,
    source and keep are counted before they are ordered, and come out again in blocks of ROWS.
    """
    own = F.col("text") if text is None else text
    rows = docs.select("doc_id", "source", *keep, n_words(own).alias("size"), F.xxhash64("doc_id", own, F.lit(seed)).alias("h"))
    rows = stage(rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int")))
    rows = rows.withColumn("slice", F.pmod("h", F.lit(1 + rows.count() // ROWS)))
    per = stage(source_targets(rows, **targets)).withColumnRenamed("source", "of")
    groups = rows.groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
    classes = groups.groupBy("source", "class").agg(F.sum("n").alias("n"))
    # first along the classes of a source, which are few, then along the slices of a class
    along = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    groups = groups.join(classes.withColumnRenamed("start", "more"), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    groups = groups.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("slice").alias("l"), (F.col("start") + F.col("more")).alias("start"))
    # rows that are equal in all columns are one row with a count, so that no task sorts a large group of copies
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "class", "slice").orderBy("h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ROWS).cast("long"))))
    placed = placed.withColumn("nth", F.explode(F.sequence("block", F.least(F.col("block") + ROWS, "n") - 1))).withColumn("place", F.col("first") + F.col("nth"))
    placed = placed.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("slice") == F.col("l")))
    placed = placed.join(per, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed), F.lit("offset")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = F.col("start") + F.col("place")
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    placed = placed.withColumn("copies", F.least(copies, F.lit(MOST)).cast("long"))
    return placed.select("doc_id", "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
