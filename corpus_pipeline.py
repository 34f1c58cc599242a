"""A corpus pipeline of five text operators: STAGES, each (name, function), applied in turn by run()."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import stage, table
from trackloom.llm.decontaminate import find_leaks
from trackloom.llm.mixing import systematic_copies
from trackloom.llm.near_dedup import near_duplicates
from trackloom.llm.pii import redact
from trackloom.llm.quality import accept
from trackloom.operators.staging import row_numbers

#: Rows of documents; stages keep these columns in this order.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, as doc_ids may be null or shared, on which every scan agrees, however it is split.

    Rows of Parquet files are numbered by their file's number, from a small written table, and their place in
    the file, which Spark tells whatever part of the file a task reads. Other rows are written with a number.
    """
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return stage(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    files = row_numbers(rows.select("_file").distinct(), [F.col("_file")], "_number")
    return rows.join(files, "_file").select(*COLUMNS, (F.shiftleft("_number", 40) + F.col("_place")).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its text alone, also those with a null doc_id or repeated ones; null and empty
    texts get the score of the bias. Very long texts are scored whole.
    """
    return accept(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (80 % of 5-word shingles): that with the smallest doc_id, null last.

    Rows are compared by their texts, whatever their doc_ids; of rows in a group that share a doc_id the
    first in its file stays. Rows without words are in no group and stay. Very long texts are compared whole.
    """
    docs = keyed(docs)
    near = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), 80).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = docs.select("row", "doc_id").join(near, "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks.

    Each row is judged by its own text: one with a null doc_id goes like others, and rows that share a
    doc_id with a leaking one stay. Null and empty texts stay. Very long texts are searched whole.
    """
    docs = keyed(docs)
    leaking = find_leaks(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return docs.join(leaking, "row", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each span of personal data replaced by its kind in angle brackets.

    Null and empty texts stay as they are, null doc_ids and repeated rows are redacted like others. Very
    long texts are searched whole.
    """
    return redact(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with the columns of documents, copy (from 1), size and source_target.

    Rows with a null or shared doc_id are documents like others; a null source is a source. Null texts have
    size 0. Very long texts are counted whole.
    """
    docs = keyed(docs)
    copies = systematic_copies(docs, keep=("row",)).where("copies > 0").select("row", "copies", "size", F.col("target").alias("source_target"))
    taken = docs.join(copies, "row")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS, "copy", "size", "source_target")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mix", mix)]
#: A trained model, banded hashing and hash-ordered sampling can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = stage(f(spark, docs, sf_dir))
    return docs
