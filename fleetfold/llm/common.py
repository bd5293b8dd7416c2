"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.session import work_dir

# A word is a run of characters other than the six ASCII blanks.
GAPS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Texts are long: batches of the default 10,000 rows or 64 MB would fill every worker's memory.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies, if it is not installed."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    for key, most in _BATCHES.items():
        spark.conf.set(key, most)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null, empty or blank text.

    Where single spaces are the only blanks, the text is split at one character, which needs no
    regular expression and costs a third.
    """
    trimmed = F.btrim(text, F.lit(GAPS))
    none = F.array().cast("array<string>")
    odd = F.contains(trimmed, F.lit("  "))
    for blank in GAPS[1:]:
        odd = odd | F.contains(trimmed, F.lit(blank))
    split = F.when(odd, F.split(trimmed, GAP)).otherwise(F.split(trimmed, " "))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, none).otherwise(split)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    They pass through a one-row generator, because the optimizer would copy an expression that is
    used inside a lambda function into it, and then compute a whole array for each of its elements.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(packed)))


def stored(rows: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """Write rows to the shared work folder and read them again: computed once, safe to reread."""
    path = work_dir(rows.sparkSession, purpose)
    rows.write.option("compression", compression).parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    found._stored_at = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote, once everything computed from them is stored in its turn."""
    for rows in tables:
        if rows is not None and getattr(rows, "_stored_at", None):
            spark = rows.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(rows._stored_at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def wide_enough(rows: DataFrame) -> DataFrame:
    """Deal rows out to every core before per-row work of many seconds, if they come in fewer splits."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def text_key(text: Column) -> Column:
    """What equal texts share; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def first_rows(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each component of texts: that with the smallest doc_id, nulls last, then the least text key.

    ``roots``: (node, root) of the text keys that are not alone. Rows that share an id are decided apart. The
    document lives in a struct, so no column of its own can clash.
    """
    named = docs.select(F.struct("*").alias("_doc"), text_key(F.col("text")).alias("_node"), F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_node")
    best = stored(named.groupBy("_node").agg(F.min(order).alias("_best")), "best")
    ids = best.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    kept = stored(ids.groupBy("root").agg(F.min("_best").alias("_best")).select("_best._node", "_best._id"), "kept")
    keep = (named["_node"] == kept["_node"]) & named["_id"].eqNullSafe(kept["_id"])
    return named.join(kept, keep, "left_semi").dropDuplicates(["_node", "_id"]).select("_doc.*")
