"""FASTA scan and writers. A file is read as records, never as one row of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dense, first_token, normalize


def read(spark: SparkSession, path: str, normal: bool = True, strict: bool = False, default_id: str | None = None) -> DataFrame:
    """(idx, id, header, seq, len), idx being the ordinal of the record in its file's order.

    normal: residues are cleaned (strict: anything to clean is an error); else lines are only trimmed and joined.
    An empty sequence, a missing id or data before a file's first header is an error under normal."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    # the first record of a file keeps its mark; the order of partitions is that of blocks in files
    marked = F.col("value").rlike(r"^\s*>")
    first = F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) == 1
    raw = raw.withColumn("headless", (F.col("b") == 0) & first & ~marked & (F.trim("value") != ""))
    rec = raw.withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.trim("value") != "")
    rec = dense(rec, "idx", ["m"], F.struct("f", "b"))
    lines = F.split("value", "\r?\n")
    header = F.element_at(lines, 1)
    # F.trim itself would be handed the line's place as the characters to cut off
    body = F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x)), "")
    seq = normalize(body, strict) if normal else body
    out = rec.select("idx", "headless", first_token(header, default_id).alias("id"), F.trim(header).alias("header"), seq.alias("seq"))
    if normal:
        bad = F.col("headless") | F.col("seq").isNull() | (F.col("seq") == "") | F.col("id").isNull()
        out = out.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("bad FASTA record "), F.coalesce("header", F.lit(""))))).otherwise(F.col("seq")))
    return out.drop("headless").withColumn("len", F.length("seq"))


def last_by_header(records: DataFrame) -> DataFrame:
    """One row per header: the first one's place, the last one's sequence."""
    return records.groupBy("header").agg(F.min("idx").alias("idx"), F.max_by("seq", "idx").alias("seq"))


def one_sequence(spark: SparkSession, path: str) -> DataFrame:
    """All lines that are no headers, joined."""
    lines = spark.read.text(path).withColumn("m", F.monotonically_increasing_id()).where("value not like '>%'")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("seq"))


def write(records: DataFrame, path: str, header: str = "header", mode: str = "overwrite") -> None:
    records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col("seq"))).write.mode(mode).text(path)
