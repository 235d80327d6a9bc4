"""Sequences from PDB text by fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dense, file_stem, one_letter


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): lines of every file with their order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value")


def _chain(pos: int):
    c = F.trim(F.substring("value", pos, 1))
    return F.when(c == "", "_").otherwise(c)


def seqres(text: DataFrame) -> DataFrame:
    """(file, chain, seq) of SEQRES records."""
    r = text.where(F.col("value").startswith("SEQRES")).withColumn("names", F.filter(F.split(F.trim(F.substring("value", 20, 51)), r"\s+"), lambda x: x != ""))
    one = F.array_join(F.transform("names", one_letter), "")
    return r.groupBy("file", _chain(12).alias("chain")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("s")))), lambda x: x["s"]), "").alias("seq"))


def atoms(text: DataFrame, hetatm: bool = True) -> DataFrame:
    """(file, chain, seq): the first atom of each residue number and insertion code names the residue."""
    kind = F.substring("value", 1, 6)
    a = text.where(kind.startswith("ATOM") | (F.lit(hetatm) & kind.startswith("HETATM")))
    a = a.select("file", "n", _chain(22).alias("chain"), F.substring("value", 23, 4).alias("number"), F.substring("value", 27, 1).alias("code"), one_letter(F.substring("value", 18, 3)).alias("s"))
    first = a.groupBy("file", "chain", "number", "code").agg(F.min(F.struct("n", "s")).alias("x"))
    return first.groupBy("file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("seq"))


def sequences(spark: SparkSession, path: str, hetatm: bool = True) -> DataFrame:
    """(idx, id, header, seq, len): SEQRES chains of a file if it has any, else those of its atoms; files by name."""
    text = lines(spark, path)
    s = seqres(text)
    all_ = s.union(atoms(text, hetatm).join(s.select("file").distinct(), "file", "left_anti")).where("seq <> ''")
    header = F.concat(file_stem(F.col("file")), F.lit("|chain:"), F.col("chain"))
    return dense(all_, "idx", ["chain"], F.col("file")).select("idx", header.alias("id"), header.alias("header"), "seq", F.length("seq").alias("len"))
