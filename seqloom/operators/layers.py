"""Layer iteration: the next layer keeps the first ends of the pairs, renumbered in order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dense
from . import neighbors


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for driver and executors; one of our own only in local mode where it names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="seqloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def step(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    kept = seqs.join(pairs.select(F.col("idx1").alias("idx")).distinct(), "idx", "left_semi")
    return dense(kept.withColumnRenamed("idx", "_old"), "idx", ["_old"], F.floor(F.col("_old") / 4096)).select(seqs.columns)


def fixpoint(seqs: DataFrame, k: int = 12, m: int = 500, start: int = 1) -> DataFrame:
    """(layer, n_sequences, n_pairs, idx1, idx2, lev): pairs of every layer until one pair or one sequence is left.

    The last index is never a first end, so each layer is smaller than the one before."""
    out, layer = None, start
    while (n := seqs.count()) >= 2:
        p = checkpointed(neighbors.pairs(seqs, neighbors.directed(seqs, k, m)))
        count = p.count()
        rows = p.select(F.lit(layer).alias("layer"), F.lit(n).cast("long").alias("n_sequences"), F.lit(count).cast("long").alias("n_pairs"), "idx1", "idx2", "lev")
        out = rows if out is None else out.union(rows)
        if count <= 1:
            break
        seqs, layer = checkpointed(step(seqs, p)), layer + 1
    return out
