"""Length statistics and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile(c: Column, pct: float) -> Column:
    """Linear interpolation; 0 or less is the minimum, 100 or more the maximum, NaN without values."""
    p = F.min(c).cast("double") if pct <= 0 else F.max(c).cast("double") if pct >= 100 else F.percentile(c, F.lit(pct / 100.0))
    return F.coalesce(p, F.lit(float("nan")))


def length_stats(seqs: DataFrame) -> DataFrame:
    """One row: n, min_len, max_len, mean_len, median_len, std_len, p5, p25, p75, p95."""
    n = F.col("len")
    some = [percentile(n, p).alias(f"p{p}") for p in (5, 25, 75, 95)]
    return seqs.agg(F.count(n).alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), percentile(n, 50).alias("median_len"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std_len"), *some)


def composition(seqs: DataFrame) -> DataFrame:
    """(idx, aa, freq): relative frequency of each residue of each sequence."""
    aa = seqs.select("idx", F.explode(F.split("seq", "")).alias("aa")).where("aa <> ''")
    n = aa.groupBy("idx", "aa").agg(F.count("*").alias("n"))
    return n.join(seqs.select("idx", F.length("seq").alias("m")), "idx").select("idx", "aa", (F.col("n") / F.col("m")).alias("freq"))
