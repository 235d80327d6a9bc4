"""Pair validation: pairs of all layers to edit paths, each step judged by a disorder predictor and a seeded coin."""

from __future__ import annotations

import functools
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ops_json
from .disorder import Predictor
from .editpath import SCHEMA, Exhausted, Expired, Limits, Path, _frame, run_validated


@dataclass(frozen=True)
class Options:
    prob: float = 0.5
    seed: int = 123
    validate: bool = True
    mode: str = "long"
    smoothing: str = "no"
    threshold: float = 0.5
    max_fraction: float = 0.5
    max_run: int = 60
    max_mean: float = 0.5
    max_lev: int = 0
    limits: Limits = field(default_factory=Limits)


def prefilter(pairs: DataFrame, max_lev: int) -> DataFrame:
    """Pairs of at most max_lev; 0 is no limit, an unknown distance passes."""
    return pairs.where(F.lit(max_lev == 0) | F.col("lev").isNull() | (F.col("lev") <= max_lev))


def located(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """pairs with the sequences a and b of both ends, null where an index is outside the layer."""
    by = [c for c in ("layer",) if c in pairs.columns and c in seqs.columns]
    end = lambda i, name: seqs.select(*by, F.col("idx").alias(f"idx{i}"), F.col("seq").alias(name))
    return pairs.join(end(1, "a"), [*by, "idx1"], "left").join(end(2, "b"), [*by, "idx2"], "left")


def invalid_index() -> Column:
    return F.col("a").isNull() | F.col("b").isNull()


def coin(idx1: int, idx2: int, prob: float, seed: int) -> Callable[[], bool]:
    """Accepts with a probability, the same sequence of answers for a pair whatever runs beside it."""
    r = random.Random((seed * 1315423911) ^ (idx1 * 2654435761) ^ idx2)
    return lambda: r.random() < prob


def validator(options: Options, predictor: Predictor | None, idx1: int, idx2: int, cache: Callable) -> Callable[[str], bool]:
    flip = coin(idx1, idx2, options.prob, options.seed)

    def ok(seq: str) -> bool:
        if not options.validate:
            return True
        if predictor is not None:
            fraction, mean, run = cache(seq)
            if fraction > options.max_fraction or run >= options.max_run or mean > options.max_mean:
                return False
        return flip()

    return ok


def paths(pairs: DataFrame, predictor: Predictor | None = None, options: Options = Options()) -> DataFrame:
    """located pairs -> with steps, ops, distance and status: found, not_found, timeout, node_limit (where limits.tell) or
    invalid_index. Each pair is judged once.

    Pairs are dealt out one by one, as the work of a pair is that of the product of its lengths."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = functools.lru_cache(10_000)(lambda s: predictor.metrics(s, options.threshold, mode=options.mode, smoothing=options.smoothing))
        for t in batches:
            found, late = [], []
            for i, j, a, b in zip(t.idx1, t.idx2, t.a, t.b):
                path, over = Path(None, None, None), None
                try:
                    if not pd.isna(a) and not pd.isna(b):
                        path = run_validated(a, b, validator(options, predictor, int(i), int(j), cache), options.limits)
                except Expired:
                    over = "timeout"
                except Exhausted:
                    over = "node_limit"
                found.append(path)
                late.append(over)
            yield pd.concat([t.reset_index(drop=True), _frame(found), pd.DataFrame({"late": pd.Series(late, dtype=object)})], axis=1)

    schema = ", ".join(f"{c} {k}" for c, k in pairs.dtypes) + ", " + SCHEMA + ", late string"
    spread = pairs.repartition(4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("idx1", "idx2"))
    out = spread.mapInPandas(work, schema)
    return out.withColumn("status", F.when(invalid_index(), "invalid_index").when(F.col("late").isNotNull(), F.col("late")).when(F.col("steps").isNull(), "not_found").otherwise("found")).drop("late")


def results(validated: DataFrame) -> DataFrame:
    """Rows of the results table; expects layer, line, idx1, idx2, id1, id2."""
    return validated.select("layer", "line", "idx1", "idx2", "id1", "id2", "status", "distance", F.when(F.col("ops").isNotNull(), ops_json(F.col("ops"))).alias("operations_json"), F.coalesce(F.size("steps"), F.lit(0)).alias("steps_count"))


def step_records(validated: DataFrame) -> DataFrame:
    """(header, seq) of every step of every path found."""
    s = validated.where("status = 'found'").select("*", F.posexplode("steps").alias("step", "seq"))
    return s.select(F.format_string("layer%d|pair%d|idx1=%d|idx2=%d|step=%d|distance=%d", "layer", "line", "idx1", "idx2", "step", "distance").alias("header"), "seq")


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("layer", "status").agg(F.count("*").alias("n"))


def random_pair(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """One pair by chance; an error if there is none. The same for a seed, whatever the order of rows."""
    p = pairs.orderBy(F.xxhash64(F.lit(seed), "idx1", "idx2"), "idx1", "idx2").limit(1)
    if p.isEmpty():
        raise ValueError("no pairs")
    return p


def farthest(pairs: DataFrame, max_lev: int = 0) -> DataFrame:
    """The first pair with the greatest distance under the limit; an error if there is none."""
    p = prefilter(pairs.where("lev is not null"), max_lev).orderBy(F.desc("lev"), "line_no").limit(1)
    if p.isEmpty():
        raise ValueError("no pair under the limit")
    return p
