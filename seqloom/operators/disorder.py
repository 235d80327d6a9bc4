"""Sliding-window scores of residues: native window plans in long form, and array kernels for the parts that need them.

long form: (idx, pos, aa) with pos from 0. Matrices and histograms are inputs: matrix (aa1, aa2, e), histogram one row
(lo, hi, step, bins), composition (aa, freq)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: mode: context reach, smoothing reach; a context starts two residues away.
MODES = {"long": (100, 10), "short": (25, 10), "glob": (100, 15)}
EDGE = -1.26


def residues(seqs: DataFrame) -> DataFrame:
    return seqs.select("idx", F.posexplode(F.split("seq", "")).alias("pos", "aa")).where("aa <> ''")


def context_energy(long: DataFrame, matrix: DataFrame, reach: int) -> DataFrame:
    """long with energy: the mean matrix value of the residue against those 2 to reach away; unknown pairs count 0.

    Counts of each residue type in the window come from running counts, so the work is residues times the alphabet and
    no pairs of positions are joined."""
    types = matrix.select("aa2").distinct()
    by = Window.partitionBy("idx").orderBy("pos")
    left, right = by.rowsBetween(-reach, -2), by.rowsBetween(2, reach)
    size = F.count("*").over(left) + F.count("*").over(right)
    names = sorted(r[0] for r in types.collect())  # an alphabet
    counts = [(F.count(F.when(F.col("aa") == a, 1)).over(left) + F.count(F.when(F.col("aa") == a, 1)).over(right)).alias(f"_{i}") for i, a in enumerate(names)]
    wide = long.select("*", size.alias("_size"), *counts)
    table = matrix.groupBy(F.col("aa1").alias("aa")).agg(F.map_from_entries(F.collect_list(F.struct("aa2", "e"))).alias("_m"))
    wide = wide.join(F.broadcast(table), "aa", "left")  # a row per letter of the alphabet
    total = sum((F.col(f"_{i}") * F.coalesce(F.element_at("_m", F.lit(a)), F.lit(0.0)) for i, a in enumerate(names)), F.lit(0.0))
    return wide.withColumn("energy", F.when(F.col("_size") > 0, total / F.col("_size")).otherwise(0.0)).select(*long.columns, "energy")


def moving_average(long: DataFrame, value: str, reach: int, out: str, edge: float | None = None) -> DataFrame:
    """Centred mean cut off at the ends, or with positions outside counted as edge."""
    w = Window.partitionBy("idx").orderBy("pos").rowsBetween(-reach, reach)
    if edge is None:
        return long.withColumn(out, F.avg(value).over(w))
    n = 2 * reach + 1
    return long.withColumn(out, (F.sum(value).over(w) + (n - F.count(value).over(w)) * F.lit(edge)) / n)


def histogram_score(long: DataFrame, value: str, histogram: DataFrame, out: str = "score") -> DataFrame:
    h = long.join(F.broadcast(histogram.select("lo", "hi", "step", "bins")))  # one row
    v = F.col(value)
    inside = F.get("bins", ((v - F.col("lo")) * (1 / F.col("step"))).cast("int"))
    return h.withColumn(out, F.when(v <= F.col("lo") + 2 * F.col("step"), 1.0).when(v >= F.col("hi") - 2 * F.col("step"), 0.0).otherwise(inside)).drop("lo", "hi", "step", "bins")


def scores(seqs: DataFrame, matrix: DataFrame, histogram: DataFrame, mode: str = "long") -> DataFrame:
    """(idx, pos, aa, energy, smooth, score) without post-smoothing."""
    reach, width = MODES.get(mode, MODES["long"])
    e = moving_average(context_energy(residues(seqs), matrix, reach), "energy", width, "smooth", EDGE if mode == "short" else None)
    return histogram_score(e, "smooth", histogram)


def runs(long: DataFrame, flag: Column) -> DataFrame:
    """(idx, first, last) of maximal runs of positions for which flag holds."""
    f = long.withColumn("_f", flag).withColumn("_g", F.col("pos") - F.row_number().over(Window.partitionBy("idx", "_f").orderBy("pos")))
    return f.where("_f").groupBy("idx", "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("_g")


def merged(islands: DataFrame, gap: int, least: int) -> DataFrame:
    """Islands joined over fewer than gap positions; those shorter than least dropped."""
    by = Window.partitionBy("idx").orderBy("first")
    new = F.coalesce((F.col("first") - F.lag("last").over(by) >= gap).cast("int"), F.lit(1))
    g = islands.withColumn("_n", new).withColumn("_g", F.sum("_n").over(by))
    return g.groupBy("idx", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g").where(F.col("last") - F.col("first") + 1 >= least)


def globular(long: DataFrame, value: str = "smooth") -> DataFrame:
    """Globular domains: values over 0.3, joined over gaps under 45, at least 35 long."""
    return merged(runs(long, F.col(value) > 0.3), 45, 35)


def metrics(long: DataFrame, seqs: DataFrame, score: str, threshold: float) -> DataFrame:
    """(idx, fraction, mean, longest): share of positions at or over the threshold, mean, longest run; 0 for empty ones."""
    longest = runs(long, F.col(score) >= threshold).groupBy("idx").agg(F.max(F.col("last") - F.col("first") + 1).alias("longest"))
    m = long.groupBy("idx").agg(F.avg((F.col(score) >= threshold).cast("double")).alias("fraction"), F.avg(score).alias("mean"))
    return seqs.select("idx").join(m, "idx", "left").join(longest, "idx", "left").fillna(0.0, ["fraction", "mean"]).fillna(0, ["longest"])


def foldable(fraction: Column, mean: Column, longest: Column, max_fraction: float = 0.5, max_run: int = 60, max_mean: float = 0.5) -> Column:
    return ~((fraction > max_fraction) | (longest >= max_run) | (mean > max_mean))


# Array kernels


def savitzky_golay(x: np.ndarray, width: int = 19, order: int = 5) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the values of the polynomial of the first and last window."""
    if len(x) < width:
        raise ValueError(f"needs {width} values")
    half = width // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1)
    fit = basis @ np.linalg.pinv(basis)
    out = np.convolve(x, fit[half][::-1], "valid")
    return np.concatenate([fit[:half] @ x[:width], out, fit[half + 1 :] @ x[-width:]])


def smooth(x: np.ndarray, reach: int) -> np.ndarray:
    s = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    lo, hi = np.maximum(0, i - reach), np.minimum(len(x), i + reach + 1)
    return (s[hi] - s[lo]) / (hi - lo)


class Predictor:
    """Scores of whole sequences from a matrix {aa: {aa: e}} and a histogram (lo, hi, step, bins)."""

    def __init__(self, matrix: dict[str, dict[str, float]], histogram: tuple[float, float, float, list[float]], composition: dict[str, float] | None = None, binding: dict[str, dict[str, float]] | None = None):
        """binding is the matrix of the binding scores, which need the composition of the partner too."""
        self.names = sorted({b for m in (matrix, binding or {}) for r in m.values() for b in r} | set(composition or {}))
        at = {b: i for i, b in enumerate(self.names)}
        self.rows, self.binding = ({a: np.array([r.get(b, 0.0) for b in self.names]) for a, r in m.items()} for m in (matrix, binding or matrix))
        self.at, self.histogram, self.composition = at, histogram, composition or {}

    def energy(self, seq: str, reach: int, rows: dict[str, np.ndarray] | None = None) -> np.ndarray:
        rows = self.rows if rows is None else rows
        n = len(seq)
        hot = np.zeros((n + 1, len(self.names)))
        for i, c in enumerate(seq):
            if c in self.at:
                hot[i + 1, self.at[c]] = 1
        sums, i = hot.cumsum(0), np.arange(n)
        lo, a, b, hi = np.maximum(0, i - reach), np.maximum(0, i - 1), np.minimum(n, i + 2), np.minimum(n, i + reach + 1)
        counts, size = sums[a] - sums[lo] + sums[hi] - sums[b], (a - lo) + (hi - b)
        own = np.array([rows.get(c, np.zeros(len(self.names))) for c in seq]).reshape(n, len(self.names))
        return np.where(size > 0, (counts * own).sum(1) / np.maximum(1, size), 0.0)

    def smoothed(self, seq: str, mode: str = "long") -> np.ndarray:
        reach, width = MODES.get(mode, MODES["long"])
        e = self.energy(seq, reach)
        if mode == "short":
            return np.convolve(np.pad(e, width, constant_values=EDGE), np.ones(2 * width + 1), "valid") / (2 * width + 1)
        return smooth(e, width)

    def run(self, seq: str, mode: str = "long", smoothing: str = "medium") -> tuple[np.ndarray, str]:
        """Scores, and in mode glob the report of globular domains, else the empty string."""
        return self.score(seq, mode, smoothing), globular_text(seq, domains(self.smoothed(seq, mode))) if mode == "glob" else ""

    def score(self, seq: str, mode: str = "long", smoothing: str = "medium") -> np.ndarray:
        w = self.smoothed(seq, mode)
        lo, hi, step, bins = self.histogram
        k = np.clip(((w - lo) * (1 / step)).astype(int), 0, len(bins) - 1)
        s = np.where(w <= lo + 2 * step, 1.0, np.where(w >= hi - 2 * step, 0.0, np.asarray(bins)[k]))
        if smoothing == "medium":
            return savitzky_golay(s)
        return smooth(s, 11) if smoothing == "strong" else s

    def redox(self, seq: str, **how) -> np.ndarray:
        return self.score(seq.replace("C", "S"), **how)

    def anchor(self, seq: str) -> np.ndarray:
        """Binding-region scores. Windows 41, 30 and 5; 0.0013, 0.26, 0.43; 22.97968 and 0.0116."""
        a, b, c = 0.0013, 0.26, 0.43
        face = np.array([self.composition.get(x, 0.0) for x in self.names])
        own = np.array([self.binding.get(x, np.zeros(len(self.names))) for x in seq]).reshape(len(seq), len(self.names))
        gain = smooth(smooth(self.energy(seq, 41, self.binding) - own @ face, 5), 5)
        d = smooth(self.score(seq, "long", "none"), 30)
        with np.errstate(divide="ignore"):
            extra = np.where((d > c - a / b) & (gain < 0), a / (d - c) + b, 0.0)
        x = np.where((gain < b) & (d < c), -1, 1) * (gain + extra - b) * (d - c)
        return 1 / (1 + np.exp(-22.97968 * (x - 0.0116)))

    def metrics(self, seq: str, threshold: float, **how) -> tuple[float, float, int]:
        if not seq:
            return 0.0, 0.0, 0
        s = self.score(seq, **how)
        over = np.concatenate([[0], (s >= threshold).astype(int), [0]])
        edge = np.flatnonzero(np.diff(over))
        return float((s >= threshold).mean()), float(s.mean()), int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def redox_regions(redox: np.ndarray, plain: np.ndarray) -> list[tuple[int, int]]:
    """Regions whose score depends on the redox state: difference over 0.15 and score 0.35 or more, longer than 14, with
    over two strong positions; those nearer than 10 are joined."""
    gap = np.asarray(redox) - np.asarray(plain)
    strong = (np.asarray(redox) > 0.5) & (np.asarray(plain) < 0.5) & (gap > 0.3)
    on = np.concatenate([[0], ((gap > 0.15) & (np.asarray(redox) >= 0.35)).astype(int), [0]])
    edge = np.flatnonzero(np.diff(on))
    out: list[tuple[int, int]] = []
    for lo, hi in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
        if hi - lo > 14 and strong[lo : hi + 1].sum() > 2:
            if out and lo - out[-1][1] < 10:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def domains(smoothed: np.ndarray, threshold: float = 0.3, gap: int = 45, least: int = 35) -> list[tuple[int, int]]:
    """What globular() finds, for one array."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.asarray(smoothed) > threshold).astype(int), [0]])))
    out: list[list[int]] = []
    for lo, hi in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
        if out and lo - out[-1][1] < gap:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out if hi - lo + 1 >= least]


def globular_text(seq: str, domains: list[tuple[int, int]]) -> str:
    """Domains in a report: their number and places from 1, then the sequence, upper case inside them, in blocks of 10 and
    lines of at most 70 characters. Fixed values: the wording and its spaces."""
    inside = np.zeros(len(seq), bool)
    for lo, hi in domains:
        inside[lo : hi + 1] = True
    shown = "".join(c.upper() if f else c.lower() for c, f in zip(seq, inside))
    blocks = [shown[i : i + 10] for i in range(0, len(shown), 10)]
    head = f"Number of globular domains: {len(domains)}\n" + "".join(f"          globular domain   {k}.\t{lo + 1}-{hi + 1}\n" for k, (lo, hi) in enumerate(domains, 1))
    return head + "\n".join(" ".join(blocks[i : i + 6]) for i in range(0, len(blocks), 6))


def score_lines(seq: str, scores: np.ndarray, binding: np.ndarray | None = None) -> list[str]:
    """A line per residue: its place from 1, the residue, and the scores with four decimals, between tabs."""
    columns = [scores] if binding is None else [scores, binding]
    return ["\t".join([str(i), c, *(f"{x[i - 1]:.4f}" for x in columns)]) for i, c in enumerate(seq, 1)]


def score_column(predictor: Predictor, kind: str = "score", **how):
    """A column function seq -> array<double>: score, redox or anchor; null for a sequence too short for its smoothing."""

    def of(s: str | None):
        try:
            return None if s is None else getattr(predictor, kind)(s, **how).tolist()
        except ValueError:
            return None

    @F.pandas_udf("array<double>")
    def column(seq: pd.Series) -> pd.Series:
        return pd.Series([of(s) for s in seq], dtype=object)

    return column
