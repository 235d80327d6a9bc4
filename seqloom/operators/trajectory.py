"""Trajectories: midpoints by bisection, structure sampling with a pluggable predictor, agreement filter and merge."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_parts, sanitize
from .editpath import kabsch_rmsd


def bisection(n: int) -> list[list[int]]:
    """Midpoints of 0 .. n - 1 breadth first: the middle, then the middles of the halves."""
    levels, todo = [], deque([(0, n - 1)])
    while todo:
        row = []
        for _ in range(len(todo)):
            lo, hi = todo.popleft()
            if hi - lo > 1:
                mid = (lo + hi) // 2
                row.append(mid)
                todo += [(lo, mid), (mid, hi)]
        if row:
            levels.append(row)
    return levels


def _levels(n: Column) -> Column:
    @F.pandas_udf("array<array<int>>")
    def levels(x: pd.Series) -> pd.Series:
        return x.map({k: bisection(int(k)) for k in x.unique()})

    return levels(n)


def parsed(records: DataFrame) -> DataFrame:
    """records (idx, header, seq) with layer, pair, step from the header."""
    return records.withColumns(header_parts(F.col("header"), F.col("idx")))


def ordered(steps: DataFrame) -> DataFrame:
    """(key, pos, n): the place of each step in its trajectory and the trajectory's length."""
    key = F.format_string("layer%d|pair%d", "layer", "pair")
    w = Window.partitionBy("key")
    return steps.withColumn("key", key).withColumn("pos", F.row_number().over(w.orderBy("step", "idx")) - 1).withColumn("n", F.count("*").over(w))


def level_rows(steps: DataFrame, max_levels: int = 0) -> DataFrame:
    """Steps that are midpoints, with level from 1 and seq_id."""
    o = ordered(steps)
    size = o.select("n").distinct().withColumn("levels", _levels(F.col("n")))
    place = size.select(F.col("n").alias("_n"), F.posexplode("levels").alias("_l", "_row")).select("_n", (F.col("_l") + 1).alias("level"), F.explode("_row").alias("_pos"))
    out = o.join(place, (F.col("n") == F.col("_n")) & (F.col("pos") == F.col("_pos"))).drop("_n", "_pos")
    if max_levels:
        out = out.where(F.col("level") <= max_levels)
    return out.withColumn("seq_id", F.format_string("%s|step=%d|pos=%d|level=%d", "key", "step", "pos", "level"))


def pending(rows: DataFrame, *done: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows whose key is in none of the tables."""
    for d in done:
        rows = rows.join(d.select(key).distinct(), key, "left_anti")
    return rows


def file_name(idx: Column, name: Column) -> Column:
    return F.concat(F.format_string("%08d_", idx), sanitize(name), F.lit(".pdb"))


def ca_atoms(pdb: str) -> list[list[list[np.ndarray | None]]]:
    """Models, chains and residues of PDB text in order, each residue by the place of its CA atom, or None without one."""
    models: list[dict] = [{}]
    for line in pdb.splitlines():
        if line.startswith("MODEL") and models[-1]:
            models.append({})
        elif line.startswith(("ATOM", "HETATM")):
            residue = models[-1].setdefault(line[21:22], {})
            key = line[17:20] if line.startswith("HETATM") else "", line[22:27]
            residue.setdefault(key, None)
            if line[12:16].strip() == "CA" and residue[key] is None:
                residue[key] = np.array([float(line[i : i + 8]) for i in (30, 38, 46)])
    return [[list(c.values()) for c in m.values()] for m in models]


def pdb_rmsd(a: str, b: str) -> float:
    """RMSD of the CA atoms of two structures, paired by model, chain and residue where both have one; infinite for none."""
    both = [(x, y) for m, n in zip(ca_atoms(a), ca_atoms(b)) for c, d in zip(m, n) for x, y in zip(c, d) if x is not None and y is not None]
    return kabsch_rmsd(*(np.array(z) for z in zip(*both))) if both else float("inf")


FATAL = "fatal"


def sampled(rows: DataFrame, predict: Callable | None, samples: int = 5, seed: int = 12345, threshold: float = 2.0, make: Callable[[], Callable] | None = None) -> DataFrame:
    """(seq_id, status, rmsd, details, structure): samples structures of each seq by predict(seq, seed) -> CA coordinates or PDB
    text, and keeps those of which no sample is farther than the threshold from the first (structure is its text, if it is
    one). One failure fails its row alone. make, if given, loads the model once per task; if that fails, the task's rows are
    left out and one row tells so: no seq_id, status fatal."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["seq_id", "status", "rmsd", "details", "structure"]
        try:
            model = make() if make else predict
        except Exception as e:  # the model is foreign code
            yield pd.DataFrame([("", FATAL, float("inf"), f"{type(e).__name__}: {e}", None)], columns=columns)
            return
        for t in batches:
            out = []
            for name, seq in zip(t.seq_id, t.seq):
                try:
                    s = [model(seq, seed + k) for k in range(samples)]
                    far = max([pdb_rmsd(s[0], x) if isinstance(x, str) else rmsd(np.asarray(s[0], float), np.asarray(x, float)) for x in s[1:]], default=0.0)
                    ok = far <= threshold
                    out.append((name, "ok" if ok else "bad_rmsd", far, None, s[0] if ok and isinstance(s[0], str) else None))
                except Exception as e:  # the predictor is foreign code; its error is the row's result
                    out.append((name, "error", float("inf"), f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=columns)

    return rows.select("seq_id", "seq").mapInPandas(work, "seq_id string, status string, rmsd double, details string, structure string")


def folded(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 1) -> DataFrame:
    """(idx, seq_id, status, name, content): the structures that a model gives for batches of sequences, with their file names.

    rows: idx, seq_id, seq. An error fails the whole batch: status error, with the message as content. If the model cannot be
    loaded, one row of the task says so: no seq_id, status fatal."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["idx", "seq_id", "status", "content"]
        try:
            model = make()
        except Exception as e:  # the model is foreign code
            yield pd.DataFrame([(-1, "", FATAL, f"{type(e).__name__}: {e}")], columns=columns)
            return
        for t in batches:
            out = []
            for at in range(0, len(t), max(1, batch)):
                part = t.iloc[at : at + max(1, batch)]
                try:
                    out += zip(part.idx, part.seq_id, ["ok"] * len(part), model(part.seq.tolist()), strict=True)
                except Exception as e:
                    out += [(i, n, "error", f"{type(e).__name__}: {e}") for i, n in zip(part.idx, part.seq_id)]
            yield pd.DataFrame(out, columns=columns)

    got = rows.select(F.col("idx").cast("long"), "seq_id", "seq").mapInPandas(work, "idx long, seq_id string, status string, content string")
    return got.withColumn("name", F.when(F.col("status") == "ok", file_name(F.col("idx"), F.col("seq_id"))))


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Of the residues that both have; infinite for none."""
    n = min(len(a), len(b))
    return kabsch_rmsd(a[:n], b[:n])


def rmsd_column(a: Column, b: Column) -> Column:
    """RMSD of two arrays of x, y, z triples."""

    @F.pandas_udf("double")
    def column(x: pd.Series, y: pd.Series) -> pd.Series:
        points = lambda v: np.array([list(p) for p in v], float).reshape(-1, 3)
        return pd.Series([rmsd(points(u), points(v)) for u, v in zip(x, y)])

    return column(a, b)


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and failed rows."""
    return results.where("status = 'ok'").select("seq_id", "rmsd"), results.where("status <> 'ok'").select("seq_id", "status", "rmsd", "details")


def four_decimals(rmsd: Column) -> Column:
    """The text of an RMSD in tables: four decimals, inf for none."""
    return F.when(rmsd == float("inf"), "inf").otherwise(F.format_string("%.4f", rmsd))


def merge_levels(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per key: the first one's place, the last one's value, in the given order of columns. rows: key, value, order."""
    o = F.struct(*order)
    return rows.groupBy("key").agg(F.max_by("value", o).alias("value"), F.min(o).alias("place"))


def manifest(merged: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, kept): 1 for keys in kept, or for all if kept is empty."""
    k = kept.select("key").distinct().withColumn("_k", F.lit(1))
    none = kept.agg((F.count("*") == 0).alias("_none"))
    return merged.join(k, "key", "left").join(F.broadcast(none)).select("key", F.when(F.col("_none"), 1).otherwise(F.coalesce("_k", F.lit(0))).alias("kept"))
