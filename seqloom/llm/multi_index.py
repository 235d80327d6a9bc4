"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learnt apart on the two halves of unit vectors, make a product grid of cells. Every vector lies in one cell;
as a query it visits cells in order of the sum of its two squared half distances (multi-sequence traversal). How many it
visits is measured: at most SAMPLE vectors are compared with ALL vectors, and the visits are enough that TARGET of these links
are met by either side, doubled for safety, up to all cells. Where a table larger than the sample shows under MEASURED links,
invented partners at the threshold are measured too. Candidates are verified by cosine in double precision. The codebooks come
from the sample and grow with the root of the number of vectors up to an eighth of it, 2500 words a half; every vector is indexed.

Vectors with equal components are one class with a count. A cell's members and visitors meet in blocks of bounded size, in
which one matrix product gives each vector's number of links and a spanning forest of the links; pairs are never listed.
A pair that only one side's visit finds counts for both: the task that finds it knows whether the other side will.

Null vectors, vectors with null or non-finite components, empty and zero vectors link with nothing. Vectors of another
length than the commonest are linked among their own length only by being in no cell together: lengths are indexed apart.
Null vec_ids link with nothing and are kept. Repeated rows count as other vectors. Labels and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

COSINE, SAMPLE, TARGET, MEMBERS, VISITORS = 0.9, 20_000, 0.9999, 1024, 4096
MEASURED, RANKS_A_BATCH, ROWS_A_BATCH = 1000, 500, 8192


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, keys, dims = [], [], []
        for v in b.column(1):
            a = v.values
            x = a.to_numpy(zero_copy_only=False).astype(np.float64) if a is not None and not a.null_count else np.zeros(0)
            n = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
            good = bool(np.isfinite(n) and n > 0)
            if len(x) and not good and np.isfinite(x).all() and (m := np.abs(x).max()) > 0:  # the square over- or underflows
                x = x / m
                n, good = np.sqrt(x @ x), True
            raw = (x / n).tobytes() if good else None
            out.append(raw)
            keys.append(xxhash.xxh3_128_digest(raw) if raw else None)
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "unit", "digest", "dim"])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = _nearest(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        for j in np.flatnonzero(n):
            c[j] = x[a == j].mean(0)
    return np.unique(c, axis=0)


def _steps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in whole steps, the same bits for a pair whatever is computed beside it; their sums are exact."""
    return (((x - c) ** 2).sum(-1) * 2.0**40).astype(np.int64)


class Index:
    """The codebooks of one vector length and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 5):
        self.half = sample.shape[1] // 2 or 1
        k = int(max(1, min(np.sqrt(n / 8), max(len(sample) // 8, 256), len(sample))))
        self.books = [codebook(sample[:, : self.half], k, seed), codebook(sample[:, self.half :], k, seed + 1)]
        self.visits = 4

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, None, : self.half], x[:, None, self.half :])
        return [np.concatenate([_steps(p[i : i + 100], c) for i in range(0, len(x), 100)]) for p, c in zip(parts, self.books)]

    def far(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The sum of the two distances of each vector to one cell."""
        a, b = np.divmod(cell, len(self.books[1]))
        return _steps(x[:, : self.half], self.books[0][a]) + _steps(x[:, self.half :], self.books[1][b])

    def home(self, x: np.ndarray) -> np.ndarray:
        d = self._halves(x)
        return d[0].argmin(1) * len(self.books[1]) + d[1].argmin(1)

    def ranks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each vector visits before the given one."""
        d = self._halves(x)
        second = np.sort(d[1], axis=1)
        return np.array([np.searchsorted(s, f - r).sum() for s, f, r in zip(second, self.far(x, cell), d[0])], np.int64)

    def settle(self, ranks: np.ndarray, weights: np.ndarray, target: float = TARGET) -> None:
        """Set the visits from ranks of partners and how many links each stands for."""
        if len(ranks):
            o = np.argsort(ranks)
            at = np.searchsorted(np.cumsum(weights[o]), target * weights.sum())
            self.visits = 2 * (int(ranks[o][min(at, len(o) - 1)]) + 1)
        self.visits = min(max(4, self.visits), len(self.books[0]) * len(self.books[1]))

    def invented(self, sample: np.ndarray, count: int = 20_000, seed: int = 6) -> np.ndarray:
        """Ranks of partners at the threshold in random directions."""
        r = np.random.default_rng(seed)
        if sample.shape[1] < 2:
            return np.zeros(0, np.int64)
        out = []
        for _ in range(0, count, 1000):
            x = sample[r.integers(len(sample), size=1000)]
            u = r.normal(size=x.shape)
            u -= (u * x).sum(1, keepdims=True) * x
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            y = COSINE * x + np.sqrt(1 - COSINE**2) * u
            out.append(np.minimum(self.ranks(x, self.home(y)), self.ranks(y, self.home(x))))
        return np.concatenate(out)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells to visit, by distance and number, and the distances. The first is the vector's own.

        The m first lie among pairs of ranks (i, j), i * j <= m."""
        m, width = self.visits, len(self.books[1])
        d = self._halves(x)
        k = [min(m, y.shape[1]) for y in d]
        o = [np.argsort(y, axis=1, kind="stable")[:, :w] for y, w in zip(d, k)]
        s = [np.take_along_axis(y, w, 1) for y, w in zip(d, o)]
        i = np.repeat(np.arange(k[0]), np.minimum(k[1], m // np.arange(1, k[0] + 1)))
        j = np.concatenate([np.arange(min(k[1], m // (a + 1))) for a in range(k[0])])
        total, cell = s[0][:, i] + s[1][:, j], o[0][:, i] * width + o[1][:, j]
        first = np.lexsort((cell, total), axis=1)[:, :m]
        return np.take_along_axis(cell, first, 1), np.take_along_axis(total, first, 1)


def _links_of(index: Index, ids: np.ndarray, queries: np.ndarray):
    """Ranks at which sampled links between queries and all vectors are met by either side, and how many links each stands for."""
    small = queries.astype(np.float32)
    homes = index.home(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(len(own), -1)
            x32 = x.astype(np.float32)
            found = [np.stack(np.nonzero(x32 @ small[lo : lo + 2000].T >= COSINE)) + [[0], [lo]] for lo in range(0, len(small), 2000)]
            i, q = np.concatenate(found, axis=1)
            other = own[i] != ids[q]
            i, q = i[other], q[other]
            if not len(i):
                continue
            at = np.random.default_rng([len(i), int(own[0]) & 0xFFFFFFFF]).permutation(len(i))[:RANKS_A_BATCH]
            weight = len(i) / len(at)
            i, q = i[at], q[at]
            rank = np.minimum(index.ranks(queries[q], index.home(x[i])), index.ranks(x[i], homes[q]))
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(np.full(len(rank), weight))], ["rank", "weight"])

    return run


def _visit(indexes: dict[int, Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(3).to_numpy()
            for d in np.unique(dims):
                all_ = b.filter(pa.array(dims == d))
                step = max(1, ROWS_A_BATCH // (indexes[int(d)].visits + 1))
                for lo in range(0, len(all_), step):
                    part = all_.slice(lo, step)
                    x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(-1, d)
                    cells, far = indexes[int(d)].cells(x)
                    t = cells.shape[1]
                    row = np.repeat(np.arange(len(x)), t + 1)
                    cell = np.concatenate([cells[:, :1], cells], axis=1).ravel()
                    asks = np.tile(np.arange(t + 1) > 0, len(x))
                    take = part.take(pa.array(row))
                    ends = [pa.array(v[row]) for v in (cells[:, 0], cells[:, -1], far[:, -1])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(cell), pa.array(asks), take.column(0), take.column(1), take.column(2), *ends], ["dim", "cell", "asks", "id", "copies", "unit", "home", "last", "reach"])

    return run


_OUT = "id long, links long, u long, v long"


def _meet(t: pa.Table, indexes: dict[int, Index]) -> pa.Table:
    """Members and visitors of a cell: links of each, and a spanning forest of them."""
    asks = t["asks"].to_numpy()
    d = t["dim"][0].as_py()
    x = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(-1, d)
    ids, copies, home, last, reach = (t[c].to_numpy() for c in ("id", "copies", "home", "last", "reach"))
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    node, local = np.unique(ids, return_inverse=True)
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for at in range(0, len(q), 512):
        part = q[at : at + 512]
        i, j = np.nonzero(x[part] @ x[m].T >= COSINE)
        i, j = part[i], m[j]
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        far = np.concatenate([indexes[d].far(x[j[k : k + 20_000]], home[i[k : k + 20_000]]) for k in range(0, len(j), 20_000)] or [np.zeros(0, np.int64)])
        alone = (far > reach[j]) | ((far == reach[j]) & (home[i] > last[j]))  # the member does not come to the visitor's own cell
        for k, n in ((i, copies[j]), (j[alone], copies[i[alone]])):
            np.add.at(links, local[k], n)
        unite(root, local[i], local[j])
    met, away = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
    n, e = len(met), len(away)
    none = lambda k: np.zeros(k, np.int64)
    # a row for each vector with links, then an edge from each to the smallest of its tree
    first = np.arange(n + e) < n
    columns = {"id": (node[met], none(e)), "links": (links[met], none(e)), "u": (none(n), node[away]), "v": (none(n), node[root[away]])}
    return pa.table({c: pa.array(np.concatenate(v), pa.int64(), mask=~first if c in ("id", "links") else first) for c, v in columns.items()})


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of linked nodes in place; root gives the smallest node of each one's tree."""
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    clean = cut(vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("e")).mapInArrow(_clean, "vec_id long, unit binary, digest binary, dim int"), "imi-clean")
    reps = cut(clean.where("unit is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim")), "imi-classes")
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    indexes = {}
    for d, n in sizes.items():
        of = reps.where(F.col("dim") == d)
        got = of.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, SAMPLE / n))).select("id", "unit").limit(int(1.1 * SAMPLE)).toArrow()
        if not len(got):
            got = of.select("id", "unit").limit(1).toArrow()
        sample = np.frombuffer(b"".join(got["unit"].to_pylist()), np.float64).reshape(-1, d)
        indexes[d] = Index(sample, n)
        met = of.select("id", "unit").mapInArrow(_links_of(indexes[d], got["id"].to_numpy(), sample), "rank long, weight double").groupBy("rank").agg(F.sum("weight").alias("weight"))
        met = met.toArrow()
        ranks, weights = met["rank"].to_numpy(), met["weight"].to_numpy()
        if len(sample) < n and weights.sum() < MEASURED:
            more = indexes[d].invented(sample)
            ranks, weights = np.concatenate([ranks, more]), np.concatenate([weights, np.ones(len(more))])
        indexes[d].settle(ranks, weights)
    rows = cut(reps.select("id", "copies", "unit", "dim").mapInArrow(_visit(indexes), "dim int, cell long, asks boolean, id long, copies long, unit binary, home long, last long, reach long"), "imi-visits")
    blocks = rows.groupBy(F.col("dim").alias("_d"), F.col("cell").alias("_c")).agg(F.ceil(F.sum((~F.col("asks")).cast("long")) / MEMBERS).alias("mb"), F.ceil(F.sum(F.col("asks").cast("long")) / VISITORS).alias("qb")).where("mb > 0 and qb > 0")
    both = rows.join(blocks, (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c")))
    h = F.xxhash64("id")
    # a member goes to one member block and all visitor blocks, a visitor to one visitor block and all member blocks
    span = lambda mine, n: F.when(mine, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array(F.pmod(h, F.col(n))))
    both = both.withColumn("_m", F.explode(span(F.col("asks"), "mb"))).withColumn("_q", F.explode(span(~F.col("asks"), "qb")))
    found = cut(both.groupBy("dim", "cell", "_m", "_q").applyInArrow(lambda t: _meet(t, indexes), _OUT), "imi-links")
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("_links"))
    group = components(found.where("u is not null").select("u", "v"))
    label = reps.join(links, "id", "left").join(group, "id", "left").select("digest", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_g"))
    out = clean.where("vec_id is not null").select("vec_id", "digest").union(clean.where("vec_id is null").select("vec_id", F.lit(None).cast("binary"))).join(label, "digest", "left")
    g = F.coalesce("_g", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), g.alias("component_id"), F.coalesce(F.col("vec_id") == g, F.lit(True)).alias("kept"))
