"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk.

A network of one hidden layer minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Its inputs are
rates of a text (symbols, case, repetition and the like) and what its words, pairs of words and runs of four bytes say: each is
hashed into one of BUCKETS, and the log ratios of a bucket's share of the sampled positives to that of all training rows are
averaged over the buckets of the text (of a text that was counted, without itself). Positives are trusted rows (quality 1), the unlabelled rows any web text; the class
prior is the share of quality 1 among the labelled training rows. Labels are read only of rows outside the held-out fold;
labels, lang, source and doc_id are no inputs. The network is fitted on a bounded sample, at most 1.2 * SAMPLE positives and as
many unlabelled rows, taken by a hash of doc_id and text; everything is scored.

Null and empty texts are scored by their counts, all 0. Null doc_ids are in the training fold and are never positives.
Repeated rows are scored alike. Several labels of a document count as several rows. Without positives or unlabelled rows
the score is the prior. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mix64

SAMPLE, HIDDEN, EPOCHS, FOLDS, THRESHOLD, BUCKETS = 20_000, 24, 40, 5, 0.3, 1 << 14
_SYMBOLS, _DIGITS, _UPPER, _ENDS, _SPACE = b"#*$%&<>|", b"0123456789", bytes(range(65, 91)), b".!?", b" \t\n\r\x0b\f"
N_RATES = 16
N_FEATURES = N_RATES + 3
_words = WordHash()


def distinct_grams(words: list[bytes]) -> int:
    """Distinct runs of four words, by 64-bit hashes."""
    h = _words.of(words)
    g = h[:-3]
    for k in range(1, 4):
        g = mix64(g) + h[k : len(h) - 3 + k]
    return len(np.unique(g))


def describe(text: bytes | None) -> list[float]:
    """Counts of a text as rates; one pass each over the bytes."""
    text = text or b""
    w = text.split()
    n, size = len(w), len(text)
    gone = lambda t, chars: (len(t) - len(t.translate(None, chars))) / max(1, len(t))
    letters = text.translate(None, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = n - sum(map(bytes.__eq__, w, w[1:]))
    grams = max(0, n - 3)
    return [
        math.log1p(n), gone(letters, _SYMBOLS) * 10, math.sqrt(gone(letters, _SYMBOLS)), text.count(b"|") / max(1, n), math.sqrt(gone(letters, _UPPER)), gone(letters, _DIGITS), gone(letters, _ENDS) * 10,
        text.count(b"!!") / max(1, n), len(letters) / max(1, n) / 10, len(set(w)) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), len(lines) / max(1, n) * 10, 1 - pairs / max(1, n),
        1 - distinct_grams(w) / grams if grams else 0.0, sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)), len(set(w)) / max(1.0, math.sqrt(n)) / 20 if size else 0.0,
    ]


def grams(text: bytes) -> np.ndarray:
    """The distinct buckets of the words, pairs of words and runs of four bytes of a text, each kind in a range of its own."""
    h = _words.of(text.lower().split())
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    runs = np.zeros(0, np.uint64) if len(x) < 4 else mix64(x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24))
    kinds = (h, mix64(h[:-1]) + h[1:], runs)
    there = np.zeros(3 * BUCKETS, bool)
    for k, v in enumerate(kinds):
        there[(v >> np.uint64(20)) % np.uint64(BUCKETS) + np.uint64(k * BUCKETS)] = True
    return np.flatnonzero(there)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, good, all) of a partition; bucket -1 counts the rows."""
    n = np.zeros((2, 3 * BUCKETS + 1), np.int64)
    for b in batches:
        for t, good in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
            g = np.append(grams(t.as_py() or b""), 3 * BUCKETS)
            n[1, g] += 1
            if good:
                n[0, g] += 1
    at = np.flatnonzero(n[1])
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 3 * BUCKETS, -1, at), pa.int64()), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "good", "n"])


class Odds:
    """Log ratios of how many good rows have a bucket to how many would, were they like all rows; near 0 where few rows have it."""

    def __init__(self, good: np.ndarray, n: np.ndarray, rows: tuple[int, int]):
        self.good, self.n, self.rows = good, n, rows
        self.table = np.log((good + 1) / (rows[0] * n / max(1, rows[1]) + 1))

    def of(self, g: np.ndarray, own: int | None = None) -> np.ndarray:
        """For buckets of a text; own says that it was counted, and as good (1) or not (0): then it is taken out first."""
        if own is None:
            return self.table[g]
        return np.log((self.good[g] - own + 1) / ((self.rows[0] - own) * (self.n[g] - 1) / max(1, self.rows[1] - 1) + 1))


def learn_odds(rows: DataFrame) -> Odds:
    """Odds of rows, (text, good). Collects a row per bucket, 3 * BUCKETS at most."""
    t = rows.mapInArrow(_presence, "bucket long, good long, n long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 3 * BUCKETS + 1), np.int64)  # bucket -1 is the last
    n[0, t["bucket"].to_numpy()], n[1, t["bucket"].to_numpy()] = t["good"].to_numpy(), t["n"].to_numpy()
    return Odds(n[0, :-1], n[1, :-1], (int(n[0, -1]), int(n[1, -1])))


def inputs(text: bytes | None, odds: Odds, own: int | None = None) -> list[float]:
    """The rates of a text and the mean log odds of its words, pairs and byte runs; 0 where it has none."""
    g = grams(text or b"")
    kind = g // BUCKETS
    n = np.bincount(kind, minlength=3)
    return [*describe(text), *(np.bincount(kind, odds.of(g, own), 3) / np.maximum(1, n)).tolist()]


class Network:
    """tanh hidden layer, one output; the score is its logistic."""

    def __init__(self, prior: float, odds: Odds):
        self.prior, self.odds, self.mean, self.scale, self.w = prior, odds, None, None, None

    def fit(self, pos: np.ndarray, unl: np.ndarray, seed: int = 3) -> Network:
        if not len(pos) or not len(unl):
            return self
        r = np.random.default_rng(seed)
        self.mean, self.scale = unl.mean(0), unl.std(0) + 1e-3
        pos, unl = self._in(pos), self._in(unl)
        w = [r.normal(0, 1 / math.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        for epoch in range(EPOCHS):
            steps = max(20, len(unl) // 256)
            for _ in range(steps):
                x = np.concatenate([pos[r.integers(len(pos), size=256)], unl[r.integers(len(unl), size=256)]])
                h = np.tanh(x @ w[0] + w[1])
                s = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
                sp, su = s[:256], s[256:]
                minus = -np.log1p(-su + 1e-7).mean() + self.prior * np.log1p(-sp + 1e-7).mean()
                # d/dz of -log(s) is s - 1, of -log(1 - s) is s
                d = np.concatenate([self.prior * (sp - 1) - self.prior * sp, su]) / 256 if minus >= 0 else np.concatenate([self.prior * sp, -su]) / 256
                dh = d[:, None] * w[2] * (1 - h**2)
                grads = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
                t += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        z = np.tanh(self._in(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _collect(rows: DataFrame, odds: Odds) -> np.ndarray:
    """Inputs of the rows of the smallest hashes, 1.2 * SAMPLE at most; texts stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [inputs(t.as_py(), odds, own) for t, own in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(2), b.column(3)], ["x", "h", "i"])

    got = rows.select("text", "good", "h", F.xxhash64("text").alias("i")).mapInArrow(run, "x array<double>, h long, i long")
    return np.array(got.orderBy("h", "i").limit(int(1.2 * SAMPLE)).toArrow()["x"].to_pylist(), float).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on samples of the training folds; their sizes are bounded by 1.2 * SAMPLE rows each, the smallest hashes first."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    n1, n0 = (known.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("quality") != 1).cast("long")), F.lit(0))).first())
    h = F.xxhash64(F.lit("pu"), F.coalesce("id", F.xxhash64("text")))
    share = lambda k: F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, k)))
    ids = known.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct().withColumn("h", F.xxhash64(F.lit("pu"), "id"))
    good = ids.where(share(n1)).orderBy("h").limit(int(1.2 * SAMPLE)).select("id", F.lit(1).alias("good"))
    open_ = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), "text")
    # at most 1.2 * SAMPLE ids are broadcast
    open_ = open_.join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"), h.alias("h"))
    odds = learn_odds(open_.select("text", "good"))
    return Network((n1 + 1) / (n1 + n0 + 2), odds).fit(_collect(open_.where("good = 1"), odds), _collect(open_.where(share(odds.rows[1])), odds))


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([inputs(t.as_py(), net.odds) for t in b.column(1).cast(pa.binary())], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(x), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
