"""Exact removal of long repeated passages with a run-length Burrows-Wheeler index.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else in the corpus. To bring equal strings together
without indexing the corpus in one place, each window of LENGTH bytes names the smallest of its hashed ANCHOR-grams
(rightmost on ties); equal windows name equal anchors at equal offsets. Neighbouring windows with one anchor form a segment,
1 per 80 bytes on average. Only segments whose anchor occurs twice go on. Equal segments are counted once; a segment that
occurs twice is repeated throughout. Those that differ under one anchor meet in buckets of bounded size: each bucket's text
gets a suffix order, its BWT is run-length compressed, and the text positions at run ends are sampled with the length of
their match to the neighbour in suffix order. Matching statistics of every other position follow from the last sample
before it, one less per byte, as the text streams by; positions of LENGTH or more start a repeated string.

An anchor whose segments exceed HOT bytes is split further: its windows are counted by hash, with partial sums, so no group
is gathered. Equality of windows and segments that is not compared byte by byte rests on 128 bits (anchor and content).

Null and empty texts have 0 bytes. Texts shorter than LENGTH lose nothing. Null doc_ids are documents like any other.
Repeated rows repeat each other. Empty tables give empty results. Extra columns are kept by strip() and ignored by
measure(), whatever they are called. Texts of any length are scanned in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, mix64, tidy

LENGTH, ANCHOR, PIECE, BUCKET, HOT = 200, 40, 1 << 19, 1_500_000, 4_000_000
_U = np.uint64
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, PIECE + 4 * LENGTH)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.full(m, _U(b))]).cumprod(dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Rolling:
    """Content hashes of any stretch of a text."""

    def __init__(self, x: np.ndarray):
        up, self.down = _power(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(_BYTE[x] * up[: len(x)], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(_U) * _U(0x9FB21C651E98DF25))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    pad = -n % w
    b = np.concatenate([v, np.full(pad, np.iinfo(_U).max, _U)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, first and last window start, anchor offset of each segment of a text."""
    out = []
    for at in range(0, max(0, len(x) - LENGTH + 1), PIECE):
        part = x[at : at + PIECE + LENGTH - 1]
        r = Rolling(part)
        h = r.all(ANCHOR)
        place = _U(0xFFFFF) - np.arange(len(h), dtype=_U)  # the rightmost wins a tie
        low = _sliding_min((h & _U(0xFFFFFFFFFFF00000)) | place, LENGTH - ANCHOR + 1)
        anchor = (_U(0xFFFFF) - (low & _U(0xFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        p = anchor[first]
        out.append((h[p], r.span(first, last + LENGTH) ^ (p - first).astype(_U), first + at, last + at, p - first))
    if not out:
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


_SEGMENT = "anchor long, seg long, d long, xh long, lo int, hi int, off short"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = []
        for d, xh, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            a, s, lo, hi, off = segments(np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8))
            got.append((a.view(np.int64), s.view(np.int64), np.full(len(a), d), np.full(len(a), xh), lo.astype(np.int32), hi.astype(np.int32), off.astype(np.int16)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], [c.split()[0] for c in _SEGMENT.split(", ")])


class RunIndex:
    """Run-length BWT of distinct segments with sampled run ends.

    Every segment ends in a terminator of its own that sorts after all bytes, so the suffix order is a strict one."""

    def __init__(self, parts: list[bytes]):
        n = sum(map(len, parts)) + len(parts)
        self.text = t = np.frombuffer(b"\xff".join(parts) + b"\xff" + b"\xff" * 8, np.uint8)
        self.n = n
        size = np.array([len(p) + 1 for p in parts])
        self.start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(parts)), size)
        self.rem = (self.start + size - 1)[owner] - np.arange(n)
        key = np.zeros(n, _U)
        for j in range(8):
            key = (key << _U(8)) | t[j : n + j].astype(_U)
        short = np.minimum(self.rem, 8)
        fill = np.array([(1 << (64 - 8 * k)) - 1 for k in range(9)], dtype=object).astype(np.uint64)
        self.key = key | fill[short]
        rank = np.unique(self.key, return_inverse=True)[1].astype(np.int32)
        self.levels = [(8, rank)]
        h = 8
        while rank.max() < n - 1:
            second = n + owner
            far = np.flatnonzero(self.rem > h)
            second[far] = rank[far + h]
            rank = np.unique((rank.astype(_U) << _U(32)) | second.astype(_U), return_inverse=True)[1].astype(np.int32)
            h *= 2
            self.levels.append((h, rank))
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        before = t[order - 1]  # the byte before each suffix; a segment's first has none and is a run of its own
        before = np.where(np.isin(order, self.start), 0xFF, before)
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0xFF)])
        self.heads = np.flatnonzero(head)
        self.symbols = before[self.heads]
        tails = np.concatenate([self.heads[1:] - 1, [n - 1]])
        self.up = self._samples(order, self.heads[self.heads > 0], -1)
        self.down = self._samples(order, tails[tails < n - 1], 1)

    def _samples(self, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        at = order[rows]
        length = self.match(at, order[rows + step])
        by = np.argsort(at)
        return at[by], length[by]

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (up to 7 more where both end)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for h, rank in reversed(self.levels[:-1]):
            same = (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)]) & (a < self.n) & (b < self.n)
            a[same] += h
            b[same] += h
        x = self.key[np.minimum(a, self.n - 1)] ^ self.key[np.minimum(b, self.n - 1)]
        return a - start + sum((x < _U(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))

    def statistics(self) -> np.ndarray:
        """For each position, the longest match of its suffix elsewhere in the text, streamed from the sampled run ends."""
        out = np.zeros(self.n, np.int64)
        for at, length in (self.up, self.down):
            if len(at):
                last = np.zeros(self.n, np.int64)
                last[at] = np.arange(len(at)) + 1
                last = np.maximum.accumulate(last)
                seen = last > 0
                k = last[seen] - 1
                np.maximum(out[seen], length[k] - (np.flatnonzero(seen) - at[k]), out=(part := out[seen]))
                out[seen] = part
        return out


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of window starts as [lo, hi) of bytes."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    lo = starts[np.concatenate([[0], edge + 1])]
    hi = starts[np.concatenate([edge, [len(starts) - 1]])]
    return list(zip(lo.tolist(), (hi + LENGTH).tolist()))


_MARK = "d long, xh long, lo long, hi long"


def _marks(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows)) or [()] * 4
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("d", "xh", "lo", "hi"), c)})


def _bucket(t: pa.Table) -> pa.Table:
    index = RunIndex([p.as_py() for p in t["part"]])
    far = (index.statistics() >= LENGTH) & (index.rem >= LENGTH)
    rows = []
    for d, xh, lo, c, start, size in zip(t["d"].to_pylist(), t["xh"].to_pylist(), t["lo"].to_pylist(), t["c"].to_pylist(), index.start.tolist(), [len(p.as_py()) for p in t["part"]]):
        if c == 1:
            rows += [(d, xh, lo + a, lo + b) for a, b in _spans(np.flatnonzero(far[start : start + size]))]
    return _marks(rows)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, xh, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            t = t.as_py()
            rows += [(w["anchor"], w["c"], d, xh, w["lo"], w["off"], t[w["lo"] : w["hi"] + LENGTH]) for w in wanted]
        for at in range(0, len(rows), 20_000):
            c = list(zip(*rows[at : at + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "c", "d", "xh", "lo", "off", "part"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a hot anchor's segments with its hash."""
    for b in batches:
        for anchor, c, d, xh, lo, off, part in zip(*(b.column(i).to_pylist() for i in range(7))):
            h = Rolling(np.frombuffer(part, np.uint8)).all(LENGTH).view(np.int64)
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(h), pa.array(np.full(n, c)), pa.array(np.full(n, d)), pa.array(np.full(n, xh)), pa.array(np.arange(lo, lo + n, dtype=np.int64))], ["anchor", "h", "c", "d", "xh", "lo"])


def keyed(docs: DataFrame, *more) -> DataFrame:
    """(d, xh, body) and more of each row: d and xh tell documents apart (rows that share both are equal), body is the text's bytes."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1)).alias("d"), F.xxhash64(body).alias("xh"), body.alias("body"), *more)


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(d, xh, spans): for each document with repeats, intervals of bytes that cover them; they may overlap."""
    k = keyed(docs)
    found = cut(k.mapInArrow(_scan, _SEGMENT), "ri-segments")
    twice = found.groupBy("anchor").agg(F.count("*").alias("m"), (F.min("seg") != F.max("seg")).alias("differ")).where("m > 1").drop("m")
    again = cut(found.join(twice, "anchor"), "ri-again")
    drop(found)
    tidy(docs.sparkSession)
    one = again.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.first("differ").alias("differ"), F.min(F.struct("d", "xh", "lo", "hi", "off")).alias("r"))
    one = cut(one.select("anchor", "seg", "c", "differ", "r.*"), "ri-classes")
    whole = again.join(one.where("c > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("d", "xh", F.col("lo").cast("long"), (F.col("hi") + LENGTH).cast("long").alias("hi"))
    ask = one.where("differ").groupBy("d", "xh").agg(F.collect_list(F.struct("anchor", "c", "lo", "hi", "off")).alias("wanted"))
    texts = k.join(ask, ["d", "xh"]).dropDuplicates(["d", "xh"]).select("d", "xh", "body", "wanted")
    parts = cut(texts.mapInArrow(_slices, "anchor long, c long, d long, xh long, lo long, off long, part binary"), "ri-parts")
    tidy(docs.sparkSession)
    sizes = parts.groupBy("anchor").agg(F.sum(F.octet_length("part")).alias("bytes"))
    big = cut(sizes.where(F.col("bytes") > hot).select("anchor"), "ri-hot")
    total = parts.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0]
    calm = parts.join(big, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(total // BUCKET + 1)))
    marks = calm.groupBy("bucket").applyInArrow(lambda t: _bucket(t), _MARK)
    w = None
    if not big.isEmpty():
        w = cut(parts.join(big, "anchor", "left_semi").mapInArrow(_windows, "anchor long, h long, c long, d long, xh long, lo long"), "ri-windows")
        more = w.groupBy("anchor", "h").agg(F.sum("c").alias("n")).where("n > 1").select("anchor", "h")
        marks = marks.union(w.where("c = 1").join(more, ["anchor", "h"], "left_semi").select("d", "xh", "lo", (F.col("lo") + LENGTH).alias("hi")))
    spans = cut(marks.union(whole).groupBy("d", "xh").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "ri-spans")
    for used in (again, one, parts, big, w):
        drop(used)
    tidy(docs.sparkSession)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def rest(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(body[at:lo])
        at = hi
    return b"".join([*out, body[at:]])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, body, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            body, spans = body.as_py(), merged(spans)
            rows.append((doc, len(body), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(rest(body, spans)).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    j = keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(repeats(docs), ["d", "xh"], "left")
    return j.select("doc_id", "body", "spans").mapInArrow(_measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text (a character cut in two goes whole) and n_chars, where there is one, made to fit."""

    @F.pandas_udf("string")
    def left(body, spans):
        return pd.Series([None if s is None else rest(bytes(x), merged(list(s))).decode("utf-8", "ignore") for x, s in zip(body, spans)], dtype=object)

    j = keyed(docs, F.struct(*docs.columns).alias("row")).drop("body").join(repeats(docs), ["d", "xh"], "left")
    # the bytes are made after the join, of documents with repeats only: the shuffle carries the text once
    text = F.col("row")["text"]
    body = F.when(F.col("spans").isNotNull(), F.encode(text, "UTF-8"))
    j = j.withColumn("t", F.when(F.col("spans").isNotNull(), left(body, "spans")).otherwise(text))
    new = {"text": F.col("t"), "n_chars": F.length("t").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return j.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
