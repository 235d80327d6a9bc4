"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps at most OPEN windows. A document's full windows leave at once; its rest goes to the window that it
leaves with the least room. When none has room and no window may be opened, the fullest is filled up with the head of the
rest and emitted, and the tail is placed again. What is still open at a partition's end is merged: windows of GROUP
partitions, at most OPEN * GROUP of them, are laid end to end and cut at the window length; the last, shorter one is cut
into powers of two, which need no padding. So no sequence is padded.

Ids are those that tokenizers gives for byte_bpe_50k.json as it stands, where the string <|endoftext|> in a text is one id,
then id 0. They are made from the same vocabulary as ranks, four times as fast; the tests compare the two libraries. Null and empty texts are the single id 0. Null doc_ids stay null. Repeated rows are separate
documents. An empty table gives an empty result. Extra columns are ignored. Texts of any length: the ids of one
document are held at a time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTH = 1024
OPEN = 64
GROUP = 16
END = b"\0\0\0\0"
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, grp long, ids binary"
_encoders: dict = {}


def encoder(path: str | None = None):
    """The BPE of a ranks file; one for each worker process."""
    import public_tokenizers as public
    import tiktoken

    path = path or public.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return _encoders[path]


def ids_of(text: str | None, path: str | None = None) -> bytes:
    """Little-endian unsigned 32-bit ids of a text and of its end."""
    if not text:
        return END
    return encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() + END


class Packer:
    """The windows of one partition. emit(pieces) gets the pieces of a full window: (doc_id, start, total, ids)."""

    def __init__(self, emit, length: int = LENGTH, limit: int = OPEN):
        self.emit, self.length, self.limit = emit, length, limit
        self.free: list[int] = []
        self.held: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.length
        while total - at >= size:
            self.emit([(doc, at, total, ids[4 * at : 4 * (at + size)])])
            at += size
        while rest := total - at:
            fits = [(f, i) for i, f in enumerate(self.free) if f >= rest]
            if fits:
                _, i = min(fits)
            elif len(self.free) < self.limit:
                i = len(self.free)
                self.free.append(size)
                self.held.append([])
            else:  # the fullest takes what it can
                i = self.free.index(min(self.free))
            n = min(rest, self.free[i])
            self.held[i].append((doc, at, total, ids[4 * at : 4 * (at + n)]))
            self.free[i] -= n
            at += n
            if not self.free[i]:
                self.emit(self.held.pop(i))
                self.free.pop(i)


def merge(pieces: list[tuple], length: int = LENGTH) -> Iterator[list[tuple]]:
    """Pieces laid end to end, cut into windows of the length and then of powers of two."""
    left = sum(len(p[3]) // 4 for p in pieces)
    todo = iter(pieces)
    now = None
    while left:
        room = length if left >= length else 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, at, total, ids = now or next(todo)
            n = min(room, len(ids) // 4)
            out.append((doc, at, total, ids[: 4 * n]))
            now = (doc, at + n, total, ids[4 * n :]) if len(ids) > 4 * n else None
            room -= n
        yield out


def _rows(sequences: list[list[tuple]], first: int) -> list[tuple]:
    rows = []
    for k, pieces in enumerate(sequences):
        at = 0
        for doc, start, total, ids in pieces:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, first + k, at, None, None))
            at += len(ids) // 4
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _partition(path: str | None, length: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        ready: list[list[tuple]] = []
        packer, done = Packer(ready.append, length, limit), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, ids_of(text.as_py(), path))
                if len(ready) >= 4096:
                    yield _batch(_rows(ready, (pid << 32) + done))
                    done += len(ready)
                    ready.clear()
        rows = _rows(ready, (pid << 32) + done)
        rows += [(doc, start, len(ids) // 4, None, total, None, None, pid // GROUP, ids) for w in packer.held for doc, start, total, ids in w]
        if rows:
            yield _batch(rows)

    return run


def _merge_group(length: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        pieces = list(zip(t["doc_id"].to_pylist(), t["start"].to_pylist(), t["doc_tokens"].to_pylist(), t["ids"].to_pylist()))
        first = (1 << 62) + (t["grp"][0].as_py() << 32)
        return pa.Table.from_batches([_batch(_rows(list(merge(pieces, length)), first))])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, limit: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    placed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_partition(path, length, limit), SCHEMA), "packed")
    full = placed.where("ids is null")
    rest = placed.where("ids is not null").groupBy("grp").applyInArrow(_merge_group(length), SCHEMA)
    return full.union(rest).drop("grp", "ids")
