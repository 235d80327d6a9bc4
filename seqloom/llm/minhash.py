"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard on the full shingle sets.

Two permutations make a whole signature: the first (sigma) spreads a shingle over the ring of 2**32 points, the second (pi),
circularly shifted by k, gives coordinate k as min pi(sigma(s) + k). BANDS bands of ROWS coordinates make buckets: a pair
of similarity 0.75 shares no bucket with probability (1 - 0.75**ROWS)**BANDS, 4e-6 here.

Documents with equal sets are one class with an id of its own, represented by the row of the smallest doc_id and text hash, so
exact copies cost one row. Inside a bucket no pairs are listed. First every class is compared with the bucket's smallest (a star); links give components. Only buckets
that still hold two components go on, and of those only pairs across components matter. Tasks that hold a part of a bucket
(at most BLOCK classes of its largest component, and BLOCK others) compare sizes and 4 bits of each of SKETCH coordinates
in memory and let out pairs of which AGREE coordinates agree (EARLY_AGREE of the first EARLY, to begin with); a pair of
similarity 0.75 fails that with probability 5e-6. A pair leaves by its first common band only, which is told by 32 bits of
the buckets. Those pairs are confirmed on full sets. Links inside a component are not looked for: they change no component.

Words are ASCII-lowered and split at ASCII white space. Null and empty texts have an empty set and link with nothing. Rows
with null doc_id link with nothing and have a null component. Repeated rows link with each other by their equal sets. Rows that
share a doc_id but not the text are documents of their own: each has the component of its own text, and keep_first() keeps
them apart. An empty table gives an empty result. Extra columns are ignored by near_duplicates() and kept by keep_first(),
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, cut, drop, lower_words, mix64, own, tidy

WIDTH, ROWS, BANDS, BLOCK, PERCENT = 5, 6, 64, 2048, 75
# at 0.75, coordinates agree in 4 bits with probability 0.7656; both bounds lie 4.5 standard deviations below that
SKETCH, AGREE, EARLY, EARLY_AGREE = 1024, 723, 256, 165
_ALIKE = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)  # of two coordinates, by their xor
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_words = WordHash()


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of all runs of width words; of the whole sequence if it is shorter."""
    w = _words.of(lower_words(text or b""))
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    s = np.full(n, width, np.uint64)
    for j in range(width):
        s += w[j : j + n] * _FACTORS[j]
    return np.unique(mix64(s))


def signature(s: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """size coordinates from the permutation pi shifted circularly by 0 .. size - 1."""
    sigma = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    # pi(x) = f(x * m): the product of the shift is added, not the shift multiplied
    sigma *= np.uint32(0x7FEB352D)
    shift = (np.arange(size, dtype=np.uint32) * np.uint32(0x7FEB352D))[:, None]
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 512):
        y = sigma[None, at : at + 512] + shift
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        np.minimum(low, y.min(axis=1), out=low)
    return low


def _bands(low: np.ndarray) -> list[int]:
    rows = np.ascontiguousarray(low[: BANDS * ROWS].reshape(BANDS, ROWS))
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=b) - (1 << 63) for b, r in enumerate(rows)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests, bands = [], [], []
        for t in b.column(2).cast(pa.binary()):
            s = shingles(t.as_py())
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(_bands(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "xh", "n_shingles", "digest", "bands"])


def sketch(s: np.ndarray) -> bytes:
    """4 bits of SKETCH coordinates, two to a byte, then 32 bits of each bucket."""
    low = signature(s, SKETCH)
    bits = (low >> np.uint32(8)).astype(np.uint8) & np.uint8(15)
    return (bits[0::2] | bits[1::2] << np.uint8(4)).tobytes() + np.array(_bands(low), np.int64).astype(np.uint32).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["id", "n", "sketch"])


def _likely(t: pa.Table) -> pa.Table:
    """Pairs across components of a part of a bucket whose sizes and sketches allow the similarity. side: 0 for both sides
    of the part, else 1 or 2."""
    ids, n, c, side = (t[x].to_numpy() for x in ("id", "n", "component", "side"))
    band = t["band"][0].as_py()
    raw = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
    bits, early = np.ascontiguousarray(raw[:, : SKETCH // 2]), np.ascontiguousarray(raw[:, : EARLY // 2])
    before = np.ascontiguousarray(raw[:, SKETCH // 2 : SKETCH // 2 + 4 * band]).view(np.uint32)
    left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    out = []
    for i in left:
        near = right[(c[right] != c[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))]
        near = near[_ALIKE[early[near] ^ early[i]].sum(1, dtype=np.int32) >= EARLY_AGREE]
        # a pair meets in many buckets: that of its first common band lets it out
        near = near[~(before[near] == before[i]).any(1)]
        near = near[_ALIKE[bits[near] ^ bits[i]].sum(1, dtype=np.int32) >= AGREE]
        out.append(np.stack([np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near])]))
    a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for b in batches:
        common, union = [], []
        for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())):
            if a != last:
                last, left = a, shingles(ta.as_py())
            right = shingles(tb.as_py())
            n = len(np.intersect1d(left, right, assume_unique=True))
            common.append(n)
            union.append(len(left) + len(right) - n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"])


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) -> with the size of the intersection and the union, cut. Sorted by a on arrival, so a's set is made once."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "ta", "tb")
    return cut(both.mapInArrow(_jaccard, "a long, b long, common long, total long"), "minhash-pairs")


_linked = f"100 * common >= {PERCENT} * total and total > 0"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, xh, text): xh tells the texts apart that share a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("xh"), "text")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, xh, n_shingles, digest, bands; per class of equal sets with a doc_id: id, digest, doc_id and xh of its first row, bands."""
    scanned = cut(_texts(docs).mapInArrow(_scan, "doc_id long, xh long, n_shingles long, digest binary, bands array<long>"), "minhash-scan")
    known = scanned.where("digest is not null and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min(F.struct("doc_id", "xh")).alias("r"), F.first("bands").alias("bands"))
    # ids are made once, in the written table
    return scanned, cut(reps.select(F.monotonically_increasing_id().alias("id"), "digest", "r.doc_id", "r.xh", "bands"), "minhash-classes")


def link(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, component) of the classes that are linked to another."""
    spark = docs.sparkSession
    rows = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    # counts are summed before the shuffle, and only the buckets of two or more are joined back
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("centre")).where("m > 1").drop("m")
    members = cut(rows.join(shared, "bucket"), "minhash-buckets")
    tidy(spark)
    wanted = members.select("id").distinct().join(reps.select("id", "doc_id", "xh"), "id")
    texts = _texts(docs).where("text is not null and doc_id is not null").join(wanted.hint("merge"), ["doc_id", "xh"])
    texts = cut(texts.dropDuplicates(["doc_id", "xh"]).select("id", "text"), "minhash-texts")
    tidy(spark)
    star = _compare(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), texts)
    links = cut(star.where(_linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "minhash-star")
    drop(star)
    found = cut(components(links), "minhash-components")
    rows = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    parts = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.max("k").alias("majors"), (F.sum("k") - F.max("k")).alias("minors")).where("minors > 0")
    ids = open_ = cut(rows.join(parts, "bucket").select("bucket", "band", "id", "component", (F.col("component") != F.col("major")).alias("minor"), F.ceil(F.col("minors") / BLOCK).alias("nb"), F.ceil(F.col("majors") / BLOCK).alias("mb")), "minhash-open")
    open_texts = texts.join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
    drop(members)
    sketches = cut(open_texts.select("id", "text").mapInArrow(_sketches, "id long, n long, sketch binary"), "minhash-sketches")
    h = F.xxhash64("id")
    # part (i, j) holds the blocks i and j of the others, part (i, nb + j) block i of the others and block j of the largest
    mine, theirs = F.pmod(h, F.col("nb")), F.pmod(h, F.col("mb"))
    place = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    among = F.transform(F.sequence(F.lit(0), F.col("nb") + F.col("mb") - 1), lambda j: F.when(j >= mine, place(mine, j, F.when(j == mine, 0).otherwise(1))).otherwise(place(j, mine, F.lit(2))))
    across = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: place(i, F.col("nb") + theirs, F.lit(2)))
    ids = ids.join(sketches, "id").select("bucket", "band", "id", "n", "component", "sketch", F.explode(F.when(F.col("minor"), among).otherwise(across)).alias("p"))
    # small but slow to compare: a stated number of partitions keeps adaptive execution from merging them into one task
    parted = ids.select("bucket", "band", "p.i", "p.j", "p.side", "id", "n", "component", "sketch").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")
    pairs = parted.groupBy("bucket", "i", "j").applyInArrow(lambda t: _likely(t), "a long, b long").distinct()
    likely = cut(pairs, "minhash-likely")
    more = _compare(likely, texts)
    out = components(links.union(more.where(_linked).select(F.col("a").alias("u"), F.col("b").alias("v"))))
    for used in (texts, found, open_, sketches, likely, more, links):
        drop(used)
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, xh, n_shingles, digest, and c and cx, the first row of its group; both null without a class."""
    scanned, reps = classes(docs)
    m = reps.drop("bands").join(link(docs, reps), "id", "left")
    top = m.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "xh")).alias("w"))
    m = m.join(top, "component", "left")
    label = m.select("digest", F.coalesce("w.doc_id", "doc_id").alias("c"), F.coalesce("w.xh", "xh").alias("cx"))
    rows = scanned.drop("bands")
    known = rows.where("digest is not null and doc_id is not null").join(label, "digest", "left").select(*rows.columns, "c", "cx")
    none = F.lit(None).cast("long")
    return known.union(rows.where("digest is null or doc_id is null").select("*", none.alias("c"), none.alias("cx")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    c = F.coalesce("c", "doc_id")
    return _labelled(docs).select("doc_id", "n_shingles", c.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == c)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns: the row of the smallest doc_id (of several texts of it, that of the
    smallest hash), once even if the row is repeated. Rows with null doc_id all stay."""
    d, x, gd, gx = own(docs, "_d", "_x", "_gd", "_gx")
    gone = _labelled(docs).where("c is not null and not (doc_id = c and xh = cx)").select(F.col("doc_id").alias(gd), F.col("xh").alias(gx)).distinct()
    mine = docs.withColumns({d: F.col("doc_id").cast("long"), x: F.xxhash64("text")})
    kept = mine.where(F.col(d).isNotNull()).join(gone, (F.col(d) == F.col(gd)) & (F.col(x) == F.col(gx)), "left_anti")
    return kept.dropDuplicates([d, x]).select(docs.columns).union(docs.where(F.col("doc_id").cast("long").isNull()))
