"""What the operators share: word splitting, hashing, scratch tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space splits words; every other byte belongs to one.
SPACE = r"[\x20\x09-\x0D]+"
EDGES_A_FILE, LEAST_FILES = 200_000, 16
_MINE: list[tuple[SparkSession, str]] = []


def lower_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lowered. bytes.split() and bytes.lower() know ASCII only, as the definition does."""
    return text.lower().split()


class WordHash(dict):
    """word -> 64-bit hash, remembered for the life of a Python worker within a bound on entries."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_column(text: Column) -> Column:
    """Native array of the words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where the session names none, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not d and jvm.isDefined():
        d = jvm.get()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    if not jvm.isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    p = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex[:12]}"
    _MINE.append((spark, p))
    return p


def own(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of ours, like those given, that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and a lost executor costs no more than a reread."""
    p = scratch_path(df.sparkSession, name)
    df.write.parquet(p)
    out = df.sparkSession.read.schema(df.schema).parquet(p)
    out._seqloom_path = p
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that cut() wrote and nothing reads any more."""
    if p := getattr(df, "_seqloom_path", None):
        remove(df.sparkSession, p)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for spark, p in _MINE:
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, p)
        except Exception:  # the session may be gone at exit
            return


def _forest(batches):
    """Edges of a partition -> a spanning forest of them, each node with the smallest of its tree. Bounded by the batch."""
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        ends = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        u, v = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:  # label propagation with pointer jumping
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges, u != v -> (id, component): the smallest id that each node with an edge reaches.

    Alternates large-star and small-star steps until nothing changes; each round ends in the shared folder.
    Groups are only aggregated (min), never collected, so a hub costs a partial aggregate and a join that can be split.
    The number of edges never grows; a round writes one file per EDGES_A_FILE of them (at least LEAST_FILES), not one per
    shuffle partition, which for the few edges of late rounds would be mostly empty files.
    """
    star = cut(edges.where("u is not null and v is not null and u <> v").mapInArrow(_forest, "u long, v long"), "cc")
    files = max(LEAST_FILES, -(-star.count() // EDGES_A_FILE))
    seen = None
    while True:
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small.coalesce(files), "cc")
        now = tuple(new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        drop(star)
        star, files = new, max(LEAST_FILES, -(-now[0] // EDGES_A_FILE))
        if now == seen:
            break
        seen = now
    return star.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
