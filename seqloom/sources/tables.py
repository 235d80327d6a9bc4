"""TSV tables with fixed schemas, whitespace tables and file listings; their writers."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIRS = "id1 string, id2 string, idx1 int, idx2 int, len1 int, len2 int, lev int, method string"
DIRECTED = "idx int, id string, best_idx int, best_id string, lev int, candidates_examined int, score int"
RESULTS = "layer int, line int, idx1 int, idx2 int, id1 string, id2 string, status string, distance int, operations_json string, steps_count int"
KEPT, FAILED = "seq_id string, rmsd double", "seq_id string, status string, rmsd double, details string"
MANIFEST = "seq_id string, kept int"


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with line_no, the physical 1-based line; blank lines and those of under four columns are skipped but counted."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    raw = raw.withColumn("line_no", F.row_number().over(Window.partitionBy("f").orderBy("m")))
    c = F.split("value", "\t")
    at = lambda i, kind: F.get(c, F.lit(i)).cast(kind)
    lev = F.when(F.size(c) >= 7, at(6, "int"))
    return raw.where((F.trim("value") != "") & (F.size(c) >= 4)).select("f", "line_no", at(0, "string").alias("id1"), at(1, "string").alias("id2"), at(2, "int").alias("idx1"), at(3, "int").alias("idx2"), lev.alias("lev"))


def numbered(pairs: DataFrame) -> DataFrame:
    """pairs with line, the place of each line in the table: line_no, counted on from part file to part file."""
    size = pairs.groupBy("f").agg(F.max("line_no").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pairs.join(size.select("f", before.alias("_before")), "f").withColumn("line", (F.col("_before") + F.col("line_no")).cast("int")).drop("_before")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(c[0].alias("aa1"), c[1].alias("aa2"), c[2].cast("double").alias("e"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """One row: lo, hi, step and bins. The step divides by the number of bins."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("m", F.monotonically_increasing_id()).where("trim(value) <> '' and value not like '#%'").select("m", c[1].cast("double").alias("x"), F.element_at(c, -1).cast("double").alias("v"))
    out = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda r: r["v"]).alias("bins"))
    return out.withColumn("step", (F.col("hi") - F.col("lo")) / F.size("bins"))


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(c[1].alias("aa"), c[2].cast("double").alias("freq"))


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, number) of the files whose name matches, in lexicographic order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(F.col("name").rlike(pattern)).withColumn("number", F.regexp_extract("name", pattern, 1).try_cast("int")).orderBy("name")


def write_tsv(df: DataFrame, path: str, header: bool = False, mode: str = "overwrite", partition: str | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def write_directed(directed: DataFrame, path: str) -> None:
    write_tsv(directed.orderBy("idx").select([c.split()[0] for c in DIRECTED.split(", ")]), path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    write_tsv(pairs.orderBy("idx1", "idx2").select([c.split()[0] for c in PAIRS.split(", ")]), path)


def write_results(results: DataFrame, path: str) -> None:
    write_tsv(results.select([c.split()[0] for c in RESULTS.split(", ")]).orderBy("layer", "line"), path, header=True)


def _uri(path: str) -> str:
    """A path as pyarrow's file systems want it: file:/x and /x as file:///x, characters that no address may hold escaped."""
    safe = quote(path, safe="/:@?=&%+,~")
    return safe if "://" in safe else "file://" + safe.removeprefix("file:")


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """One file per row through pyarrow's file systems, from the executors; the number of files."""

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(_uri(path))
        where.create_dir(root, recursive=True)
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with where.open_output_stream(f"{root}/{n}", compression=None) as f:
                    f.write(c.encode() if isinstance(c, str) else c)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select(name, content).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_files(files: DataFrame, path: str, source: str = "path", name: str = "name") -> int:
    """Copy files into a folder from the executors; those that are not there are left out. The number of copies."""

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(_uri(path))
        to.create_dir(root, recursive=True)
        for b in batches:
            n = 0
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, at = fs.FileSystem.from_uri(_uri(p))
                if where.get_file_info(at).is_file:
                    with where.open_input_stream(at, compression=None) as f, to.open_output_stream(f"{root}/{x}", compression=None) as g:
                        while chunk := f.read(1 << 20):
                            g.write(chunk)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select(source, name).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_kept(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """seq_id and rmsd with four decimals."""
    from ..operators.trajectory import four_decimals

    write_tsv(rows.select("seq_id", four_decimals(F.col("rmsd")).alias("rmsd")), path, mode=mode)


def write_failed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """seq_id, status, rmsd with four decimals, details in one line."""
    from ..operators.trajectory import four_decimals

    write_tsv(rows.select("seq_id", "status", four_decimals(F.col("rmsd")).alias("rmsd"), F.regexp_replace(F.coalesce("details", F.lit("")), r"[\t\r\n]+", " ").alias("details")), path, mode=mode)
