"""Jobs over folders of files. Outputs are folders of part files, which every job reads like single files.

Options that name threads, devices or progress lines are taken and have no effect: Spark plans the tasks."""

from __future__ import annotations

import argparse
import importlib
import re
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import disorder, layers, neighbors, trajectory, validate
from .sources import fasta, pdb, tables


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in found or [])


def model_predictor(spark: SparkSession, a: argparse.Namespace) -> disorder.Predictor | None:
    """The predictor of the given tables, each one bounded by the alphabet or its bins; none without a matrix."""
    if not a.matrix:
        return None

    def matrix(path: str) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {}
        for r in tables.read_matrix(spark, path).collect():
            out.setdefault(r.aa1, {})[r.aa2] = r.e
        return out

    if not a.histogram:
        raise ValueError("a matrix needs a histogram")
    h = tables.read_histogram(spark, a.histogram).first()
    faces = {r.aa: r.freq for r in tables.read_composition(spark, a.composition).collect()} if a.composition else None
    return disorder.Predictor(matrix(a.matrix), (h.lo, h.hi, h.step, h.bins), faces, matrix(a.binding) if a.binding else None)


def loaded(name: str) -> Callable:
    """The function that module:function names."""
    module, _, f = name.partition(":")
    return getattr(importlib.import_module(module), f)


def options(a: argparse.Namespace, **more) -> validate.Options:
    how = dict(seed=a.seed, validate=not a.no_validator, mode=a.iupred_mode, smoothing=a.iupred_smoothing, threshold=a.disorder_threshold)
    return validate.Options(**how, max_fraction=a.max_disordered_fraction, max_run=a.max_disordered_run, max_mean=a.max_mean_score, max_lev=a.max_lev, **more)


def extract_pdb_sequences(spark: SparkSession, a: argparse.Namespace) -> int:
    found = layers.checkpointed(pdb.sequences(spark, a.input))
    fasta.write(found.orderBy("idx"), a.output)
    for k, v in stats.length_stats(found).first().asDict().items():
        print(f"{k}: {v}")
    return 0


def run_layers(spark: SparkSession, a: argparse.Namespace) -> int:
    n, place = a.start, a.dir.rstrip("/")
    while True:
        source, records = f"{place}/pairs_{n}_layer.tsv", f"{place}/pdb_sequences_layer_{n}.fasta"
        if not (listing(spark, source) and listing(spark, records)):
            print(f"missing {source} or {records}")
            return 1
        n += 1
        target = f"{place}/pdb_sequences_layer_{n}.fasta"
        kept = layers.checkpointed(layers.step(fasta.read(spark, records, normal=False), tables.read_pairs(spark, source)))
        fasta.write(kept.orderBy("idx"), target)
        count = kept.count()
        print(f"layer {n}: {count} records")
        if count < 2:
            return 0
        seqs = layers.checkpointed(fasta.read(spark, target, strict=bool(a.strict)))
        _, found, counts = neighbors.find_pairs(seqs, a.k, a.M)
        found = layers.checkpointed(found)
        pairs = layers.checkpointed(neighbors.pairs(seqs, found))
        tables.write_pairs(pairs, f"{place}/pairs_{n}_layer.tsv")
        tables.write_directed(found, f"{place}/directed{n}.tsv")
        size = pairs.count()
        print(f"layer {n}: {size} pairs, {counts}")
        if size <= 1:
            return 0


def run_pair_validations(spark: SparkSession, a: argparse.Namespace) -> int:
    place, pairs, seqs = a.layers_dir.rstrip("/"), None, None
    for path in listing(spark, f"{place}/pairs_*_layer.tsv"):
        if not (m := re.search(r"pairs_(\d+)_layer\.tsv$", path)):
            continue
        layer, records = int(m[1]), f"{place}/pdb_sequences_layer_{int(m[1])}.fasta"
        if not listing(spark, records):
            print(f"missing {records}, layer {layer} is left out")
            continue
        p = tables.numbered(tables.read_pairs(spark, path)).withColumn("layer", F.lit(layer)).drop("f", "line_no")
        s = fasta.read(spark, records, normal=False).select(F.lit(layer).alias("layer"), "idx", "seq")
        pairs, seqs = (p, s) if pairs is None else (pairs.union(p), seqs.union(s))
    if pairs is None:
        print("no layers")
        return 1
    how = options(a, prob=a.validator_prob, limits=validate.Limits(seconds=float(a.pair_timeout)))
    located = validate.located(validate.prefilter(pairs, a.max_lev), seqs)
    done = layers.checkpointed(validate.paths(located, None if a.no_validator else model_predictor(spark, a), how))
    out = a.out_dir.rstrip("/")
    tables.write_results(validate.results(done), f"{out}/results.tsv")
    fasta.write(validate.step_records(done.orderBy("layer", "line")), f"{out}/new_sequences.fasta")
    for r in validate.status_counts(done).orderBy("layer", "status").collect():  # a row per layer and status
        print(f"layer {r.layer}: {r.status} {r.n}")
    return 0


def debug_max_lev(spark: SparkSession, a: argparse.Namespace) -> int:
    pair = validate.farthest(tables.numbered(tables.read_pairs(spark, a.pairs)).withColumn("line_no", F.col("line")), a.max_lev)
    located = validate.located(pair, fasta.read(spark, a.fasta, normal=False).select("idx", "seq"))
    r = validate.paths(located, None if a.no_validator else model_predictor(spark, a), options(a, prob=1.0)).first()
    print(f"idx1={r.idx1} idx2={r.idx2} lev={r.lev} status={r.status} distance={r.distance}")
    for i, s in enumerate(r.steps or ()):
        print(f"{i}: {s}")
    return 0


def run_trajectory_layers(spark: SparkSession, a: argparse.Namespace) -> int:
    steps = trajectory.parsed(fasta.read(spark, a.fasta, normal=False))
    rows = layers.checkpointed(trajectory.level_rows(steps, a.max_levels).select("seq_id", "seq", "level"))
    out, model = a.out_dir.rstrip("/"), loaded(a.model)
    for (level,) in sorted(rows.select("level").distinct().collect()):  # as many as the binary logarithm of the longest one
        here, now = f"{out}/level_{level}", rows.where(F.col("level") == level)
        if not listing(spark, f"{here}/sequences.fasta"):
            fasta.write(now.orderBy("seq_id"), f"{here}/sequences.fasta", header="seq_id")
        if a.skip_existing:
            done = [tables.read_tsv(spark, p, s).select("seq_id") for n, s in (("kept", tables.KEPT), ("failed", tables.FAILED)) for p in listing(spark, f"{here}/{n}.tsv")]
            now = trajectory.pending(now, *done)
        got = layers.checkpointed(trajectory.sampled(now, model, a.num_samples, a.seed, a.rmsd_threshold))
        if fatal := got.where(F.col("status") == trajectory.FATAL).select("details").first():
            print(f"level {level}: {fatal[0]}")
            return 2
        kept, failed = trajectory.split(got)
        files = got.where("structure is not null").select(F.concat("seq_id", F.lit(".pdb")).alias("name"), F.col("structure").alias("content"))
        tables.write_files(files, f"{here}/pdbs")
        tables.write_kept(kept, f"{here}/kept.tsv", "append")
        tables.write_failed(failed, f"{here}/failed.tsv", "append")
        print(f"level {level}: {got.count()} done")
    return 0


def run_esmfold_batch(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = fasta.read(spark, a.fasta, normal=False).select("idx", F.coalesce("id", F.lit("")).alias("seq_id"), "seq")
    rows, out = rows.withColumn("name", trajectory.file_name(F.col("idx"), F.col("seq_id"))), a.out_dir.rstrip("/")
    if a.skip_existing and listing(spark, f"{out}/*.pdb"):
        rows = trajectory.pending(rows, tables.discover(spark, out, r"()\.pdb$").select("name"), key="name")
    got = layers.checkpointed(trajectory.folded(rows, loaded(a.model), a.batch_size))
    if fatal := got.where(F.col("status") == trajectory.FATAL).select("content").first():
        print(fatal[0])
        return 2
    tables.write_files(got.where("status = 'ok'"), out)
    for r in got.groupBy("status").count().orderBy("status").collect():
        print(f"{r[0]}: {r[1]}")
    return 0


def merge_trajectory_layers(spark: SparkSession, a: argparse.Namespace) -> int:
    out, records, kept, files = a.out_dir.rstrip("/"), None, None, None
    for level in listing(spark, f"{a.levels_dir.rstrip('/')}/level_*"):
        if not listing(spark, f"{level}/sequences.fasta"):
            continue
        r = fasta.read(spark, f"{level}/sequences.fasta", normal=False).select(F.col("header").alias("key"), F.col("seq").alias("value"), F.lit(level).alias("level"), "idx")
        records = r if records is None else records.union(r)
        for path in listing(spark, f"{level}/kept.tsv"):
            k = tables.read_tsv(spark, path, tables.KEPT).select(F.col("seq_id").alias("key"))
            kept = k if kept is None else kept.union(k)
        if listing(spark, f"{level}/pdbs/*.pdb"):
            p = tables.discover(spark, f"{level}/pdbs", r"()\.pdb$").select("path", "name", F.lit(level).alias("level"))
            files = p if files is None else files.union(p)
    if records is None:
        print("no levels")
        return 1
    merged = layers.checkpointed(trajectory.merge_levels(records, ["level", "idx"]))
    marks = trajectory.manifest(merged, merged.select("key").where("false") if kept is None else kept)
    both = layers.checkpointed(merged.join(marks, "key").orderBy("place"))
    fasta.write(both.where("kept = 1").select("key", F.col("value").alias("seq")), f"{out}/sequences.fasta", header="key")
    tables.write_tsv(both.select(F.col("key").alias("seq_id"), "kept"), f"{out}/manifest.tsv", header=True)
    if files is not None:  # of files of one name in several levels the last level's one stays
        tables.copy_files(files.groupBy("name").agg(F.max_by("path", "level").alias("path")), f"{out}/pdbs")
    return 0


def iupred3(spark: SparkSession, a: argparse.Namespace) -> int:
    seq, p = fasta.one_sequence(spark, a.seqfile).first().seq, model_predictor(spark, a)
    if p is None:
        raise ValueError("give --matrix and --histogram")
    scores, report = p.run(seq, a.iupred_type, a.smoothing)
    print(f"# Prediction type: {a.iupred_type}\n# Smoothing used: {a.smoothing}\n# Prediction output")
    if report:
        print(report)
    print("\t".join(["# POS", "RES", "IUPRED2", *(["ANCHOR2"] if a.anchor else []), ""]))
    print("\n".join(disorder.score_lines(seq, scores, p.anchor(seq) if a.anchor else None)))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m seqloom", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(f: Callable, unused: tuple[str, ...] = (), unused_flags: tuple[str, ...] = (), **defaults) -> argparse.ArgumentParser:
        p = jobs.add_parser(f.__name__)
        p.set_defaults(run=f)
        for name, value in defaults.items():
            p.add_argument("--" + (name if name == "M" else name.replace("_", "-")), default=value, type=type(value), dest=name)
        for name in unused:
            p.add_argument(f"--{name}", help="without effect")
        for name in unused_flags:
            p.add_argument(f"--{name}", action="store_true", help="without effect")
        return p

    def model_tables(p: argparse.ArgumentParser) -> None:
        for name in ("matrix", "histogram", "composition", "binding"):
            p.add_argument(f"--{name}", default="", help="table of the disorder predictor")

    def judged(p: argparse.ArgumentParser) -> None:
        model_tables(p)
        p.add_argument("--iupred-mode", choices=["long", "short", "glob"], default="long")
        p.add_argument("--iupred-smoothing", choices=["no", "medium", "strong"], default="no")
        p.add_argument("--no-validator", action="store_true")

    limits = {"disorder_threshold": 0.5, "max_disordered_fraction": 0.5, "max_disordered_run": 60, "max_mean_score": 0.5, "max_lev": 0, "seed": 123}
    job(extract_pdb_sequences, input="./dompdb", output="./pdb_sequences.fasta")
    job(run_layers, ("threads",), dir=".", start=4, k=12, M=500, strict=0)
    judged(job(run_pair_validations, ("threads", "backend", "progress-interval"), layers_dir="layer_outputs", out_dir="validation_outputs", validator_prob=0.5, pair_timeout=0, **limits))
    judged(job(debug_max_lev, ("log-every", "log-fails"), pairs="layer_outputs/pairs_1_layer.tsv", fasta="layer_outputs/pdb_sequences_layer_1.fasta", **limits))
    p = job(run_trajectory_layers, ("gpus",), ("stochastic",), out_dir="trajectory_levels", num_samples=5, rmsd_threshold=2.0, max_levels=0, seed=12345)
    p.add_argument("--fasta", required=True)
    p.add_argument("--model", required=True, help="module:function, called as f(seq, seed)")
    p.add_argument("--skip-existing", action="store_true")
    p = job(run_esmfold_batch, ("gpus", "chunk-size"), ("no-preload",), fasta="validation_outputs/new_sequences.fasta", out_dir="esmfold_outputs", batch_size=1)
    p.add_argument("--model", required=True, help="module:function, called without arguments, gives f(list of sequences)")
    p.add_argument("--skip-existing", action="store_true")
    job(merge_trajectory_layers, levels_dir="trajectory_levels", out_dir="trajectory_merged")
    p = job(iupred3)
    p.add_argument("seqfile")
    p.add_argument("iupred_type", choices=["long", "short", "glob"])
    p.add_argument("-a", "--anchor", action="store_true")
    p.add_argument("-s", "--smoothing", choices=["no", "medium", "strong"], default="medium")
    model_tables(p)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName(f"seqloom {a.job}").getOrCreate(), a)
