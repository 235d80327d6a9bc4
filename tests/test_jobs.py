import pytest

from seqloom.functions import text
from seqloom.jobs import main
from seqloom.sources import fasta, tables

SEQS = ["ACDEFGHIKLMN", "ACDEFGHIKLMM", "ACDEFGHIKLW", "WYVTSRQPNMLK", "WYVTSRQPNMLL", "WYVTSRQPNM"]


def point_model(seq, seed):
    """PDB text with an atom per residue, the same for every seed."""
    if "W" in seq:
        raise ValueError("no W")
    return "".join(f"ATOM  {i:5d}  CA  ALA A{i:4d}    {i * 1.5:8.3f}{i * i * 0.1:8.3f}{0.0:8.3f}\n" for i in range(1, len(seq) + 1))


def batch_model():
    return lambda seqs: [point_model(s, 0) for s in seqs]


@pytest.fixture
def layer(tmp_path):
    (tmp_path / "pdb_sequences_layer_1.fasta").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(SEQS)))
    line = "s{0}\ts{1}\t{0}\t{1}\t12\t12\t{2}\tkmer_topm+lev\n"
    (tmp_path / "pairs_1_layer.tsv").write_text(line.format(0, 1, 1) + "\n" + line.format(3, 4, 1) + line.format(1, 2, 2) + line.format(4, 9, 3))
    return tmp_path


def predictor_files(d):
    (d / "m.txt").write_text("".join(f"{a} {b} {((ord(a) * 31 + ord(b) * 17) % 200 - 100) / 100}\n" for a in text.ALPHABET for b in text.ALPHABET))
    (d / "h.txt").write_text("# bins\n" + "".join(f"0 {x / 10} {1 - i / 20}\n" for i, x in enumerate(range(-10, 11))))
    (d / "c.txt").write_text("".join(f"1 {a} 0.05\n" for a in text.ALPHABET[:20]))
    return ["--matrix", f"{d}/m.txt", "--histogram", f"{d}/h.txt", "--composition", f"{d}/c.txt"]


def test_run_layers(spark, layer):
    assert main(["run_layers", "--dir", str(layer), "--start", "1", "--k", "3", "--M", "5"], spark) == 0
    ids = [r.id for r in fasta.read(spark, f"{layer}/pdb_sequences_layer_2.fasta").orderBy("idx").collect()]
    assert ids == ["s0", "s1", "s3", "s4"]
    pairs = tables.read_pairs(spark, f"{layer}/pairs_2_layer.tsv").collect()
    assert {(r.idx1, r.idx2, r.lev) for r in pairs} == {(0, 1, 1), (2, 3, 1)}
    found = tables.read_tsv(spark, f"{layer}/directed2.tsv", tables.DIRECTED).orderBy("idx").collect()
    assert [(r.id, r.best_id) for r in found] == [("s0", "s1"), ("s1", "s0"), ("s3", "s4"), ("s4", "s3")]
    assert main(["run_layers", "--dir", str(layer), "--start", "7"], spark) == 1


def test_validations_trajectories_and_merge(spark, layer):
    out = f"{layer}/out"
    assert main(["run_pair_validations", "--layers-dir", str(layer), "--out-dir", out, "--no-validator", "--threads", "4"], spark) == 0
    r = tables.read_tsv(spark, f"{out}/results.tsv", tables.RESULTS, header=True).orderBy("line").collect()
    assert [(x.line, x.status, x.distance, x.steps_count) for x in r] == [(1, "found", 1, 2), (3, "found", 1, 2), (4, "found", 2, 3), (5, "invalid_index", None, 0)]
    steps = fasta.read(spark, f"{out}/new_sequences.fasta", normal=False).orderBy("idx").collect()
    assert steps[0].header == "layer1|pair1|idx1=0|idx2=1|step=0|distance=1" and steps[0].seq == SEQS[0] and len(steps) == 7
    # only the path of three steps has a midpoint
    levels = f"{layer}/levels"
    job = ["run_trajectory_layers", "--fasta", f"{out}/new_sequences.fasta", "--out-dir", levels, "--model", "tests.test_jobs:point_model", "--num-samples", "2"]
    assert main(job, spark) == 0
    name = "layer1|pair4|step=1|pos=1|level=1"
    both = [x for n, s in (("kept", tables.KEPT), ("failed", tables.FAILED)) for x in tables.read_tsv(spark, f"{levels}/level_1/{n}.tsv", s).collect()]
    assert [x.seq_id for x in both] == [name]
    assert main([*job, "--skip-existing"], spark) == 0
    again = [x for n, s in (("kept", tables.KEPT), ("failed", tables.FAILED)) for x in tables.read_tsv(spark, f"{levels}/level_1/{n}.tsv", s).collect()]
    assert again == both
    assert main(["merge_trajectory_layers", "--levels-dir", levels, "--out-dir", f"{layer}/merged"], spark) == 0
    m = tables.read_tsv(spark, f"{layer}/merged/manifest.tsv", tables.MANIFEST, header=True).collect()
    assert [(x.seq_id, x.kept) for x in m] == [(name, 1)]
    assert len(list((layer / "merged" / "pdbs").glob("*.pdb"))) == sum("rmsd" in x and "status" not in x for x in both)
    assert main(["merge_trajectory_layers", "--levels-dir", f"{layer}/none", "--out-dir", f"{layer}/merged"], spark) == 1


def test_structures_in_batches(spark, layer):
    job = ["run_esmfold_batch", "--fasta", f"{layer}/pdb_sequences_layer_1.fasta", "--out-dir", f"{layer}/pdbs", "--model", "tests.test_jobs:batch_model"]
    assert main(job, spark) == 0
    names = sorted(p.name for p in (layer / "pdbs").glob("*.pdb"))
    assert names == ["00000000_s0.pdb", "00000001_s1.pdb"]
    assert main([*job, "--skip-existing"], spark) == 0
    assert sorted(p.name for p in (layer / "pdbs").glob("*.pdb")) == names


def test_longest_pair_and_scores(spark, layer, capsys):
    files = predictor_files(layer)
    where = ["--pairs", f"{layer}/pairs_1_layer.tsv", "--fasta", f"{layer}/pdb_sequences_layer_1.fasta"]
    assert main(["debug_max_lev", *where, "--no-validator", "--max-lev", "2"], spark) == 0
    assert "idx1=1 idx2=2 lev=2 status=found distance=2" in capsys.readouterr().out
    (layer / "one.seq").write_text(">x\n" + "".join(SEQS[:3]) + "\n")
    assert main(["iupred3", f"{layer}/one.seq", "long", "-a", "-s", "no", *files], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[3] == "# POS\tRES\tIUPRED2\tANCHOR2\t" and len(lines) == 4 + 35 and lines[4].split("\t")[:2] == ["1", "A"]
    with pytest.raises(ValueError):
        main(["iupred3", f"{layer}/one.seq", "long"], spark)


def test_extraction(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdb").write_text("SEQRES   1 A    3  ALA GLY MSE\n")
    assert main(["extract_pdb_sequences", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out.fasta"], spark) == 0
    assert [(r.id, r.seq) for r in fasta.read(spark, f"{tmp_path}/out.fasta").collect()] == [("a|chain:A", "AGM")]
    assert "n: 1" in capsys.readouterr().out


def test_failures_take_one_line(spark, tmp_path):
    rows = spark.createDataFrame([("a", "error", float("inf"), "one\n\ttwo"), ("b", "bad_rmsd", 2.5, None)], tables.FAILED)
    tables.write_failed(rows.coalesce(1), str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ["a\terror\tinf\tone two", "b\tbad_rmsd\t2.5000\t"]
