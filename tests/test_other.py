import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import stats, text
from seqloom.operators import disorder as D, trajectory as T, validate as V
from seqloom.operators.editpath import SCHEMA, kabsch_rmsd
from seqloom.plans import catalog
from seqloom.sources import fasta, pdb, tables


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">id1 more\nacd\nE-F*\n\n>id2\nBZ U\n")
    r = fasta.read(spark, str(tmp_path / "a.fasta")).collect()
    assert [(x.idx, x.id, x.header, x.seq, x.len) for x in r] == [(0, "id1", "id1 more", "ACDEF", 5), (1, "id2", "id2", "XXX", 3)]
    raw = fasta.read(spark, str(tmp_path / "a.fasta"), normal=False).collect()
    assert [x.seq for x in raw] == ["acdE-F*", "BZ U"]
    with pytest.raises(Exception, match="bad FASTA"):
        fasta.read(spark, str(tmp_path / "a.fasta"), strict=True).collect()
    fasta.write(fasta.read(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert fasta.read(spark, str(tmp_path / "out")).count() == 2
    assert fasta.one_sequence(spark, str(tmp_path / "a.fasta")).first().seq == "acdE-F*BZ U"


def test_fasta_lines_keep_digits(spark, tmp_path):
    """Lines that begin or end with the digit of their own place, and blanks at both ends."""
    (tmp_path / "a.fasta").write_text(">a\n0AC0\n1DE1\n  2F2 \n>b\nW10\n")
    read = lambda **kw: [(x.seq, x.len) for x in fasta.read(spark, str(tmp_path / "a.fasta"), **kw).orderBy("idx").collect()]
    assert read(normal=False) == [("0AC01DE12F2", 11), ("W10", 3)]
    assert read() == [("XACXXDEXXFX", 11), ("WXX", 3)]


def test_pairs_keep_physical_lines(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("a\tb\t0\t1\t3\t4\t2\tm\n\nx\ty\n c\td\t2\t3\n")
    r = tables.read_pairs(spark, str(tmp_path / "p.tsv")).orderBy("line_no").collect()
    assert [(x.line_no, x.idx1, x.lev) for x in r] == [(1, 0, 2), (4, 2, None)]


def test_pdb(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("SEQRES   1 A    3  ALA GLY FOO\nSEQRES   1      2  CYS TRP\n")
    atom = "ATOM      1  CA  {} {}{:4d}    \n"
    (tmp_path / "b.pdb").write_text(atom.format("ALA", "B", 1) + atom.format("GLY", "B", 1) + atom.format("SER", "B", 2) + "HETATM    9  O   HOH B   3    \n")
    r = pdb.sequences(spark, str(tmp_path)).collect()
    assert [(x.id, x.seq) for x in r] == [("a|chain:A", "AGX"), ("a|chain:_", "CW"), ("b|chain:B", "ASX")]


def test_matrix_and_histogram(spark, tmp_path):
    (tmp_path / "m").write_text("A C 0.5\nC A -1\n")
    (tmp_path / "h").write_text("# c\n1 0.0 0.9\n2 0.5 0.4\n3 1.0 0.1\n")
    assert tables.read_matrix(spark, str(tmp_path / "m")).count() == 2
    h = tables.read_histogram(spark, str(tmp_path / "h")).first()
    assert (h.lo, h.hi, h.bins) == (0.0, 1.0, [0.9, 0.4, 0.1]) and h.step == pytest.approx(1 / 3)


def test_percentiles(spark):
    d = spark.createDataFrame([(1,), (2,), (4,)], "len int")
    r = stats.length_stats(d).first()
    assert (r.n, r.median_len, r.p25) == (3, 2.0, 1.5)
    assert np.isnan(d.where("len > 9").agg(stats.percentile(F.col("len"), 50)).first()[0])


def test_bisection():
    assert [T.bisection(n) for n in (2, 3, 5, 6)] == [[], [[1]], [[2], [1, 3]], [[2], [1, 3], [4]]]


def test_kernel_equals_windows(spark):
    s = catalog.seqs(spark, "/root/testdata/sf0.001")
    long = D.scores(s, catalog.matrix(spark), catalog.histogram(spark)).orderBy("idx", "pos").toPandas()
    p = catalog.predictor()
    for idx, part in list(long.groupby("idx"))[:5]:
        seq = "".join(part.aa)
        np.testing.assert_allclose(p.energy(seq, 100), part.energy, atol=1e-9)
        np.testing.assert_allclose(p.score(seq, smoothing="no"), part.score, atol=1e-9)


def test_smoothing_keeps_polynomials():
    x = np.arange(40) / 40
    y = 1 + x - 3 * x**3 + x**5
    np.testing.assert_allclose(D.savitzky_golay(y), y, atol=1e-8)
    with pytest.raises(ValueError):
        D.savitzky_golay(x[:10])


def test_redox_regions_and_text():
    r, p = np.full(60, 0.2), np.full(60, 0.2)
    r[10:30] = 0.9
    r[34:52] = 0.9
    assert D.redox_regions(r, p) == [(10, 51)]
    assert "ABCDE fgh".replace(" ", "") in D.globular_text("abcdefgh", [(0, 4)]).replace(" ", "")


def test_rmsd():
    a = np.random.default_rng(0).normal(size=(9, 3))
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    assert kabsch_rmsd(a, a @ turn + 5) == pytest.approx(0, abs=1e-7)
    assert T.rmsd(a[:0], a) == float("inf")


def test_validation_statuses(spark):
    p = spark.createDataFrame([(3, 1, 0, 1, "x", "y", 2, "AB", "CD"), (3, 2, 0, 9, "x", "z", None, "AB", None)], "layer int, line int, idx1 int, idx2 int, id1 string, id2 string, lev int, a string, b string")
    v = V.paths(p, None, V.Options(validate=False))
    r = {x.line: x for x in V.results(v).collect()}
    assert r[1].status == "found" and r[1].distance == 2 and r[1].steps_count == 3 and json.loads(r[1].operations_json)[0][0] == "replace"
    assert r[2].status == "invalid_index" and r[2].operations_json is None
    assert V.step_records(v).first().header == "layer3|pair1|idx1=0|idx2=1|step=0|distance=2"
    assert V.prefilter(p, 1).count() == 1 and V.prefilter(p, 0).count() == 2
    flips = [V.coin(1, 2, 0.5, 123)() for _ in range(2)]
    assert flips[0] == flips[1]


def test_ops_json(spark):
    d = spark.createDataFrame([([("replace", 'a"', "b\\", None), ("swap", None, None, 3)],)], "ops array<struct<op: string, a: string, b: string, pos: int>>")
    assert json.loads(d.select(text.ops_json(d.ops)).first()[0]) == [["replace", 'a"', "b\\"], ["swap", 3]]


def test_sampling_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "AAAA"), ("k2", "CC")], "seq_id string, seq string")

    def predict(seq, seed):
        if seq == "CC":
            raise RuntimeError("no model")
        return np.ones((4, 3)) * np.arange(4)[:, None]

    r = {x.seq_id: x for x in T.sampled(rows, predict, 3).collect()}
    assert r["k1"].status == "ok" and r["k2"].status == "error"
    n = tables.write_files(rows.select(T.file_name(F.lit(7), F.col("seq_id")).alias("name"), F.col("seq").alias("content")), str(tmp_path / "f"))
    assert n == 2 and sorted(os.listdir(tmp_path / "f")) == ["00000007_k1.pdb", "00000007_k2.pdb"]


def test_stream_resumes(spark, tmp_path):
    from seqloom.streaming.resume import follow

    got = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), "id long", str(tmp_path / "cp"), lambda b, i: got.append(b.count())).awaitTermination()
    assert sum(got) == 3
    assert SCHEMA


def test_walk_has_a_point_per_residue():
    from seqloom.plans import catalog

    assert catalog._walk("ab" * 500, 1).shape == (1000, 3)
