"""Nearest neighbours of sequences: k-mer equi-join, per-key top M, edit distance.

seqs has idx (dense from 0), id, seq, len. Candidates that share a k-mer come from an equi-join on k-mers that are counted
per sequence first; k-mers of more than df_max sequences are dropped, which also bounds the skew of the join. Candidates
without a shared k-mer fill up the top M with the lowest indices; they come from a join with the at most M + 1 lowest rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(n: int, m: int, k: int) -> None:
    if n < 2 or m <= 0 or k <= 0:
        raise ValueError(f"need two sequences and positive M and k, got {n}, {m}, {k}")


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(idx, kmer, cnt): windows of each sequence, counted."""
    w = F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda p: F.col("seq").substr(p, F.lit(k)))
    return seqs.where(F.length("seq") >= k).select("idx", F.explode(w).alias("kmer")).groupBy("idx", "kmer").agg(F.count("*").alias("cnt"))


def code(kmer: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX") -> Column:
    """Base-21 number of a k-mer modulo 2**32."""
    return F.aggregate(F.transform(F.split(kmer, ""), lambda c: digit_of(c, alphabet)), F.lit(0).cast("long"), lambda a, v: (a * 21 + v) % 4294967296)


def digit_of(c: Column, alphabet: str) -> Column:
    table = F.create_map(*[x for i, a in enumerate(alphabet) for x in (F.lit(a), F.lit(i).cast("long"))])
    return F.coalesce(F.element_at(table, c), F.lit(len(alphabet) - 1).cast("long"))


def document_frequency(counted: DataFrame) -> DataFrame:
    return counted.groupBy("kmer").agg(F.count("*").alias("df"))


def default_df_max(n: int) -> int:
    return max(2000, int(0.02 * n))


def frequent_enough(counted: DataFrame, df_max: int) -> DataFrame:
    """Counted k-mers of at most df_max sequences."""
    return counted.join(document_frequency(counted).where(F.col("df") <= df_max), "kmer")


def scores(counted: DataFrame) -> DataFrame:
    """(q, t, score): the sum over shared k-mers of the products of their counts."""
    a = counted.select(F.col("idx").alias("q"), "kmer", F.col("cnt").alias("cq"))
    b = counted.select(F.col("idx").alias("t"), "kmer", F.col("cnt").alias("ct"))
    return a.join(b, "kmer").where("q <> t").groupBy("q", "t").agg(F.sum(F.col("cq") * F.col("ct")).alias("score"))


def candidates(seqs: DataFrame, k: int, m: int, df_max: int | None = None, n: int | None = None) -> DataFrame:
    """(q, t, score, place): the top M of each sequence by score, then index."""
    n = seqs.count() if n is None else n
    check(n, m, k)
    m = min(m, n - 1)
    positive = scores(frequent_enough(kmers(seqs, k), df_max or default_df_max(n)))
    # among the M + 1 lowest there are always enough others; their number is the parameter M
    low = seqs.where(F.col("idx") <= m).select(F.col("idx").alias("t"))
    fill = seqs.select(F.col("idx").alias("q")).join(F.broadcast(low), F.col("q") != F.col("t")).select("q", "t", F.lit(0).cast("long").alias("score"))
    both = positive.union(fill).groupBy("q", "t").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))
    return both.withColumn("place", place).where(F.col("place") <= m)


def bounded(a: Column, b: Column, limit: Column) -> Column:
    """Edit distance up to a limit; limit + 1 above it."""
    d = F.levenshtein(a, b)
    return F.when(d <= limit, d).otherwise(limit + 1)


def directed(seqs: DataFrame, k: int, m: int, df_max: int | None = None) -> DataFrame:
    """Per sequence: idx, id, best_idx, best_id, lev, candidates_examined, score."""
    c = candidates(seqs, k, m, df_max)
    side = lambda x: seqs.select(F.col("idx").alias(x), F.col("seq").alias(f"s{x}"))
    size = lambda x: seqs.select(F.col("idx").alias(x), F.length("seq").alias(f"l{x}"))
    c = c.join(size("q"), "q").join(size("t"), "t").withColumn("gap", F.abs(F.col("lq") - F.col("lt")))
    # the first candidate in full; of the others only those whose lengths allow less, up to one less than the first
    first = c.where("place = 1").join(side("q"), "q").join(side("t"), "t").select("q", "t", "score", "place", F.levenshtein("sq", "st").alias("lev"), "gap")
    more = c.where("place > 1").join(first.select("q", F.col("lev").alias("top")), "q").where("gap < top").join(side("q"), "q").join(side("t"), "t")
    lev = F.expr("levenshtein(sq, st, top - 1)")
    d = first.union(more.select("q", "t", "score", "place", F.when(lev >= 0, lev).alias("lev"), "gap"))
    before = F.min("lev").over(Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("seen", (before.isNull() | (F.col("gap") < before)).cast("int"))
    best = d.groupBy("q").agg(F.min(F.when(F.col("lev").isNotNull(), F.struct("lev", "place", "t", "score"))).alias("b"), F.sum("seen").alias("candidates_examined"))
    ids = seqs.select("idx", "id")
    best = best.select(F.col("q").alias("idx"), F.col("b.t").alias("best_idx"), "b.lev", F.col("candidates_examined").cast("int"), F.col("b.score").cast("int").alias("score"))
    return best.join(ids, "idx").join(ids.select(F.col("idx").alias("best_idx"), F.col("id").alias("best_id")), "best_idx").select("idx", "id", "best_idx", "best_id", "lev", "candidates_examined", "score")


def pairs(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """Undirected pairs with ids and lengths of both ends."""
    p = found.select(F.least("idx", "best_idx").alias("idx1"), F.greatest("idx", "best_idx").alias("idx2"), "lev").dropDuplicates(["idx1", "idx2"])
    end = lambda i: seqs.select(F.col("idx").alias(f"idx{i}"), F.col("id").alias(f"id{i}"), F.length("seq").alias(f"len{i}"))
    return p.join(end(1), "idx1").join(end(2), "idx2").select("id1", "id2", "idx1", "idx2", "len1", "len2", "lev", F.lit("kmer_topm+lev").alias("method"))


def find_pairs(seqs: DataFrame, k: int = 4, m: int = 500, df_max: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Pairs, directed results, and the counts of the run."""
    n = seqs.count()
    check(n, m, k)
    found = directed(seqs, k, m, df_max)
    total = seqs.agg(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0)))).first()[0] or 0
    if not total:
        raise ValueError(f"no sequence has {k} residues")
    return pairs(seqs, found), found, {"n_sequences": n, "total_kmers": total, "k": k, "M": min(m, n - 1), "df_max": df_max or default_df_max(n)}
