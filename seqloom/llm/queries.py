"""One query per operator over its whole table, and DuckDB SQL where it can state the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import extract, minhash, mixing, multi_index, packing, pitman_yor, pu_quality, quality_rules, run_index, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # long texts: a batch must fit in a worker
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules vote, EM weighs them, the posterior decides. Null texts count as empty and fail."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("v")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents"))


ORACLES["op9_mixing"] = mixing.ORACLE


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 5-word shingle similarity 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_minhash"] = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as h from s),
r as (select *, row_number() over (partition by doc_id order by f, h) as pos from (select *, count(*) over (partition by h) as f from x)),
prefix as (select doc_id, n, h from r where pos <= n - ceil(0.75 * n) + 1 and f > 1),
c as (select distinct a.doc_id as a, b.doc_id as b from prefix a join prefix b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
e as (select a, b from c join s sa on sa.doc_id = a join s sb on sb.doc_id = b
      where 100 * len(list_intersect(sa.s, sb.s)) >= 75 * (len(sa.s) + len(sb.s) - len(list_intersect(sa.s, sb.s)))),
both_ as (select a, b from e union all select b, a from e),
reach as (select a as id, a as seen from both_ union select reach.id, both_.b from reach join both_ on reach.seen = both_.a),
m as (select id, min(seen) as c from reach group by id)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.c, s.doc_id) as component_id, coalesce(m.c, s.doc_id) = s.doc_id as kept
from s left join m on m.id = s.doc_id
"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from their archives; intact says that length and digest hold."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


@query
def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of the held-out fold stay unread."""
    docs = table(spark, sf_dir, "documents")
    return pu_quality.scores(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur twice."""
    return run_index.measure(table(spark, sf_dir, "documents"))


@query
def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the model of the training folds."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))
