"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, repeating; their targets share the total of all
sizes by weight, stop at REPEATS times the source's size, and what is left over is shared again among the others.
The mix is a row of slots of equal tokens. Slot k gets the point frac((k + 1/2) * golden ratio), which falls into the
interval of one source on the cumulative targets; its rank among that source's slots names the block of the source's
shuffled, endlessly repeated stream that it takes. Every prefix of the mix is then near the target weights.

Documents are shuffled by md5(seed:doc_id). Their places in the stream come from sums over 65,536 buckets of that hash, in two
steps of 256, and running sums inside a bucket, so that a source with a third of all rows is never in one task. A block grows
with the corpus (SLOTS) only as far as every source keeps a target of FEW blocks. Ranks of slots are running counts inside
runs of RUN slots, on top of sums of the runs before. Sources are a dimension of a few rows.

Null and empty texts have size 0 and are not taken. Null doc_ids count as one id. Repeated rows are separate documents
that follow one another. An empty table gives an empty result. Extra columns are kept by take(), whatever they are called,
and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, words_column

WEIGHTS = (5, 2, 1)
REPEATS = 3
SLOTS = 1 << 20
LEAST_BLOCK = 16
FEW = 64
RUN = 4096
GOLDEN = 0.6180339887498949
SEED = "mix"


def _key(source) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(source, key, size, h, b) of each row, and more: h is the shuffle key, b its bucket."""
    h = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select(F.col("source").cast("string").alias("source"), F.size(words_column(F.col("text"))).cast("long").alias("size"), h.alias("h"), *more)
    return d.withColumns({"key": _key(F.col("source")), "b": F.substring("h", 1, 4)})


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, lo, hi): one row per source; lo and hi are its interval of [0, 1)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", w)
    fill = Window.orderBy(F.lit(REPEATS) * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.lit(REPEATS) * F.col("source_size")
    total = F.sum("source_size").over(Window.partitionBy())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_left": total - F.coalesce(F.sum(cap).over(before), F.lit(0)), "_weights": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)), "_p": F.row_number().over(fill)})
    s = s.withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
    # sources are filled in the order in which they reach their cap; the first that stays below it sets the level of the rest
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct(F.col("_p"), F.col("_level").alias("v")))).over(Window.partitionBy())["v"])
    s = s.withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), cap.cast("double"))))
    share = F.sum("target").over(Window.partitionBy())
    s = s.withColumn("hi", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / share)
    return s.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).select("source", "source_size", "weight", "target", "lo", "hi")


def slots(sources: DataFrame) -> tuple[DataFrame, int]:
    """(k, key): the slots of the mix with their source, and the words of a block."""
    total, least = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(LEAST_BLOCK, -(-total // SLOTS))
    if least and block * FEW > least:
        block = max(LEAST_BLOCK, int(least // FEW))
    n = round(total / block)
    cells = 1024
    x = (F.col("id") + 0.5) * GOLDEN
    points = sources.sparkSession.range(n).select(F.col("id").alias("k"), (x - F.floor(x)).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    spans = sources.where("hi > lo").select(_key(F.col("source")).alias("key"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))).alias("cell"))
    # the last interval ends at 1, or an ulp beside it; spans has a row or two per cell and source
    return points.join(F.broadcast(spans), "cell").where("x >= lo and x < hi").select("k", "key"), block


def ranked(taken: DataFrame) -> DataFrame:
    """(k, key, rank): slots with their rank among those of their source."""
    taken = taken.withColumn("run", F.floor(F.col("k") / RUN))
    per = taken.groupBy("key", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("key", "run").orderBy("k")) - 1
    return taken.withColumn("i", inside).join(per.select("key", "run", before.alias("before")), ["key", "run"]).select("k", "key", (F.col("before") + F.col("i")).alias("rank"))


def placed(d: DataFrame) -> DataFrame:
    """sized() rows with off: the words before the document in its source's stream. Rows of one h and size are in no order."""
    prior = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = d.groupBy("key", "b").agg(F.sum("size").alias("n")).withColumn("a", F.substring("b", 1, 2))
    tops = per.groupBy("key", "a").agg(F.sum("n").alias("n")).select("key", "a", prior(Window.partitionBy("key").orderBy("a")).alias("top"))
    start = per.select("key", "a", "b", prior(Window.partitionBy("key", "a").orderBy("b")).alias("start")).join(tops, ["key", "a"])
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("key", "b").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("within", inside).join(start.select("key", "b", (F.col("start") + F.col("top")).alias("start")), ["key", "b"])
    return d.withColumn("off", F.col("start") + F.col("within")).drop("start", "within")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs."""
    d = cut(sized(docs, F.col("doc_id")), "mix")
    sources = cut(targets(d), "mix-sources")
    taken, block = slots(sources)
    words = cut(taken.groupBy("key").agg((F.count("*") * block).alias("words")), "mix-slots")
    of = sources.select(_key(F.col("source")).alias("key"), "source_size", "target").join(words, "key", "left")
    p = placed(d).join(F.broadcast(of), "key")  # a row per source
    left = lambda e: F.coalesce("words", F.lit(0)) - F.col("off") - F.lit(e) * F.col("source_size")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), left(e))) for e in range(REPEATS))
    return p.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix in the order of its slots, each as often as the schedule takes it (0 to REPEATS times), with
    the columns of docs.

    A document goes to the slot that takes the block of its source's stream with the document's middle word; in a slot,
    documents keep the order of the stream. The schedule is made of hashes and sizes alone; texts are joined to it once,
    equal rows as one, and then sorted."""
    g = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    d = cut(sized(docs, g.alias("g")), "mix")
    sources = cut(targets(d), "mix-sources")
    taken, block = slots(sources)
    ranks = cut(ranked(taken), "mix-slots")
    size = F.broadcast(sources.select(_key(F.col("source")).alias("key"), "source_size"))  # a row per source
    at = placed(d.where("size > 0")).join(size, "key")
    at = at.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("pos", F.col("off") + F.floor(F.col("size") / 2) + F.col("e") * F.col("source_size"))
    at = at.select("key", F.floor(F.col("pos") / block).alias("rank"), "pos", "h", "g")
    times = cut(at.join(ranks, ["key", "rank"]).select("h", "g", "k", "pos"), "mix-times")
    for used in (d, ranks):
        drop(used)
    text = sized(docs, g.alias("g"), F.struct(*docs.columns).alias("row")).select("h", "g", "row").dropDuplicates(["h", "g"])
    return text.join(times, ["h", "g"]).orderBy("k", "pos").select("row.*")


ORACLE = f"""
with d as (
  select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '')) as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight
  from d group by source),
f as (
  select *, sum(source_size) over ()::bigint - coalesce(sum({REPEATS} * source_size) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
         sum(weight) over (w rows between current row and unbounded following)::bigint as weights, row_number() over w as pos
  from s window w as (order by {REPEATS} * source_size / weight::double, source nulls last)),
l as (select arg_min(rest::double / weights, pos) as level from f where rest::double / weights * weight <= {REPEATS} * source_size),
g as (select source, source_size, weight, least({REPEATS}.0::double * source_size, coalesce(level * weight, {REPEATS}.0::double * source_size)) as target from f, l),
c as (select *, sum(target) over (order by source nulls last rows unbounded preceding) / sum(target) over () as hi from g),
i as (select *, coalesce(lag(hi) over (order by source nulls last), 0.0) as lo from c),
b as (select greatest({LEAST_BLOCK}, ceil(sum(source_size) / {SLOTS}.0))::bigint as block, sum(source_size)::bigint as total from s),
k as (select unnest(range(round(total / block::double)::bigint)) as k from b),
x as (select (k + 0.5::double) * {GOLDEN}::double - floor((k + 0.5::double) * {GOLDEN}::double) as x from k),
n as (select source, count(*) * any_value(block) as words from x join i on x.x >= lo and x.x < hi, b group by source),
p as (select *, coalesce(sum(size) over (partition by source order by h, size, rid rows between unbounded preceding and 1 preceding), 0)::bigint as off from d)
select p.doc_id, p.size, i.source_size, i.target,
       coalesce(list_sum([greatest(0, least(p.size, coalesce(n.words, 0) - p.off - e * i.source_size)) for e in range({REPEATS})]), 0)::bigint as taken
from p join i on p.source is not distinct from i.source left join n on p.source is not distinct from n.source
"""
