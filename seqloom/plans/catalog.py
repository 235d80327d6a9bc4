"""The query catalogue: name -> plan over a folder of parquet tables, and the DuckDB SQL for the same rows.

Sequences are the whole texts of benchmark, normalised; trajectories are the conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import disorder, editpath, layers, neighbors, trajectory, validate
from ..sources import fasta, pdb, tables

K, M = 4, 20
SEARCH = editpath.Limits(nodes=2_000, tell=True)  # a stated bound of these queries; pairs that hit it have a status of their own
SHIFT = 0.35  # lifts the synthetic energies so that there are globular domains
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_NORM = "regexp_replace(regexp_replace(" + _UP + ", '[ \\t\\r\\n*-]', '', 'g'), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')"
SEQS = f"seqs as (select (row_number() over (order by item_id) - 1)::int as idx, 'item' || item_id as id, {_NORM.format('text')} as seq from benchmark)"
KMERS = f"kmers as (select idx, kmer, count(*) as cnt from (select idx, substr(seq, p, {K}) as kmer from seqs, unnest(range(1, length(seq) - {K} + 2)) as t(p)) group by all)"
SCORES = "scores as (select a.idx as q, b.idx as t, sum(a.cnt * b.cnt)::bigint as score from kmers a join kmers b on a.kmer = b.kmer and a.idx <> b.idx group by all)"
TOP = f"top as (select * from (select q, t, score, row_number() over (partition by q order by score desc, t) as place from (select a.idx as q, b.idx as t, coalesce(s.score, 0) as score from seqs a join seqs b on a.idx <> b.idx left join scores s on s.q = a.idx and s.t = b.idx)) where place <= {M})"
DIRECTED = """dist as (select q, t, score, place, levenshtein(a.seq, b.seq) as lev, abs(length(a.seq) - length(b.seq)) as gap from top join seqs a on a.idx = q join seqs b on b.idx = t),
seen as (select *, min(lev) over (partition by q order by place rows between unbounded preceding and 1 preceding) as before from dist),
best as (select q, arg_min(t, (lev, place)) as t, min(lev) as lev, arg_min(score, (lev, place)) as score, sum((before is null or gap < before)::int) as examined from seen group by q),
directed as (select q as idx, a.id, t as best_idx, b.id as best_id, lev::int as lev, examined::int as candidates_examined, score::int as score from best join seqs a on a.idx = q join seqs b on b.idx = t),
pairs as (select p.*, a.id as id1, b.id as id2, length(a.seq)::int as len1, length(b.seq)::int as len2, 'kmer_topm+lev' as method from (select distinct least(idx, best_idx) as idx1, greatest(idx, best_idx) as idx2, lev from directed) p join seqs a on a.idx = idx1 join seqs b on b.idx = idx2)"""
NN = f"with {SEQS}, {KMERS}, {SCORES}, {TOP}, {DIRECTED}"
_LETTERS = "unnest(string_split('ACDEFGHIKLMNPQRSTVWYX', ''))"
MATRIX = f"matrix as (select aa1, aa2, ((ascii(aa1) * 31 + ascii(aa2) * 17) % 200 - 100) / 100.0 as e from (select {_LETTERS} as aa1), (select {_LETTERS} as aa2))"
ENERGY = f"""with {SEQS}, {MATRIX}, long as (select idx, p - 1 as pos, substr(seq, p, 1) as aa from seqs, unnest(range(1, length(seq) + 1)) as t(p)),
energy as (select a.idx, a.pos, a.aa, coalesce(avg(coalesce(e, 0.0)::double) filter (where b.pos is not null), 0) as energy from long a left join long b on a.idx = b.idx and abs(a.pos - b.pos) between 2 and 100
           left join matrix on aa1 = a.aa and aa2 = b.aa group by all),
sm as (select *, avg(energy) over (partition by idx order by pos rows between 10 preceding and 10 following) as smooth from energy),
sc as (select *, case when smooth <= -1 + 2 * 0.04::double then 1.0::double when smooth >= 1 - 2 * 0.04::double then 0.0::double else floor((smooth + 1) * (1 / 0.04::double)) / 50.0::double end as score from sm)"""
ISLANDS = """f as (select idx, pos, pos - row_number() over (partition by idx order by pos) as g from {src} where {flag}),
isl as (select idx, min(pos) as first, max(pos) as last from f group by idx, g)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    t = text.dense(table(spark, d, "benchmark"), "idx", ["item_id"], F.floor(F.col("item_id") / 4096))
    return t.select("idx", F.concat(F.lit("item"), "item_id").alias("id"), text.normalize(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))


def matrix(spark: SparkSession, shift: float = 0.0) -> DataFrame:
    a = spark.createDataFrame([(c,) for c in text.ALPHABET], "aa1 string")
    return a.crossJoin(a.select(F.col("aa1").alias("aa2"))).withColumn("e", ((F.ascii("aa1") * 31 + F.ascii("aa2") * 17) % 200 - 100) / 100.0 + F.lit(shift))


def histogram(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1.0, 1.0, 0.04, [i / 50 for i in range(50)])], "lo double, hi double, step double, bins array<double>")


def predictor(shift: float = 0.0) -> disorder.Predictor:
    m = {a: {b: ((ord(a) * 31 + ord(b) * 17) % 200 - 100) / 100.0 + shift for b in text.ALPHABET} for a in text.ALPHABET}
    binding = {a: {b: ((ord(a) * 13 + ord(b) * 29) % 200 - 100) / 100.0 for b in text.ALPHABET} for a in text.ALPHABET}
    return disorder.Predictor(m, (-1.0, 1.0, 0.04, [i / 50 for i in range(50)]), {a: 1 / 21 for a in text.ALPHABET}, binding)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) + F.lit(0.0) for n in names})  # no negative zero


# Sources and scalar functions


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{layers.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_BODY = "'M' || replace(coalesce(text, ''), '>', ' ')"


@query(f"select (row_number() over (order by doc_id) - 1)::int as idx, 'doc' || doc_id as id, 'doc' || doc_id || ' ' || source as header, seq, length(seq)::int as len from (select doc_id, source, {_NORM.format(_BODY)} as seq from documents)")
def fasta_scan(spark, d):
    """All documents written as FASTA, their lines as they are but for the mark of headers, and read back."""
    t, path = table(spark, d, "documents"), _scratch(spark, "fasta")
    header = F.concat(F.lit("doc"), "doc_id", F.lit(" "), "source").alias("header")
    body = F.concat(F.lit("M"), F.replace(F.coalesce("text", F.lit("")), F.lit(">"), F.lit(" "))).alias("seq")
    fasta.write(t.orderBy("doc_id").select(header, body), path)
    return fasta.read(spark, path)


@query(NN + " select row_number() over (order by idx1, idx2)::int as line, id1, id2, idx1, idx2, lev from pairs")
def pairs_table(spark, d):
    path = _scratch(spark, "pairs")
    tables.write_pairs(nn_pairs(spark, d), path)
    return tables.numbered(tables.read_pairs(spark, path)).select("line", "id1", "id2", "idx1", "idx2", "lev")


@query(NN + " select * from directed")
def directed_table(spark, d):
    path = _scratch(spark, "directed")
    tables.write_directed(neighbors.directed(seqs(spark, d), K, M), path)
    return tables.read_tsv(spark, path, tables.DIRECTED)


@query(f"with {SEQS} select f.idx, f.header as id, f.header, f.seq, length(f.seq)::int as len from (select (row_number() over (order by id) - 1)::int as idx, id || '|chain:' || case when idx % 2 = 0 then 'A' else '_' end as header, seq from seqs) f")
def pdb_chains(spark, d):
    """Sequences written as PDB text, those of even idx as SEQRES records of chain A beside atoms that do not count, the others
    as two atoms a residue of a blank chain, a file each, and read back."""
    three = {v: k for k, v in text.THREE_TO_ONE.items() if k != "MSE"}
    code = F.create_map(*[F.lit(x) for kv in three.items() for x in kv])
    names, path = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.element_at(code, c)), _scratch(spark, "pdb")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 13)), lambda i: F.concat(F.lit("SEQRES     A       "), F.array_join(F.slice("_names", (i * 13 + 1).cast("int"), 13), " ")))
    atom = lambda kind, c, i, chain: F.concat(F.lit(f"ATOM         {kind:4s}"), c, F.lit(f" {chain}"), F.lpad((i + 1).cast("string"), 4, " "), F.lit("    "))
    atoms = F.flatten(F.transform("_names", lambda c, i: F.array(atom(" N", c, i, " "), atom(" CA", c, i, " "))))
    whole = F.when(F.col("idx") % 2 == 0, F.concat(rows, F.array(atom(" CA", F.lit("TRP"), F.lit(0), "A")))).otherwise(atoms)
    files = seqs(spark, d).withColumn("_names", names).select(F.concat("id", F.lit(".pdb")).alias("name"), F.array_join(whole, "\n").alias("content"))
    tables.write_files(files, path)
    return pdb.sequences(spark, path)


@query(f"select doc_id, {_NORM.format('text')} as seq, length({_NORM.format('text')})::int as len from documents")
def fasta_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))


@query("select doc_id, regexp_extract(text, '^\\s*(\\S+)', 1) as token, left(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 200) as name from documents")
def sanitize_id(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_token(F.col("text"), "").alias("token"), text.sanitize(F.col("text")).alias("name"))


@query("""with h as (select conv_id, turn, 'layer' || (conv_id % 7) || '|pair' || conv_id || '|idx1=1|idx2=2|step=' || turn || '|distance=9' as header from conversations)
select conv_id, turn, regexp_extract(header, 'layer(\\d+)', 1)::int as layer, regexp_extract(header, 'pair(\\d+)', 1)::int as pair, regexp_extract(header, 'step=(\\d+)', 1)::int as step from h""")
def header_parse(spark, d):
    h = F.format_string("layer%d|pair%d|idx1=1|idx2=2|step=%d|distance=9", F.col("conv_id") % 7, "conv_id", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", h.alias("header")).withColumns(text.header_parts(F.col("header"), F.lit(0))).drop("header")


@query("select event_id, case when s < 0 then '?' when s >= 3600 then format('{:d}h{:02d}m', s // 3600, s % 3600 // 60) when s >= 60 then format('{:d}m{:02d}s', s // 60, s % 60) else format('{:d}s', s) end as eta from (select event_id, (event_id * 7 - 50)::bigint as s from events)")
def format_eta(spark, d):
    return table(spark, d, "events").select("event_id", text.eta(F.col("event_id") * 7 - 50).alias("eta"))


_CODES = ["ALA", "MSE", "mse", " GLX ", "XLE", "SEC", "PYL", "ASX", "UNK", "HOH", "TRP", "tyr", "VAL", "GLU", "GLN", "ASN", "ASP", "LYS", ""]
_ONE = "A M M Z X U O B X X W Y V E Q N D K X".split()


@query(f"select n_nationkey, ({_ONE})[n_nationkey % {len(_ONE)} + 1] as aa from nation")
def residue_codes(spark, d):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("n_nationkey") % len(_CODES) + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", text.one_letter(code).alias("aa"))


@query("select conv_id, turn, json_quote(left(text, 300) || chr(9) || chr(34) || chr(92)) as quoted from conversations where not regexp_matches(left(text, 300), '[^\\x20-\\x7E\\n]')")
def json_strings(spark, d):
    t = F.substring("text", 1, 300)
    return table(spark, d, "conversations").where(~t.rlike(r"[^\x20-\x7E\n]")).select("conv_id", "turn", text.json_text(F.concat(t, F.lit('\t"\\'))).alias("quoted"))


# Aggregates


@query(f"""with {SEQS}, l as (select length(seq) as len from seqs)
select count(*) as n, min(len)::int as min_len, max(len)::int as max_len, round(avg(len), 9) as mean_len, median(len)::double as median_len, round(stddev_pop(len), 9) as std_len,
round(quantile_cont(len, 0.05)::double, 9) as p5, round(quantile_cont(len, 0.25)::double, 9) as p25, round(quantile_cont(len, 0.75)::double, 9) as p75, round(quantile_cont(len, 0.95)::double, 9) as p95 from l""")
def seq_length_stats(spark, d):
    return _round(stats.length_stats(seqs(spark, d)), "mean_len", "std_len", "p5", "p25", "p75", "p95")


@query(f"with {SEQS}, a as (select idx, unnest(string_split(seq, '')) as aa from seqs) select idx, aa, round(count(*) / sum(count(*)) over (partition by idx), 9) as freq from a group by idx, aa")
def residue_composition(spark, d):
    return _round(stats.composition(seqs(spark, d)), "freq")


# Nearest neighbours


@query(f"with {SEQS}, {KMERS} select * from kmers")
def kmer_counts(spark, d):
    return neighbors.kmers(seqs(spark, d), K)


@query(f"with {SEQS}, {KMERS} select kmer, count(*) as df from kmers group by kmer")
def kmer_df(spark, d):
    return neighbors.document_frequency(neighbors.kmers(seqs(spark, d), K))


@query(f"with {SEQS}, {KMERS}, d as (select kmer, count(*) as df from kmers group by kmer) select idx, kmer, cnt, df from kmers join d using (kmer) where df <= 5")
def kmer_df_filter(spark, d):
    return neighbors.frequent_enough(neighbors.kmers(seqs(spark, d), K), 5)


@query(f"with {SEQS}, k as (select idx, p, substr(seq, p, 9) as kmer from seqs, unnest(range(1, length(seq) - 7)) as t(p)) select idx, kmer, count(*) as cnt, (list_sum([(instr('ACDEFGHIKLMNPQRSTVWYX', substr(kmer, i, 1)) - 1)::hugeint * (21::hugeint ** (9 - i))::hugeint for i in range(1, 10)]) % 4294967296)::bigint as code from k group by idx, kmer")
def kmer_code_mod32(spark, d):
    return neighbors.kmers(seqs(spark, d), 9).withColumn("code", neighbors.code(F.col("kmer")))


@query(f"with {SEQS}, {KMERS}, {SCORES} select * from scores")
def kmer_score(spark, d):
    return neighbors.scores(neighbors.kmers(seqs(spark, d), K))


@query(f"with {SEQS}, {KMERS}, {SCORES}, {TOP} select * from top")
def topm_candidates(spark, d):
    return neighbors.candidates(seqs(spark, d), K, M)


@query("select distinct a.p_name as a, b.p_name as b, case when levenshtein(a.p_name, b.p_name) <= 5 then levenshtein(a.p_name, b.p_name) else 6 end::int as lev from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_name < b.p_name")
def bounded_levenshtein(spark, d):
    p = table(spark, d, "part")
    o = p.select(F.col("p_name").alias("b"), "p_brand", "p_size")
    return p.join(o, ["p_brand", "p_size"]).where("p_name < b").select(F.col("p_name").alias("a"), "b").distinct().withColumn("lev", neighbors.bounded(F.col("a"), F.col("b"), F.lit(5)))


@query(NN + " select * from directed")
def nn_directed(spark, d):
    return neighbors.directed(seqs(spark, d), K, M)


@query(NN + " select * from pairs")
def nn_pairs(spark, d):
    s = seqs(spark, d)
    return neighbors.pairs(s, neighbors.directed(s, K, M))


@query(NN + " select (row_number() over (order by idx) - 1)::int as idx, id, seq, length(seq)::int as len from seqs where idx in (select idx1 from pairs)")
def layer_step(spark, d):
    return layers.step(seqs(spark, d), nn_pairs(spark, d))


@query()
def layer_fixpoint(spark, d):
    return layers.fixpoint(seqs(spark, d), K, M)


# Pair validation


@query(NN + " select idx1, idx2, lev from pairs where lev <= 150")
def validation_prefilter(spark, d):
    return validate.prefilter(nn_pairs(spark, d), 150).select("idx1", "idx2", "lev")


def _shifted(spark, d) -> DataFrame:
    """Pairs of which some point past the end."""
    return nn_pairs(spark, d).withColumn("idx2", F.when(F.col("idx2") % 5 == 0, F.col("idx2") + 1_000_000).otherwise(F.col("idx2")))


_SHIFT = ", s as (select * replace (case when idx2 % 5 = 0 then idx2 + 1000000 else idx2 end as idx2) from pairs), v as (select s.*, a.seq as a, b.seq as b, a.seq is null or b.seq is null as invalid from s left join seqs a on a.idx = idx1 left join seqs b on b.idx = idx2)"


@query(NN + _SHIFT + " select idx1, idx2, invalid from v")
def invalid_index(spark, d):
    return validate.located(_shifted(spark, d), seqs(spark, d)).select("idx1", "idx2", validate.invalid_index().alias("invalid"))


@query(NN + _SHIFT + " select 3 as layer, case when invalid then 'invalid_index' else 'found' end as status, count(*) as n from v group by all")
def status_counts(spark, d):
    v = validate.paths(_located(spark, d, _shifted(spark, d)), None, validate.Options(validate=False))
    return validate.status_counts(v)


def _located(spark, d, pairs: DataFrame) -> DataFrame:
    line = F.row_number().over(Window.orderBy("idx1", "idx2")).cast("int")
    return validate.located(pairs.select(F.lit(3).alias("layer"), line.alias("line"), "idx1", "idx2", "id1", "id2", "lev"), seqs(spark, d))


@query()
def pair_validation(spark, d):
    """Paths between nearest neighbours under the disorder predictor."""
    options = validate.Options(prob=0.99, limits=SEARCH)
    return validate.results(validate.paths(_located(spark, d, nn_pairs(spark, d)), predictor(), options))


@query()
def random_accept(spark, d):
    v = validate.paths(_located(spark, d, nn_pairs(spark, d)), None, validate.Options(prob=0.999, limits=SEARCH))
    return v.select("idx1", "idx2", "status", "distance")


@query(NN + " select * exclude (idx1, idx2, len1, len2, method) from pairs order by lev desc, idx1, idx2 limit 1")
def farthest_pair(spark, d):
    p = nn_pairs(spark, d).withColumn("line_no", F.row_number().over(Window.orderBy("idx1", "idx2")))
    return validate.farthest(p).select("id1", "id2", "lev")


# Edit paths


def _names(spark, d) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_name").alias("a"), "p_size").distinct()
    return n.join(n.select(F.col("a").alias("b"), "p_size"), "p_size").where("a <> b").select("a", "b").distinct()


@query("""with recursive n as (select distinct a.p_name as a, b.p_name as b from part a join part b on a.p_size = b.p_size and a.p_name <> b.p_name),
r as (select a, b, 0 as i, range(0, length(b) + 1) as cur, []::bigint[] as prev from n
      union all select a, b, i + 1, list_transform(range(1, length(b) + 2), lambda p: list_min(list_transform(range(1, p + 1), lambda k: c[k] - k)) + p), cur from
      (select *, [i + 1] || list_transform(range(1, length(b) + 1), lambda j: least(cur[j + 1] + 1, cur[j] + (a[i + 1] <> b[j])::int, case when i >= 1 and j >= 2 and a[i + 1] = b[j - 1] and a[i] = b[j] then prev[j - 1] + 1 else 1000000 end)) as c from r where i < length(a)))
select a, b, cur[length(b) + 1]::int as distance from r where i = length(a)""")
def osa_distance(spark, d):
    return _names(spark, d).withColumn("distance", editpath.osa_column(F.col("a"), F.col("b")))


@query()
def edit_path(spark, d):
    return _names(spark, d).withColumn("p", editpath.path_column()(F.col("a"), F.col("b"))).select("a", "b", "p.*").withColumn("ops", text.ops_json(F.col("ops")))


@query()
def edit_path_validated(spark, d):
    ok = editpath.path_column("validated", lambda: lambda s: "ee" not in s)
    return _names(spark, d).withColumn("p", ok(F.col("a"), F.col("b"))).select("a", "b", "p.*").withColumn("ops", text.ops_json(F.col("ops")))


@query("select distinct a.p_name as a, b.p_name as b, levenshtein(a.p_name, b.p_name)::int as distance from part a join part b on a.p_size = b.p_size and a.p_name <> b.p_name")
def edit_path_plain(spark, d):
    return _names(spark, d).withColumn("p", editpath.path_column("plain")(F.col("a"), F.col("b"))).select("a", "b", "p.distance")


# Disorder


def _scored(spark, d) -> DataFrame:
    return disorder.scores(seqs(spark, d), matrix(spark), histogram(spark))


@query(ENERGY + " select idx, pos::int as pos, aa, round(energy, 9) + 0.0::double as energy from energy")
def residue_context_energy(spark, d):
    return _round(disorder.context_energy(disorder.residues(seqs(spark, d)), matrix(spark), 100), "energy")


@query(ENERGY + " select idx, pos::int as pos, aa, round(energy, 9) + 0.0::double as energy, round(smooth, 9) + 0.0::double as smooth from sm")
def moving_average(spark, d):
    e = disorder.context_energy(disorder.residues(seqs(spark, d)), matrix(spark), 100)
    return _round(disorder.moving_average(e, "energy", 10, "smooth"), "energy", "smooth")


@query(ENERGY + " select idx, pos::int as pos, aa, round((sum(energy) over w + (21 - count(*) over w) * -1.26) / 21, 9) as smooth from energy window w as (partition by idx order by pos rows between 10 preceding and 10 following)")
def edge_average(spark, d):
    e = disorder.context_energy(disorder.residues(seqs(spark, d)), matrix(spark), 100)
    return _round(disorder.moving_average(e, "energy", 10, "smooth", disorder.EDGE), "smooth").drop("energy")


@query(ENERGY + " select idx, pos::int as pos, aa, round(score, 9) as score from sc")
def histogram_score(spark, d):
    return _round(_scored(spark, d), "score").select("idx", "pos", "aa", "score")


@query(ENERGY + ", " + ISLANDS.format(src="sc", flag="score >= 0.5") + ", lr as (select idx, max(last - first + 1) as longest from isl group by idx) select s.idx, round(avg((score >= 0.5)::int), 9) as fraction, round(avg(score), 9) as mean, coalesce(any_value(longest), 0)::int as longest from sc s left join lr using (idx) group by s.idx")
def disorder_metrics(spark, d):
    return _round(disorder.metrics(_scored(spark, d), seqs(spark, d), "score", 0.5), "fraction", "mean").withColumn("longest", F.col("longest").cast("int"))


GLOB = ENERGY.replace("/ 100.0 as e", f"/ 100.0 + {SHIFT}::double as e").replace("10 preceding and 10 following", "15 preceding and 15 following") + ", " + ISLANDS.format(src="sm", flag="smooth > 0.3") + ", n as (select *, coalesce((first - lag(last) over (partition by idx order by first) >= 45)::int, 1) as new from isl), g as (select *, sum(new) over (partition by idx order by first) as grp from n), dom as (select idx, min(first)::int as first, max(last)::int as last from g group by idx, grp having max(last) - min(first) + 1 >= 35)"


@query(GLOB + " select * from dom")
def globular_islands(spark, d):
    return disorder.globular(disorder.scores(seqs(spark, d), matrix(spark, SHIFT), histogram(spark), "glob"))


@query(GLOB + """, shown as (select l.idx, string_agg(case when dom.idx is null then lower(l.aa) else l.aa end || case when l.pos + 1 = length(seq) then '' when (l.pos + 1) % 60 = 0 then chr(10) when (l.pos + 1) % 10 = 0 then ' ' else '' end, '' order by l.pos) as shown
  from long l join seqs using (idx) left join dom on dom.idx = l.idx and l.pos between dom.first and dom.last group by l.idx),
head as (select idx, count(*) as n, string_agg(format('          globular domain   {}.{}{}-{}{}', place, chr(9), first + 1, last + 1, chr(10)), '' order by place) as lines from (select *, row_number() over (partition by idx order by first) as place from dom) group by idx)
select idx, 'Number of globular domains: ' || coalesce(n, 0) || chr(10) || coalesce(lines, '') || coalesce(shown, '') as report from seqs left join head using (idx) left join shown using (idx)""")
def globular_report(spark, d):
    p = predictor(SHIFT)
    report = F.udf(lambda s: p.run(s, "glob", "no")[1])
    return seqs(spark, d).select("idx", report("seq").alias("report"))


@query()
def disorder_kernel(spark, d):
    """Array scores with polynomial and strong smoothing, the redox pair and binding scores, as means; null for sequences too
    short for the polynomial."""
    p, s = predictor(), seqs(spark, d)
    kinds = {"medium": ("score", {"smoothing": "medium"}), "strong": ("score", {"smoothing": "strong"}), "short": ("score", {"mode": "short", "smoothing": "no"}), "redox": ("redox", {"smoothing": "no"}), "anchor": ("anchor", {})}
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    out = s.select("idx", *(disorder.score_column(p, k, **how)(F.col("seq")).alias(n) for n, (k, how) in kinds.items()))
    return out.select("idx", *(F.round(mean(F.col(n)), 9).alias(n) for n in kinds))


# Trajectories and merging


def _steps(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.lit(1).alias("layer"), F.col("conv_id").alias("pair"), F.col("turn").alias("step"), F.col("turn").alias("idx"), F.col("text").alias("seq"))


@query("""with recursive o as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as pos, count(*) over (partition by conv_id) as n from conversations),
b as (select n, 0 as lo, n - 1 as hi, 1 as level from (select distinct n from o)
      union all select n, case when s = 0 then lo else (lo + hi) // 2 end, case when s = 0 then (lo + hi) // 2 else hi end, level + 1 from b, (values (0), (1)) t(s) where hi - lo > 1),
m as (select n, level, (lo + hi) // 2 as pos from b where hi - lo > 1)
select 'layer1|pair' || conv_id || '|step=' || turn || '|pos=' || pos || '|level=' || level as seq_id, level::int as level, pos::int as pos from o join m using (n, pos)""")
def trajectory_levels(spark, d):
    return trajectory.level_rows(_steps(spark, d)).select("seq_id", "level", "pos")


@query("select d.doc_id from documents d where doc_id not in (select doc_id from labels) and doc_id not in (select item_id from benchmark)")
def resume_anti_join(spark, d):
    return trajectory.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), key="doc_id")


_MERGE = "m as (select role as key, arg_max(text, (conv_id::varchar, turn)) as value, min((conv_id::varchar, turn)) as place from conversations group by role)"


@query(f"with {_MERGE} select key, value, place[1] as first_level, place[2] as first_turn from m")
def merge_last_wins(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("key"), F.col("text").alias("value"), F.col("conv_id").cast("string").alias("level"), "turn")
    return trajectory.merge_levels(c, ["level", "turn"]).select("key", "value", F.col("place.level").alias("first_level"), F.col("place.turn").alias("first_turn"))


@query("select doc_id as key, case when (select count(*) from labels where quality = 1) = 0 then 1 else (doc_id in (select doc_id from labels where quality = 1))::int end as kept from documents")
def kept_manifest(spark, d):
    kept = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return trajectory.manifest(table(spark, d, "documents").select(F.col("doc_id").alias("key")), kept)


def _walk(seq: str, seed: int):
    """A stand-in for a structure model: a seeded walk, one point per residue."""
    import numpy as np

    steps = np.random.default_rng([len(seq), sum(map(ord, seq))]).normal(size=(len(seq), 3))
    return steps.cumsum(0) + np.random.default_rng(seed).normal(scale=0.5 + len(seq) % 3, size=steps.shape)


@query()
def structure_filter(spark, d):
    rows = trajectory.level_rows(_steps(spark, d))
    return trajectory.sampled(rows, _walk, 3).withColumn("rmsd", F.round("rmsd", 9))


@query()
def rmsd(spark, d):
    v = table(spark, d, "embeddings")
    three = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 3 + 1, 3))
    p = v.select("vec_id", three.alias("p"))
    pairs = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return pairs.select("vec_id", F.round(trajectory.rmsd_column(F.col("p"), F.col("q")), 9).alias("rmsd"))
