"""Weak supervision for text quality, in DataFrame functions only.

Rules look at a document and vote good (+1), bad (-1) or abstain (0). Expectation-maximisation over the histogram of
vote patterns (at most 3 to the number of rules rows, whatever the corpus) estimates for each rule
how often it is right when it votes. The posterior probability of good replaces an
all-rules-must-pass filter.

Null and empty texts have no words: every count is 0 and base_failed is true. Repeated rows are judged alike.
Extra columns stay untouched, whatever they are called: a row travels as one struct column beside the columns of ours.
Long lines, long words and texts of any length are read whole. An empty table gives an empty result; EM then keeps its priors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_column

RULES = ("symbols", "pipes", "shouting", "dup_lines", "repeats", "variety", "word_length", "prose")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
PRIOR, BALANCE = 20, 0.6


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i"))))

    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))  # noqa: E731  names a value: else each use computes it anew

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]))
        return one(F.sort_array(F.transform(twice, lambda x: x["i"])), summed)

    def summed(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    # texts without a repeated window, nearly all, need no sort
    return F.when(F.coalesce(one(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(True)), F.lit(0).cast("long")).otherwise(one(pairs, covered))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, _q_*): the row of docs as a struct, the base counts and the inputs of the rules."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_q_text"))
    t = F.coalesce("_q_text", F.lit(""))
    d = d.withColumn("_q_w", words_column(F.col("_q_text"))).withColumn("_q_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # flat columns: fields of a struct would be computed anew wherever they are used
    return d.withColumns(
        {
            "_q_n_words": F.size("_q_w").cast("long"),
            "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
            "_q_n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_q_n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
            "_q_n_repeat_words": repeat_words(F.col("_q_w")),
            "_q_n_lines": F.size("_q_l"),
            "_q_n_distinct": F.size(F.array_distinct("_q_w")),
            "_q_n_upper": F.regexp_count(t, F.lit(r"[A-Z]")),
            "_q_n_ends": F.regexp_count(t, F.lit(r"[.!?](\s|$)")),
        }
    ).drop("_q_w", "_q_l", "_q_text")


def base_failed(q: str = "_q_") -> Column:
    w, r = F.col(f"{q}n_words"), F.col(f"{q}n_repeat_words")
    return (w < 20) | (100 * r > 30 * w)


def votes(q: str = "_q_") -> Column:
    """One small integer per rule: 1 good, -1 bad, 0 abstains."""
    c = lambda n: F.col(f"{q}{n}")
    w = c("n_words")
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")
    rules = {
        "symbols": vote(5 * c("n_symbols") > w),
        "pipes": vote((10 * c("n_symbols") > w) & (c("n_ends") * 25 < w)),
        "shouting": vote(2 * c("n_upper") > c("word_chars")),
        "dup_lines": vote((10 * c("n_dup_lines") > 3 * c("n_lines")) & (c("n_lines") >= 4)),
        "repeats": vote((5 * c("n_repeat_words") > w) & (2 * c("n_distinct") < w)),
        # from 2000 words on, where both bounds meet, the distinct words of a text grow with the root of its length
        "variety": vote((w >= 30) & (c("n_distinct") * 8 < w) & (4 * c("n_distinct").cast("long") * c("n_distinct") < 125 * w)),
        "word_length": vote((c("word_chars") < 2 * w) | (c("word_chars") > 20 * w)),
        "prose": vote((w >= 60) & (c("n_ends") * 150 < w), (w >= 20) & (c("n_ends") * 40 >= w)),
    }
    return F.array(*(rules[r] for r in RULES))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict:
    """EM over (votes, count) rows. Returns the log odds of the class balance, a parameter, and of each rule's accuracy.

    A rule has one accuracy: how often it is right when it votes; whether it votes says nothing. Its Beta prior counts as
    PRIOR votes, 19 in 20 of them right. A weight is never negative, so that the classes cannot swap.
    Without documents only the priors are left."""
    start = math.log(BALANCE / (1 - BALANCE))
    good = [0.01 if any(v < 0 for v in p) else 0.99 for p, _ in patterns]
    for _ in range(rounds):
        weights = []
        for j in range(len(RULES)):
            right = 0.95 * PRIOR + sum((g if p[j] > 0 else 1 - g) * c for g, (p, c) in zip(good, patterns) if p[j])
            a = right / (PRIOR + sum(c for p, c in patterns if p[j]))
            weights.append(max(0.0, math.log(a / (1 - a))))
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, start + sum(w * v for w, v in zip(weights, p)))))) for p, _ in patterns]
    return {"start": start, "weights": weights}


def posterior(model: dict, v: Column) -> Column:
    """P(good | votes)."""
    z = F.lit(model["start"])
    for j, w in enumerate(model["weights"]):
        z = z + F.lit(w) * F.get(v, F.lit(j))
    return 1 / (1 + F.exp(-z))


def learn(judged: DataFrame) -> dict:
    """judged has an array column v of votes. Collects the histogram of patterns: 3**8 rows at most."""
    return fit(sorted((tuple(r["v"]), r["c"]) for r in judged.groupBy("v").agg(F.count("*").alias("c")).collect()))


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, the base counts, base_failed, p_good and kept of each row."""
    f = features(docs, text)
    t = cut(f.select(*(F.col("row")[k].alias(k) for k in keys), *(F.col(f"_q_{c}").alias(c) for c in BASE), base_failed().alias("base_failed"), votes().alias("v")), "quality")
    p = posterior(learn(t), F.col("v"))
    return t.select("*", p.alias("p_good")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are judged good, with their columns as they were."""
    f = features(docs, text)
    t = cut(f.select("row", base_failed().alias("failed"), votes().alias("v")), "quality-docs")
    p = posterior(learn(t), F.col("v"))
    return t.where(~F.col("failed") & (p >= 0.5)).select("row.*")
