"""Scalar functions on sequences and names, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The residue alphabet and the three-letter codes.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M",
    "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "ASX": "B", "GLX": "Z", "SEC": "U", "PYL": "O", "UNK": "X", "MSE": "M",
}
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalize(raw: Column, strict: bool = False) -> Column:
    """Upper-case residues; blanks and gaps dropped, other letters X. strict: null for a text that has any of them but blanks."""
    up = F.regexp_replace(F.translate(raw, _LOWER, _UPPER), r"[ \t\r\n]", "")
    if strict:
        return F.when(~up.rlike(f"[^{ALPHABET}]") & (up != ""), up)
    return F.regexp_replace(F.regexp_replace(up, r"[*-]", ""), f"[^{ALPHABET}]", "X")


def first_token(header: Column, default: str | None = None) -> Column:
    t = F.regexp_extract(header, r"^\s*(\S+)", 1)
    return F.when(t != "", t) if default is None else F.when(t != "", t).otherwise(default)


def one_letter(residue: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in THREE_TO_ONE.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(F.trim(residue))), F.lit("X"))


def sanitize(name: Column, limit: int = 200) -> Column:
    s = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, limit)
    return F.when(s == "", "seq").otherwise(s)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def header_parts(header: Column, fallback: Column) -> dict[str, Column]:
    """layer, pair and step of a steps header; absent ones are 0 and the fallback ordinal."""
    part = lambda p: F.regexp_extract(header, p, 1)
    get = lambda p, other: F.when(part(p) != "", part(p).cast("int")).otherwise(other.cast("int"))
    return {"layer": get(r"layer(\d+)", F.lit(0)), "pair": get(r"pair(\d+)", fallback), "step": get(r"step=(\d+)", fallback)}


def eta(seconds: Column) -> Column:
    """1h05m, 1m05s or 7s, cut down to whole seconds; a question mark for a negative time."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    long = F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, s % 60))
    return F.when(seconds < 0, "?").otherwise(F.coalesce(long, F.format_string("%ds", s)))


def json_text(c: Column) -> Column:
    """A string in JSON, in ASCII only: short escapes, \\uXXXX for other control and non-ASCII characters, pairs beyond 16 bits."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))

    def one(x: Column) -> Column:
        n = F.ascii(x)
        out = F.when(n > 0xFFFF, F.concat(code(F.lit(0xD800) + F.floor((n - 0x10000) / 1024)), code(F.lit(0xDC00) + (n - 0x10000) % 1024)))
        for short, value in (("b", 8), ("t", 9), ("n", 10), ("f", 12), ("r", 13)):
            out = out.when(n == value, F.lit("\\" + short))
        return out.when((n < 32) | (n > 127), code(n)).otherwise(x)

    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    other = F.array_join(F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), one), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"[^\x20-\x7F]"), other).otherwise(plain), F.lit('"'))


def ops_json(ops: Column) -> Column:
    """Edit operations as the JSON of ragged lists: strings quoted, positions bare."""
    item = lambda o: F.concat(F.lit("["), F.concat_ws(", ", json_text(o["op"]), json_text(o["a"]), json_text(o["b"]), o["pos"].cast("string")), F.lit("]"))
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(ops, item)), F.lit("]"))


def dense(df: DataFrame, out: str, order: list[str], bucket: Column) -> DataFrame:
    """df with out, the place of each row from 0 in the order of columns. bucket must not fall in that order.

    Buckets are counted, their counts summed up in one small table, and rows numbered inside each bucket, so that no task
    holds more than the table of buckets or one bucket."""
    d = df.withColumn("_bucket", bucket)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = d.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return d.withColumn("_inside", inside).join(start, "_bucket").withColumn(out, (F.col("_before") + F.col("_inside")).cast("int")).drop("_bucket", "_inside", "_before")
