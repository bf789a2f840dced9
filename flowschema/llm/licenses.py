"""License scans by canonical digest lookup (DataFrame functions only).

A text is put into canonical form: lower case, copyright lines removed, equivalent spellings unified (licence/license,
CC BY for Creative Commons Attribution, ...), punctuation and white space reduced to single spaces. Its SHA-256 is
looked up among the digests of known licence texts by a hash join. The table of known digests is part of the
code (tens of rows), which is why it may be broadcast; documents are neither shuffled nor collected.

Whole documents are looked up, and apart from that each line that speaks of a license, since a notice in a corpus is
mostly one line of a longer document.

Defined cases: a null text counts as empty and has no license; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read, text_or_empty
from .license_texts import KNOWN

#: Applied in this order to lower-cased text; the first removes copyright lines.
RULES = (
    (r"(^|\n)[^\n\w]*(copyright|\(c\)|©)[^\n]*", "\n"),
    (r"licence", "license"),
    (r"https?://", ""),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bcc by noncommercial\b", "cc by nc"),
    (r"\bversion (\d)", "$1"),
    (r"\bv(\d)", "$1"),
    (r"^ | $", ""),
)


def canonical(c: Column) -> Column:
    out = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def known(spark: SparkSession) -> DataFrame:
    """license, digest: one row per known text."""
    rows = spark.createDataFrame(list(KNOWN), "license string, body string")
    return rows.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest")).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest (canonical form of the whole text), license (of the whole text, else null), notices (sorted
    licenses of single lines, empty if none) for every row of docs."""
    docs = pick(docs, "doc_id", "text")
    digests = F.broadcast(known(docs.sparkSession))
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: F.lower(x).rlike("licen[sc]e"))
    rows = docs.select("doc_id", F.sha2(canonical(text_or_empty()), 256).alias("text_digest"), F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    # The few known digests as one map literal: a line is a lookup, without exploding lines.
    table = digests.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("table"))
    rows = rows.join(digests, F.col("text_digest") == F.col("digest"), "left").crossJoin(F.broadcast(table))
    found = F.transform(F.filter("lines", lambda d: F.map_contains_key("table", d)), lambda d: F.col("table")[d])
    return rows.select("doc_id", "text_digest", "license", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    x = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, to in RULES:
        to = "chr(10)" if to == "\n" else "'" + to.replace("$", "\\") + "'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in KNOWN)
    line = _sql_canonical("x")
    return f"""
WITH k AS (SELECT license, sha256({_sql_canonical("body")}) AS digest FROM (VALUES {values}) v(license, body)),
d AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS text_digest,
             list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), 'licen[sc]e')),
                            lambda x: sha256({line})) AS lines FROM documents),
m AS (SELECT map(list(digest), list(license)) AS t, list(digest) AS ks FROM k)
SELECT doc_id, text_digest, license,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(lines, lambda x: list_contains(m.ks, x)), lambda x: m.t[x]))), ','), '') AS notices
FROM d LEFT JOIN k ON text_digest = digest, m
"""


SQL = _sql()
