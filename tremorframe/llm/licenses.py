"""Licence scan: canonical digests of entire texts joined to known licences.

A text is brought to a canonical form: ASCII lower case; copyright notices out;
punctuation and white space to single spaces; equivalent spellings to one.  The
SHA-256 of that form is hash-joined to the digests of the known licences.  The
same is done for every line of every text, since documents often carry a notice
rather than the whole licence: the lines' digests are exploded and joined too.
No spelling rule makes what it replaces, so equal words come out equal wherever
they stand.  Built-in functions only.

The known licences are a table (license, text) of any size, a list of such
pairs, or ``KNOWN``, twenty-one texts with and without their titles and four
notices.  A whole text matches only if it is the licence and nothing else but
copyright lines, so it is mostly licence files that match that way (of the test
tables' documents none does); a notice in a document is found as a line.  Their digests are broadcast while there are at most
BROADCAST of them (some 100 bytes each); a longer list is joined by shuffling.

Nulls: a null text is the empty text; texts without a letter or digit have a
null digest and match nothing; known rows with a null name or text are left
out.  Repeated rows are judged each.  Ties: of several names with one digest the
least is given.  An empty table gives no rows.  A text's lines are an array of
its own row, so its length is bounded by a task's memory only.  Columns besides
text and those kept are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licensetexts import KNOWN
from .shared import written

#: Spellings that count as the same, anywhere in a word.
SPELLINGS = [
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authoris", "authoriz"), ("favour", "favor"), ("honour", "honor"),
    ("judgement", "judgment"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
]
#: Spellings that count as the same, over a space.
SPACED = [("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("per cent", "percent")]
VERSION = " (?:version|ver|v) ?([0-9])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright notice at the beginning of a line, up to the words that open a grant or to the end of the line.
COPYRIGHT = (
    "(^|\n)[ \t]*(?:copyright[ \t]*(?:\\(c\\)|©|[0-9]|by )|\\(c\\)[ \t]*(?:copyright|[0-9])|©)"
    "(?:[^\n]*?[ \t](permission is|redistribution and|licen[cs]ed under|released under|this software|this work|this program)\\b|[^\n]*)"
)
RESERVED = "(^|\n)[ \t]*all rights reserved"
#: ASCII other than digits, lower-case letters and the end of a line.
OTHER = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST = 100_000


def spaced(form: Column) -> Column:
    """The rules that may reach over the end of a line; words are enclosed by single spaces."""
    for a, b in SPACED:
        form = F.replace(form, F.lit(a), F.lit(b))
    return F.regexp_replace(form, VERSION, " v$1")


def lines(text: Column) -> Column:
    """The canonical form of each line, enclosed by spaces; lines without a word are single spaces."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, "$1 $2"), RESERVED, "$1")
    out = F.regexp_replace(out, OTHER, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    # Every line begins and ends with a space, and no two spaces meet.
    out = F.regexp_replace(F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" ")), " +", " ")
    return F.split(spaced(out), "\n")


def whole(canonical_lines: Column) -> Column:
    """The canonical form of the entire text of these lines."""
    return spaced(F.regexp_replace(F.concat_ws("", canonical_lines), " +", " "))


def digest(form: Column) -> Column:
    return F.when(form != " ", F.sha2(form, 256))


def known_digests(spark: SparkSession, known: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """known_digest, license: one row for each digest."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    rows = rows.select("license", digest(whole(lines(F.col("text")))).alias("known_digest")).where("license is not null and known_digest is not null")
    # Written, so that joins with it can split the rows of one digest.
    table = written(rows.groupBy("known_digest").agg(F.min("license").alias("license")), "licenses")
    return F.broadcast(table) if table.count() <= BROADCAST else table


def scan(docs: DataFrame, known: DataFrame | list[tuple[str, str]] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., digest, license (of the entire text), n_license_lines, line_licenses, is_license."""
    table = known_digests(docs.sparkSession, known)
    rows = docs.select(F.struct(*keep).alias("keep"), lines(F.coalesce("text", F.lit(""))).alias("lines"))
    # 32 bytes a line travel through the shared folder; the rows are numbered as they are written.
    found = F.transform(F.filter("lines", lambda x: x != " "), lambda x: F.unhex(F.sha2(x, 256)))
    rows = written(rows.select("keep", digest(whole(F.col("lines"))).alias("digest"), found.alias("lines"), F.monotonically_increasing_id().alias("row")), "digests")
    each = rows.select("row", F.explode("lines").alias("line")).join(table.select(F.unhex("known_digest").alias("line"), "license"), "line")
    hits = each.groupBy("row").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("license"))).alias("names"))
    named = table.withColumnRenamed("known_digest", "digest")
    out = rows.select("row", "keep", "digest").join(named, "digest", "left").join(hits, "row", "left")
    return out.select(
        *(F.col(f"keep.{c}") for c in keep), "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("names", F.lit("")).alias("line_licenses"), F.col("license").isNotNull().alias("is_license"),
    )
