"""How far the word use of a language's sources is apart, as an inverted index of corrections.

Terms are matches of ``TERM``, A-Z in lower case.  A language keeps the terms
that at least ``min_docs`` of its documents have.  With n occurrences of a term
among the total of all kept terms in a source, and V kept terms, its share is
``1 + floor(10^9 (n + 2) / (total + 2 V))``; two shares p and q are
``floor((p - q)^2 / (p + q))`` apart, and two sources by the sum over all kept
terms.  Few terms occur in both, so nothing is computed for a term and a pair
that lacks it:

* a pair starts at V times what two counts of zero give;
* a term that a source has n times adds the same correction against every source
  without it, so such postings meet the other sources as (source, n, terms);
* only postings of one term in both sources meet in a join, and add what both
  corrections together leave open.  Corrections of zero are dropped.

The work is that of the postings that two sources share and of (source, count)
times the sources of the language, not of terms times pairs.  Integers only.

Nulls: a null text, language or source is the empty one.  Repeated rows are
documents of their own.  Ties in value are ranked by the item's UTF-8 bytes.  A
source without terms, or a language without kept terms (then all values are 0),
has its pairs; a language with one source has none.  An empty table gives no
rows.  A very long text is one row, counted by one task.  Other columns of docs
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, text_bytes, written
from .words import Words, chunks, mixed

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
#: Characters that a task counts at once.
CHUNK = 8 << 20
#: Bytes that no term has become spaces, A-Z become lower case.
_TERMS = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _paired(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A hash for a word and a number; not symmetric in them, as a short word's own hash is that of a small number."""
    return mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + mixed(numbers.astype(np.uint64)))


def _counted(groups: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """For each group and term of the texts: group, term, occurrences, documents."""
    w = Words([t.translate(_TERMS) for t in texts])
    doc = w.doc_of_words()
    _, at, n = np.unique(_paired(w.hashes, doc), return_index=True, return_counts=True)
    group = groups[doc[at]]
    _, first, of, documents = np.unique(_paired(w.hashes[at], group), return_index=True, return_inverse=True, return_counts=True)
    at_first = at[first]
    terms = [w.buffer[a:b] for a, b in zip(w.starts[at_first].tolist(), w.ends[at_first].tolist(), strict=True)]
    return group[first], terms, np.bincount(of, n, len(first)).astype(np.int64), documents


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs: how often and in how many documents each source has each term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")

    def run(batches):
        for batch in batches:
            # Batches are bounded by rows and bytes; a chunk's groups get numbers of their own.
            texts = text_bytes(batch["text"])
            names = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
            for a, b in chunks(texts, CHUNK):
                known = {g: k for k, g in enumerate(dict.fromkeys(names[a:b]))}
                group, terms, n, documents = _counted(np.array([known[g] for g in names[a:b]], np.int64), texts[a:b])
                of, index = list(known), pa.array(group.astype(np.int32))
                column = lambda k: pa.DictionaryArray.from_arrays(index, pa.array([g[k] for g in of], pa.string())).cast(pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(documents.astype(np.int64))], names=["lang", "source", "term", "n", "n_docs"])

    counts = map_arrow(rows, run, "lang string, source string, term string, n long, n_docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: str, total: str, v: str = "v") -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)); null where the language keeps no terms."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(10, 0)) * ({n} + 2)) div ({total} + 2 * {v}) END")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, n_lang, first of the kept terms; first marks one posting of each term."""
    of_term = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumns({"in_docs": F.sum("n_docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": (F.min("source").over(of_term) == F.col("source")).cast("long")})
    return rows.where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "n_lang", "first")


def sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, v, lang_total, zero: of every source that occurs; zero is its share of a term it lacks."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    of_lang = Window.partitionBy("lang")
    rows = every.join(sums, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    rows = rows.withColumns({"v": F.sum("firsts").over(of_lang), "lang_total": F.sum("total").over(of_lang)})
    return rows.select("lang", "source", "total", "v", "lang_total", share("0", "total").alias("zero"))


def pairs(kept: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b, value for every two sources a < b of a language."""
    side = lambda rows, x: rows.select(*(F.col(c).alias(c if c in ("lang", "term") else f"{x}_{c}") for c in rows.columns))
    key, both_zero = ("lang", F.least("a_source", "b_source").alias("a"), F.greatest("a_source", "b_source").alias("b")), apart("a_zero", "b_zero")
    facts = known.select("lang", "source", "v", "zero")
    start = side(facts, "a").join(side(facts, "b"), "lang").where("a_source < b_source")
    start = start.select(*key, F.coalesce(F.col("a_v") * both_zero, F.lit(0)).alias("value"))
    # A source's postings of one count, against all other sources as if those had none of the terms.
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(known, ["lang", "source"])
    alike = side(alike.select("lang", "source", "zero", share("n", "total").alias("p"), "terms"), "a")
    one = alike.join(side(facts, "b"), "lang").where("a_source != b_source")
    one = one.select(*key, (F.col("a_terms") * (apart("a_p", "b_zero") - both_zero)).alias("value"))
    # Postings of one term in both.
    posted = kept.join(known, ["lang", "source"]).select("lang", "term", "source", "zero", share("n", "total").alias("p"))
    two = side(posted, "a").join(side(posted, "b"), ["lang", "term"]).where("a_source < b_source")
    two = two.select(*key, (apart("a_p", "b_p") - apart("a_p", "b_zero") - apart("a_zero", "b_p") + both_zero).alias("value"))
    summed = [x.where("value != 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (one, two)]
    return start.union(summed[0]).union(summed[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def marked_terms(kept: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, term, value of the terms that a source has more of than its language."""
    rows = kept.join(known, ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("n_lang", "lang_total")})
    return rows.where("p > q").select("lang", "source", "term", apart("p", "q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a source's language (part pair) and its top terms (part term)."""
    kept = written(postings(docs, min_docs), "postings")
    known = written(sources(docs, kept), "sources")
    found = pairs(kept, known)
    found = found.withColumn("way", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    found = found.select("lang", "way.source", "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = ranked(marked_terms(kept, known).withColumnRenamed("term", "item"), "term").where(F.col("rank") <= top)
    return ranked(found, "pair").union(terms)
