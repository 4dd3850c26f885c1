"""Groups spelling variants: words one edit apart, each pointing to a far more frequent form.

An even-partition pigeonhole join.  One edit leaves one of two halves of a word
alone, so words are indexed by length, half and its text, and probed with the
halves that an equal or one-longer word would have, shifted by the longer word's
extra character where the half comes after it.  What is not the shared half is
again one edit apart, so it is cut in two by the same rule and its part goes
into the key: a common prefix or ending, which may be shared by any number of
words, is thereby split by three quarters of the word, and no bucket is capped.
A pair that several parts find counts with the first alone, and every pair is
verified on the whole words.

Following forms ends, as each is ``RATIO`` times as frequent as the word before:
a word of the highest count m is reached in log10(m) steps, so pointers are
doubled log2 of that many times.

Nulls: a null text has no words, a null id counts as the empty one (ids matter
for ``damage`` only).  Repeated rows count again.  Ties among the near words of
the largest count go to the first in code-point order.  Empty texts and tables
give no words.  A very long text is one row, read by one task.  Other columns of
docs are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, text_bytes, written
from .words import Words, chunks, mixed

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: Bytes that a task counts at once.
CHUNK = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), 0xC3]] = True


def letters(texts: list[bytes]) -> list[bytes]:
    """The texts with A-Z in lower case and a space for each byte outside of a-z and U+00C0 to U+00FF (0xC3 and the byte after it)."""
    a = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    keep = _LETTER[a]
    keep[1:] |= a[:-1] == 0xC3
    masked, out, at = np.where(keep, a, np.uint8(0x20)).tobytes(), [], 0
    for t in texts:
        out.append(masked[at : at + len(t)])
        at += len(t) + 1
    return out


def _without(word: bytes, h: int) -> str:
    """The word without its code point h % length."""
    w = word.decode()
    i = h % len(w)
    return w[:i] + w[i + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, damage: int | None = None) -> DataFrame:
    """word, n: the words of at least so many code points.

    With ``damage``, a word of a document loses a letter where damage divides the
    crc32 h of ``<doc_id>:<word>``: the code point h % length.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            texts, ids = text_bytes(batch["text"]), batch["doc_id"].to_pylist()
            for a, b in chunks(texts, CHUNK):
                w = Words(letters(texts[a:b]))
                begun = np.concatenate(([0], np.cumsum((w.bytes & 0xC0) != 0x80, dtype=np.int32)))
                at = np.flatnonzero(begun[w.ends] - begun[w.starts] >= min_length)
                doc = w.doc_of_words()[at]
                _, first, n = np.unique(mixed(w.hashes[at] * np.uint64(0xD6E8FEB86659FD93) + mixed(doc.astype(np.uint64))), return_index=True, return_counts=True)
                at, doc, lost = at[first], doc[first], np.zeros(len(first), bool)
                cut, cut_n = [], []
                if damage:
                    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[a:b]], np.int64)
                    h = np.fromiter((zlib.crc32(w.buffer[s:e], p) for s, e, p in zip(w.starts[at].tolist(), w.ends[at].tolist(), before[doc].tolist(), strict=True)), np.int64, len(at))
                    lost = h % damage == 0
                    for i, x, k in zip(at[lost].tolist(), h[lost].tolist(), n[lost].tolist(), strict=True):
                        short = _without(w.buffer[w.starts[i] : w.ends[i]], x)
                        if len(short) >= min_length:
                            cut.append(short)
                            cut_n.append(k)
                at, n = at[~lost], n[~lost]
                _, first, of = np.unique(w.hashes[at], return_index=True, return_inverse=True)
                whole = [w.buffer[s:e].decode() for s, e in zip(w.starts[at[first]].tolist(), w.ends[at[first]].tolist(), strict=True)]
                sums = np.bincount(of, n, len(first)).astype(np.int64).tolist()
                yield pa.RecordBatch.from_pydict({"word": whole + cut, "n": sums + cut_n}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _part(text: Column, start: Column, length: Column | None = None) -> Column:
    """Code points from start (0 is the first) on."""
    return F.substring(text, start + 1, length if length is not None else F.lit(1 << 30))


def _halves(text: Column, length: Column, longer: int) -> list[tuple[Column, Column, Column]]:
    """(kept half, rest, length of the rest in the shorter word) for either half of a text that is ``length`` + ``longer`` long."""
    half = F.floor(length / 2).cast("int")
    return [(_part(text, F.lit(0), half), _part(text, half), length - half), (_part(text, half + longer), _part(text, F.lit(0), half + longer), half)]


def _keys(text: Column, length: Column, longer: int) -> Column:
    """An array of (part, key): what of the text is left alone by an edit elsewhere, two levels deep."""
    out = []
    for i, (kept, rest, m) in enumerate(_halves(text, length, longer)):
        for j, (again, _, _) in enumerate(_halves(rest, m, longer)):
            out.append(F.struct(F.lit(2 * i + j).alias("part"), F.xxhash64(F.lit(2 * i + j), length, kept, again).alias("key")))
    return F.array(*out)


def links(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every two words (word, n) exactly one edit apart, once; b is longer or comes after a."""
    rows = words.select("word", "n", F.length("word").alias("l"))
    index = rows.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("word"), F.col("l"), 0)).alias("k")).select("a", "a_n", "k.part", "k.key")
    probes = F.concat(_keys(F.col("word"), F.col("l"), 0), _keys(F.col("word"), F.col("l") - 1, 1))
    probe = rows.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(probes).alias("k")).select("b", "b_n", "k.part", "k.key")
    both = index.join(probe, ["part", "key"]).where("length(a) < length(b) or length(a) = length(b) and a < b")
    l = F.length("a")  # noqa: E741
    longer = F.length("b") - l
    half = F.floor(l / 2).cast("int")
    # The first part that fits counts: the second half only if the first halves differ, and so for the rest.
    in_first = F.col("part") < 2
    rest = lambda x, more: F.when(in_first, _part(x, half)).otherwise(_part(x, F.lit(0), half + more))
    quarter = F.floor(F.when(in_first, l - half).otherwise(half) / 2).cast("int")
    start = lambda x, n: _part(x, F.lit(0), n)
    first = (in_first | (start(F.col("a"), half) != start(F.col("b"), half))) & ((F.col("part") % 2 == 0) | (start(rest(F.col("a"), 0), quarter) != start(rest(F.col("b"), longer), quarter)))
    return both.where(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _followed(forms: DataFrame, most: int) -> DataFrame:
    """word, root for (word, form): pointers doubled until the longest possible chain has ended."""
    steps = max(1, math.floor(math.log(max(most, RATIO), RATIO)) + 1)
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variants(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for (word, n)."""
    words = written(counts.where(F.col("n") >= min_count), "words")
    # Both ways round, the near word of the largest count first.
    ways = F.array(*(F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("n"), F.col(y).alias("word")).alias("near")) for x, y in (("a", "b"), ("b", "a"))))
    near = links(words).select(F.explode(ways).alias("w")).groupBy("w.word").agg(F.count("*").alias("n_near"), F.min("w.near").alias("best"))
    rows = words.join(near, "word", "left").withColumn("far", -F.col("best.n") >= RATIO * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(far, best.word, null)").alias("form"), F.expr("if(far, -best.n, null)").alias("form_n"))
    rows = written(rows, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _followed(rows.where("form is not null"), most)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
