"""Substring dedup: word windows that occur again anywhere, by FM-index.

A word goes if a window of WINDOW consecutive words that covers it has the same
words as a window with another start, in any document or in its own.

* Anchors.  Of the word ANCHOR-grams in every window those of least hash are
  its anchors, so two equal windows have the same anchors at the same places.
  Only anchors that occur more than once can lie in a repeated window.
* Segments.  Around a repeated anchor the words that its windows can reach are
  one segment; equal segments of one anchor are one with a weight.
* Shards.  Segments are dealt by anchor, and every shard of some SHARD symbols
  has its own compressed FM-index (wavelet matrix, packed bits).  A symbol is a
  word together with its anchor and its distance from it, so a stretch that
  occurs twice in the index occurs at two starts in the corpus.
* Search.  Each segment is streamed against its shard's index by backward
  search, whose matching statistics give the maximal stretches that occur
  twice or more; those of WINDOW words or more become spans of all documents
  that hold the segment.
* An anchor with over HOT unlike segments would be too much for one index.  Its
  windows hold either the next words before it or those after it, so it is
  split into longer anchors, with those words on one side, whose segments are
  parts of its own, and each is indexed by itself; what is still hot is split
  again, until an anchor is a window.

Words are compared by 64-bit hashes within shards' keys (32 bits of each word,
35 of which make a window, and 64 of the anchor).

Nulls: a null text has no words.  A null id is a row like any other.  Repeated
rows are documents of their own, so all their windows repeat; of tied anchors of
a window all are taken.  An empty table gives no rows.  Texts are read whole, a
text at a time, so their length is bounded by a task's memory only.  Columns
besides doc_id, text and those kept are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, repeated_intervals
from .shared import map_arrow, text_bytes, widened, written
from .words import Words, _power_tables, chunks, mixed, shingles

WINDOW = 35
ANCHOR = 8
REACH = WINDOW - ANCHOR
SHARD = 400_000
HOT = 20_000


def lengths() -> list[int]:
    """Of anchors and of what hot ones are split into: each holds half of the words that were free."""
    out = [ANCHOR]
    while out[-1] < WINDOW:
        out.append(out[-1] + -(-(WINDOW - out[-1]) // 2))
    return out


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive entries."""
    step = 1
    while 2 * step <= n:
        x = f(x[: len(x) - step], x[step:])
        step *= 2
    return f(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (words of the whole list) and hashes of all windows' anchors."""
    n, grams = len(w.hashes), shingles(w.hashes, ANCHOR)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.maximum(grams, np.uint64(1))
    least = _sliding(grams, REACH + 1, np.minimum)
    end = np.repeat(w.bounds[1:], np.diff(w.bounds))[: len(least)]
    least = np.where(np.arange(len(least)) + WINDOW <= end, least, np.uint64(0))
    padded = np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(len(grams) - len(least), np.uint64)))
    chosen = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum)[: len(grams)] == grams)
    return chosen, grams[chosen]


def _segments(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the segments round the anchors, and their hashes."""
    doc = np.searchsorted(w.bounds, at, "right") - 1
    lo, hi = np.maximum(at - REACH, w.bounds[doc]), np.minimum(at + WINDOW, w.bounds[doc + 1])
    power, inverse = _power_tables(len(w.hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hashes * power[: len(w.hashes)], dtype=np.uint64)))
    h = mixed((sums[hi] - sums[lo]) * inverse[lo])
    return lo, hi, mixed(h + ((at - lo) << 8 | (hi - at)).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """text, two numbers that name it (equal texts lose the same words) and one that tells copies apart."""
    return docs.withColumn("_key", F.xxhash64("text", F.lit(1))).withColumn("_size", F.coalesce(F.length("text"), F.lit(-1))).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))


def _occurrences(keyed: DataFrame) -> DataFrame:
    """anchor, segment, key, size, id, at: a row for each anchor of each document."""

    def run(batches):
        for batch in batches:
            texts, key, size = text_bytes(batch["text"]), np.asarray(batch["_key"], np.int64), np.asarray(batch["_size"], np.int32)
            ids = np.asarray(batch["_id"], np.int64)
            for a, b in chunks(texts, 1 << 20):
                w = Words(texts[a:b])
                at, anchor = anchors(w)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                _, _, h = _segments(w, at)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), pa.array(key[a:b][doc]), pa.array(size[a:b][doc]), pa.array(ids[a:b][doc]), pa.array((at - w.bounds[doc]).astype(np.int32))], names=["anchor", "segment", "key", "size", "id", "at"])

    return map_arrow(keyed.select("text", "_key", "_size", "_id"), run, "anchor long, segment long, key long, size int, id long, at int")


def _anchor_counts(keyed: DataFrame) -> DataFrame:
    """anchor, n: of all documents."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch["text"])
            found = [anchors(Words(texts[a:b]))[1] for a, b in chunks(texts, 1 << 20)]
            anchor, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return map_arrow(keyed.select("text"), run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _words_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, segment, weight, before, words (32 bits each) for the wanted places: key, size, id, then a list of anchor, segment, weight and at."""
    names = ["key", "size", "id"]
    rows = keyed.select("text", *(F.col(f"_{c}").alias(c) for c in names)).join(wanted, names).select("text", "places")

    def run(batches):
        for batch in batches:
            texts, places = text_bytes(batch["text"]), batch["places"]
            sizes = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False)
            flat = places.flatten()
            at_of = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            for a, b in chunks(texts, 1 << 20):
                w = Words(texts[a:b])
                part = flat.slice(at_of[a], at_of[b] - at_of[a])
                field = {name: np.asarray(part.field(name)).astype(np.int64) for name in ("anchor", "segment", "weight", "at")}
                at = field["at"] + np.repeat(w.bounds[:-1], sizes[a:b])
                lo, hi, _ = _segments(w, at)
                short = w.hashes.astype(np.uint32)
                words = pa.array([short[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(field[c]) for c in ("anchor", "segment", "weight")), pa.array((at - lo).astype(np.int32)), words], names=["anchor", "segment", "weight", "before", "words"])

    return map_arrow(rows, run, "anchor long, segment long, weight long, before int, words binary")


def _split(hot: DataFrame, length: int, longer: int) -> DataFrame:
    """anchor, segment, weight, before, words of the longer anchors in hot segments, with those they come from (of_anchor, of_segment) and the shift to them."""
    more = longer - length
    free = WINDOW - longer
    names = ["anchor", "segment", "weight", "before", "words", "of_anchor", "of_segment", "shift"]

    def run(batches):
        for batch in batches:
            anchor, segment, weight, place = (np.asarray(batch[c]).astype(np.int64) for c in ("anchor", "segment", "weight", "before"))
            raw = batch["words"].to_pylist()
            size = np.array([len(x) // 4 for x in raw], np.int64)
            word = np.frombuffer(b"".join(raw), np.uint32)
            begin = np.cumsum(size) - size
            power, inverse = _power_tables(len(word) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(word.astype(np.uint64) + np.uint64(1)) * power[: len(word)], dtype=np.uint64)))
            named = lambda lo, hi: mixed((sums[hi] - sums[lo]) * inverse[lo])  # noqa: E731, B023
            for side, at, beside in ((1, place - more, place - more), (2, place, place + length)):
                lo, hi = np.maximum(at - free, 0), np.minimum(at + WINDOW, size)
                # A part that cannot hold a window is of no use.
                i = np.flatnonzero((at >= 0) & (at + longer <= size) & (hi - lo >= WINDOW))
                first, last = begin[i] + lo[i], begin[i] + hi[i]
                own = mixed(mixed(anchor[i].view(np.uint64) + np.uint64(side)) ^ named(begin[i] + beside[i], begin[i] + beside[i] + more))
                part = mixed(named(first, last) + ((at - lo)[i] << 8 | (hi - at)[i]).astype(np.uint64))
                words = pa.array([word[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                shift = np.full(len(i), -more if side == 1 else 0, np.int32)
                columns = [pa.array(own.view(np.int64)), pa.array(part.view(np.int64)), pa.array(weight[i]), pa.array((at - lo)[i].astype(np.int32)), words, pa.array(anchor[i]), pa.array(segment[i]), pa.array(shift)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(hot.select(*names[:5]), run, "anchor long, segment long, weight long, before int, words binary, of_anchor long, of_segment long, shift int")


def _merged(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans that meet; who tells the spans' owners."""
    order = np.lexsort((lo, who))
    who, lo, hi = who[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(who):
        return who, lo, hi
    base = who * (1 << 20)
    reach = np.maximum.accumulate(base + hi)
    fresh = np.concatenate(([True], (base + lo)[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    return who[at], lo[at], (np.maximum.reduceat(base + hi, at) - base[at])


def _search(segments: DataFrame, length: int = ANCHOR) -> DataFrame:
    """anchor, segment, lo, hi: repeated stretches as distances from the anchor, which has so many words."""
    rows = segments.select("anchor", "segment", "weight", "before", "words").repartition("anchor").sortWithinPartitions("anchor", "segment")

    def shard(table):
        anchor, weight, before = (np.asarray(table[c]) for c in ("anchor", "weight", "before"))
        parts = table["words"].to_pylist()
        size = np.array([len(x) // 4 for x in parts])
        word = np.frombuffer(b"".join(parts), np.uint32)
        starts = np.cumsum(size) - size
        # A segment of weight 2 or more repeats as a whole; the others are searched for.
        whole = np.flatnonzero((weight >= 2) & (size >= WINDOW))
        found = [(whole, -before[whole], (size - before)[whole])]
        # Groups of one anchor without any segment to search for need no index.
        group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        useful = np.bincount(group, weight < 2) > 0
        of = np.repeat(np.arange(len(size)), size)
        distance = np.arange(len(word)) - starts[of] - before[of]
        # The words of the anchor are equal in its group: the first of them stands for all.
        used = useful[group][of] & ((distance <= 0) | (distance >= length))
        of, distance = of[used], distance[used]
        symbol = mixed(mixed(anchor.view(np.int64).view(np.uint64)[of] + (distance + REACH).astype(np.uint64)) + word[used].astype(np.uint64))
        _, text = np.unique(symbol, return_inverse=True)
        # A window that occurs again has only symbols that do, so stretches of
        # these are searched, and all other symbols are one in the index.
        twice = np.bincount(text, weight[of]) >= 2
        text = np.where(twice[text], np.cumsum(twice)[text], 0)
        some = (text > 0) & (weight < 2)[of]
        same = np.concatenate(([False], of[1:] == of[:-1]))
        begin = np.flatnonzero(some & ~(same & np.concatenate(([False], some[:-1]))))
        end = np.flatnonzero(some & ~(np.concatenate((same[1:], [False])) & np.concatenate((some[1:], [False])))) + 1
        # Every window holds the whole anchor, so a stretch is this many symbols at least.
        least = WINDOW - length + 1
        long = end - begin >= least
        if long.any():
            begin, end = begin[long], end[long]
            index = FMIndex(text, weight[of], 2 * REACH + 3)
            # Equal stretches (symbols tell anchor and distance too) are searched once.
            power, inverse = _power_tables(len(text))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(text.astype(np.uint64)) * power[: len(text)], dtype=np.uint64)))
            _, one, kind = np.unique((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64), return_index=True, return_inverse=True)
            run, first, last = repeated_intervals(index, text, begin[one], end[one], least)
            by_kind, number = np.argsort(kind, kind="stable"), np.bincount(kind)
            of_kind = np.cumsum(number) - number
            k = np.repeat(np.arange(len(run)), number[run])
            member = by_kind[of_kind[run][k] + np.arange(len(k)) - np.repeat(np.cumsum(number[run]) - number[run], number[run])]
            first, last = first[k] - begin[one][run][k] + begin[member], last[k] - begin[one][run][k] + begin[member]
            left, right = distance[first], distance[last - 1]
            # Only what reaches over the anchor is of its windows.
            over = (left <= 0) & (right >= 0)
            found.append((of[first][over], left[over], np.where(right > 0, right + 1, length)[over]))
        who, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        fits = hi - lo >= WINDOW
        who, lo, hi = _merged(who[fits], lo[fits], hi[fits])
        return pa.RecordBatch.from_arrays([pa.array(anchor[who]), pa.array(np.asarray(table["segment"])[who]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["anchor", "segment", "lo", "hi"])

    def run(batches):
        held, most = None, SHARD // (WINDOW + REACH)
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            while held.num_rows >= most:
                anchor = np.asarray(held["anchor"])
                ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                fit = ends[ends <= most]
                cut = fit[-1] if len(fit) else ends[0] if len(ends) else 0
                if not cut:
                    break
                yield shard(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield shard(held.combine_chunks())

    return map_arrow(rows, run, "anchor long, segment long, lo int, hi int")


def _hot(segments: DataFrame) -> DataFrame | None:
    """anchor: those with over HOT unlike segments; None if there are none."""
    hot = written(segments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot-anchors")
    return None if hot.isEmpty() else hot


def _repeats(segments: DataFrame, hot: DataFrame | None, steps: list[int]) -> DataFrame:
    """anchor, segment, lo, hi: repeated stretches of unlike segments (written, if some are hot)."""
    if hot is None:
        return _search(segments, steps[0])
    found = _search(segments.join(hot, "anchor", "left_anti"), steps[0])
    parts = written(_split(segments.join(hot, "anchor", "left_semi"), *steps[:2]), "split-anchors")
    own = parts.groupBy("anchor", "segment").agg(F.sum("weight").alias("weight"), F.first("before").alias("before"), F.first("words").alias("words"))
    own = written(own, "split-segments")
    below = _repeats(own, _hot(own) if steps[1] < WINDOW else None, steps[1:])
    back = parts.select("anchor", "segment", "of_anchor", "of_segment", "shift").join(below, ["anchor", "segment"])
    return found.unionByName(back.select(F.col("of_anchor").alias("anchor"), F.col("of_segment").alias("segment"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")))


def spans(keyed: DataFrame) -> DataFrame:
    """key, size, spans: word spans (lo, hi) to remove from each text; texts without any are left out."""
    # A table of its own, so that the join can split an anchor that is in very many documents.
    again = written(_anchor_counts(keyed).where("n > 1").select("anchor"), "repeated-anchors")
    kept = written(_occurrences(keyed).join(again, "anchor"), "anchors")
    unlike = kept.groupBy("anchor", "segment").agg(F.count("*").alias("weight"), F.min(F.struct("key", "size", "id", "at")).alias("place"))
    unlike = written(unlike.select("anchor", "segment", "weight", "place.*"), "segments")
    # A list has an entry for each anchor of a text, so it is no longer than the text; the document of least id stands for all that have the same segment.
    wanted = unlike.groupBy("key", "size", "id").agg(F.collect_list(F.struct("anchor", "segment", "weight", "at")).alias("places"))
    segments, hot = _words_of(keyed, wanted), _hot(unlike)
    result = _repeats(segments if hot is None else written(segments, "segment-words"), hot, lengths())
    rows = kept.join(result, ["anchor", "segment"]).select("key", "size", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("span"))
    return rows.groupBy("key", "size").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """keep..., n_words, n_removed, kept_sha256 and, if wanted, the kept text; a row for every row of docs."""
    keyed = _keyed(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])))
    gone = written(spans(keyed.select("text", "_key", "_size", "_id")), "spans").select(F.col("key").alias("_k"), F.col("size").alias("_s"), "spans")
    rows = keyed.join(gone, (keyed._key == gone._k) & (keyed._size == gone._s), "left").select(*keep, F.col("text").alias("_text"), "spans")

    def run(batches):
        for batch in batches:
            texts, spans_of = text_bytes(batch["_text"]), batch["spans"].to_pylist()
            out = []
            for a, b in chunks(texts, 1 << 20):
                w = Words(texts[a:b], hashes=False)
                for i in range(a, b):
                    lo, hi = w.bounds[i - a], w.bounds[i - a + 1]
                    covered = np.zeros(hi - lo + 1, np.int32)
                    for s in spans_of[i] or ():
                        covered[s["lo"]] += 1
                        covered[s["hi"]] -= 1
                    stays = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
                    kept = b" ".join(texts[i].split()) if len(stays) == hi - lo else b"" if not len(stays) else b" ".join(w.buffer[x:y] for x, y in zip(w.starts[lo + stays].tolist(), w.ends[lo + stays].tolist(), strict=True))
                    out.append((hi - lo, hi - lo - len(stays), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out])]
            columns += [pa.array([r[3] for r in out])] if text else []
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns], names=[*keep, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if text else [])])

    return map_arrow(rows, run, widened(rows.select(*keep).schema, "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if text else "")))

