"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are the presence of its hashed words (A-Z folded, up to
three punctuation marks off either end), word pairs and skip-grams (pairs with
one word between).  Per-coordinate rates adapt to how
often a feature is seen and the L1 term leaves most weights at exactly zero, so
the model that travels to the executors is a short list of (index, weight).

Training takes a bounded sample of the labelled rows (``max_rows``, chosen by a
hash of the id; all of them if there are fewer).  The sample is dealt to tasks
of ``SHARD_ROWS`` rows and ``SHARD_CHARS`` characters; each runs FTRL over its
rows ``epochs`` times in the order of a hash, and the shards' weights are
averaged.  Scoring runs over all rows.

Nulls: a null text counts as empty (its score is that of the bias), a null id
is scored too and is never held out; null labels are not learnt from.  With no
usable label the score is 0.0 everywhere.  Repeated rows are scored each; of
tied labels of an id the greatest counts, and rows that tie in the order of the
hash follow the order of their texts' features.  An empty table gives no rows.
A very long text is one row of its task.  Columns besides doc_id, text and those
kept are not looked at, and kept ones may have any name but those of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, map_arrow, small_batches, text_bytes, widened
from .words import Words, chunks, mixed

BITS = 22
#: Rows of a shard, as far as the sample allows; MAX_ROWS makes four shards.
SHARD_ROWS = 8_000
#: Characters of a shard; a feature has four bytes and a word of some five characters three features.
SHARD_CHARS = 64_000_000
MAX_ROWS = 32_000


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed feature) of each word, pair and skip-gram."""
    h, doc = w.hashes, w.doc_of_words()
    mask = np.uint64((1 << bits) - 1)
    index, of = [h & mask], [doc]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            index.append((mixed(h[:-gap] * np.uint64(factor) + h[gap:])[same]) & mask)
            of.append(doc[gap:][same])
    return np.concatenate(of), np.concatenate(index).astype(np.int32)


def _present(w: Words, bits: int) -> list[np.ndarray]:
    """The distinct features of each text."""
    doc, index = features(w, bits)
    key = np.unique((doc.astype(np.int64) << 32) | index)
    cut = np.searchsorted(key >> 32, np.arange(len(w.bounds)))
    index = (key & 0xFFFFFFFF).astype(np.int32)
    return [index[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def ftrl(rows: list[tuple[int, np.ndarray]], bits: int = BITS, alpha: float = 3.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0, epochs: int = 6) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, features); returns the weights and the bias."""
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    bz = bn = 0.0

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, x in rows:
            zx, nx = z[x], n[x]
            w = solve(zx, nx, l1)
            bias = float(solve(bz, bn, 0.0))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - label
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = np.zeros(1 << bits, np.float32)
    w[at] = solve(z[at], n[at], l1)
    return w, float(solve(bz, bn, 0.0))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, **ftrl_options) -> dict[int, float]:
    """Weights by feature index; -1 has the bias.  docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = usable.count()
    if not count:
        return {}
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(share < min(1.0, max_rows / count)) if count > max_rows else usable
    # The sample has about max_rows ids and labels at most, some 16 bytes each.
    sample = F.broadcast(sample)
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, round(min(count, max_rows) / SHARD_ROWS), -(-chars // SHARD_CHARS))

    def to_features(batches):
        for batch in batches:
            texts, toxic, ids = text_bytes(batch["text"]), batch["toxic"].to_pylist(), batch["doc_id"].to_pylist()
            for a, b in chunks(texts):
                x = _present(Words(texts[a:b], lower=True, trim=3), bits)
                yield pa.RecordBatch.from_pydict({"shard": [int(mixed(np.array([i % (1 << 63)], np.uint64))[0] % shards) for i in ids[a:b]], "doc_id": ids[a:b], "toxic": toxic[a:b], "x": [v.tobytes() for v in x]}, schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.binary())]))

    def one_shard(table: pa.Table) -> pa.Table:
        ids = np.array(table["doc_id"].to_pylist(), np.int64)
        y, x = table["toxic"].to_pylist(), table["x"].to_pylist()
        hashed = mixed(ids.astype(np.uint64)).tolist()
        order = sorted(range(len(ids)), key=lambda i: (hashed[i], x[i]))
        w, bias = ftrl([(int(y[i] > 0), np.frombuffer(x[i], np.int32)) for i in order], bits, **ftrl_options)
        at = np.flatnonzero(w)
        give_back()
        return pa.table({"i": pa.array([-1, *at.tolist()], pa.int32()), "w": pa.array([bias, *w[at].tolist()], pa.float64())})

    fitted = map_arrow(rows, to_features, "shard int, doc_id long, toxic int, x binary").groupBy("shard").applyInArrow(one_shard, "i int, w double")
    # Weights that are not zero, at most 2 ** bits and in fact as many as the L1 term leaves of max_rows texts; each shard has one of each.
    each = fitted.groupBy("i").agg(F.sort_array(F.collect_list("w")).alias("w")).collect()
    number = max((len(r["w"]) for r in each if r["i"] == -1), default=1)
    return {r["i"]: float(sum(r["w"]) / number) for r in each}


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score and predicted to the kept columns of every row."""
    index = np.array(sorted(i for i in weights if i >= 0), np.int32)
    value = np.array([weights[i] for i in index.tolist()], np.float32)
    bias = weights.get(-1, -np.inf)
    model = docs.sparkSession.sparkContext.broadcast((index, value))
    extra = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = widened(extra.select(*keep).schema, "score double, predicted int")

    def run(batches):
        dense = np.zeros(1 << bits, np.float32)
        dense[model.value[0]] = model.value[1]
        for batch in batches:
            texts = text_bytes(batch["text"])
            out = np.zeros(len(texts))
            for a, b in chunks(texts):
                doc, x = features(Words(texts[a:b], lower=True, trim=3), bits)
                hit = dense[x] != 0
                key = np.unique((doc[hit].astype(np.int64) << 32) | x[hit])
                out[a:b] = np.bincount(key >> 32, dense[key & 0xFFFFFFFF], b - a) if len(key) else 0.0
            s = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30))) if np.isfinite(bias) else out
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return map_arrow(extra, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_rows: int = MAX_ROWS) -> DataFrame:
    """Trains on the labelled rows of docs and scores every row of docs."""
    return score(docs, train(docs, labels, max_rows), keep=keep)
