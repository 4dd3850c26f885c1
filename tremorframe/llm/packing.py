"""Best-fit packing: documents into sequences of at most CAPACITY tokens.

Only documents over CAPACITY are cut; all their pieces but the first have
CAPACITY tokens.  The histogram of piece lengths (at most CAPACITY rows) goes
to the driver, which solves the configuration linear program over it: a
pattern is a multiset of lengths that fits, and as few patterns as possible
shall cover all pieces.  Multiplicative weights give prices to lengths, a
knapsack dynamic program finds the patterns of most value, lengths covered
beyond the others become cheaper, and so on.  The patterns' numbers are rounded
down, and the pieces that remain are packed best-fit, longest first, by counts
of lengths.

Pieces then find their places without the driver: a piece's rank among those of
its length is the number in earlier buckets and its number in its own, and the
patterns say which sequence and offset the slot of that rank has.  A length has
as many buckets as its pieces need at BUCKET_ROWS each.

What the driver gets and sends does not grow with the input: CAPACITY lengths
come in; out go patterns, at most ROUNDS of them for each length from the linear
program and some more from best fit, each with at most 45 unlike lengths (the
sum of the first 45 is over 1024).  ``Slots`` refuses to be larger than that.

Nulls: a null text is empty (one token, the end); a null id stays null.
Repeated rows are packed each, and which of equal pieces gets which of their
places does not matter.  No rows: no sequences.  A very long text is encoded
whole by one task.  Columns besides text and those kept are not looked at, and
kept ones may have any name but those of the result.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import CLEARED, map_arrow, widened, written

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task numbers.
BUCKET_ROWS = 50_000
ROUNDS = 40
RATE = 0.02
#: Shares of the rounded patterns (fullest first) that are tried; the rest is packed best-fit.
KEPT = (1.0, 0.75, 0.5, 0.25)
TOKENIZER = "byte_bpe_50k"
#: Bound on the entries (32 bytes each) for each length of the plan that is broadcast: twice what the linear program's patterns can have.
MOST_ENTRIES = 2 * ROUNDS * 45

_encoders: dict[str, tuple] = {}
CLEARED.append(_encoders.clear)


def encoder(name: str = TOKENIZER):
    """text -> ids, as tokenizers gives them with add_special_tokens=False.

    tiktoken has the same vocabulary and is several times as fast; a text in
    which a special token is spelt out goes to tokenizers.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[name] = (fast, [])
    fast, slow = _encoders[name]

    def encode(text: str) -> list[int]:
        if "<|" not in text:
            return fast.encode_ordinary(text)
        if not slow:
            import public_tokenizers
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """keep..., piece, start, length, ids_crc32, spread (a number that deals pieces out evenly)."""
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        encode, number = encoder(tokenizer), 0
        for batch in batches:
            out, of = [], []
            for i, text in enumerate(batch["_text"].to_pylist()):
                ids = encode(text or "")
                ids.append(END_ID)
                raw = struct.pack(f"<{len(ids)}I", *ids)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), number))
                    of.append(i)
                    number += 1
            own = pa.array(of, pa.int64())
            kinds = [pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(own) for c in keep), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds))], names=[*keep, "piece", "start", "length", "ids_crc32", "spread"])

    return map_arrow(rows, run, widened(rows.select(*keep).schema, "piece int, start long, length long, ids_crc32 long, spread long"))


class Knapsack:
    """Patterns of most value, by dynamic programming over the capacity."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        """lengths ascend; a length may be taken more than once."""
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        usable = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(int(lengths[0]), capacity + 1):
            got = value[c - lengths[: usable[c]]] + prices[: usable[c]]
            k = int(got.argmax())
            if got[k] > value[c - 1]:
                value[c], choice[c] = got[k], k
            else:
                value[c] = value[c - 1]
        self.lengths, self.value, self.capacity = lengths.tolist(), value, capacity
        self.choice = choice.tolist()

    def pattern(self, k: int) -> Counter:
        """The best one that has the k-th length: numbers by place of the length."""
        out, c = Counter([k]), self.capacity - self.lengths[k]
        while c > 0:
            i = self.choice[c]
            if i < 0:
                c -= 1
            else:
                out[i] += 1
                c -= self.lengths[i]
        return out


def configuration_lp(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """Pattern (pairs of length and number) -> how often: a fractional cover of the histogram.

    A length's price starts as its share of the capacity, the dual solution of
    a perfect packing.  Round r of R covers every length to r / R of its
    number: one knapsack gives the best pattern with each length that is
    behind.  What a length is covered beyond that lowers its price by a factor
    exp(-rate) for each round it is ahead.
    """
    lengths = np.array(sorted(histogram))
    demand = [float(histogram[n]) for n in lengths.tolist()]
    ahead, cover, times = np.zeros(len(lengths)), [0.0] * len(lengths), defaultdict(float)
    for r in range(rounds):
        knapsack = Knapsack(lengths, lengths / capacity * np.exp(-rate * ahead), capacity)
        target = (r + 1) / rounds
        for k in range(len(lengths) - 1, -1, -1):
            if (lack := target - cover[k]) > 1e-12:
                pattern = knapsack.pattern(k)
                step = lack * demand[k] / pattern[k]
                times[tuple(sorted(pattern.items()))] += step
                for i, m in pattern.items():
                    cover[i] += step * m / demand[i]
        ahead = np.minimum((np.array(cover) - target) * rounds, 20.0)
    names = lengths.tolist()
    return {tuple((names[i], m) for i, m in p): x for p, x in times.items()}


def round_down(times: dict[tuple, float], left: Counter) -> list[tuple[tuple, int]]:
    """Whole numbers of patterns as far as pieces are left (left is lowered).

    Fuller patterns come first; fractions are carried over to the next pattern.
    """
    out, carry = [], 0.0
    for pattern, x in sorted(times.items(), key=lambda p: (-sum(n * k for n, k in p[0]), -p[1], p[0])):
        carry += x
        number = min([int(carry + 1e-9), *(left[n] // k for n, k in pattern)])
        if number > 0:
            out.append((pattern, number))
            for n, k in pattern:
                left[n] -= number * k
        carry -= int(carry + 1e-9)
    return out


def best_fit(left: Counter, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Best-fit decreasing by counts: like bins are kept together."""
    room: dict[int, Counter] = defaultdict(Counter)
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        count = left[n]
        for r in range(n, capacity):
            while count and room.get(r):
                pattern, bins = next(iter(sorted(room[r].items())))
                fit = min(r // n, count)
                moved = min(bins, count // fit)
                room[r][pattern] -= moved
                if not room[r][pattern]:
                    del room[r][pattern]
                room[r - fit * n][(*pattern, *[n] * fit)] += moved
                count -= moved * fit
            if not count:
                break
        per = capacity // n
        if count // per:
            room[capacity - per * n][(n,) * per] += count // per
        if count % per:
            room[capacity - count % per * n][(n,) * (count % per)] += 1
    return [(tuple(sorted(Counter(p).items())), k) for r in sorted(room) for p, k in sorted(room[r].items())]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Patterns and how often each is used; every piece has exactly one slot."""
    if not histogram:
        return []
    times, best = configuration_lp(histogram, capacity), None
    whole = round_down(times, Counter(histogram))
    for keep in KEPT:
        made, left = whole[: max(1, round(keep * len(whole)))], Counter(histogram)
        for pattern, number in made:
            for n, k in pattern:
                left[n] -= k * number
        made = made + best_fit(left, capacity)
        if best is None or sum(k for _, k in made) < sum(k for _, k in best):
            best = made
    return best


class Slots:
    """For each length, its slots in the order of patterns: rank -> sequence and offset."""

    def __init__(self, patterns: list[tuple[tuple, int]]) -> None:
        by, base = defaultdict(list), 0
        for pattern, times in patterns:
            offset = 0
            for n, k in reversed(pattern):
                by[n].append((times * k, k, base, offset))
                offset += n * k
            base += times
        self.sequences = base
        if (entries := sum(map(len, by.values()))) > MOST_ENTRIES * len(by):
            raise ValueError(f"{entries} entries for {len(by)} lengths; a plan has at most {MOST_ENTRIES} each")
        self.by = {n: (np.concatenate(([0], np.cumsum([r[0] for r in rows]))), *(np.array([r[j] for r in rows]) for j in (1, 2, 3))) for n, rows in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            begin, k, base, at = self.by[n]
            p = np.searchsorted(begin, rank[own], "right") - 1
            inside = rank[own] - begin[p]
            sequence[own] = base[p] + inside // k[p]
            offset[own] = at[p] + n * (inside % k[p])
        return sequence, offset


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """keep..., piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = written(pieces(docs, keep, capacity, tokenizer), "pieces")
    # At most CAPACITY rows.
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity)))
    buckets = F.array(*(F.lit(-(-histogram.get(n, 0) // BUCKET_ROWS) or 1) for n in range(capacity + 1)))
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("spread", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))))
    counts = written(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keep, "piece", "ids_crc32")) - 1
    # Both sides are dealt by length and bucket, so the join moves no piece again.
    ranked = dealt.withColumn("number", number).join(earlier, ["length", "bucket"])
    rows = ranked.select(*keep, "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("number")).alias("rank"))

    def run(batches):
        for batch in batches:
            sequence, offset = slots.value.find(np.asarray(batch["length"], np.int64), np.asarray(batch["rank"], np.int64))
            names = [*keep, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_arrow(rows, run, widened(rows.drop("rank").schema, "sequence_id long, offset long"))
