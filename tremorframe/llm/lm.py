"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood.

Tokens are the words of a text (A-Z folded) and one end.  The model's symbols
are the frequent tokens (at most VOCABULARY) and CLASSES rare classes, which a
token's last two bytes choose; inside a class a token has its smoothed share.
So P(text) = P_hmm(symbols) * product of P(token | class) over rare tokens.

* ``token_counts``: counts of all training tokens; as many rows as tokens are
  distinct, kept as a table and never sent anywhere whole.
* ``encode``: every text as 16-bit symbols, once.  Counts of the KNOWN most
  frequent tokens are broadcast (at most 2^18 rows); the remaining tokens'
  counts come from a join with the table.
* ``baum_welch``: each partition runs scaled forward-backward over its texts
  and gives expected counts; Spark adds them up, the driver normalises a
  matrix of fixed size.  The first states are signs of three random
  projections of each text.
* ``likelihood``: the scaled forward recursion over each whole text.

Texts of a batch advance in lockstep, longest first, so numpy works on all
texts that are still running at once.  A text of over BLOCK tokens is cut into
blocks: what each block does to any distribution of states is a small matrix,
the blocks' matrices give each block the states it begins and ends with, and
then the blocks run in lockstep like texts of their own.  So neither the steps
nor the memory of a task grow with the longest text.

Nulls: a null text is empty (its only token is the end); a null id counts as
training.  Repeated rows count as often as they occur; of tokens that tie in
count all or none are symbols.  With nothing to learn from, every score is that
of the uniform model; an empty table gives no rows.  Columns besides text and
those kept are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, text_bytes, widened, written
from .words import Words, chunks, mixed

STATES = 8
CLASSES = 256
VOCABULARY = 65_536 - CLASSES
KNOWN = 1 << 18
MIN_COUNT = 3
ITERATIONS = 3
END = np.uint64(1)
END_CLASS = 0
GROUP = 300_000
#: Tokens that run in one go.
BLOCK = 16_384


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens, and the bounds of each text's."""
    w = Words(texts, lower=True)
    last = w.bytes[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.bytes[w.ends - 2], 0).astype(np.int64)
    n = len(texts)
    bounds = w.bounds + np.arange(n + 1)
    hashes, classes = np.full(bounds[-1], END, np.uint64), np.full(bounds[-1], END_CLASS, np.int64)
    at = np.arange(len(w.hashes)) + w.doc_of_words()
    hashes[at] = np.where(w.hashes == END, np.uint64(2), w.hashes)
    classes[at] = mixed((last << 8 | before).astype(np.uint64)).astype(np.int64) % CLASSES
    return hashes, np.abs(classes), bounds


def token_counts(docs: DataFrame) -> DataFrame:
    """token (its hash), class, n; over all rows of docs."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(back, n, len(u)).astype(np.int64)

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int16)), pa.array(x[2])], names=["token", "class", "n"])

        for batch in batches:
            texts = text_bytes(batch["text"])
            for a, b in chunks(texts):
                h, c, _ = tokens(texts[a:b])
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, c[first], n))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held[:] = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield rows(held.pop())
        if held:
            yield rows(merged())

    got = map_arrow(docs.select("text"), run, "token long, class short, n long")
    return got.groupBy("token").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Lexicon:
    """What of the counts is small enough to travel: totals, frequent tokens, classes."""

    def __init__(self, counts: DataFrame) -> None:
        bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
        self.total, self.distinct = sum(r["n"] for r in bins), sum(r["v"] for r in bins)

        def least(most: int) -> int:
            """Count from which on there are at most so many tokens."""
            seen, at = 0, 1 << 62
            for r in sorted(bins, key=lambda r: -r["b"]):
                seen += r["v"]
                if seen > most:
                    break
                at = r["least"]
            return at

        known_from, symbol_from = least(KNOWN), max(MIN_COUNT, least(VOCABULARY))
        rows = counts.where(F.col("n") >= known_from).select("token", "class", "n").toPandas()
        order = np.argsort(rows["token"].to_numpy(np.int64).view(np.uint64))
        self.token = rows["token"].to_numpy(np.int64).view(np.uint64)[order]
        self.n = rows["n"].to_numpy(np.int64)[order]
        self.token_class = rows["class"].to_numpy(np.int64)[order]
        frequent = self.n >= max(symbol_from, known_from)
        self.symbols = int(frequent.sum())
        self.symbol = np.where(frequent, np.cumsum(frequent) - 1, self.symbols + self.token_class)
        rare = counts.where(F.col("n") < max(symbol_from, known_from)).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rare:
            self.class_n[r["class"]], self.class_v[r["class"]] = r["n"], r["v"]
        self.symbol_n = np.concatenate((self.n[frequent], self.class_n))

    def base_log(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def class_log(self, c, of):
        return np.log10((c + 0.5) / (self.class_n[of] + 0.5 * (self.class_v[of] + 1)))


def encode(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """keep..., key, n_tokens, symbols, and for tokens that have no known count hashes, classes, numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(*keep, "text", F.xxhash64(F.lit(1), "text").alias("key"), F.xxhash64(F.lit(2), "text").alias("key_b"))

    def run(batches):
        x = shared.value
        token = np.append(x.token, np.uint64(0))
        for batch in batches:
            texts, out = text_bytes(batch["text"]), []
            for a, b in chunks(texts):
                h, c, bounds = tokens(texts[a:b])
                at = np.searchsorted(x.token, h)
                found = token[at] == h
                found &= at < len(x.token)
                at = np.where(found, at, 0)
                symbol, n = np.where(found, x.symbol[at] if len(x.token) else 0, x.symbols + c), np.where(found, x.n[at] if len(x.token) else 0, 0)
                base = np.where(found, x.base_log(n), 0.0)
                inside = np.where(found & (symbol >= x.symbols), x.class_log(n, c), 0.0)
                cb, ci, ck = (np.concatenate(([0.0], np.cumsum(v))) for v in (base, inside, found))
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    other = ~found[i:j]
                    u, first, m = np.unique(h[i:j][other], return_index=True, return_counts=True)
                    out.append((j - i, int(ck[j] - ck[i]), cb[j] - cb[i], ci[j] - ci[i], symbol[i:j].astype(np.uint16).tobytes(), u.tobytes(), c[i:j][other][first].astype(np.uint8).tobytes(), m.astype(np.uint32).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
            names = ["n_tokens", "known", "base", "inside", "symbols", "other", "other_class", "other_n"]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in (*keep, "key", "key_b")), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds))], names=[*keep, "key", "key_b", *names])

    ddl = "n_tokens long, known long, base double, inside double, symbols binary, other binary, other_class binary, other_n binary"
    return map_arrow(rows, run, widened(rows.drop("text").schema, ddl))


def other_sums(encoded: DataFrame, counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """key, key_b, known2, base2, inside2 of the tokens whose counts are in the table only."""

    def run(batches):
        for batch in batches:
            other, cls, m = (batch[c].to_pylist() for c in ("other", "other_class", "other_n"))
            sizes = [len(x) // 8 for x in other]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.asarray(batch[c], np.int64), sizes)) for c in ("key", "key_b")), pa.array(np.frombuffer(b"".join(other), np.int64)), pa.array(np.frombuffer(b"".join(cls), np.uint8).astype(np.int16)), pa.array(np.frombuffer(b"".join(m), np.uint32).astype(np.int64))], names=["key", "key_b", "token", "class", "m"])

    # Copies of a text have the same tokens, so one of them is enough.
    once = encoded.where("length(other) > 0").groupBy("key", "key_b").agg(F.first("other").alias("other"), F.first("other_class").alias("other_class"), F.first("other_n").alias("other_n"))
    rows = map_arrow(once, run, "key long, key_b long, token long, class short, m long")
    rows = rows.join(counts.select("token", "n"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = F.array(*(F.lit(float(a + 0.5 * (b + 1))) for a, b in zip(lexicon.class_n, lexicon.class_v, strict=True)))
    base = F.log10((F.col("n") + 0.5) / (lexicon.total + 0.5 * (lexicon.distinct + 1)))
    inside = F.log10((F.col("n") + 0.5) / F.get(sizes, F.col("class").cast("int")))
    return rows.groupBy("key", "key_b").agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * base).alias("base2"), F.sum(F.col("m") * inside).alias("inside2"))


class Model:
    """Start (K), transition (K, K) and emission (symbols, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def fitted(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, symbol_n: np.ndarray) -> Model:
        """From expected counts, smoothed a little."""
        share = (symbol_n + 0.5) / (symbol_n + 0.5).sum()
        emit = emit + 50.0 * share[:, None]
        start, move = start + 1.0, move + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Packed:
    """Texts in lockstep order: all first symbols, longest text first, then all second ones, ..."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.active = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), "left")
        self.offsets = np.concatenate(([0], np.cumsum(self.active)))
        text = np.repeat(np.arange(len(texts)), self.lengths)
        step = np.arange(len(text)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.at = self.offsets[step] + text
        self.symbols = np.empty(len(text), np.int64)
        self.symbols[self.at] = np.concatenate([texts[i] for i in self.order])
        self.later = self.at[step > 0]
        self.before = (self.offsets[np.maximum(step - 1, 0)] + text)[step > 0]


def _groups(texts: list[np.ndarray]):
    """Indices of texts of like length, with GROUP symbols or one text each."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    held, total = [], 0
    for i in order:
        if held and total + len(texts[i]) > GROUP:
            yield held
            held, total = [], 0
        held.append(i)
        total += len(texts[i])
    if held:
        yield held


def forward(model: Model, p: Packed, all_steps: bool = False, prior: np.ndarray | None = None):
    """Natural log likelihood of each text (in the order given); alphas and scales if wanted.

    prior: the distribution of each text's first state, if not the model's.
    """
    e = model.emit[p.symbols]
    out = np.zeros(len(p.lengths))
    a = np.broadcast_to(model.start, (p.active[0], len(model.start))) if prior is None else prior[p.order]
    scales = np.empty(len(p.symbols)) if all_steps else None
    for t, n in enumerate(p.active):
        lo = p.offsets[t]
        a = (a if t == 0 else a[:n] @ model.move) * e[lo : lo + n]
        s = a.sum(1)
        a /= s[:, None]
        out[:n] += np.log(s)
        if all_steps:
            e[lo : lo + n], scales[lo : lo + n] = a, s
    back = np.empty_like(out)
    back[p.order] = out
    return back, e, scales


def expected(model: Model, p: Packed, chain: Chain | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves, and states of every packed symbol."""
    _, alpha, scale = forward(model, p, True, chain and chain.prior)
    e = model.emit[p.symbols]
    k = alpha.shape[1]
    beta = np.ones((len(alpha), k))
    if chain is not None:
        last = p.at[np.cumsum(p.lengths) - 1]
        # So scaled that a symbol's states sum up to one.
        beta[last] = chain.end[p.order] / (alpha[last] * chain.end[p.order]).sum(1, keepdims=True)
    for t in range(len(p.active) - 2, -1, -1):
        n, lo, hi = p.active[t + 1], p.offsets[t], p.offsets[t + 1]
        beta[lo : lo + n] = (e[hi : hi + n] * beta[hi : hi + n] / scale[hi : hi + n, None]) @ model.move.T
    gamma = alpha * beta
    weighed = e[p.later] * beta[p.later] / scale[p.later, None]
    moves = alpha[p.before].T @ weighed
    n = p.active[0]
    if chain is None:
        return gamma[:n].sum(0), moves * model.move, gamma
    begins = chain.begins[p.order]
    # From the last symbol of the block before to the first of this one.
    moves += chain.before[p.order][~begins].T @ (e[:n] * beta[:n] / scale[:n, None])[~begins]
    return gamma[:n][begins].sum(0), moves * model.move, gamma


def transfers(model: Model, p: Packed) -> np.ndarray:
    """For each block (in the order given) the matrix from its first state's distribution to its last state, up to a factor."""
    k = len(model.start)
    out = model.emit[p.symbols[: p.active[0]]][:, None, :] * np.eye(k)
    for t in range(1, len(p.active)):
        n, lo = p.active[t], p.offsets[t]
        out[:n] = (out[:n] @ model.move) * model.emit[p.symbols[lo : lo + n]][:, None, :]
        out[:n] /= out[:n].sum((1, 2), keepdims=True)
    back = np.empty_like(out)
    back[p.order] = out
    return back


class Chain:
    """What blocks of long texts know of their neighbours: the distribution of the first state (prior), of the state before it (before), and how likely the rest is after each last state (end)."""

    def __init__(self, prior: np.ndarray, before: np.ndarray, end: np.ndarray, begins: np.ndarray) -> None:
        self.prior, self.before, self.end, self.begins = prior, before, end, begins

    def of(self, some: list[int]) -> Chain:
        return Chain(self.prior[some], self.before[some], self.end[some], self.begins[some])


def blocks(model: Model, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, Chain]:
    """Texts cut into blocks, which text each is of, and what they know of each other."""
    cut = [np.split(t, range(BLOCK, len(t), BLOCK)) for t in texts]
    parts, number = [b for c in cut for b in c], np.array([len(c) for c in cut])
    of, k = np.repeat(np.arange(len(texts)), number), len(model.start)
    begins = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    chain = Chain(np.tile(model.start, (len(parts), 1)), np.zeros((len(parts), k)), np.ones((len(parts), k)), begins)
    joined = np.flatnonzero(number[of] > 1)
    matrix = np.empty((len(parts), k, k)) if len(joined) else None
    for group in _groups([parts[i] for i in joined]):
        own = joined[group]
        matrix[own] = transfers(model, Packed([parts[i] for i in own]))
    for i in joined.tolist():
        if not begins[i]:
            a = chain.prior[i - 1] @ matrix[i - 1]
            chain.before[i] = a / a.sum()
            chain.prior[i] = chain.before[i] @ model.move
    for i in joined[::-1].tolist():
        if not begins[i]:
            b = model.move @ (matrix[i] @ chain.end[i])
            chain.end[i - 1] = b / b.sum()
    return parts, of, chain


def _summed(encoded: DataFrame, per_batch, size: int, k: int = STATES):
    """Adds up (k + 1 rows of starts and moves, then a row for each symbol) over all partitions."""
    columns = [f"c{i}" for i in range(k)]

    def run(batches):
        total = np.zeros((size + k + 1, k))
        for batch in batches:
            per_batch([np.frombuffer(x, np.uint16).astype(np.int64) for x in batch["symbols"].to_pylist()], total)
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 10_000):
            part = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[part, j]) for j in range(k))], names=["i", *columns])

    got = map_arrow(encoded.select("symbols"), run, "i long, " + ", ".join(f"{c} double" for c in columns))
    total = np.zeros((size + k + 1, k))
    # A row for each symbol of the fixed vocabulary.
    rows = got.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    total[rows["i"].to_numpy(np.int64)] = rows[columns].to_numpy()
    return total[0], total[1 : k + 1], total[k + 1 :]


def baum_welch(encoded: DataFrame, lexicon: Lexicon, iterations: int = ITERATIONS, states: int = STATES) -> Model:
    spark, size = encoded.sparkSession, len(lexicon.symbol_n)
    planes = max(1, (states - 1).bit_length())
    signs = np.random.default_rng(1).choice([-1.0, 1.0], (size, planes))
    centre = (lexicon.symbol_n @ signs) / max(1.0, lexicon.symbol_n.sum())
    first = spark.sparkContext.broadcast(signs - centre)

    def by_sign(texts, total):
        lengths = np.array([len(t) for t in texts])
        if not len(texts):
            return
        s = np.concatenate(texts)
        side = np.add.reduceat(first.value[s], np.cumsum(lengths) - lengths) > 0
        state = side @ (1 << np.arange(planes)) % states
        total[0] += np.bincount(state, minlength=states)
        total[1 : states + 1] += np.diag(np.bincount(state, lengths - 1, states))
        np.add(total[states + 1 :], np.bincount(s * states + np.repeat(state, lengths), minlength=size * states).reshape(size, states), out=total[states + 1 :])

    start, move, emit = _summed(encoded, by_sign, size, states)
    move = 0.9 * move + 0.1 * move.sum(1, keepdims=True) / states
    model = Model.fitted(start, move, emit, lexicon.symbol_n)
    for _ in range(iterations):
        now = spark.sparkContext.broadcast(model)

        def by_model(texts, total, now=now):
            parts, _, chain = blocks(now.value, texts)
            for group in _groups(parts):
                p = Packed([parts[i] for i in group])
                start, move, gamma = expected(now.value, p, chain.of(group))
                total[0] += start
                total[1 : states + 1] += move
                for j in range(states):
                    total[states + 1 :, j] += np.bincount(p.symbols, gamma[:, j], size)

        model = Model.fitted(*_summed(encoded, by_model, size, states), lexicon.symbol_n)
        now.unpersist()
    return model


def likelihood(encoded: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """keep..., hmm: log10 probability of each row's symbols."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(*keep, "symbols")

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch["symbols"].to_pylist()]
            parts, of, chain = blocks(shared.value, texts)
            each = np.zeros(len(parts))
            for group in _groups(parts):
                each[group] = forward(shared.value, Packed([parts[i] for i in group]), prior=chain.prior[group])[0]
            out = np.bincount(of, each, len(texts)) if len(texts) else each
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(out / np.log(10))], names=[*keep, "hmm"])

    return map_arrow(rows, run, widened(rows.drop("symbols").schema, "hmm double"))


def score(docs: DataFrame, training, keep: tuple[str, ...] = ("doc_id",), iterations: int = ITERATIONS) -> DataFrame:
    """Learns from the rows where the column ``training`` is true; scores all rows."""
    counts = written(token_counts(docs.where(training)), "lm-counts")
    lexicon = Lexicon(counts)
    named = docs.select(*keep, "text", training.alias("training"))
    encoded = written(encode(named, lexicon, (*keep, "training")), "lm-symbols")
    model = baum_welch(encoded.where("training"), lexicon, iterations)
    scored = likelihood(encoded, model, (*keep, "training", "key", "key_b", "n_tokens", "known", "base", "inside"))
    # A table of its own, so that the join can split the copies of one text.
    both = scored.join(written(other_sums(encoded, counts, lexicon), "lm-others"), ["key", "key_b"], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return both.select(*keep, "training", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), (plus("inside", "inside2") + F.col("hmm")).alias("score"))
