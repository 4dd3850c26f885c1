"""HTML extraction: a recurrent block labeller decides what is main text.

Every page becomes its sequence of leaf blocks.  A block's vector has its
hashed tag path (elements and their class, id and role names), its hashed
words, and measures such as its length and share of link text.  A bidirectional
LSTM in numpy reads the sequence both ways, so each block is classified with
the whole page as context; blocks labelled as main text are the result.

The model is trained here, on pages that a seeded generator makes from many
layouts, with menus, headers, footers, sidebars, notices, adverts, forms and
comments round and inside the article.  Training takes some seconds of one task,
once a session; the weights (about 200 kB) are broadcast.

Nulls: null or empty html gives the empty text.  Repeated rows are read each,
alike.  A block whose odds tie is left out.  An empty table gives no rows.  A
very long page is one sequence: a task holds its text and blocks, and the vectors
of GROUP blocks at a time; tags may be nested to any depth, and time and memory
grow with the page's length whether or not its markup is broken or cut off.
Columns besides html and those kept are not looked at, and kept ones may have
any name but those of the result.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, Element, read_blocks
from .shared import CLEARED, map_arrow, widened
from .words import Words

PATH_SIZE, WORD_SIZE, MEASURES = 128, 48, 12
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
HIDDEN = 24
PAGES = 1400
EPOCHS = 6
GROUP = 20_000


#: Sums by those of the elements round one, its tag and names; and whole vectors by sums and the nearest two tags.  Of so many each, 512 bytes are kept.
MOST_KEPT = 20_000
_kept_sums: dict[tuple, tuple[int, np.ndarray]] = {}
_kept_paths: dict[tuple, np.ndarray] = {}
_numbers = itertools.count(1)
CLEARED.extend((_kept_sums.clear, _kept_paths.clear))


def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % PATH_SIZE


def _sums(element: Element) -> tuple[int, np.ndarray]:
    """Half for the tag and one for each name of the element and all round it, up to 2, by hashed place; and a number for these sums.

    Elements with the same tags and names round them share their sums, in all
    pages of a task; one that adds nothing shares those of the one round it, and
    as sums end at 2, no more than 4 x PATH_SIZE are on the way to any.
    """
    way = []
    while element is not None and element.memo is None:
        way.append(element)
        element = element.parent
    now = element.memo if element is not None else (0, np.zeros(PATH_SIZE, np.float32))
    for e in reversed(way):
        key = (now[0], e.tag, e.names)
        found = _kept_sums.get(key)
        if found is None:
            new = now[1].copy()
            new[_place(f"t{e.tag}")] += 0.5
            for name in e.names:
                new[_place(f"n{name}")] += 1.0
            np.minimum(new, 2.0, out=new)
            found = now if np.array_equal(new, now[1]) else (next(_numbers), new)
            if len(_kept_sums) >= MOST_KEPT:
                _kept_sums.clear()
            _kept_sums[key] = found
        e.memo = now = found
    return now


def _path_vector(element: Element | None) -> np.ndarray:
    """Hashed elements and names; names of all ancestors count, the nearest two tags most."""
    if element is None:
        return np.zeros(PATH_SIZE, np.float32)
    number, sums = _sums(element)
    near = [e.tag for e in (element, element.parent) if e is not None]
    out = _kept_paths.get((number, *near))
    if out is None:
        out = sums.copy()
        for tag in near:
            out[_place(f"t{tag}")] += 0.5
        np.minimum(out, 2.0, out=out)
        if len(_kept_paths) >= MOST_KEPT:
            _kept_paths.clear()
        _kept_paths[(number, *near)] = out
    return out


def _measures(b: Block, i: int, n: int) -> list[float]:
    text, size = b.text, len(b.text)
    words = text.count(" ") + 1
    own = b.element.tag if b.element else ""
    return [
        np.log1p(words) / 5, np.log1p(size) / 7, min(1.0, b.linked / size), text[-1] in ".!?…:;\"'”»", sum(map(text.count, ".,;")) / words,
        i / n, float(i < 3), float(n - i <= 3), own in ("h1", "h2", "h3", "h4", "h5", "h6"), own == "p", bool(b.element and b.element.in_list), sum(map(str.isdigit, text)) / size,
    ]


def vectors(pages: list[list[Block]], part: slice = slice(None)) -> np.ndarray:
    """One row for each block of all pages, or of this part of each."""
    blocks = [b for p in pages for b in p[part]]
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    w = Words([b.text.encode("utf-8", "replace") for b in blocks], lower=True, trim=2)
    of = w.doc_of_words()
    counts = np.bincount(of * WORD_SIZE + (w.hashes % np.uint64(WORD_SIZE)).astype(np.int64), minlength=len(blocks) * WORD_SIZE).reshape(-1, WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt(1 + counts.sum(1, keepdims=True))
    k = 0
    for p in pages:
        for i in range(len(p))[part]:
            x[k, :PATH_SIZE] = _path_vector(p[i].element)
            x[k, PATH_SIZE + WORD_SIZE :] = _measures(p[i], i, len(p))
            k += 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a logistic layer over its states and inputs."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = r.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{way}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"b{way}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["o"] = r.normal(0, HIDDEN**-0.5, 2 * HIDDEN).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, memory: bool, before: tuple[np.ndarray, np.ndarray] | None = None):
        """x: (steps, pages, INPUT); states (steps, pages, HIDDEN), the gates if wanted, and what to go on with (h, c)."""
        steps, pages, _ = x.shape
        given = x.reshape(-1, INPUT) @ self.p[f"x{way}"] + self.p[f"b{way}"]
        given = given.reshape(steps, pages, -1)
        h, c = before or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        states, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"h{way}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if memory:
                kept.append((t, i, f, o, g, c, squashed, h))
            c, h = np.where(m, new, c), np.where(m, o * squashed, h)
            states[t] = h
        return states, kept, (h, c)

    def _back(self, way: str, x, mask, kept, d_states, grads) -> None:
        steps, pages, _ = x.shape
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t, i, f, o, g, c, squashed, h in reversed(kept):
            m = mask[t][:, None]
            dh = dh + d_states[t]
            own_h, own_c = dh * m, dc * m
            d_new = own_c + own_h * o * (1 - squashed**2)
            dz = np.concatenate((d_new * g * i * (1 - i), d_new * c * f * (1 - f), own_h * squashed * o * (1 - o), d_new * i * (1 - g**2)), 1)
            dz_all[t] = dz
            grads[f"h{way}"] += h.T @ dz
            dh, dc = dh * ~m + dz @ self.p[f"h{way}"].T, dc * ~m + d_new * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"x{way}"] += x.reshape(-1, INPUT).T @ flat
        grads[f"b{way}"] += flat.sum(0)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _, _ = self._run("f", x, mask, False)
        b, _, _ = self._run("b", x, mask, False)
        return f @ self.p["o"][:HIDDEN] + b @ self.p["o"][HIDDEN:] + self.p["c"]

    def logits_of_one(self, page: list[Block], step: int) -> np.ndarray:
        """The same for one page, with the vectors of so many blocks at once: what is read either way is carried on."""
        out, starts = np.full(len(page), self.p["c"], np.float32), range(0, len(page), step)
        for way, order, o in (("f", starts, self.p["o"][:HIDDEN]), ("b", reversed(starts), self.p["o"][HIDDEN:])):
            carried = None
            for a in order:
                x = vectors([page], slice(a, a + step))[:, None]
                states, _, carried = self._run(way, x, np.ones(x.shape[:2], bool), False, carried)
                out[a : a + step] += states[:, 0] @ o
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the blocks."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        f, kept_f, _ = self._run("f", x, mask, True)
        b, kept_b, _ = self._run("b", x, mask, True)
        s = _sigmoid(f @ self.p["o"][:HIDDEN] + b @ self.p["o"][HIDDEN:] + self.p["c"])
        d = (((s - y) * mask) / mask.sum()).astype(np.float32)
        grads["o"] = np.concatenate((np.tensordot(d, f, ([0, 1], [0, 1])), np.tensordot(d, b, ([0, 1], [0, 1]))))
        grads["c"] = d.sum(keepdims=True).reshape(1)
        self._back("f", x, mask, kept_f, d[..., None] * self.p["o"][:HIDDEN], grads)
        self._back("b", x, mask, kept_b, d[..., None] * self.p["o"][HIDDEN:], grads)
        return grads


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, INPUT) and the mask of the real blocks."""
    out, mask = np.zeros((max(sizes), len(sizes), x.shape[1]), np.float32), np.zeros((max(sizes), len(sizes)), bool)
    at = 0
    for k, n in enumerate(sizes):
        out[:n, k], mask[:n, k] = x[at : at + n], True
        at += n
    return out, mask


def fit(pages: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 1, rate: float = 0.01) -> Labeller:
    """pages: html and the texts of its main blocks."""
    model, r = Labeller(seed), np.random.default_rng(seed)
    data = []
    for page, main in pages:
        blocks = read_blocks(page)
        if blocks:
            wanted = set(main)
            data.append((vectors([blocks]), np.array([b.text in wanted for b in blocks], np.float32)))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    step = 0
    for epoch in range(epochs):
        for k in r.permutation(len(batches)).tolist():
            sizes = [len(y) for _, y in batches[k]]
            x, mask = padded(np.concatenate([x for x, _ in batches[k]]), sizes)
            y = np.zeros(mask.shape, np.float32)
            y.T[mask.T] = np.concatenate([y for _, y in batches[k]])
            step += 1
            for name, g in model.gradients(x, mask, y).items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[name] -= rate * (0.5 ** (epoch // 3)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


@functools.lru_cache(1)
def trained() -> Labeller:
    from .pagegen import page

    return fit([page(i) for i in range(PAGES)])


_SENT: dict = {}


def weights(spark):
    """The trained weights as a broadcast, made by one task and once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _SENT:

        def run(batches):
            for batch in batches:
                for _ in range(batch.num_rows):
                    made = trained().p
                    yield pa.RecordBatch.from_pydict({"name": list(made), "shape": [list(v.shape) for v in made.values()], "data": [v.astype(np.float32).tobytes() for v in made.values()]}, schema=pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())]))

        # Nine arrays of a fixed size.
        rows = spark.range(0, 1, 1, 1).mapInArrow(run, "name string, shape array<int>, data binary").collect()
        _SENT[key] = spark.sparkContext.broadcast({r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in rows})
    return _SENT[key]


def labels(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order and len(pages[order[-1]]) > GROUP:
        i = order.pop()
        out[i] = model.logits_of_one(pages[i], GROUP) > 0
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= GROUP:
            end += 1
        own = order[at:end]
        x, mask = padded(vectors([pages[i] for i in own]), [len(pages[i]) for i in own])
        yes = model.logits(x, mask) > 0
        for k, i in enumerate(own):
            out[i] = yes[: len(pages[i]), k]
        at = end
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), model: Labeller | None = None) -> DataFrame:
    """keep..., text, n_chars, n_blocks, n_kept of each row of pages (html)."""
    spark = pages.sparkSession
    sent = weights(spark) if model is None else spark.sparkContext.broadcast(model.p)
    rows = pages.select(*keep, pages["html"].alias("_html"))

    def run(batches):
        own = Labeller()
        own.p = sent.value
        for batch in batches:
            html = [x or "" for x in batch["_html"].to_pylist()]
            for a in range(0, len(html), 200):
                part = [read_blocks(x) for x in html[a : a + 200]]
                which = labels(own, part)
                texts = ["\n\n".join(b.text for b, y in zip(blocks, yes, strict=True) if y) for blocks, yes in zip(part, which, strict=True)]
                columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in part], pa.int32()), pa.array([int(y.sum()) for y in which], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, len(part)) for c in keep), *columns], names=[*keep, "text", "n_chars", "n_blocks", "n_kept"])

    return map_arrow(rows, run, widened(rows.select(*keep).schema, "text string, n_chars long, n_blocks int, n_kept int"))
