"""MinHash near-dedup by chosen-path set similarity join.

A document is the set of its distinct five-word shingles (A-Z folded; fewer
words: the whole sequence).  Rows with equal sets are one node, whatever their
ids; nodes are numbered and carry a signature of T minwise tokens.

Each of TREES independent trees branches documents recursively: in a tree node
every document follows BRANCHES minwise tokens whose numbers the node's own
hash selects, so two documents of similarity s share a child BRANCHES * s times
on average, over one at the threshold, however deep the tree becomes.  A tree
node of at most LEAF documents is compared exhaustively, from T bytes a
document.  A larger one branches again, unless it holds over SIMILAR of the
node it comes from: then branching does not part its documents, and it is
compared in blocks that all hold some pivots.

Estimates over LOW connect documents to groups; a link can only be inside a
group.  There all pairs are compared by their full sets, as a product of the
group's incidence matrix, and the links that span what is linked are the
result.  Groups over LEAF documents are compared in blocks too; their pivots
are the documents nearest to the group's commonest tokens.

Whatever blocks may have missed is done after them, without bounds: documents
that are not connected with most of their group meet every block of it.

Recall: a pair of similarity 0.75 misses all trees with a chance under 1e-4,
and LOW with one under 1e-3.  Full sets hold 64 bits of each shingle's hash.

Nulls: a null text is empty; an empty document or one without words is linked
with nothing.  A row without an id is linked like any other; it has the least
id of its component, null if none of it has one, and is kept only then.
Repeated ids: rows of one id with different texts are documents of their own,
each searched and each in its own component; equal rows get the same component
and are all kept if their id is its least.  An empty table gives no rows; texts
may be as long as a task's memory holds some ten times; columns besides doc_id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, map_arrow, text_bytes, written
from .words import Words, chunks, mixed, shingles

SHINGLE = 5
WORD = "[^\\x20\\x09-\\x0D]"
PERCENT = 75
T = 128
TREES = 4
BRANCHES = 2
LEAF = 768
BLOCK = 256
PIVOTS = 32
#: A group of long documents counts as one document for so many shingles, which bounds a task's memory.
SHINGLES = 3000
#: Shingles that are compared at once.
SLICE = 1_000_000
#: Two documents that have this share of their shingles in common have a similarity of 0.67.
SIMILAR = 0.8
LOW = round(T * 0.617)
MAX_DEPTH = 40
#: Rows with the same of these are equal to the operator.
KEY = ("doc_id", "key_a", "key_b")

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, T, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 32, T, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    all_of = shingles(w.hashes, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_of[a : b - k + 1]))
        elif b > a:
            out.append(shingles(w.hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """T minwise tokens (32 bits) of each set; sets must not be empty."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), T), np.uint32)
    for k in range(T):
        out[:, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MULTIPLY[k], starts)
    return out


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, keep..., text and key_a, key_b: two hashes that name the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    return rows.withColumn("key_a", F.xxhash64(F.lit(1), "text")).withColumn("key_b", F.xxhash64(F.lit(2), "text"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b, n_shingles, digest (16 bytes of the set), tokens (T minwise tokens)."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch["text"])
            n, digest, tokens = [], [], []
            for a, b in chunks(texts, 1 << 20):
                sets = shingle_sets(texts[a:b])
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some)) if some else iter(())
                for s in sets:
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    tokens.append(next(sig).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in KEY), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary())], names=[*KEY, "n_shingles", "digest", "tokens"])

    return map_arrow(keyed(docs), run, "doc_id long, key_a long, key_b long, n_shingles long, digest binary, tokens binary")


def _branch(nodes: DataFrame) -> DataFrame:
    """path, id, above, low of the children; nodes: id, tokens and, below the roots, path and size.

    above is the size of the node they come from, 0 at the roots; low has the
    low bytes of all tokens, enough to estimate similarity.
    """
    below = "path" in nodes.columns

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch["id"], np.int64)
            sig = np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.uint32).reshape(-1, T)
            above = np.asarray(batch["size"], np.int64) if below else np.zeros(len(ids), np.int64)
            low = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            parents = [np.asarray(batch["path"], np.int64).view(np.uint64)] if below else [np.full(len(ids), mixed(np.array([r + 1], np.uint64))[0]) for r in range(TREES)]
            for parent in parents:
                at = (parent % np.uint64(T)).astype(np.int64)
                step = (mixed(parent) % np.uint64(T // 2)).astype(np.int64) * 2 + 1
                for b in range(BRANCHES):
                    k = (at + (b + 1) * step) % T
                    child = mixed(mixed(parent + k.astype(np.uint64)) + sig[np.arange(len(ids)), k])
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids), pa.array(above), low], names=["path", "id", "above", "low"])

    return map_arrow(nodes.select("id", "tokens", *(["path", "size"] if below else [])), run, "path long, id long, above long, low binary")


def _low_bytes(nodes: DataFrame) -> DataFrame:
    """id and the low bytes of the tokens."""

    def run(batches):
        for batch in batches:
            low = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(low, pa.binary())], names=["id", "low"])

    return map_arrow(nodes.select("id", "tokens"), run, "id long, low binary")


def _agreements(low: np.ndarray):
    """(first row, counts of equal bytes with all rows) for blocks of rows."""
    for i in range(0, len(low), 32):
        yield i, (low[i : i + 32, None, :] == low[None, :, :]).sum(2, dtype=np.int16)


def _forest(linked) -> list[tuple[int, int]]:
    """Pairs of rows that span what is linked; linked(i) gives the links of row i as booleans."""
    n, pairs = linked.shape[0], []
    free = np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            pairs += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    return pairs


def _alike(low: np.ndarray) -> np.ndarray:
    """Which rows' estimates are over LOW."""
    out = np.empty((len(low), len(low)), bool)
    for i, agree in _agreements(low):
        out[i : i + len(agree)] = agree >= LOW
    return out


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets (sorted) are similar enough, by products of their incidence matrix, a range of values at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    both = np.zeros((n, n))
    slices = int(sizes.sum()) // SLICE + 1
    cuts = np.array([(k << 64) // slices for k in range(1, slices)], np.uint64)
    at = np.stack([np.concatenate(([0], np.searchsorted(s, cuts), [len(s)])) for s in sets])
    for k in range(at.shape[1] - 1):
        value = np.concatenate([s[i:j] for s, i, j in zip(sets, at[:, k], at[:, k + 1], strict=True)])
        of = np.repeat(np.arange(n), at[:, k + 1] - at[:, k])
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[column] > 1
        column, of = number[column[shared]], of[shared]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, (first, first + 2048))
            x = np.zeros((n, 2048), np.float32)
            x[of[lo:hi], column[lo:hi] - first] = 1
            both += x @ x.T
    return 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)


def _pairs(rows: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    """a, b (a < b): links that span what is alike in each group of rows.

    rows: keys..., id, and low (estimates) or set (exact).  A group has some
    LEAF rows; rows are streamed in the order of groups.
    """
    data = "set" if exact else "low"
    dealt = rows.select(*keys, "id", data).repartition(*keys).sortWithinPartitions(*keys, "id")

    def groups(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            own = [np.asarray(held[k]) for k in keys]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in own])) + 1
            if len(ends):
                yield held.slice(0, ends[-1]), np.concatenate(([0], ends))
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield held, np.array([0, held.num_rows])

    def run(batches):
        for table, bounds in groups(batches):
            ids, values = np.asarray(table["id"], np.int64), table[data].to_pylist()
            out: list[tuple[int, int]] = []
            if exact:
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if b - a > 1:
                        out += [(a + i, a + j) for i, j in _forest(_linked([np.frombuffer(x, np.uint64) for x in values[a:b]]))]
            else:
                low = np.frombuffer(b"".join(values), np.uint8).reshape(-1, T)
                two = bounds[np.flatnonzero(np.diff(bounds) == 2)]
                hit = two[(low[two] == low[two + 1]).sum(1) >= LOW]
                out += list(zip(hit.tolist(), (hit + 1).tolist(), strict=True))
                for k in np.flatnonzero(np.diff(bounds) > 2).tolist():
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    out += [(a + i, a + j) for i, j in _forest(_alike(low[a:b]))]
            x, y = (ids[[p[k] for p in out]] if out else ids[:0] for k in (0, 1))
            differ = x != y
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[differ]), pa.array(np.maximum(x, y)[differ])], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def _sets_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, set: the full sets (64 bits of each shingle) of these nodes, from the row that stands for each."""
    chosen = ids.join(nodes.select("id", "row.*"), "id").withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    texts = keyed(docs).join(chosen, same).select("id", "text")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch["text"])
            sets = [s.tobytes() for a, b in chunks(texts) for s in shingle_sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], names=["id", "set"])

    # Equal rows all come here; one of them is enough.
    return written(map_arrow(texts, run, "id long, set binary").dropDuplicates(["id"]), "shingle-sets")


def _tree_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(path, id, low) of the tree nodes to compare whole, and (path, id, size, low) of those to compare in blocks.

    Only the sizes of nodes over LEAF are looked up.
    """
    leaves, blocked, level = None, None, _branch(nodes)
    for depth in range(MAX_DEPTH):
        big = written(level.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > LEAF), "big-nodes")
        if big.isEmpty():
            small = level.select("path", "id", "low")
            return small if leaves is None else leaves.unionByName(small), blocked
        sized = level.join(big, "path", "left")
        small = sized.where("size is null").select("path", "id", "low")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = written(sized.where("size is not null").select("path", "id", "size", "above", "low"), "large-nodes")
        alike = (F.col("size") > SIMILAR * F.col("above")) & (F.col("above") > 0) if depth < MAX_DEPTH - 1 else F.lit(True)
        own = large.where(alike).select("path", "id", "size", "low")
        blocked = own if blocked is None else blocked.unionByName(own)
        level = written(_branch(large.where(~alike).select("path", "id", "size").join(nodes.select("id", "tokens"), "id")), "paths")
    return leaves, blocked


def _blocks(large: DataFrame, group: str, pivots: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """group, block, id, extra...: each row (group, id, size, extra...) in one block of its group, the pivots in all.

    Without given pivots (group, id) some PIVOTS rows are taken by hash.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), count).cast("int")
    if pivots is None:
        marked = large.withColumn("_all", F.pmod(F.xxhash64("id", F.lit(4)), F.col("size")) < PIVOTS)
    else:
        marked = large.join(pivots.withColumn("_all", F.lit(True)), [group, "id"], "left").withColumn("_all", F.coalesce("_all", F.lit(False)))
    return marked.select(group, "id", *extra, F.explode(F.when(F.col("_all"), F.sequence(F.lit(0), count - 1)).otherwise(F.array(own))).alias("block"))


def _apart(large: DataFrame, group: str, label: DataFrame, in_blocks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """group, block, part, id, extra...: rows without the label most of their group have, with every block of it.

    They come in parts of some LEAF rows, each of which meets all blocks.
    """
    named = large.join(label, "id", "left").withColumn("label", F.coalesce("component", "id"))
    most = named.groupBy(group, "label").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    apart = written(named.join(most, group).where("label != main").select(group, "id", "size", *extra), "apart")
    weight = F.greatest(F.count("*"), F.sum("n_shingles") / SHINGLES) if "n_shingles" in extra else F.count("*")
    parts = apart.groupBy(group).agg(F.ceil(weight / LEAF).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    mine = apart.join(parts, group).select(group, "id", *extra, F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block"), part.alias("part"))
    theirs = in_blocks.join(parts, group).select(group, "id", *extra, "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return mine.unionByName(theirs).distinct()


def _central(large: DataFrame, group: str, low: DataFrame) -> DataFrame:
    """group, id: the PIVOTS rows of each group that agree most with the commonest byte at every place."""
    rows = large.select(group, "id").join(low, "id")
    place = F.sequence(F.lit(1), F.lit(T))
    each = rows.select(group, F.explode(F.transform(place, lambda k: F.struct(k.alias("k"), F.substring(F.col("low"), k, F.lit(1)).alias("v")))).alias("e"))
    common = each.groupBy(group, "e.k", "e.v").agg(F.count("*").alias("n")).groupBy(group, "k").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    consensus = common.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("c"))
    agree = F.aggregate(place, F.lit(0), lambda s, k: s + F.when(F.get("c", k - 1) == F.substring(F.col("low"), k, F.lit(1)), 1).otherwise(0))
    scored = rows.join(consensus, group).select(group, "id", agree.alias("agree"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("agree"), "id"))
    return scored.withColumn("_n", first).where(F.col("_n") <= PIVOTS).select(group, "id")


def _estimated(nodes: DataFrame) -> DataFrame:
    """id, component: nodes that estimates over LOW connect in some tree."""
    leaves, blocked = _tree_nodes(nodes)
    members = leaves.withColumn("block", F.lit(0))
    if blocked is not None:
        in_blocks = written(_blocks(blocked, "path", extra=("low",)), "blocks")
        members = members.unionByName(in_blocks)
    pairs = written(_pairs(members, ["path", "block"], False).distinct(), "pairs")
    found = components(pairs)
    if blocked is None:
        return found
    more = written(_pairs(_apart(blocked, "path", found, in_blocks, ("low",)), ["path", "block", "part"], False), "pairs")
    return found if more.isEmpty() else components(pairs.unionByName(more))


def numbered(sketched: DataFrame) -> DataFrame:
    """id, digest, row (the least key), tokens, n_shingles: a row for each set, numbered as it is written."""
    # Equal sets meet in the map tasks first, so the hottest of them is a row a task.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEY)).alias("row")
    sets = sketched.where("digest is not null").groupBy("digest").agg(row, F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "nodes")


def joined(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component of all linked nodes."""
    low = _low_bytes(nodes)
    group = _estimated(nodes).withColumnRenamed("component", "near")
    group = written(group.join(nodes.select("id", "n_shingles"), "id"), "groups")
    size = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("size")
    sized = group.join(group.groupBy("near").agg(size), "near")
    large = written(sized.where(F.col("size") > LEAF), "large")
    any_large = not large.isEmpty()
    dealt = sized.where(F.col("size") <= LEAF).select("near", "id", F.lit(0).alias("block"))
    if any_large:
        in_blocks = written(_blocks(large, "near", _central(large, "near", low), ("n_shingles",)), "blocks")
        dealt = dealt.unionByName(in_blocks.select("near", "id", "block"))
    sets = _sets_of(group.select("id"), nodes, docs)
    pairs = written(_pairs(dealt.join(sets, "id"), ["near", "block"], True), "links")
    found = components(pairs)
    if any_large:
        more = written(_pairs(_apart(large, "near", found, in_blocks, ("n_shingles",)).join(sets, "id"), ["near", "block", "part"], True), "links")
        if not more.isEmpty():
            found = components(pairs.unionByName(more))
    found = written(found, "components")
    dropped(sets)
    return found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b, n_shingles, component_id, first: a row for every row of docs.

    first tells the rows equal to the one that stands for their component: its
    least id, and of rows with that id the least key.  It is null without words.
    """
    docs = docs.select("doc_id", "text")
    sketched = written(sketch(docs), "sketch")
    nodes = numbered(sketched)
    member = written(joined(docs, nodes).join(nodes.select("id", "row"), "id"), "members")
    # Tables of their own, so that the joins with them can split a large component or set.
    least = written(member.groupBy("component").agg(F.min("row").alias("least")), "least-rows")
    member = written(member.join(least, "component").select("id", "least"), "named")
    named = nodes.select("id", "digest", "row").join(member, "id", "left").select("digest", F.coalesce("least", "row").alias("least"))
    rows = sketched.select(*KEY, "n_shingles", "digest").join(written(named, "sets"), "digest", "left")
    first = F.struct(F.col("doc_id").isNull().alias("none"), *KEY) == F.col("least")
    return rows.select(*KEY, "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), F.when(F.col("least").isNotNull(), first).alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of docs."""
    return classes(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """These columns of one row of each component, and of every row without words; doc_id and text are among them.

    Of rows with equal id and text the one whose other columns are least stays.
    """
    stays = written(classes(docs).where("first").select(*(F.col(c).alias(f"_{c}") for c in KEY)).distinct(), "representatives")
    other = [c for c in columns if c not in ("doc_id", "text")]
    rows = keyed(docs.select("doc_id", "text", (F.struct(*other) if other else F.lit(0)).alias("other")), "other")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # Equal rows meet before they travel.
    least = rows.where(worded).groupBy(*KEY).agg(F.min(F.struct("other", "text")).alias("least"))
    chosen = least.join(stays, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_semi").select("doc_id", "least.*")
    both = chosen.unionByName(rows.where(~worded).select("doc_id", "other", "text"))
    return both.select(*(F.col(c if c in ("doc_id", "text") else f"other.{c}") for c in columns))
