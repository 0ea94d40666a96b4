"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Sets are the distinct five-word shingles of whole texts. Documents of one set are one class, found by a 128-bit key. Each class
has TOKENS minwise tokens and a sketch of two bits from each of SKETCH minwise values. The join recurses from the root of
several independent trees: every node draws positions of the minwise tokens by its own hash, and a class goes to the child
(node, position, its token there). Classes of similarity s meet in a child with probability s for each position drawn.

A node of at most SMALL classes is compared exhaustively: sketches tell which of its classes hang together by plausible pairs,
and each such cluster is confirmed on full sets, all of its pairs at once. Larger nodes are first cut into random blocks, each
with the node's pivot; then the classes outside the node's largest component are compared with all of the node, block by block,
or the node recurses if those are many. Within one component no comparison can change the result.

No pair ever leaves a task. What goes from step to step is a row for each class of a cluster, and a star of links for each
component found in it. The same cluster met in several nodes is confirmed once; the clusters of the first tree come first, so
that those of the others are confirmed only if they still hold several components. Full sets are made from texts once for the
classes that a cluster names, in one scan more than that for the features.

Recall: a pair at the threshold is in a common child of one node with probability 1 - 0.15 ** BRANCHES[0], so that it misses
all TREES trees at the first level with probability 1e-10; deeper levels only split nodes that are large and mixed. The
sketch drops a pair at the threshold with probability 3e-5 (four standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, discard, materialise, mix64, shingle_sets, steps, whole_rows, word_hashes

#: Linked from 100 * intersection >= PERCENT * union on.
PERCENT = 85
TOKENS = 64
SKETCH = 512
SKETCH_BYTES = SKETCH // 4
TREES = 4
#: Positions drawn by a node at each level; at the last entry's level and below, that many on average.
BRANCHES = (3, 3, 1.2)
#: Classes up to which a node is compared exhaustively.
SMALL = 400
#: Comparisons by sketch, of a large node's classes outside its largest component with all, up to which it does not recurse.
CROSS = 10_000_000
#: Levels of recursion; nodes that are still large and mixed at the last one are compared exhaustively, block by block.
LEVELS = 12
#: Outsiders, and members that they are compared with, in one run.
OUTSIDERS = 1000
#: Shingles of the sets that are confirmed together, about; a larger cluster is confirmed by pairs of its blocks.
RUN_SHINGLES = 1_000_000
#: Shingles that one step of the confirmation counts.
COLUMNS = 8192
#: Links that one task contracts at most.
TASK_LINKS = 500_000
#: Bits of the filter that picks the texts for confirmation: so many for each class wanted, up to 2 ** FILTER_BITS (16 MB).
FILTER_EACH = 16
FILTER_BITS = 27

_FEATURES = "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, tokens binary, sketch binary"
_CLUSTER = "turn int, cluster bigint, key binary"
_PAIR = "a binary, b binary"
_MULTIPLY = (mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = mix64(np.arange(7001, 7001 + SKETCH, dtype=np.uint64)).astype(np.uint32)


def least_equal(percent: int) -> int:
    """Equal sketch values that a pair needs: four standard deviations below the expected number at the threshold."""
    p = percent / 100
    p += (1 - p) / 4
    return int(SKETCH * p - 4 * (SKETCH * p * (1 - p)) ** 0.5)


def _chunk_words(chunks: list[bytes]) -> list[list[int]]:
    return [[h] for h in word_hashes(chunks)]


def text_sets(table: ChunkTable, texts: list[str | None]) -> list[np.ndarray]:
    """Shingle sets: A-Z lower-cased, words between ASCII white space."""
    words, sizes = table.values(t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts)
    return shingle_sets(words, sizes)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of the set's hashes under each of SKETCH linear functions modulo 2 ** 32."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 1024):
        values = h[at : at + 1024, None] * _MULTIPLY
        values += _ADD
        np.minimum(least, values.min(axis=0), out=least)
    return least


def sketch_of(least: np.ndarray) -> bytes:
    """Two bits of each minwise value, four values a byte."""
    two = ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def equal_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the SKETCH values are equal, for rows of sketches as 64-bit words."""
    odd = x ^ y
    odd |= odd >> np.uint64(1)
    odd &= np.uint64(0x5555555555555555)
    return SKETCH - np.bitwise_count(odd).sum(axis=1, dtype=np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = ChunkTable(_chunk_words, limit=200_000)
    for b in batches:
        texts, sizes, keys, tokens, sketches = b["text"].to_pylist(), [], [], [], []
        for i, j in steps(texts):
            for s in text_sets(table, texts[i:j]):
                least = minwise(s) if len(s) else None
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                tokens.append(least[:TOKENS].tobytes() if len(s) else None)
                sketches.append(sketch_of(least) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, tokens, sketches)]], names=["doc_id", "text_hash", "n_shingles", "key", "tokens", "sketch"])


def _stack(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _sketches(column: pa.Array) -> np.ndarray:
    return _stack(column, "<u8", SKETCH_BYTES // 8)


def _children(level: int):
    """Rows (node, key, kid, n, tokens) to rows (node, turn, key, kid, n) of the children.

    At level 0 the roots of all trees are the parents, and turn is 0 in the first tree and 1 in the others; below it is 0.
    """
    wanted = BRANCHES[min(level, len(BRANCHES) - 1)]
    draws = int(np.ceil(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens = _stack(b["tokens"], "<u4", TOKENS)
            if level == 0:
                parents = np.tile(mix64(np.arange(1, TREES + 1, dtype=np.uint64)), (b.num_rows, 1))
            else:
                parents = b["node"].to_numpy().astype(np.int64).view(np.uint64)[:, None]
            out, take = [], []
            for k in range(draws):
                drawn = mix64(parents + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
                value = np.take_along_axis(tokens, (drawn % np.uint64(TOKENS)).astype(np.int64), axis=1).astype(np.uint64)
                out.append(mix64(drawn ^ mix64(value + np.uint64(0x2545F4914F6CDD1D))))
                take.append((mix64(drawn) >> np.uint64(11)).astype(float) / 2.0**53 < wanted - k)  # the last draw happens in a share of the nodes
            turns = np.tile(np.minimum(np.arange(parents.shape[1]), 1), (b.num_rows, draws)).reshape(-1)
            nodes, take = np.concatenate(out, axis=1), np.concatenate(take, axis=1).reshape(-1)
            at = pa.array(np.repeat(np.arange(b.num_rows), nodes.shape[1])[take])
            columns = [pa.array(nodes.reshape(-1)[take].view(np.int64), pa.int64()), pa.array(turns[take], pa.int32()), *[b[c].take(at) for c in ("key", "kid", "n")]]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "turn", "key", "kid", "n"])

    return run


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives the ends of all edges (x, y), and what had their labels, the least label of their component."""
    while len(x):
        a, b = label[x], label[y]
        on = a != b
        if not on.any():
            return
        x, y, low, high = x[on], y[on], np.minimum(a, b)[on], np.maximum(a, b)[on]
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _screen(percent: int):
    """Rows (run, turn, key, n, sketch, root) sorted by run to the clusters (turn, cluster, key) of each run.

    A cluster is the classes of a run that hang together by pairs of different roots whose sizes and sketches allow a link;
    its name is a hash of its keys. One of more than RUN_SHINGLES shingles becomes one cluster for each pair of its blocks.
    """
    need = least_equal(percent)

    def named(rows: np.ndarray, hashes: np.ndarray) -> int:
        return int(mix64(hashes[rows]).sum(dtype=np.uint64).view(np.int64))

    def plausible(n, sketch, root, starts, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for size in np.unique(sizes):
            i, j = np.triu_indices(size, 1)
            runs = starts[sizes == size]
            per = max(1, 40_000 // max(1, len(i)))
            for at in range(0, len(runs), per):
                x, y = ((runs[at : at + per, None] + z[None, :]).reshape(-1) for z in (i, j))
                ok = (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & (root[x] != root[y])
                x, y = x[ok], y[ok]
                equal = np.concatenate([equal_values(sketch[x[k : k + 40_000]], sketch[y[k : k + 40_000]]) for k in range(0, len(x), 40_000)] or [np.empty(0, int)])
                yield x[equal >= need], y[equal >= need]

    def clusters(t: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        keys, n = t["key"].combine_chunks(), t["n"].to_numpy()
        label = np.arange(len(n))
        for x, y in plausible(n, _sketches(t["sketch"]), t["root"].to_numpy(), starts, sizes):
            _merge(label, x, y)
        rows = np.flatnonzero(np.bincount(label, minlength=len(n))[label] > 1)
        rows = rows[np.argsort(label[rows], kind="stable")]
        hashes = _stack(keys, "<u8", 2)[:, 0]
        first = np.flatnonzero(np.concatenate([[True], label[rows][1:] != label[rows][:-1]])) if len(rows) else np.empty(0, int)
        out_rows, out_names = [], []
        for group in np.split(rows, first[1:]) if len(rows) else ():
            total = n[group].sum()
            if total <= RUN_SHINGLES or len(group) == 2:
                out_rows.append(group)
                out_names.append(np.full(len(group), named(group, hashes)))
                continue
            group = group[np.argsort(n[group], kind="stable")]
            block = np.minimum(np.cumsum(n[group]) * 2 // RUN_SHINGLES, np.arange(len(group)))
            parts = np.split(group, np.flatnonzero(np.diff(block)) + 1)
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    both = np.concatenate([parts[i], parts[j]])
                    out_rows.append(both)
                    out_names.append(np.full(len(both), named(both, hashes)))
        at = pa.array(np.concatenate(out_rows) if out_rows else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([t["turn"].combine_chunks().take(at), pa.array(np.concatenate(out_names) if out_names else [], pa.int64()), keys.take(at)], names=["turn", "cluster", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool):
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            node = t["run"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            end = len(node) if last else starts[-1]
            held = [] if last else t.slice(end).to_batches()
            starts = starts[starts < end]
            if end:
                yield clusters(t.slice(0, end), starts, np.diff(np.append(starts, end)))

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= 20_000:
                    yield from done(False)
                    rows = 0
        if held:
            yield from done(True)

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of the sorted sets the first one of its component, over all pairs that are linked."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, width = np.zeros((len(sets), len(sets)), np.int64), int(common.sum())
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        both += (dense @ dense.T).astype(np.int64)
    label = np.arange(len(sets))
    x, y = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    _merge(label, x, y)
    return label


def _confirmed(percent: int):
    """Rows (cluster, key, set) sorted by cluster to links (a, b): a star for each component found in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []
        links: list[tuple[bytes, bytes]] = []

        def done():
            if len(keys) > 1:
                label = linked(sets, percent)
                links.extend((keys[i], keys[k]) for i, k in enumerate(label.tolist()) if i != k)

        for x in batches:
            for at, key, s in zip(x["cluster"].to_pylist(), x["key"].to_pylist(), x["set"], strict=True):
                if at != now:
                    done()
                    now, keys, sets = at, [], []
                keys.append(key)
                sets.append(np.frombuffer(s.as_py(), "<u8"))
            yield _pairs(links)
            links.clear()
        done()
        yield _pairs(links)

    return run


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


class _Forest:
    """Disjoint sets of keys, each named by its least key."""

    def __init__(self):
        self.parent: dict[bytes, bytes] = {}

    def root(self, k: bytes) -> bytes:
        parent, top = self.parent, k
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[k] != top:
            parent[k], k = top, parent[k]
        return top

    def join(self, a: bytes, b: bytes) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _filter_words(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of every doc_id: at most 2 ** bits / 64 numbers reach the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.where("doc_id is not null").select(bit.alias("bit")).selectExpr("bit >> 6 AS word", "shiftleft(1L, CAST(bit & 63 AS int)) AS bits")
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, set: the full shingle sets of the wanted keys, made from the texts of their classes' first documents.

    A bit filter on doc_id picks the texts, so that no others are hashed or shuffled but for a share of one in FILTER_EACH
    while the filter is within its bound; what passes it by chance falls out in the join with the wanted keys.
    """
    ids = materialise(wanted.join(classes.select("key", "doc_id"), "key").select("key", "doc_id"), "wanted")
    bits = min(FILTER_BITS, max(12, (FILTER_EACH * ids.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(ids, bits))
    rows = docs.select("doc_id", F.col("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = ChunkTable(_chunk_words, limit=200_000), shared.value
        for b in batches:
            bit = b["bit"].to_numpy()
            on = (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            on |= b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            texts = b["text"].filter(pa.array(on)).to_pylist()
            for i, j in steps(texts):
                sets = [s for s in text_sets(table, texts[i:j]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    found = rows.mapInArrow(run, "key binary, set binary").join(ids.select("key"), "key", "left_semi").dropDuplicates(["key"])
    found = materialise(found, "sets")
    shared.destroy()
    discard(ids)
    return found


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of one task to links (key, least key of its component within the task)."""
    forest = _Forest()
    for x in batches:
        for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True):
            forest.join(a, b)
    keys = list(forest.parent)
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([forest.root(k) for k in part], pa.binary())], names=["key", "root"])


def components(links: DataFrame) -> DataFrame:
    """key, root: the least key of each key's component, for keys in links (a, b).

    Links are first contracted to stars within tasks of at most TASK_LINKS links; with more tasks than one, the stars are joined
    by alternating large and small stars until nothing changes. Each of those rounds is two joins with partial sums, written to
    the shared folder; no list of neighbours is ever gathered.
    """
    n = links.count()
    tasks = max(1, -(-n // TASK_LINKS))
    forest = materialise((links.coalesce(1) if tasks == 1 else links.repartition(tasks)).mapInArrow(_forest, "key binary, root binary"), "forest")
    if tasks == 1:
        return forest
    links = forest.select(F.col("key").alias("a"), F.col("root").alias("b"))
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # Large star: every larger neighbour of u to the least of u and its neighbours.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours to the least of them.
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(least, "u")
        after = materialise(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(edges)
        edges = after
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("key"), F.col("v").alias("root"))).distinct()


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members with `root`, a hash of the key of each one's component."""
    if roots is None:
        return members.withColumn("root", F.xxhash64("key"))
    return members.join(roots.select("key", F.col("root").alias("_root")), "key", "left").withColumn("root", F.xxhash64(F.coalesce("_root", "key"))).drop("_root")


def _mixed(members: DataFrame, roots: DataFrame | None, group: str) -> DataFrame:
    """The members, with root, of the groups that hold several components."""
    rooted = _rooted(members, roots)
    mixed = rooted.groupBy(group).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(group)
    return rooted.join(mixed, group)


def _blocks(large: DataFrame) -> DataFrame:
    """Runs (run, turn, key, n) of about SMALL classes of each large node, the node's pivot in every one of them."""
    count = F.ceil(F.col("size") / SMALL * 1.25)
    own = large.where("kid <> pivot").select("node", F.pmod("kid", count).alias("block"), "turn", "key", "n")
    pivots = large.where("kid = pivot").select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block"), "turn", "key", "n")
    return own.unionAll(pivots).select(F.xxhash64("node", "block").alias("run"), "turn", "key", "n")


def _weighed(large: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows (node, turn, key, kid, n) of the nodes that hold several components, with root, and for the node main, members and outside.

    main is the root of the node's largest component, members its rows, outside those of the other components. They are sums over
    (node, root), so that no task gets a whole node, and are written before the one join, which broadcasts them while they are few.
    """
    rooted = _rooted(large.select("node", "turn", "key", "kid", "n"), roots)
    parts = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("rows"))
    nodes = parts.groupBy("node").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.sum("rows").alias("members"), (F.sum("rows") - F.max("rows")).alias("outside"))
    nodes = materialise(nodes.where("outside > 0"), "nodes")
    mixed = materialise(rooted.join(nodes, "node"), "mixed")
    discard(nodes)
    return mixed


def _outsiders(mixed: DataFrame, cross: int | None) -> tuple[DataFrame, DataFrame]:
    """Runs (run, turn, key, n, root) that compare each class outside its node's largest component with all of the node; and the other nodes' rows.

    mixed is as _weighed gives it. A run is a block of about OUTSIDERS outsiders with a block of as many of all, so that no task
    gets a whole node. Nodes whose outsiders times members exceed cross are left for the recursion.
    """
    rows = mixed.withColumn("_out", F.col("root") != F.col("main"))
    within = F.lit(True) if cross is None else F.col("members") * F.col("outside") <= cross
    few = rows.where(within).withColumns({"_i": F.ceil(F.col("outside") / OUTSIDERS), "_j": F.ceil(F.col("members") / OUTSIDERS)})
    i, j = F.pmod(F.xxhash64("key", F.lit(1)), F.col("_i")), F.pmod(F.xxhash64("key", F.lit(2)), F.col("_j"))
    zero = F.lit(0).cast("bigint")
    left = few.where("_out").select("node", "turn", "key", "n", "root", i.alias("i"), F.explode(F.sequence(zero, F.col("_j") - 1)).alias("j"))
    right = few.select("node", "turn", "key", "n", "root", F.explode(F.sequence(zero, F.col("_i") - 1)).alias("i"), j.alias("j"))
    run = F.xxhash64("node", "i", "j").alias("run")
    return left.unionAll(right.select(left.columns)).select(run, "turn", "key", "n", "root"), rows.where(~within).select("node", "key", "kid", "n")


class _Links:
    """Confirmed links and the components they make, as the join goes on."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int):
        self.docs, self.classes, self.percent = docs, classes, percent
        self.roots: DataFrame | None = None
        self.sets: DataFrame | None = None

    def screen(self, runs: DataFrame) -> DataFrame:
        """The clusters (turn, cluster, key) of runs (run, turn, key, n, root)."""
        sketched = runs.join(self.classes.select("key", "sketch"), "key").select("run", "turn", "key", "n", "sketch", "root")
        return materialise(sketched.repartition("run").sortWithinPartitions("run").mapInArrow(_screen(self.percent), _CLUSTER), "clusters")

    def confirm(self, clusters: DataFrame) -> None:
        """Confirms the clusters that hold several components, each once."""
        rows = materialise(_mixed(clusters.select("cluster", "key").distinct(), self.roots, "cluster").select("cluster", "key"), "mixed")
        if not rows.isEmpty():
            new = rows.select("key").distinct()
            if self.sets is not None:
                new = new.join(self.sets.select("key"), "key", "left_anti")
            if self.sets is None or not new.isEmpty():
                more = _sets_of(self.docs, self.classes, new)
                self.sets = more if self.sets is None else self.sets.unionAll(more)
            sets = rows.join(self.sets, "key").select("cluster", "key", "set")
            found = materialise(sets.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_confirmed(self.percent), _PAIR), "links")
            if not found.isEmpty():
                before = self.roots
                self.roots = components(found if before is None else found.unionAll(before.select(F.col("key").alias("a"), F.col("root").alias("b"))))
            discard(found)
        discard(rows)


def similar_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, root over the classes (key, n, tokens, sketch, doc_id) that have a link to another."""
    links, kid = _Links(docs, classes, percent), F.xxhash64("key").alias("kid")
    nodes = classes.select(F.lit(0).cast("bigint").alias("node"), "key", kid, "n", "tokens")
    for level in range(LEVELS):
        drawn = materialise(nodes.mapInArrow(_children(level), "node bigint, turn int, key binary, kid bigint, n bigint"), "nodes")
        counts = drawn.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("kid").alias("pivot")).where("size > 1")
        shared = materialise(drawn.join(counts, "node"), "members")
        discard(drawn)
        small, large = shared.where(F.col("size") <= SMALL).select(F.col("node").alias("run"), "turn", "key", "n"), shared.where(F.col("size") > SMALL)
        has_large = not large.isEmpty()
        runs = small.unionAll(_blocks(large)) if has_large else small
        clusters = links.screen(_rooted(runs, links.roots))
        for turn in (0, 1) if level == 0 else (0,):
            links.confirm(clusters.where(F.col("turn") == turn))
        discard(clusters)
        if not has_large:
            discard(shared)
            break
        mixed = _weighed(large, links.roots)
        outside, many = _outsiders(mixed, CROSS if level + 1 < LEVELS else None)
        clusters = links.screen(outside)
        links.confirm(clusters)
        members = materialise(_mixed(many, links.roots, "node").drop("root"), "mixed")
        discard(shared, mixed, clusters)
        if members.isEmpty():
            break
        nodes = members.join(classes.select("key", "tokens"), "key").select("node", "key", "kid", "n", "tokens")
    if links.sets is not None:
        discard(links.sets)
    return links.roots if links.roots is not None else classes.select("key", F.col("key").alias("root")).limit(0)


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The features of all rows, and the classes (key, doc_id, least, root); least is the first row (no_id, doc_id, text_hash) of a class."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    rows = materialise(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_feature_rows, _FEATURES), "features")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    classes = rows.where("key is not null").groupBy("key").agg(least, F.min("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("doc_id", F.col("least.doc_id")), "classes")
    roots = similar_classes(texts, classes, percent)
    return rows, classes.select("key", "doc_id", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id of the linked rows), kept (doc_id = component_id).

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text of one to four words is one shingle of
    all of them. Rows are linked from 100 * intersection >= percent * union on; texts that are null, empty or without words have
    no shingles and are linked with nothing. Repeated rows are rows of one class. A null doc_id is never a component's id
    unless all ids of the component are null (then component_id is null); kept is null for every row without an id. An empty
    table gives no rows; only doc_id and text are read, whatever other columns there are.
    """
    rows, rooted = _classes(docs, percent)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept, with all their columns: one row of each component.

    That is the row of the least doc_id (rows without an id come last), and among rows of that id the one of the least text
    hash. Rows are told apart by id and text, so that two texts under one id are judged each by itself; of rows with equal id
    and text one stays, whatever their other columns hold. Texts that are null, empty or without words are linked with nothing
    and stay, once for each id. An empty table gives no rows. Columns of any other name pass through.
    """
    rows, rooted = _classes(docs, percent)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("least")
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least").unionAll(rows.where("key is null").select(own).distinct())
    at = lambda no_id, doc_id, text_hash: [no_id.alias("no_id"), F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("id"), text_hash.alias("hash")]
    marks = kept.select(*at(F.col("least.no_id"), F.col("least.doc_id"), F.col("least.text_hash")))
    number = F.col("doc_id").cast("bigint")
    whole = docs.select(*at(number.isNull(), number, F.xxhash64("text")), whole_rows(docs))
    names = ["no_id", "id", "hash"]
    return whole.dropDuplicates(names).join(marks, names, "left_semi").select("row.*")


#: DuckDB SQL for near_duplicates over the table documents.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.c + nb.c - k)
), r AS (
  SELECT DISTINCT a AS doc_id, a AS c FROM links
  UNION
  SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id
), comp AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(comp.c, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(comp.c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
