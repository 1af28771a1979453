"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents of equal sets form a class, which
takes part once. Each class has POSITIONS minwise tokens (MinHash values). In each of TREES independent random trees a
node draws positions (out of the first BRANCHING), 1/SIMILARITY of them on average and one at least, and sends each of
its classes to one child per position, the one of the class's minwise token there. A node of at most SMALL classes is
compared exhaustively; larger ones branch again, up to DEPTH times. A node of at most WIDEST blocks that kept
most of its parent's classes on some levels in a row (so that branching parts little) is compared block by block, and
so is a node that is large at the greatest depth. A pair at the similarity of 0.75 meets in
a tree with a chance of 0.81 where nodes become small at once, and so is missed by 10 trees with a chance below 1e-7.

Comparison in nodes is by 8 bits of each of the POSITIONS minwise tokens: pairs with fewer than SCREEN equal ones, or
fewer than GLANCE among the first 32, are dropped (at similarity 0.75 the counts have means 96 and 24 and deviations 4.9
and 2.4, so a link at the very threshold is dropped with a chance of 3e-5, one at 0.8 with 1e-7). The other pairs are confirmed on the full sets.

There are two rounds. The first FIRST trees give a spanning forest of each node's pairs; its confirmed links give
components. Then all trees grow again, without the nodes that hold one component only, and pairs between different
components are confirmed inside their nodes: links inside a component add nothing, so none that matters is lost, a
group of copies is worked through once, and no group gives out its pairs.

No list of documents, links or components leaves the executors; components are labelled by joins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialise, scratch, table, text_batches, worker_memory

WORDS, SIMILARITY = 5, (75, 100)
POSITIONS, BRANCHING, SCREEN = 128, 64, 76
GLANCE = 12
TREES, FIRST, DEPTH, SMALL = 10, 2, 6, 1024
#: Nodes of at most WIDEST blocks of BLOCK classes that keep over ALIKE hundredths of their parent's classes on STREAK levels
#: in a row are compared block by block, so that a class takes part in WIDEST + 1 pairs of blocks of such a node at most.
ALIKE, STREAK, WIDEST, BLOCK = 65, 2, 4, 4096
#: Pairs of classes that are looked at together.
PAIRS = 200_000
#: Classes that are confirmed with one class together, about.
STAR = 64
#: Classes among which a central one is sought by comparing all.
CENTRE = 48
_SEED = 20240229
#: Hash buckets of ids that are broadcast, at most.
BUCKETS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEYS = _mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SEED))


class _WordHashes(dict):
    """64-bit word hashes; starts afresh at a bounded size."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            out.append(np.zeros(0, np.uint64))
            continue
        w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
        n = max(1, len(w) - WORDS + 1)
        h = np.full(n, min(len(w), WORDS), np.uint64)
        for k in range(min(len(w), WORDS)):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
        h.sort()
        out.append(h[np.append(True, h[1:] != h[:-1])])
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS minwise tokens of each set (32 bits of them); zeros for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    tokens = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    # tokens are well-mixed 64-bit hashes, so a random linear function of their halves orders them evenly enough
    low, high = (tokens >> np.uint64(32)).astype(np.uint32), tokens.astype(np.uint32)
    for p in range(POSITIONS):
        k = _KEYS[p] | np.uint64(1)
        out[full, p] = np.minimum.reduceat(low * np.uint32(k & np.uint64(0xFFFFFFFF)) + high * (np.uint32(k >> np.uint64(32)) | np.uint32(1)), starts)
    return out


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(_SEED)
    with np.errstate(over="ignore"):
        for x in parts:
            h = _mix(np.atleast_1d((np.atleast_1d(h) + np.asarray(x).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)))
    return h


def _level_positions() -> np.ndarray:
    """(TREES, DEPTH + 1, positions): each tree's levels draw from different positions, so that no level repeats one."""
    each = BRANCHING // (DEPTH + 1)
    order = np.stack([np.argsort(_hash(np.arange(BRANCHING), tree, 7)) for tree in range(TREES)])
    return order[:, : each * (DEPTH + 1)].reshape(TREES, DEPTH + 1, each)


def children(nodes: np.ndarray, trees: np.ndarray, depth: int, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes of rows that stand in `nodes`. A node draws one position, and a second one with the
    chance that makes 1/0.75 on average."""
    pool = _level_positions()[trees, depth]
    h = _hash(nodes)
    first, second = (h % np.uint64(pool.shape[1])).astype(np.int64), (_hash(h, 1) % np.uint64(pool.shape[1])).astype(np.int64)
    more = np.flatnonzero(((h >> np.uint64(20)) % np.uint64(100) < 38) & (first != second))  # 1/3, as some draws are equal
    rows = np.concatenate([np.arange(len(nodes)), more])
    positions = pool[rows, np.concatenate([first, second[more]])]
    return rows, _hash(nodes[rows], positions, signatures[rows, positions]).view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BRANCHING)


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text rows to (doc_id, n, digest of the set, signature, brief): brief has 8 bits of each minwise token, for comparison only."""
    import hashlib

    worker_memory("near_dedup", _words.clear)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = shingle_sets(part.column(1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signatures = minwise(sets)
            brief = signatures.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in signatures[:, :BRANCHING]], pa.binary()), pa.array([x.tobytes() for x in brief], pa.binary())], ["doc_id", "n", "digest", "signature", "brief"])


def _root_rows(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.arange(count)
        roots = _hash(trees + 1)
        for batch in batches:
            n = batch.num_rows
            if n:
                rows, nodes = children(np.tile(roots, n), np.tile(trees, n), 0, np.repeat(_signatures(batch.column(1)), count, axis=0))
                at = pa.array(rows // count)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column(0).take(at), batch.column(2).take(at), pa.array((rows % count).astype(np.int32))], ["node", "c", "comp", "tree"])

    return run


def _child_rows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, nodes = children(batch.column(0).to_numpy().view(np.uint64), batch.column(4).to_numpy(), depth, _signatures(batch.column(3)))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), *(batch.column(i).take(at) for i in (1, 2, 4, 5, 6))], ["node", "c", "comp", "tree", "parent", "streak"])

    return run


def _pairs(edges: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i < j of all pairs within runs of rows, about PAIRS at a time."""
    ahead = np.arange(int(sizes.sum()))
    ahead = np.repeat(edges + sizes, sizes) - 1 - ahead  # rows that follow in the run
    upto = np.cumsum(ahead)
    lo = 0
    while lo < len(ahead):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        some = ahead[lo:hi]
        i = np.repeat(np.arange(lo, hi), some)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi


_LOW7, _ALL7 = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of each row of x and y, held as 64-bit words, are equal."""
    z = x ^ y
    zero = ~(((z & _LOW7) + _LOW7) | z) & _ALL7
    return np.bitwise_count(zero).sum(axis=1, dtype=np.int16)


def _node_pairs(node: np.ndarray, c: np.ndarray, n: np.ndarray, tokens: np.ndarray, comp: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible links in whole nodes, rows ordered by (node, c): by the screen and the sizes of the sets.

    Without comp a spanning forest of them: each class with the earlier class most like it. With comp those between
    classes of different components, and, where side is 0 or 1, of different sides.
    """
    edges = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(edges, len(node)))
    words = np.ascontiguousarray(tokens).view(np.uint64)
    first = np.ascontiguousarray(words[:, :4])
    out_i, out_j, likeness = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]

    def forest(i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = np.lexsort((i, -equal, j))
        best = best[np.append(True, j[best][1:] != j[best][:-1])] if len(best) else best
        return i[best], j[best], equal[best]

    for i, j in _pairs(edges, sizes):
        ok = (SIMILARITY[1] * np.minimum(n[i], n[j]) >= SIMILARITY[0] * np.maximum(n[i], n[j])) & (c[i] != c[j])
        if comp is not None:
            ok &= comp[i] != comp[j]
        if side is not None:
            ok &= (side[i] != side[j]) | (side[i] == 2)
        i, j = i[ok], j[ok]
        ok = _equal(first[i], first[j]) >= GLANCE
        i, j = i[ok], j[ok]
        equal = _equal(words[i], words[j])
        ok = equal >= SCREEN
        i, j, equal = i[ok], j[ok], equal[ok]
        if comp is None:
            i, j, equal = forest(i, j, equal)
        out_i.append(i), out_j.append(j), likeness.append(equal)
    i, j, equal = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(likeness)
    return forest(i, j, equal)[:2] if comp is None else (i, j)


def _groups(i: np.ndarray, j: np.ndarray, rows: int) -> np.ndarray:
    """The least row that each row is connected with by pairs."""
    least = np.arange(rows)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low), np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the nodes in a partition ordered by (node, c), or, with comp, the rows that stand in any, each connected
    group of them as a node of its own, with a name that its members decide; a node may go on in the next batch."""
    held = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(t.column("brief").to_pylist()), np.uint8).reshape(-1, POSITIONS)
        c, node = t.column("c").to_numpy(), t.column("node").to_numpy()
        comp, side = (t.column(k).to_numpy() if k in t.column_names else None for k in ("comp", "side"))
        i, j = _node_pairs(node, c, t.column("n").to_numpy(), tokens, comp, side)
        if comp is not None:
            some = np.unique(np.concatenate([i, j]))
            group = _groups(np.searchsorted(some, i), np.searchsorted(some, j), len(some))
            # named by its members, so that a group which several nodes or trees hold is the same everywhere
            names = np.zeros(len(some), np.uint64)
            np.add.at(names, group, _hash(c[some]) if len(some) else names)
            own = names[group].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(c[some]), pa.array(comp[some])], ["node", "c", "comp"])
        both = np.unique(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        node = t.column("node").to_numpy()
        whole = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
        held = t.slice(whole)
        if whole:
            yield pairs(t.slice(0, whole))
    if held is not None:
        yield pairs(held)


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class most like the others of each head, of rows (head, node, c, brief) ordered by (head, c)."""
    held = None

    def best(t: pa.Table) -> pa.RecordBatch:
        head, node, c = (t.column(k).to_numpy() for k in ("head", "node", "c"))
        tokens = np.frombuffer(b"".join(t.column("brief").to_pylist()), np.uint8).reshape(-1, POSITIONS)
        edges = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        chosen = [lo + int((tokens[lo:hi, None] == tokens[None, lo:hi]).sum(axis=(1, 2)).argmax()) for lo, hi in zip(edges, [*edges[1:], len(head)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node[chosen]), pa.array(c[chosen])], ["node", "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        head = t.column("head").to_numpy()
        whole = int(np.flatnonzero(head != head[-1])[-1]) + 1 if head[0] != head[-1] else 0
        held = t.slice(whole)
        if whole:
            yield best(t.slice(0, whole))
    if held is not None:
        yield best(held)


def medoids(rows: DataFrame, brief: DataFrame) -> DataFrame:
    """(node, c): a central class of each node of rows (node, c, blocks): the most central one of each block, of blocks of
    those, and so on."""
    blocks = F.col("blocks")
    while True:
        dealt = rows.withColumn("head", F.xxhash64("node", F.pmod(F.xxhash64("node", "c"), blocks)))
        found = dealt.join(brief.select("c", "brief"), "c").select("head", "node", "c", "brief").repartition("head").sortWithinPartitions("head", "c").mapInArrow(_medoids, "node long, c long")
        rows = materialise(found, "medoids")
        sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / CENTRE).cast("int").alias("blocks"), F.count("*").alias("k"))
        if sizes.where("k > 1").isEmpty():
            return rows
        rows = rows.join(sizes.select("node", "blocks"), "node")


def compare(rows: DataFrame) -> DataFrame:
    """Possible links of `rows` (node, c, n, brief[, comp, side]), where no node has more than SMALL rows or two blocks: (a, b), or,
    with comp, the rows (node, c, comp) that have one to another component, in new nodes."""
    out = "node long, c long, comp long" if "comp" in rows.columns else "a long, b long"
    return rows.repartition("node").sortWithinPartitions("node", "c").mapInArrow(_compare, out)


def _links_of_node(c: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the node's components on full sets, as many as join them; no others."""
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)))
    # ranges of the tokens' hashes, so that some 500,000 tokens are looked at together
    edges = np.linspace(0, 2.0**64, max(1, -(-int(sizes.sum()) // 500_000)) + 1)[1:-1].astype(np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    width = 1 << 12
    for k in range(len(edges) + 1):
        parts = [s[cut[k] : cut[k + 1]] for s, cut in zip(sets, cuts, strict=True)]
        tokens, rows = np.concatenate(parts), np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        _, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1  # tokens of one class only are in no intersection
        keep = counts[at] > 1
        rows, at = rows[keep], shared[at[keep]]
        for lo in range(0, int(at.max(initial=-1)) + 1, width):
            some = (at >= lo) & (at < lo + width)
            held = np.zeros((len(sets), width), np.float32)
            held[rows[some], at[some] - lo] = 1
            common += held @ held.T
    linked = SIMILARITY[1] * common >= SIMILARITY[0] * (sizes[:, None] + sizes[None] - common)
    linked &= comp[:, None] != comp[None]
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while x in to:
            x = to[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = root(int(comp[i])), root(int(comp[j]))
        if x != y:
            to[max(x, y)] = min(x, y)
            out.append((int(min(c[i], c[j])), int(max(c[i], c[j]))))
    return out


def _confirm_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, c, comp, text) ordered by node to the links between the components of each node."""
    worker_memory("near_dedup", _words.clear)
    held: list = []

    def links() -> pa.RecordBatch:
        c, comp = (np.array([r[k] for r in held]) for k in (1, 2))
        found = _links_of_node(c, comp, shingle_sets([r[3] for r in held]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held and row[0] != held[0][0]:
                yield links()
                held = []
            held.append(row)
    if held:
        yield links()


def confirm_nodes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links on full sets between the components of each node of rows (node, c, comp); a row that stands twice counts once.

    A text meets the nodes of its class in one join and goes to each as it is, as sets of hashes are longer than texts. A
    class stands in few nodes, but for a star's centre, which stands in one for each STAR of its pairs.
    """
    placed = materialise(rows.groupBy("c").agg(F.collect_set("node").alias("nodes"), F.first("comp").alias("comp")), "rows")
    near = near_ids(docs.select(F.col("doc_id").cast("long").alias("c"), "text"), placed, "c")
    full = near.join(placed, "c").select(F.explode("nodes").alias("node"), "c", "comp", "text")
    return materialise(full.repartition("node").sortWithinPartitions("node").mapInArrow(_confirm_nodes, "a long, b long"), "links")


def stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as nodes (node, c, comp) of one a and about STAR of its b at most, each class a component of its own."""
    # only what has more than one block is joined, as a table of its own, so that a centre's pairs are split where they are dealt
    large = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("blocks")).where("blocks > 1"), "large-stars")
    block = F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0))
    dealt = pairs.join(large, "a", "left").select(F.xxhash64("a", block).alias("node"), F.explode(F.array("a", "b")).alias("c"))
    return dealt.withColumn("comp", F.col("c"))


def nodes(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """Of the first `trees` trees over classes (c, signature, comp): (node, c, comp) of the small nodes, and (node, c, comp, m) of
    those to be compared in blocks, m being their classes. Nodes of one component are left out."""
    rows = classes.select("c", "signature", "comp").mapInArrow(_root_rows(trees), "node long, c long, comp long, tree int").withColumn("parent", F.lit(1 << 50).cast("long")).withColumn("streak", F.lit(0))
    small, alike = [], []
    for depth in range(DEPTH + 1):
        rows = materialise(rows, "nodes")
        # a table of its own: the join with it has plain sides, so that a node with many classes is split where it is dealt
        sizes = materialise(rows.groupBy("node").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "m"), "sizes")
        streak = F.when(100 * F.col("m") > ALIKE * F.col("parent"), F.col("streak") + 1).otherwise(0)
        shared = materialise(rows.join(sizes, "node").select("node", "c", "comp", "tree", "m", streak.alias("streak")), "shared")
        small.append(shared.where(F.col("m") <= SMALL).select("node", "c", "comp"))
        ends = F.lit(depth == DEPTH) | ((F.col("streak") >= STREAK) & (F.col("m") <= WIDEST * BLOCK))
        alike.append(shared.where((F.col("m") > SMALL) & ends).select("node", "c", "comp", "m"))
        large = shared.where((F.col("m") > SMALL) & ~ends)
        if depth == DEPTH or large.isEmpty():
            break
        branching = large.join(near_ids(classes.select("c", "signature"), large, "c"), "c").select("node", "c", "comp", "signature", "tree", F.col("m").alias("parent"), "streak")
        rows = branching.mapInArrow(_child_rows(depth + 1), "node long, c long, comp long, tree int, parent long, streak int")
    return functools.reduce(DataFrame.unionByName, small), functools.reduce(DataFrame.unionByName, alike)


def block_pairs(large: DataFrame) -> DataFrame:
    """Rows (node, c, comp, m) of large nodes as rows (node, c, comp, side) of pairs of blocks of about BLOCK of them.

    Apart from the members of a node's main component, which need no comparison with one another, each class meets each
    other class of its node in one pair of blocks; those members take part only as the other side of the rest.
    """
    sizes = large.groupBy("node", "comp").agg(F.count("*").alias("k"), F.first("m").alias("m"))
    main = materialise(sizes.groupBy("node").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k"), F.first("m").alias("m")), "main")
    blocks = lambda x: F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("long")
    placed = large.select("node", "c", "comp").join(main.select("node", "main", blocks(F.col("k")).alias("q"), blocks(F.col("m") - F.col("k")).alias("p")), "node")
    h, upto = F.xxhash64("node", "c"), lambda x: F.sequence(F.lit(0).cast("long"), x - 1)
    mine = placed.where("comp = main").select("node", "c", "comp", F.pmod(h, "q").alias("y"), F.explode(upto(F.col("p"))).alias("x"), F.lit(1).alias("side"), F.lit("main").alias("kind"))
    rest = placed.where("comp <> main").withColumn("own", F.pmod(h, "p"))
    facing = rest.select("node", "c", "comp", F.explode(upto(F.col("q"))).alias("y"), F.col("own").alias("x"), F.lit(0).alias("side"), F.lit("main").alias("kind"))
    among = rest.withColumn("to", F.explode(upto(F.col("p"))))
    side = F.when(F.col("own") < F.col("to"), 0).when(F.col("own") > F.col("to"), 1).otherwise(2)
    among = among.select("node", "c", "comp", F.greatest("own", "to").alias("y"), F.least("own", "to").alias("x"), side.alias("side"), F.lit("rest").alias("kind"))
    dealt = mine.unionByName(facing).unionByName(among)
    return dealt.select(F.xxhash64("node", "kind", "x", "y").alias("node"), "c", "comp", "side")


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS))


def near_ids(rows: DataFrame, ids: DataFrame, key: str, near: bool = True) -> DataFrame:
    """The rows whose key is in a hash bucket of one of the ids' keys, or the rows whose is not.

    The buckets, of which there are BUCKETS at most, are broadcast, so that few rows need the join by key, and those that
    it does not concern are not shuffled.
    """
    name = max(rows.columns, key=len) + "_"  # a name that no column has
    some = F.broadcast(ids.select(_bucket(key).alias(name)).distinct())
    return rows.withColumn(name, _bucket(key)).join(some, name, "left_semi" if near else "left_anti").drop(name)


def by_id(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of docs whose doc_id is among the distinct ids (doc_id), or the rows whose is not."""
    near = near_ids(docs, ids, "doc_id")
    if inside:
        return near.join(ids, "doc_id", "left_semi").select(*docs.columns)
    return near_ids(docs, ids, "doc_id", near=False).unionByName(near.join(ids, "doc_id", "left_anti").select(*docs.columns))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; a doc_id that is null makes a component of its own.

    Null or empty texts have empty sets and are linked with nothing; texts under five words are one shingle, the whole
    sequence; repeated rows have equal sets and so share a component, of which the first by doc_id is kept (all equal
    doc_ids are); an empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession):
        return materialise(_dedup(docs), "dedup", keep=True)


def _dedup(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    text_batches(docs.sparkSession)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_class_rows, "doc_id long, n long, digest binary, signature binary, brief binary")
    hashed = materialise(hashed, "sets")
    # the smallest doc_id of equal sets stands for them; sets without a doc_id or without shingles stand alone
    classes = hashed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("c"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("brief").alias("brief"))
    classes = materialise(classes, "classes")
    brief = classes.select("c", "n", "brief")
    small, large = nodes(classes.withColumn("comp", F.col("c")), FIRST)
    first = small.select("node", "c")
    hot = not large.isEmpty()
    if hot:
        block = F.pmod(F.xxhash64("node", "c"), F.ceil(F.col("m") / BLOCK))
        first = first.unionByName(large.select(F.xxhash64("node", block).alias("node"), "c"))
    pairs = compare(first.join(brief, "c"))
    if hot:
        # and each class with the central one of its largest node: copies may differ more from one another than from it
        central = medoids(large.select("node", "c", F.ceil(F.col("m") / CENTRE).cast("int").alias("blocks")), brief).withColumnRenamed("c", "to")
        widest = large.groupBy("c").agg(F.max_by("node", F.struct("m", "node")).alias("node"))
        star = widest.join(central, "node").where("c <> to").select(F.col("to").alias("a"), F.col("c").alias("b"))
        pairs = pairs.unionByName(star)
    links = confirm_nodes(stars(materialise(pairs, "pairs")), docs)
    comps = components(links)
    # second round: all trees, and only what lies between the components
    labelled = materialise(classes.select("c", "signature").join(comps, "c", "left").select("c", "signature", F.coalesce("comp", "c").alias("comp")), "labelled")
    small, large = nodes(labelled, TREES)
    rest = small.withColumn("side", F.lit(2))
    if not large.isEmpty():
        rest = rest.unionByName(block_pairs(large))
    more = confirm_nodes(compare(rest.join(brief, "c")), docs)
    if not more.isEmpty():
        # what is joined already goes on as stars, which take few rounds more
        comps = components(comps.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionByName(more))
    # rows without a set or an id have no class; apart, as their null keys would meet in one task
    bare = F.col("digest").isNull() | F.col("doc_id").isNull()
    named = hashed.where(~bare).select("doc_id", "n", "digest").join(classes.select("digest", "c"), "digest").select("doc_id", "n", "c").join(comps, "c", "left")
    named = named.select("doc_id", "n", "c", "comp").unionByName(hashed.where(bare).select("doc_id", "n", F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("comp")))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "c", "doc_id"))
    return named.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), comp.cast(kind).alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
