"""Product codes of vectors by Lloyd rounds over two trees, one over a block's parts and one over a codebook's entries.

Pairs of nodes go down both trees together. An entry node goes as soon as its least distance from a point node is more
than the greatest distance to another one; a point node that is left with one entry is assigned whole, by its cached
sum. What is still open at the leaves is compared in integers, point by point.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import integers, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block, points of a leaf, and rows of the comparisons that are made at once.
BLOCK, LEAF, AT_ONCE = 4096, 16, 1 << 20
#: Labels whose totals are broadcast; with more of them the join is salted.
BROADCAST_LABELS, SALTS = 1 << 16, 16


def grow(points: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the points (parts x n x width) in which every node of each part's tree is a stretch; nodes are halved along their widest side."""
    parts, n, _ = points.shape
    order = np.tile(np.arange(n), (parts, 1))
    for level in range(int(np.log2(max(1, n // leaf)))):
        edge = n * np.arange((1 << level) + 1) >> level
        here = np.take_along_axis(points, order[:, :, None], 1)
        wide = np.maximum.reduceat(here, edge[:-1], axis=1) - np.minimum.reduceat(here, edge[:-1], axis=1)
        owner = np.repeat(np.arange(1 << level), np.diff(edge))
        value = np.take_along_axis(here, wide.argmax(2)[:, owner, None], 2)[:, :, 0]
        value -= value.min()
        order = np.take_along_axis(order, np.argsort(owner * (value.max() + 1) + value, axis=1, kind="stable"), 1)
    return order


@dataclass
class Tree:
    """Boxes of all nodes, level by level, of points (parts x n x width) that are in the tree's order; sums of the deepest."""

    points: np.ndarray
    leaf: int

    def __post_init__(self):
        n = self.points.shape[1]
        self.depth = int(np.log2(max(1, n // self.leaf)))
        self.edge = n * np.arange((1 << self.depth) + 1) >> self.depth
        self.low = [np.minimum.reduceat(self.points, self.edge[:-1], axis=1)]
        self.high = [np.maximum.reduceat(self.points, self.edge[:-1], axis=1)]
        self.sums = [np.add.reduceat(self.points, self.edge[:-1], axis=1)]
        for _ in range(self.depth):  # upwards, two children each
            for kept, join in ((self.low, np.minimum), (self.high, np.maximum), (self.sums, np.add)):
                kept.insert(0, join(kept[0][:, 0::2], kept[0][:, 1::2]))

    def reach(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one point of nodes."""
        step = self.depth - level
        return self.edge[node << step], self.edge[(node + 1) << step]


def runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of ranges."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes by part and place in the tree's order, sums and counts by part and entry, points assigned one by one).

    ``book`` is parts x entries x width; of entries that are equally near, the one of lower number is taken.
    """
    parts, n, width = tree.points.shape
    number = grow(book, 1)
    ordered = np.take_along_axis(book, number[:, :, None], 1)
    entries = Tree(ordered, 1)
    codes = np.zeros((parts, n), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
    part, q, e = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    level, below, single = 0, 0, False  # of the points, of the entries; whether e are entries themselves
    while len(part):
        a, b = tree.low[level][part, q], tree.high[level][part, q]
        c, d = (ordered[part, e],) * 2 if single else (entries.low[below][part, e], entries.high[below][part, e])
        near = (np.maximum(np.maximum(c - b, a - d), 0) ** 2).sum(1)
        far = (np.maximum(np.abs(b - c), np.abs(d - a)) ** 2).sum(1)
        first = runs(part << 32 | q)
        size = np.diff(np.append(first, len(part)))
        keep = near <= np.repeat(np.minimum.reduceat(far, first), size)
        if single:  # farther than the best entry everywhere in the box
            best = np.lexsort((far, np.repeat(np.arange(len(first)), size)))[first]
            mid, own = np.repeat(c[best], size, 0), np.repeat(best, size) == np.arange(len(part))
            keep &= own | ((mid**2 - c**2 + 2 * np.maximum(a * (c - mid), b * (c - mid))).sum(1) >= 0)
        part, q, e = part[keep], q[keep], e[keep]
        if single:
            first = runs(part << 32 | q)
            alone = np.diff(np.append(first, len(part))) == 1
            done = first[alone]
            entry = number[part[done], e[done]]
            start, end = tree.reach(level, q[done])
            np.add.at(sums, (part[done], entry), tree.sums[level][part[done], q[done]])
            np.add.at(counts, (part[done], entry), end - start)
            owner, place = spread(start, end - start)
            codes[part[done][owner], place] = entry[owner]
            open_ = np.repeat(~alone, np.diff(np.append(first, len(part))))
            part, q, e = part[open_], q[open_], e[open_]
            if level == tree.depth:
                break
        if not single and below < entries.depth:
            below += 1
            part, q, e = np.repeat(part, 2), np.repeat(q, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e))
        elif not single:
            start, end = entries.reach(below, e)
            owner, e = spread(start, end - start)
            part, q, single = part[owner], q[owner], True
        if level < tree.depth:
            level += 1
            part, q, e = np.repeat(part, 2), np.repeat(2 * q, 2) + np.tile([0, 1], len(q)), np.repeat(e, 2)
            order = np.argsort(part << 32 | q, kind="stable")
            part, q, e = part[order], q[order], e[order]
    return codes, sums, counts, _leaves(tree, book, number, part, q, e, codes, sums, counts)


def _leaves(tree, book, number, part, q, e, codes, sums, counts) -> int:
    """Points of the leaves with several entries left, each compared with these; adds to ``codes``, ``sums`` and ``counts``."""
    first = runs(part << 32 | q)
    size = np.diff(np.append(first, len(part)))
    start, end = tree.reach(tree.depth, q[first])
    group, place = spread(start, end - start)
    of, entry = part[first][group], number[part, e]
    ahead = np.concatenate([[0], np.cumsum(size[group])])
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + AT_ONCE, "right")) - 1)
        point, pair = spread(first[group[at:to]], size[group[at:to]])
        gap = ((tree.points[of[at:to], place[at:to]][point] - book[part[pair], entry[pair]]) ** 2).sum(1)
        best = np.minimum.reduceat(gap * book.shape[1] + entry[pair], ahead[at:to] - ahead[at]) % book.shape[1]
        codes[of[at:to], place[at:to]] = best
        np.add.at(sums, (of[at:to], best), tree.points[of[at:to], place[at:to]])
        np.add.at(counts, (of[at:to], best), 1)
        at = to
    return len(group)


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    return np.ascontiguousarray(values.reshape(len(values), parts, -1).transpose(1, 0, 2))


def plant(vectors: DataFrame, dim: int, parts: int) -> DataFrame:
    """Blocks of up to BLOCK vectors of (vec_id, label, embedding): ids, labels, integer components, and each part's tree as an order."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                values = integers(block.column("embedding"), dim)
                order = grow(_parts(values, parts), LEAF)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, block.num_rows], block.column(c)) for c in ("vec_id", "label")] + [pa.array([x.tobytes()]) for x in (values.astype(np.int32), order.astype(np.int16))],
                    names=["vec_ids", "labels", "vals", "tree_order"],
                )

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vals binary, tree_order binary")


def _open(vals: bytes, tree_order: bytes, dim: int, parts: int) -> tuple[np.ndarray, Tree]:
    values = np.frombuffer(vals, np.int32).astype(np.int64).reshape(-1, dim)
    order = np.frombuffer(tree_order, np.int16).astype(np.int64).reshape(parts, -1)
    return order, Tree(np.take_along_axis(_parts(values, parts), order[:, :, None], 1), LEAF)


def lloyd_round(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round: every used entry becomes the floor of the mean of its parts. Sums are added up in tasks, then by entry."""
    parts, k, width = book.shape

    def run(batches):
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for vals, order in zip(batch.column("vals"), batch.column("tree_order")):
                _, more, n, _ = assign(_open(vals.as_py(), order.as_py(), parts * width, parts)[1], book)
                sums, counts = sums + more, counts + n
        used = np.flatnonzero(counts.ravel())
        columns = [used // k, used % k, counts.ravel()[used], *sums.reshape(-1, width)[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = ["n", *(f"s{i}" for i in range(width))]
    summed = blocks.select("vals", "tree_order").mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", *names)))
    new = book.copy()
    for row in summed.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect():  # parts x entries at most
        new[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return new


def encode(blocks: DataFrame, book: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    parts, k, width = book.shape
    hexes = np.array([f"{i:02x}" for i in range(k)])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                order, tree = _open(batch.column("vals")[i].as_py(), batch.column("tree_order")[i].as_py(), parts * width, parts)
                found, *_ = assign(tree, book)
                gap = ((tree.points - np.take_along_axis(book, found[:, :, None], 1)) ** 2).sum(2)
                codes, errors = np.empty_like(found), np.empty_like(gap)
                np.put_along_axis(codes, order, found, 1)
                np.put_along_axis(errors, order, gap, 1)
                text = hexes[codes[0]]
                for row in codes[1:]:
                    text = np.char.add(text, hexes[row])
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(text.tolist(), pa.string()), pa.array(errors.sum(0))], names=["vec_id", "label", "code", "error"])

    kinds = {c: t[len("array<") : -1] for c, t in blocks.dtypes}
    return blocks.mapInArrow(run, f"vec_id {kinds['vec_ids']}, label {kinds['labels']}, code string, error long")


def first_vectors(vectors: DataFrame, most: int) -> tuple[int, np.ndarray]:
    """(length, integer components) of the ``most`` vectors of the smallest ids; the length is that of the first one."""
    order = (F.col("vec_id").asc_nulls_last(), "embedding", "label")
    one = vectors.orderBy(*order).limit(1).collect()
    if not one:
        return 0, np.zeros((0, 0), np.int64)
    dim = len(one[0].embedding)
    rows = vectors.where(F.size("embedding") == dim).orderBy(*order).limit(most).collect()
    return dim, integers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), dim)


def book_text(book: np.ndarray) -> str:
    """All components by part, entry and place, as decimal integers with commas between."""
    return ",".join(map(str, book.ravel().tolist()))


def compress(vectors: DataFrame, folder: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the vectors (vec_id, embedding, label), and the codebooks (parts x entries x width).

    Vectors that are null, empty, or hold null or non-finite components are left out, and so are those of another length than
    the vector of the smallest id, which has to be a multiple of ``parts`` (else ValueError). Null ids come last, null labels
    are kept, repeated rows are encoded each, other columns are ignored. An empty table gives no rows. ``entries`` is 256 at most.
    """
    kept = vectors.select("vec_id", "embedding", "label").where(whole(F.col("embedding")))
    dim, seeds = first_vectors(kept, entries)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    if not dim:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), np.zeros((parts, 0, 0), np.int64)
    book = _parts(seeds, parts)
    blocks = materialize(plant(kept.where(F.size("embedding") == dim), dim, parts), f"{folder}/blocks")  # read once a round
    for _ in range(rounds):
        book = lloyd_round(blocks, book)
    return encode(blocks, book), book


def vector_codes(vectors: DataFrame, folder: str) -> DataFrame:
    """Codes with their errors, the error of all vectors of the same label (nulls together), and the digest of the codebooks."""
    coded, book = compress(vectors, folder)
    coded = materialize(coded, f"{folder}/codes")
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("k"), F.col("label").isNull().alias("none")]
    totals = materialize(coded.groupBy(*key).agg(F.sum("error").alias("label_error")), f"{folder}/labels")
    rows = coded.select("vec_id", "code", "error", *key)
    if totals.count() <= BROADCAST_LABELS:
        rows = rows.join(F.broadcast(totals), ["k", "none"])
    else:  # a label's rows are dealt to SALTS tasks
        salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, ["k", "none", "salt"])
    return rows.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(book_text(book).encode()).hexdigest()).alias("codebooks_sha256"))
