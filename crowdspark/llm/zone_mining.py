"""Hard negatives from Parquet blocks along a Hilbert curve, chosen by zone maps.

Candidates are sorted by label and place on a Hilbert curve and written in blocks (row groups); beside each file stands a
zone map with every block's labels and least and greatest integer component by dimension. Interval arithmetic on these
bounds the inner products of an anchor with a whole block, and says which blocks its windows must read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, write_atomic
from .dual_tree import first_vectors
from .vectors import integers, whole

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOWEST, HIGHEST = 50, 95
#: Rows of a block and of a file at most, anchors that sweep the blocks together.
BLOCK, FILE_ROWS, CHUNK = 256, 1 << 18, 2048
#: Bits of a dimension on the curve; cells end at these numbers of deviations from the mean.
BITS, CUTS = 2, (-0.67, 0.0, 0.67)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (n x d), as rows of bytes in order of the curve."""
    x = cells.astype(np.uint32).T.copy()
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(len(x)):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(bit) & np.uint32(1), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([x >> np.uint32(bit) & np.uint32(1) for bit in range(bits - 1, -1, -1)])  # bits x d x n
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def moments(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, deviation by dimension); every task adds up its own."""

    def run(batches):
        n, sums, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            v = integers(batch.column("embedding"), dim).astype(np.float64)
            n, sums, squares = n + len(v), sums + v.sum(0), squares + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(sums), pa.array(squares)], names=["d", "n", "s", "q"])

    found = rows.select("embedding").mapInArrow(run, "d long, n long, s double, q double").groupBy("d").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("d").toPandas()  # dim rows
    n = int(found["n"].iloc[0]) if len(found) else 0
    mean = found["s"].to_numpy() / max(n, 1)
    return n, mean, np.sqrt(np.maximum(found["q"].to_numpy() / max(n, 1) - mean**2, 0))


def _parquet(table: pa.Table, rows: int) -> bytes:
    out = io.BytesIO()
    pq.write_table(table, out, row_group_size=rows, compression="zstd")
    return out.getvalue()


def write_blocks(rows: DataFrame, dim: int, every: int, folder: str) -> DataFrame:
    """Files of blocks with their zone maps; returns (file, rows, anchors) of each, written to ``folder`` as well."""
    n, mean, deviation = moments(rows, dim)
    cuts, rank = mean + np.array(CUTS)[:, None] * deviation, np.argsort(-deviation, kind="stable")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = max(min(2 * cores, n // (4 * BLOCK)), -(-n // FILE_ROWS), 1)

    def place(batches):
        for batch in batches:
            v = integers(batch.column("embedding"), dim)
            keys = hilbert_keys((v[:, rank] > cuts[:, None, rank]).sum(0), BITS)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "place", "vals"])

    def write(batches):
        got = [batch for batch in batches if batch.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).select(["vec_id", "label", "vals"])
        v, labels = _values(table, dim), table.column("label").to_numpy()
        file = TaskContext.get().partitionId()
        edge = np.arange(0, len(v), BLOCK)
        ends = [np.minimum.reduceat(labels, edge), np.maximum.reduceat(labels, edge), *([x.tobytes() for x in f.reduceat(v, edge, axis=0)] for f in (np.minimum, np.maximum))]
        write_atomic(f"{folder}/blocks-{file}.parquet", [_parquet(table, BLOCK)])
        write_atomic(f"{folder}/zones-{file}.parquet", [_parquet(pa.table(dict(zip(("label_low", "label_high", "low", "high"), map(pa.array, ends)))), 4096)])
        anchors = int((table.column("vec_id").to_numpy() % every == 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (file, len(v), anchors)], names=["file", "rows", "anchors"])

    key = ["label", "place", "vec_id", F.spark_partition_id()]
    placed = rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(place, "vec_id long, label long, place binary, vals binary")
    dealt = placed.repartitionByRange(files, *key).sortWithinPartitions("label", "place", "vec_id")
    return materialize(dealt.mapInArrow(write, "file long, rows long, anchors long"), f"{folder}/files")


def _values(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vals").to_pylist()), np.int32).reshape(-1, dim)


class Best:
    """The best ``k`` rows of each slot: highest score first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id, self.rank = k, *(np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(slots, -np.inf)  # the score that a further row has to reach

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        self.rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = self.rank < self.k
        self.slot, self.score, self.id, self.rank = slot[keep], score[keep], ids[keep], self.rank[keep]
        full = self.rank == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in the narrowest floats that hold all partial sums, which lengths bound, else in integers."""
    most = np.sqrt((a.astype(np.float64) ** 2).sum(1).max() * (b.astype(np.float64) ** 2).sum(1).max())
    kind = np.float32 if most < 2**24 - 1 else np.float64 if most < 2**52 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each row of ``a`` can have with any vector of each box."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = low.astype(np.float64).T, high.astype(np.float64).T
    return up @ low + down @ high, up @ high + down @ low


def sweep(folder: str, files: list[int], a: np.ndarray, wanted, visit, count: list[int] | None = None) -> None:
    """Visit what ``wanted(label_low, label_high, least, greatest)`` (anchors x blocks, asked again before a block is read) calls for.

    ``visit(anchors, ids, labels, scores)`` gets the block's rows and the scores of the anchors that want it. ``count`` adds up (blocks read, all blocks).
    """
    fs, path = filesystem(folder)
    for file in files:
        with fs.open_input_file(f"{path}/zones-{file}.parquet") as f:
            zones = pq.read_table(f)
        low, high = (np.frombuffer(b"".join(zones.column(c).to_pylist()), np.int32).reshape(-1, a.shape[1]) for c in ("low", "high"))
        labels = [zones.column(c).to_numpy() for c in ("label_low", "label_high")]
        source = None
        for at in range(0, len(low), 1024):
            least, greatest = bounds(a, low[at : at + 1024], high[at : at + 1024])
            ask = lambda b: wanted(labels[0][at + b], labels[1][at + b], least[:, b], greatest[:, b])  # noqa: B023, E731
            for b in range(least.shape[1]):
                rows = np.flatnonzero(ask(b))
                if count is not None:
                    count[0], count[1] = count[0] + (len(rows) > 0), count[1] + 1
                if not len(rows):
                    continue
                source = source or pq.ParquetFile(fs.open_input_file(f"{path}/blocks-{file}.parquet"))
                block = source.read_row_group(at + b)
                visit(rows, block.column("vec_id").to_numpy(), block.column("label").to_numpy(), inner(a[rows], _values(block, a.shape[1])))
        if source:
            source.close(force=True)


def _offer(best: Best, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
    """Put the fitting scores (rows x candidates) into ``best``; of very many only what can be among the first of its row."""
    if fits.sum() > 8 * best.k * len(slot) and scores.shape[1] > best.k:
        held = np.where(fits, scores, -np.inf)
        fits = fits & (held >= np.partition(held, -best.k, axis=1)[:, -best.k, None])
    row, column = np.nonzero(fits)
    if len(row):
        best.add(slot[row], scores[row, column].astype(np.int64), ids[column])


def mine_chunk(folder: str, files: list[int], ids: np.ndarray, labels: np.ndarray, a: np.ndarray, positives: int, negatives: int, low: int, high: int, count: list[int] | None = None) -> dict[str, np.ndarray]:
    """Rows of the result for some anchors."""
    near = Best(len(a), positives)

    def same(rows, others, kinds, scores):
        fits = (kinds == labels[rows, None]) & (others != ids[rows, None]) & (scores >= near.floor[rows, None].astype(scores.dtype if scores.dtype.kind == "f" else np.float64))
        _offer(near, rows, others, scores, fits)

    sweep(folder, files, a, lambda first, last, least, most: (first <= labels) & (labels <= last) & (most >= near.floor), same, count)
    # windows of the positives, as anchors x positives; those that an anchor lacks are empty
    top, bottom = np.full((2, len(a), positives), -np.inf)
    bottom[:] = np.inf
    top[near.slot, near.rank], bottom[near.slot, near.rank] = high * near.score // 100, -(-low * near.score // 100)
    hard = Best(len(a) * positives, negatives)
    floor = lambda: np.maximum(bottom, hard.floor.reshape(bottom.shape))

    def other(rows, others, kinds, scores):
        kind = scores.dtype if scores.dtype.kind == "f" else np.float64
        unlike, least = kinds != labels[rows, None], floor()[rows].astype(kind)
        for j in range(positives):
            _offer(hard, rows * positives + j, others, scores, unlike & (scores <= top[rows, j, None].astype(kind)) & (scores >= least[:, j, None]))

    def open_(first, last, least, most):
        return ((first != labels) | (last != labels)) & ((most[:, None] >= floor()) & (least[:, None] <= top)).any(1)

    sweep(folder, files, a, open_, other, count)
    if not len(hard.slot):
        return {}
    place = np.searchsorted(near.slot * positives + near.rank, hard.slot)
    return {"anchor_id": ids[hard.slot // positives], "positive_id": near.id[place], "rank": hard.rank + 1, "negative_id": hard.id, "positive_score": near.score[place], "negative_score": hard.score}


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int, folder: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOWEST, high: int = HIGHEST) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``every``) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    another label whose score is ``low`` to ``high`` percent of the positive's.

    Scores are inner products of integer components; higher ones come first, ties by smaller id. ``rows`` has (vec_id, label, embedding); labels are
    integers. Rows with a null id, label or vector, with null or non-finite components, without components, or of another length than the vector of the
    smallest id take no part. Repeated rows each take part; rows with the anchor's id are not other rows. An anchor without positives, and a positive without
    rows in its window, give no row; an empty table gives none. Other columns are ignored.

    A task sweeps the blocks for up to CHUNK anchors of a file, nearest files of the curve first. It holds one block and its file's zone map at a time.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("embedding")))
    dim, _ = first_vectors(kept, 1)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    files = write_blocks(kept.where(F.size("embedding") == dim), dim, every, folder)
    names = sorted(r.file for r in files.select("file").collect())  # one number a file
    units = files.where("anchors > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchors") - 1, F.lit(CHUNK).cast("long"))).alias("start"))

    def run(batches):
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = filesystem(folder)
                found, seen = [], 0
                with fs.open_input_file(f"{path}/blocks-{file}.parquet") as f:
                    for block in pq.ParquetFile(f).iter_batches():
                        mine_ = pa.Table.from_batches([block]).filter(block.column("vec_id").to_numpy() % every == 0)
                        found.append(mine_.slice(max(0, start - seen), max(0, min(start + CHUNK - seen, mine_.num_rows) - max(0, start - seen))))
                        seen += mine_.num_rows
                anchors = pa.concat_tables(found)
                order = sorted(names, key=lambda other: (abs(other - file), other))
                got = mine_chunk(folder, order, anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _values(anchors, dim), positives, negatives, low, high)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "rank" else pa.int64()) for c, v in got.items()], names=list(got))

    return units.repartition(max(1, units.count())).mapInArrow(run, SCHEMA)
