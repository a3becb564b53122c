"""What is near what in one instant: rows are moved once, by instant, and met by cells within the task that has it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Candidate pairs that are tested, and sent on, in one piece.
PIECE = 1 << 20


def _met(group: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (each once) of one group whose cells are equal or touch, in pieces. Cells are in order, so neighbours are stretches."""
    gx, gy = (v - v.min() + 1 for v in (gx, gy))
    wide, high = gx.max() + 2, gy.max() + 2
    _, g = np.unique(group, return_inverse=True)
    if (g.max() + 1.0) * wide * high >= 2.0**62:
        raise ValueError("places are too far apart for cells of this radius")
    cell = (g * int(wide) + gx.astype(np.int64)) * int(high) + gy.astype(np.int64)
    at = np.argsort(cell, kind="stable")
    cell = cell[at]
    place = np.arange(len(at))
    for first, last in ((place + 1, np.searchsorted(cell, cell + 1, "right")), (np.searchsorted(cell, cell + int(high) - 1), np.searchsorted(cell, cell + int(high) + 1, "right"))):
        some = np.maximum(last - first, 0)
        total = np.concatenate([[0], np.cumsum(some)])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, "right")) - 1)
            n = some[lo:hi]
            if n.any():
                i = np.repeat(place[lo:hi], n)
                j = np.repeat(first[lo:hi] - (total[lo:hi] - total[lo]), n) + np.arange(len(i))
                yield at[i], at[j]
            lo = hi


def close(group: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, edge: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (each once) of one group closer than ``radius``, or with ``edge`` also as far, in pieces."""
    fit = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    if len(fit) < 2:
        return
    for a, b in _met(group[fit], *(np.floor(v[fit] / radius) for v in (x, y))):
        a, b = fit[a], fit[b]
        d = np.hypot(x[a] - x[b], y[a] - y[b])
        hit = d <= radius if edge else d < radius
        yield a[hit], b[hit]


def overlapping(group: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, kind: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes (each once) of one group that share an area, in pieces; with ``kind`` those of unequal kind only. Cells are as large as the largest box, so centres of such pairs touch."""
    fit = np.flatnonzero(np.isfinite(x1 + x2 + y1 + y2) & (x2 > x1) & (y2 > y1))
    if len(fit) < 2:
        return
    cells = (np.floor((lo[fit] + hi[fit]) / 2 / ((hi[fit] - lo[fit]).max() * (1 + 1e-9))) for lo, hi in ((x1, x2), (y1, y2)))
    for a, b in _met(group[fit], *cells):
        if kind is not None:
            other = kind[fit[a]] != kind[fit[b]]
            a, b = a[other], b[other]
        a, b = fit[a], fit[b]
        hit = (x1[a] < x2[b]) & (x1[b] < x2[a]) & (y1[a] < y2[b]) & (y1[b] < y2[a])
        yield a[hit], b[hit]


def shared(sides: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area that boxes (x1, y1, x2, y2) at ``a`` and ``b`` share, their IoU)."""
    x1, y1, x2, y2 = ((v[a], v[b]) for v in sides)
    wide, high = (np.maximum(0.0, np.minimum(*hi) - np.maximum(*lo)) for lo, hi in ((x1, x2), (y1, y2)))
    total = (x2[0] - x1[0]) * (y2[0] - y1[0]) + (x2[1] - x1[1]) * (y2[1] - y1[1]) - wide * high
    return wide * high, np.divide(wide * high, total, out=np.zeros(len(a)), where=total > 0)


#: Rows of whole groups that go to the work at once, about, where a block of instants has more.
ROWS = 1 << 16


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers that are equal where all ``keys`` are; a row without a key is alone."""
    code, alone = np.zeros(len(table), np.int64), np.zeros(len(table), bool)
    for k in keys:
        v = table.column(k).combine_chunks()
        each = v.dictionary_encode()
        alone |= each.indices.is_null().to_numpy(zero_copy_only=False)
        code = code * (len(each.dictionary) + 1) + pc.fill_null(each.indices, 0).to_numpy()
        _, code = np.unique(code, return_inverse=True)
    return np.where(alone, len(table) + np.arange(len(table)), code)


def by_instant(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str, dealt: list[str] | None = None, whole: bool = False) -> DataFrame:
    """``work(table, group)`` over whole groups of equal ``keys``, many small ones at a time; rows without a key are left out, or with ``whole`` by themselves.

    A task reads its groups in order and holds one group, or one batch, at a time. ``dealt`` are columns by which rows come dealt out
    and in order already, with all rows of a group in one of these blocks: then nothing is moved, and a task holds one block at a time.
    """
    order = dealt or keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def edges(table: pa.Table) -> np.ndarray:
            """Places where another group, or block, than that of the row before begins."""
            new = np.zeros(max(len(table) - 1, 0), bool)
            for k in order:
                v = table.column(k).combine_chunks()
                new |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new) + 1

        def parts(table: pa.Table):
            if dealt is None:
                yield table, np.searchsorted(edges(table), np.arange(len(table)), "right")
                return
            group = _codes(table, keys)
            if len(table) <= ROWS:
                yield table, group
                return
            at = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[at])) + 1
            lo = 0
            while lo < len(at):
                fits = cut[(cut > lo) & (cut <= lo + ROWS)]
                later = cut[cut > lo + ROWS]
                hi = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(at)
                hi = len(at) if len(at) - lo <= ROWS else hi
                yield table.take(pa.array(at[lo:hi])), group[at[lo:hi]]
                lo = hi

        def send(table: pa.Table):
            for part, group in parts(table):
                for done in work(part, group):
                    yield from done.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held:
                seam = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table.slice(0, 1)])
                if len(edges(seam)):
                    yield from send(pa.concat_tables(held))
                    held = []
            cut = edges(table)
            if len(cut):
                yield from send(pa.concat_tables([*held, table.slice(0, cut[-1])]))
                held = [table.slice(cut[-1])]
            else:
                held.append(table)
        if held:
            yield from send(pa.concat_tables(held))

    rows = rows if whole else rows.dropna(subset=keys)
    return (rows.repartition(*keys).sortWithinPartitions(*keys) if dealt is None else rows).mapInArrow(run, schema)


def kinds_of(rows: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in rows.schema}


def box_pairs(boxes: DataFrame, find: Callable, keep: Callable[[np.ndarray], np.ndarray], more: tuple[str, ...] = (), dealt: list[str] | None = None) -> DataFrame:
    """(session, camera, t, person_id, person_id_b, iou), the lesser person first, of the pairs that ``find(group, *more, *box)`` gives and whose IoU ``keep`` takes."""
    key, box = ["session", "camera", "t"], ["x1", "y1", "x2", "y2"]
    kinds = kinds_of(boxes)

    def pairs(table: pa.Table, group: np.ndarray):
        sides, others = numbers(table, *box), numbers(table, *more)
        who = table.column("person_id").combine_chunks()
        rank = pc.rank(who, "ascending", tiebreaker="dense").to_numpy()
        for a, b in find(group, *others, *sides):
            a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
            _, iou = shared(sides, a, b)
            hit = (rank[a] < rank[b]) & keep(iou)
            a, b = a[hit], b[hit]
            yield pa.table({**{c: table.column(c).take(pa.array(a)) for c in (*key, "person_id")}, "person_id_b": who.take(pa.array(b)), "iou": iou[hit]})

    rows = boxes.select(*dict.fromkeys((*(dealt or ()), *key, "person_id", *more, *box)))
    return by_instant(rows.dropna(subset=["person_id"]), key, pairs, ", ".join(f"{c} {kinds[c]}" for c in (*key, "person_id")) + f", person_id_b {kinds['person_id']}, iou double", dealt)


def numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(float) for c in columns]
