"""Sum-of-squares packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean, cut boolean"
#: Windows that a packer may hold open; bytes of text that a packer gets at least, where the table has them.
OPEN_WINDOWS, PACKER_BYTES = 4096, 8 << 20


@dataclass
class Window:
    """A sequence: its pieces (doc_id, start, ids, doc_tokens) in order, how many of them the closing added, and the places of those cut at the bound."""

    pieces: list = field(default_factory=list)
    added: int = 0
    cut: list = field(default_factory=list)


class SquarePacker:
    """Online packing: an item goes to the fill level that leaves the least sum of squared window counts.

    ``counts[h]`` is the level array: how many windows are open at fill h. Moving a window from h to h+size
    changes the sum by 1-2*counts[h] (nothing for a new window) plus 1+2*counts[h+size] (nothing if that fills
    it). Ties go to the fullest level. Full windows are given out at once. Once ``most`` windows are open and an
    item would open one more, the item is cut instead: its first ids fill up a window, by the same measure, and
    the rest is placed as an item of its own. So the windows held are bounded; by itself the rule holds a few
    hundred of 2,048 ids, well under the default, where nothing is cut (a test).
    """

    def __init__(self, length: int, most: int = OPEN_WINDOWS):
        self.length, self.most, self.held = length, max(1, most), 0
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[Window]] = {}

    def level(self, size: int) -> int:
        n = self.length
        gain = 2 * self.counts[size : n + 1] + 1
        gain[-1] = 0  # filled
        loss = 1 - 2 * self.counts[: n - size + 1]
        loss[0] = 0  # a new window
        cost = np.where(self.counts[: n - size + 1] > 0, gain + loss, np.iinfo(np.int64).max)
        cost[0] = gain[0]
        return n - size - int(np.argmin(cost[::-1]))

    def cut(self, size: int) -> int:
        """The open level that an item is cut to fill: the least sum of squares with the rest in a window of its own."""
        n = self.length
        levels = np.flatnonzero(self.counts[n - size + 1 : n]) + n - size + 1
        if not len(levels):
            return 0
        cost = 2 * self.counts[levels + size - n] - 2 * self.counts[levels]
        return int(levels[len(levels) - 1 - np.argmin(cost[::-1])])

    def _take(self, h: int) -> Window:
        self.counts[h] -= 1
        self.held -= 1
        return self.open[h].pop()

    def put(self, piece: tuple) -> list[Window]:
        """Place a piece of fewer than ``length`` ids; the windows that this filled."""
        full: list[Window] = []
        doc, start, ids, tokens = piece
        own = start
        while True:
            h = self.level(len(ids))
            if h or self.held < self.most or not (c := self.cut(len(ids))):
                break
            window, room = self._take(c), self.length - c
            window.cut.append(len(window.pieces))
            window.pieces.append((doc, start, ids[:room], tokens))
            full.append(window)
            start, ids = start + room, ids[room:]
        window = self._take(h) if h else Window()
        if start > own:
            window.cut.append(len(window.pieces))
        window.pieces.append((doc, start, ids, tokens))
        h += len(ids)
        if h == self.length:
            return [*full, window]
        self.counts[h] += 1
        self.held += 1
        self.open.setdefault(h, []).append(window)
        return full

    def rest(self):
        """The windows still open, closed: the fullest stay as placed and are filled up from the emptiest.

        Only what the emptiest held is cut anew. What is left of it goes by powers of two, unpadded.
        """
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        fill = [sum(len(p[2]) for p in w.pieces) for w in windows]
        spare, first, last = 0, 0, len(windows)
        loose: list[tuple] = []
        while first < last:
            need = self.length - fill[first]
            while spare < need and last - 1 > first:
                last -= 1
                loose += windows[last].pieces
                spare += fill[last]
            if spare < need:  # the last one: of its own
                loose, last = windows[first].pieces + loose, first
                break
            own = windows[first]
            while need:
                doc, start, ids, tokens = loose.pop()
                own.pieces.append((doc, start, ids[:need], tokens))
                own.added += 1
                if len(ids) > need:
                    loose.append((doc, start + need, ids[need:], tokens))
                spare, need = spare - min(need, len(ids)), need - min(need, len(ids))
            yield own
            first += 1
        total = sum(len(p[2]) for p in loose)
        sizes = [self.length] * (total // self.length) + [1 << k for k in reversed(range(total.bit_length())) if (total % self.length) >> k & 1]
        window, room = Window(), sizes.pop(0) if sizes else 0
        for doc, start, ids, tokens in loose:
            while len(ids):
                take = min(room, len(ids))
                window.pieces.append((doc, start, ids[:take], tokens))
                window.added += 1
                start, ids, room = start + take, ids[take:], room - take
                if not room:
                    yield window
                    window, room = Window(), sizes.pop(0) if sizes else 0


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int | None = 1, packer_bytes: int = PACKER_BYTES) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``length`` ids, with the columns of PIECES.

    Each partition packs its own documents, without a shuffle: full stretches of long documents become
    sequences at once, remainders are placed by the sum-of-squares rule, and at the partition's end the windows
    still open are filled up from the emptiest of them, with a tail of power-of-two lengths. ``placed`` tells the
    pieces that lie where the rule put them from those that this closing cut anew, and ``cut`` those that were cut because
    OPEN_WINDOWS windows were open. A small table's partitions are
    put together until a packer gets ``packer_bytes`` of text, for few documents leave most windows open.
    Null text counts as empty; a document without any id (empty, and no end id) has no piece; rows that share a
    doc_id are packed each for itself; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Fewer partitions where there are more than that; never more.
    docs = docs.coalesce(max(1, total // packer_bytes))

    def pack(batches):
        coder, packer = encoder(tokenizer), SquarePacker(length)
        serial = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        end = np.array([] if end_id is None else [end_id], coder.dtype)

        def close(window: Window) -> None:
            nonlocal serial
            offset, own, cut = 0, len(window.pieces) - window.added, set(window.cut)
            for k, (doc, start, ids, tokens) in enumerate(window.pieces):
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, serial, offset, k < own, k in cut and k < own))
                offset += len(ids)
            serial += 1

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            types = [pa.int64()] * 7 + [pa.bool_()] * 2
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names=names)
            out.clear()
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = coder.encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.concatenate([ids[a:b], end])
                    tokens, at = len(own), 0
                    while len(own) - at >= length:
                        close(Window([(doc, at, own[at : at + length], tokens)]))
                        at += length
                    if at < tokens:
                        for full in packer.put((doc, at, own[at:].copy() if at else own, tokens)):  # an open window does not hold on to a long document
                            close(full)
                if len(out) >= 20_000:
                    yield flush()
        for window in packer.rest():
            close(window)
        yield flush()

    return docs.mapInArrow(pack, PIECES)
