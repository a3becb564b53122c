"""Words of many texts at once, as numpy arrays: bounds, 64-bit hashes and token ids."""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Keeps the first k of eight bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n+1 offsets of the texts; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, none across two texts, and the n+1 word offsets."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _WORD[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = word[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


class Words:
    """Words of a text buffer as numbers: their first eight bytes, length, further bytes in blocks of eight, and hash.

    The hash mixes every block with its place before blocks are added up. It is fast and meant for grouping: unequal words can be made to share
    one. ``equal`` compares the bytes themselves.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True):
        padded = np.concatenate([_LOWER[raw] if lower else raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
        self.size = ends - starts
        self.head = eight[starts] & _MASK[np.minimum(self.size, 8)]
        blocks = np.maximum(self.size - 1, 0) // 8
        self.at = np.concatenate([[0], np.cumsum(blocks)])
        place = np.arange(self.at[-1]) - np.repeat(self.at[:-1], blocks) + 1
        where = np.repeat(starts, blocks) + 8 * place
        self.tail = eight[where] & _MASK[np.minimum(np.repeat(ends, blocks) - where, 8)]
        self.hashes = self.hash(place)

    def __len__(self) -> int:
        return len(self.size)

    def hash(self, place: np.ndarray) -> np.ndarray:
        h = mix(self.head + self.size.astype(np.uint64) * _STEP)
        long = np.flatnonzero(self.at[:-1] < self.at[1:])
        if len(long):
            h[long] += np.add.reduceat(mix(self.tail ^ mix(place.astype(np.uint64) * _STEP)), self.at[long])
        return mix(h)

    def take(self, rows: np.ndarray) -> Words:
        """The same of some of the words."""
        found = object.__new__(Words)
        blocks = np.diff(self.at)[rows]
        found.size, found.head, found.hashes = self.size[rows], self.head[rows], self.hashes[rows]
        found.at = np.concatenate([[0], np.cumsum(blocks)])
        found.tail = self.tail[np.repeat(self.at[:-1][rows] - found.at[:-1], blocks) + np.arange(found.at[-1])]
        return found

    def equal(self, other: Words) -> np.ndarray:
        """Whether each word has the bytes of the other's word of the same number."""
        same = (self.size == other.size) & (self.head == other.head)
        rows = np.flatnonzero(same & (self.at[:-1] < self.at[1:]))
        if len(rows):
            a, b = self.take(rows), other.take(rows)
            same[rows] = ~np.logical_or.reduceat(a.tail != b.tail, a.at[:-1])
        return same

    @staticmethod
    def merge(a: Words, b: Words, order: np.ndarray) -> Words:
        """Both one after the other, then in the given order."""
        both = object.__new__(Words)
        for name in ("size", "head", "hashes", "tail"):
            setattr(both, name, np.concatenate([getattr(a, name), getattr(b, name)]))
        both.at = np.concatenate([a.at, a.at[-1] + b.at[1:]])
        return both.take(order)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct word, number of every word among them), told apart by their bytes."""
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~words.equal(words.take(first[inverse])))
    if len(odd):  # equal hashes, other bytes
        seen: dict[tuple, int] = {}
        for i in odd.tolist():
            key = (int(words.size[i]), int(words.head[i]), words.tail[words.at[i] : words.at[i + 1]].tobytes())
            inverse[i] = seen.setdefault(key, len(first) + len(seen))
        new = np.zeros(len(seen), np.int64)
        new[inverse[odd][::-1] - len(first)] = odd[::-1]
        first = np.concatenate([first, new])
    return first, inverse


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word; with ``lower`` A-Z count as a-z. Any two of n distinct words share one with odds of n * n / 2**65.

    It is a keyed BLAKE2 digest, taken once a distinct word, so words can't be made to share one; the fast hash of ``Words``
    only groups equal ones, which are told apart by their bytes.
    """
    words = Words(raw, starts, ends, lower)
    if not len(words):
        return np.zeros(0, np.uint64)
    first, inverse = distinct(words)
    text = (_LOWER[raw] if lower else raw).tobytes()
    digest = lambda a, b: hashlib.blake2b(text[a:b], digest_size=8, key=b"words").digest()
    return np.frombuffer(b"".join(map(digest, starts[first].tolist(), ends[first].tolist())), np.uint64)[inverse]


#: Single pieces for the splitter: letters, then punctuation that can only be one piece of its own.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*%$#&]*)")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of whole texts by the tokenizers library, each distinct word encoded once.

    Holds for tokenizers that lower-case, drop white space and never join across it (their file says so); the
    ids of a text are then those of its words in order. Any other file is applied to whole texts. Words are found
    by hash and confirmed by their bytes. The table is bounded: beyond ``limit`` words it starts anew.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pattern = json.dumps((told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", ""))
        self.by_word = told["model"].get("end_of_word_suffix") == "</w>" and json.loads(pattern) == _WORD_SPLIT and not told.get("post_processor")
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limit = limit
        self.tails: dict[str, list[int]] = {"": []}
        self._clear()

    def _clear(self) -> None:
        nothing = np.zeros(0, np.int64)
        self.known = Words(np.zeros(0, np.uint8), nothing, nothing)  # by hash
        self.start, self.length = nothing, nothing
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Letters-only stems go in joined, each a single piece that ends with an end-of-word id."""
        stems: dict[str, int] = {}
        parts, others = [], []
        for i, w in enumerate(words):
            if m := _SIMPLE.fullmatch(w):
                parts.append((i, stems.setdefault(m[1], len(stems)), m[2]))
            else:
                others.append(i)
        names = list(stems)
        ids: list[list[int]] = []
        for at in range(0, len(names), 1000):
            group = names[at : at + 1000]
            flat = self._plain([" ".join(group)])[0]
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(flat):
                cut = [0, *cuts.tolist()]
                ids += [flat[a:b] for a, b in zip(cut, cut[1:])]
            else:
                ids += self._plain(group)
        out: list[list[int]] = [[]] * len(words)
        for i, stem, tail in parts:
            if tail not in self.tails:
                self.tails[tail] = self._plain([tail])[0]
            out[i] = ids[stem] + self.tails[tail] if tail else ids[stem]
        if others:
            for i, found in zip(others, self._plain([words[i] for i in others])):
                out[i] = found
        if len(self.tails) > 100_000:
            self.tails = {"": []}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n+1 offsets; null counts as empty."""
        if not self.by_word:
            found = self._plain(texts.fill_null("").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            return np.array([i for x in found for i in x], self.dtype), offsets
        raw, offsets = text_bytes(texts)
        data = raw.tobytes()
        lower = b"<|" not in data  # a special token's text is told from others by its case
        starts, ends, bounds = word_bounds(raw, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), bounds
        words = Words(raw, starts, ends, lower)
        first, inverse = distinct(words)
        own = words.take(first)
        if self.used > 8 * self.limit or len(self.known) > self.limit:
            self._clear()
        start, length = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        free, hit = np.ones(len(own), bool), np.zeros(len(own), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known.hashes, own.hashes), len(self.known) - 1)
            free = self.known.hashes[at] != own.hashes
            hit = own.equal(self.known.take(at)) & ~free
            start[hit], length[hit] = self.start[at[hit]], self.length[at[hit]]
        if not hit.all():
            new = np.flatnonzero(~hit)
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            text = data.lower() if lower else data
            found = self._new_words([text[a:b].decode() for a, b in zip(s, e)])
            length[new] = np.fromiter(map(len, found), np.int64, len(found))
            total = int(length[new].sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), self.dtype, total)
            start[new] = self.used + np.cumsum(length[new]) - length[new]
            self.used += total
            keep = new[free[new]]  # a word whose hash another has is encoded each time
            keep = keep[np.unique(own.hashes[keep], return_index=True)[1]]
            order = np.argsort(np.concatenate([self.known.hashes, own.hashes[keep]]), kind="stable")
            self.known = Words.merge(self.known, own.take(keep), order)
            self.start = np.concatenate([self.start, start[keep]])[order]
            self.length = np.concatenate([self.length, length[keep]])[order]
        length = length[inverse]
        after = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(start[inverse] - after[:-1], length) + np.arange(after[-1])
        return self.flat[where], after[bounds]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker and tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
