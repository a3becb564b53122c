"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, slices

DIMENSIONS = 1024
_SLICE = 1 << 20
_TABLE_LIMIT = 1 << 16
#: Texts and trigrams that are bundled at once, and characters of a text; the rest follows and adds up.
_TEXTS, _GRAMS, _PIECE = 512, 4096, 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """A random vector of -1 and 1 that the code point alone decides."""
    return (np.random.default_rng([7, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


class Profiler:
    """Turns texts into bundles of trigram vectors.

    A trigram abc has the vector of a permuted twice, times the vector of b permuted once, times that of c;
    permuting is a rotation. Runs of other characters than letters count as one space, one is set before and
    after each text, and letters are lower-cased.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.int8)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, each given as three code points in 21 bits each."""
        if len(self.rows) > _TABLE_LIMIT:
            self.rows = {}
        at = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            row = self.rows.get(code)
            if row is None:
                row = self.rows[code] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = (letter_vector(code >> s & 0x1FFFFF, self.dimensions) for s in (42, 21, 0))
                self.table[row] = np.roll(a, 2) * np.roll(b, 1) * c
            at[i] = row
        return self.table[at].astype(np.float32)

    def add(self, symbols: np.ndarray, owner: np.ndarray, into: np.ndarray) -> None:
        """Add the trigrams of symbols, none across two owners' ends, to the rows of ``into`` that ``owner`` names."""
        inside = owner[:-2] == owner[2:]
        if not inside.any():
            return
        present = np.flatnonzero(np.bincount(symbols, minlength=33))
        number = np.zeros(present[-1] + 1, np.int64)
        number[present] = np.arange(len(present))
        s, n = number[symbols], len(present)
        code = (s[:-2] * n * n + s[1:-1] * n + s[2:])[inside]
        if n**3 <= 1 << 24:
            found = np.flatnonzero(np.bincount(code, minlength=1))
            place = np.zeros(n**3, np.int64)
            place[found] = np.arange(len(found))
            code = place[code]
        else:
            found, code = np.unique(code, return_inverse=True)
        a, b, c = (present[x].astype(np.int64) for x in (found // (n * n), found // n % n, found % n))
        grams = (a << 42) | (b << 21) | c
        rows, own = np.unique(owner[:-2][inside], return_inverse=True)
        key = np.sort(code * len(rows) + own)  # by trigram
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[first], np.diff(np.append(first, len(key)))
        for at in range(0, len(grams), _GRAMS):
            lo, hi = np.searchsorted(key, [at * len(rows), (at + _GRAMS) * len(rows)])
            own_grams = grams[at : at + _GRAMS]
            table = np.zeros((len(rows), len(own_grams)), np.float32)
            table[key[lo:hi] % len(rows), key[lo:hi] // len(rows) - at] = count[lo:hi]
            into[rows] += table @ self.vectors(own_grams)

    def bundles(self, texts: list[str], group: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bundle of each of n groups, letters of each text). What is held at once is bounded beside the texts and the bundles."""
        into, letters = np.zeros((n, self.dimensions)), np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= _PIECE]
        for at in range(0, len(short), _TEXTS):
            own = short[at : at + _TEXTS]
            padded = [f" {texts[i].lower()} " for i in own]
            points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
            length = np.fromiter(map(len, padded), np.int64, len(padded))
            edge = np.cumsum(length) - length
            letter = _letters()[points]
            begin = np.zeros(len(points), bool)
            begin[edge] = True
            keep = letter | begin
            keep[1:] |= letter[:-1] & ~begin[1:]
            letters[own] = np.add.reduceat(letter, edge, dtype=np.int64)
            doc = np.repeat(np.arange(len(own)), length)[keep]
            symbols = np.where(letter, points, 32)[keep]
            # Within a text first, then by group: two texts of a group have no trigram across them.
            one = np.zeros((len(own), self.dimensions))
            self.add(symbols, doc, one)
            np.add.at(into, [group[i] for i in own], one)
        for i in (i for i, t in enumerate(texts) if len(t) > _PIECE):
            low, tail, one = texts[i].lower(), np.array([32], np.uint32), np.zeros((1, self.dimensions))
            for at in range(0, len(low) + 1, _PIECE):
                piece = low[at : at + _PIECE] + ("" if at + _PIECE < len(low) + 1 else " ")
                points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                letter = _letters()[points]
                letters[i] += int(letter.sum())
                keep = letter.copy()
                keep[1:] |= letter[:-1]
                keep[:1] |= tail[-1] != 32
                symbols = np.concatenate([tail, np.where(letter, points, 32)[keep]])
                self.add(symbols, np.zeros(len(symbols), np.int64), one)
                tail = symbols[-2:]
            into[group[i]] += one[0]
        return into, letters


@functools.cache
def profiler(dimensions: int) -> Profiler:
    return Profiler(dimensions)


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """A unit prototype for each language of ``docs(text, lang)``: the sum of its documents' bundles.

    Rows without text or lang teach nothing. Tasks add up what they read and send ``dimensions`` numbers a
    language, which Spark sums; the driver gets the profiles only and refuses more than ``max_languages``.
    """

    def partial(batches):
        own, sums = profiler(dimensions), {}
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = {name: k for k, name in enumerate(names)}
                vectors, _ = own.bundles(part.column("text").to_pylist(), [number[x] for x in langs], len(names))
                for name, v in zip(names, vectors):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])

    usable = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    summed = usable.mapInArrow(partial, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = summed.limit(max_languages * dimensions + 1).collect()
    if len(rows) > max_languages * dimensions:
        raise ValueError(f"more than {max_languages} languages")
    profiles: dict[str, np.ndarray] = {}
    for r in rows:
        profiles.setdefault(r.lang, np.zeros(dimensions))[r.dim] = r.value
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(profiles.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred and score (cosine with that prototype, 0 at least) for each row of ``docs(doc_id, text)``.

    Text without a letter, null text, or no profile at all gives ``und`` and 0. Ties go to the first name.
    """
    names = list(profiles)
    matrix = np.array([profiles[n] for n in names]).reshape(len(names), dimensions).T

    def run(batches):
        own = profiler(dimensions)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bundle, letters = own.bundles(texts, list(range(len(texts))), len(texts))
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    cosine = (bundle @ matrix) / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
                    best = np.argmax(cosine, axis=1)
                    known = letters > 0
                    pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
                    score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows whose id bucket is not 0, predict all rows: doc_id, held_out, lang_pred, score."""
    learned = learn_profiles(docs.where(id_bucket("doc_id", folds) != 0))
    return identify(docs, learned).select("doc_id", (id_bucket("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
