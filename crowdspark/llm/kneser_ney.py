"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, materialize, slices, write_atomic
from .words import mix, text_bytes, word_bounds, word_hashes

_U = np.uint64
BEGIN, END = _U(0x0B0B0B0B0B0B0B01), _U(0x0E0E0E0E0E0E0E01)
_FACTOR = _U(0xC2B2AE3D27D4EB4F)
#: Distinct n-grams a task gathers before it sends them on, and n-grams a bucket holds on average.
GATHER, BUCKET = 4_000_000, 4_000_000
#: A context with more than 1/HEAVY of all tokens may be told apart and spread over buckets.
HEAVY = 16384
#: Counts from this on are kept apart, with 64 bits.
_LONG = 0xFFFFFFFF


def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, n+1 offsets): each text's words and one end, after the token before or the begin mark."""
    raw, offsets = text_bytes(texts)
    starts, ends, words = word_bounds(raw, offsets)
    tokens = np.insert(word_hashes(raw, starts, ends), words[1:], END)
    bounds = words + np.arange(len(words))
    context = np.concatenate([[BEGIN], tokens[:-1]]).astype(np.uint64) if len(tokens) else tokens
    context[bounds[:-1]] = BEGIN
    return context, tokens, bounds


@dataclass
class Model:
    """What scoring needs beside the files: bucket layout, discounts, totals, and first keys of the word files."""

    out: str
    buckets: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    top: tuple = (0.5, 1.0, 1.5)
    tokens: int = 0
    vocabulary: int = 0
    documents: int = 0
    unseen: float = 1.0
    files: tuple = ()

    def bucket(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Bucket of each bigram: by its context, a frequent context's also by the token."""
        salt = np.zeros(len(context), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            is_hot = self.hot[at] == context
            salt[is_hot] = mix(token[is_hot] ^ _FACTOR) % self.spread[at[is_hot]] + _U(1)
        return (mix(context * _FACTOR + salt) % _U(self.buckets)).astype(np.int64)


def gram_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _FACTOR + mix(token))


def _pack(context: np.ndarray, token: np.ndarray, count: np.ndarray) -> bytes:
    """Bigrams sorted by context as: sizes, contexts once each, their numbers of tokens, tokens, counts (8 bits, long ones apart)."""
    edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    long = np.flatnonzero(count > 255)
    head = np.array([len(edge), len(token), len(long)], "<i8")
    return b"".join(x.tobytes() for x in (head, context[edge], np.diff(np.append(edge, len(token))).astype(np.uint32), token, np.minimum(count, 255).astype(np.uint8), long.astype(np.uint32), count[long].astype(np.int64)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, k = np.frombuffer(data, "<i8", 3).tolist()
    at = 24
    parts = []
    for kind, size in ((np.uint64, n), (np.uint32, n), (np.uint64, m), (np.uint8, m), (np.uint32, k), (np.int64, k)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    contexts, numbers, token, small, place, large = parts
    count = small.astype(np.int64)
    count[place] = large
    return np.repeat(contexts, numbers), token, count


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams occur once, twice, three and four times; usual ones if too few do."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def _frequent(docs: DataFrame) -> DataFrame:
    """Per task: its number of tokens and of documents (key 0 and 1 of kind 0), and counts of its frequent contexts."""

    def run(batches):
        keys, counts, tokens, documents = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                context, token, bounds = pairs(part.column("text"))
                tokens, documents = tokens + len(token), documents + len(bounds) - 1
                k, n = np.unique(context, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > 500_000:
                    few = counts * 4 * HEAVY >= tokens
                    keys, counts = keys[few], counts[few]
        many = counts * 2 * HEAVY >= tokens
        kinds = [0, 0] + [1] * int(many.sum())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.concatenate([[0, 1], keys[many].view(np.int64)])), pa.array(np.concatenate([[tokens, documents], counts[many]]))], names=["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, out: str, bucket_size: int = BUCKET) -> Model:
    """Count ``docs(text)`` into files under ``out``; null text counts as empty, an empty table gives a uniform model.

    Tasks gather their bigrams and send each bucket a sorted block of them; buckets go by context hash, and
    contexts that would fill one are spread over several by the token (they are found by a count over all
    documents; it only shapes buckets, not results). A bucket writes its bigrams' keys in ascending order beside
    their counts, and sends on what it saw of contexts and of tokens' predecessors, which Spark sums by word.
    """
    told = _frequent(docs)
    sums = {r.key: r.n for r in told.where("kind = 0").collect()}
    model = Model(out, tokens=sums.get(0, 0), documents=sums.get(1, 0))
    model.buckets = max(1, math.ceil(model.tokens / bucket_size))
    limit = max(model.tokens / (4 * model.buckets), model.tokens / HEAVY)
    hot = sorted((r.key & 0xFFFFFFFFFFFFFFFF, r.n) for r in told.where((F.col("kind") == 1) & (F.col("n") > limit)).collect())  # HEAVY rows at most
    if model.buckets > 1:
        model.hot = np.array([k for k, _ in hot], np.uint64)
        model.spread = np.array([math.ceil(n / limit) for _, n in hot], np.uint64)

    def gather(batches):
        held, size = [], 0

        def send():
            context, token = (np.concatenate(x) for x in zip(*held))
            _, first, count = np.unique(gram_key(context, token), return_index=True, return_counts=True)
            context, token = context[first], token[first]
            bucket = model.bucket(context, token)
            order = np.lexsort((context, bucket))
            context, token, count, bucket = context[order], token[order], count[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(edges, edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([_pack(context[a:b], token[a:b], count[a:b])], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for part in slices(batch, "text"):
                context, token, _ = pairs(part.column("text"))
                held.append((context, token))
                size += len(token)
                if size >= GATHER:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    names = ["kind", "word", "total", "once", "twice", "more", "before"]

    def merge(key, table):
        blocks = [_unpack(b.as_py()) for b in table.column("block")]
        context, token, count = (np.concatenate(x) for x in zip(*blocks))
        del blocks, table
        keys, first, back = np.unique(gram_key(context, token), return_index=True, return_inverse=True)
        count = np.bincount(back, count, len(keys)).astype(np.int64)
        context, token = context[first], token[first]
        write_grams(f"{out}/grams-{key[0].as_py()}.bin", keys, count)
        words, back = np.unique(context, return_inverse=True)
        table_of = lambda w: np.bincount(back, w, len(words)).astype(np.int64)
        after, seen = np.unique(token, return_counts=True)
        few = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        zero = lambda n: np.zeros(n, np.int64)
        columns = [
            np.concatenate([[0], np.ones(len(words) + len(after), np.int32)]).astype(np.int32),
            np.concatenate([np.zeros(1, np.uint64), words, after]).view(np.int64),
            np.concatenate([[few[0]], table_of(count), zero(len(after))]),
            np.concatenate([[few[1]], table_of(count == 1), zero(len(after))]),
            np.concatenate([[few[2]], table_of(count == 2), zero(len(after))]),
            np.concatenate([[few[3]], table_of(count > 2), zero(len(after))]),
            np.concatenate([[len(keys)], zero(len(words)), seen]),
        ]
        return pa.table(columns, names=names)

    blocks = docs.select("text").mapInArrow(gather, "bucket int, block binary")
    seen = blocks.groupBy("bucket").applyInArrow(merge, "kind int, word long, total long, once long, twice long, more long, before long")
    words = materialize(seen.groupBy("kind", "word").agg(*(F.sum(c).alias(c) for c in names[2:])), f"{out}/words")
    top = words.where("kind = 0").first()
    if top is None:
        return model
    model.top = discounts([top.total, top.once, top.twice, top.more])
    words = words.where("kind = 1").drop("kind")
    low = words.agg(*(F.sum((F.col("before") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)), F.sum((F.col("before") > 2).cast("long")).alias("many"), F.sum("before").alias("all"), F.sum((F.col("before") > 0).cast("long")).alias("v")).first()
    lower = discounts([low.n1, low.n2, low.n3, low.n4])
    model.vocabulary = low.v
    model.unseen = (lower[0] * low.n1 + lower[1] * low.n2 + lower[2] * low.many) / low.all / (low.v + 1)
    taken = F.when(F.col("before") == 1, lower[0]).when(F.col("before") == 2, lower[1]).otherwise(lower[2])
    share = F.greatest(F.lit(0.0), F.col("before") - taken) / F.lit(float(low.all)) + F.lit(model.unseen)
    mass = F.lit(model.top[0]) * F.col("once") + F.lit(model.top[1]) * F.col("twice") + F.lit(model.top[2]) * F.col("more")
    unsigned = F.col("word").bitwiseXOR(F.lit(-(1 << 63)))  # orders as the unsigned hash does
    rows = words.select(unsigned.alias("rank"), "total", mass.alias("mass"), share.alias("share")).repartitionByRange("rank").sortWithinPartitions("rank")

    def write(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        key = table.column("rank").to_numpy().view(np.uint64) ^ _U(1 << 63)
        part = TaskContext.get().partitionId()
        write_atomic(f"{out}/words-{part}.bin", (np.array([len(key)], "<i8").tobytes(), key.tobytes(), *(table.column(c).to_numpy().astype(t).tobytes() for c, t in (("total", "<i8"), ("mass", "<f8"), ("share", "<f8")))))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(key[0].view(np.int64))], pa.int64())], names=["part", "low"])

    listed = rows.mapInArrow(write, "part int, low long").collect()  # one row a file
    model.files = tuple(sorted((r.low & 0xFFFFFFFFFFFFFFFF, r.part) for r in listed))
    return model


def write_grams(uri: str, keys: np.ndarray, count: np.ndarray) -> None:
    """Ascending keys and their counts of 32 bits; then the places and the counts of those that need 64 bits."""
    long = np.flatnonzero(count >= _LONG)
    write_atomic(uri, (np.array([len(keys)], "<i8").tobytes(), keys.tobytes(), np.minimum(count, _LONG).astype(np.uint32).tobytes(), long.astype("<i8").tobytes(), count[long].astype("<i8").tobytes()))


@functools.lru_cache(maxsize=256)
def _gram_file(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.fromfile(path, "<i8", 1)[0])
    end = 8 + 12 * n
    long, large = np.fromfile(path, "<i8", offset=end).reshape(2, -1)
    return np.memmap(path, np.uint64, "r", 8, (n,)), np.memmap(path, np.uint32, "r", 8 + 8 * n, (n,)), long, large


def gram_counts(path: str, wanted: np.ndarray) -> np.ndarray:
    """Counts of ``wanted`` keys in a file, 0 where it has none."""
    keys, counts, long, large = _gram_file(path)
    at, ok = _find(keys, wanted)
    found = np.where(ok, counts[at], 0).astype(np.int64)
    over = found == _LONG
    if over.any():
        found[over] = large[np.searchsorted(long, at[over])]
    return found


@functools.lru_cache(maxsize=256)
def _word_file(path: str) -> tuple[np.ndarray, ...]:
    n = int(np.fromfile(path, "<i8", 1)[0])
    return tuple(np.memmap(path, t, "r", 8 + 8 * n * i, (n,)) for i, t in enumerate((np.uint64, np.int64, np.float64, np.float64)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def look_up_words(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, discounted mass, share) of ascending distinct words."""
    total, mass, share = np.zeros(len(words), np.int64), np.zeros(len(words)), np.full(len(words), model.unseen)
    lows = np.array([low for low, _ in model.files], np.uint64)
    home = np.searchsorted(lows, words, "right") - 1
    for k in np.unique(home[home >= 0]).tolist():
        pick = home == k
        keys, *values = _word_file(local_path(f"{model.out}/words-{model.files[k][1]}.bin"))
        at, ok = _find(keys, words[pick])
        for target, value in zip((total, mass, share), values):
            target[np.flatnonzero(pick)[ok]] = value[at[ok]]
    return total, mass, share


def look_up_pairs(model: Model, context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Counts of bigrams, in any order."""
    key, bucket = gram_key(context, token), model.bucket(context, token)
    order = np.lexsort((key, bucket))
    count = np.zeros(len(key), np.int64)
    sorted_bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1], [True]])) if len(order) else []
    for a, b in zip(edges, edges[1:]):
        path = local_path(f"{model.out}/grams-{sorted_bucket[a]}.bin")
        if path:  # a bucket that no bigram fell into has no file
            count[order[a:b]] = gram_counts(path, key[order[a:b]])
    return count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row of ``docs(doc_id, text)``; null text is just the end."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                context, token, bounds = pairs(part.column("text"))
                words, back = np.unique(np.concatenate([context, token]), return_inverse=True)
                total, mass, share = look_up_words(model, words)
                before, now = back[: len(token)], back[len(token) :]
                all_pairs, place = np.unique(before.astype(np.int64) * len(words) + now, return_inverse=True)
                count = look_up_pairs(model, words[all_pairs // len(words)], words[all_pairs % len(words)])[place]
                taken = np.select([count == 0, count == 1, count == 2], [0.0, model.top[0], model.top[1]], model.top[2])
                whole = total[before]
                known = np.maximum(whole, 1)
                chance = np.where(whole > 0, np.maximum(count - taken, 0) / known + mass[before] / known * share[now], share[now])
                seen = np.where(token == END, model.documents, total[now])
                base = np.log10((seen + 1) / (model.tokens + model.vocabulary + 1))
                add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(add((seen > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(chance)))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
