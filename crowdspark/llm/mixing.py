"""Mixing sources to target weights with soft domain membership."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .words import Words, mix, text_bytes, word_bounds

#: Domains, in the order of posteriors, and the condition on ``labels`` that makes a row an example of each.
DOMAINS = {"clean": "quality = 1 AND toxic = 0", "rough": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
WEIGHTS = {"clean": 0.9, "rough": 0.1, "toxic": 0.0}
#: Bound of the classifier's sample: labelled documents a domain.
SAMPLE_ROWS = 1500
#: Share of the total that whole rates may add to what domains miss of their targets.
SNAP_MISS = 0.01
_BUCKETS, _PICKED, _DENSE = 1 << 16, 2000, 5
_U = np.uint64
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,!?;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words a text, five statistics a text, hashed words, owner of each): words lower-case without end marks, each once a text."""
    raw, offsets = text_bytes(texts)
    starts, ends, bounds = word_bounds(raw, offsets)
    n = np.diff(bounds)
    for _ in range(3):
        cut = (ends - starts > 1) & _TRIM[raw[ends - 1]] if len(ends) else np.zeros(0, bool)
        ends = ends - cut
    key = Words(raw, starts, ends).hashes % _U(_BUCKETS)  # buckets are shared anyway
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    once = np.unique(owner * _U(_BUCKETS) + key)
    owner, key = (once // _U(_BUCKETS)).astype(np.int64), (once % _U(_BUCKETS)).astype(np.int64)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    distinct = np.bincount(owner, minlength=len(n))
    dense = np.stack([total(_UPPER[raw]) / size, total(_SIGN[raw]) / np.maximum(n, 1), total(_MARK[raw]) / np.maximum(n, 1), 1 - distinct / np.maximum(n, 1), np.log1p(n) / 10], axis=1)
    return n, dense, key, owner


@dataclass
class Classifier:
    """Softmax regression over five statistics and the presence of picked hashed words."""

    column: np.ndarray  # place of a hashed word among the picked, or -1
    weight: np.ndarray  # (statistics + picked words + 1) x domains

    def posteriors(self, dense: np.ndarray, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        logits = dense @ self.weight[:_DENSE] + self.weight[-1]
        at = self.column[key]
        own, at = owner[at >= 0], at[at >= 0]
        for k in range(logits.shape[1]):
            logits[:, k] += np.bincount(own, self.weight[_DENSE + at, k], len(dense))
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def learn_domains(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on at most SAMPLE_ROWS labelled documents a domain, taken by the hash of their doc_id; of rows that share an id the least text."""
    columns, weights = np.full(_BUCKETS, -1), np.zeros((_DENSE + 1, len(DOMAINS)))
    domain = F.coalesce(*(F.when(F.expr(c), F.lit(i)) for i, c in enumerate(DOMAINS.values())))
    named = labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = None
    for i in range(len(DOMAINS)):
        own = named.where(F.col("domain") == i).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        picked = own if picked is None else picked.union(own)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))  # one row an id before anything leaves the tasks

    def show(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, dense, key, owner = features(part.column("text"))
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, _DENSE, dtype=np.int32)), pa.array(dense.ravel())), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.astype(np.int32)))], names=["doc_id", "domain", "dense", "words"])

    shown = rows.mapInArrow(show, "doc_id long, domain int, dense array<double>, words array<int>")
    sample = sorted(shown.collect(), key=lambda r: r.doc_id)
    if not sample:
        return Classifier(columns, weights)
    y = np.array([r.domain for r in sample])
    owner = np.repeat(np.arange(len(sample)), [len(r.words) for r in sample])
    key = np.concatenate([np.array(r.words, np.int64) for r in sample])
    rate = np.stack([(np.bincount(key[y[owner] == k], minlength=_BUCKETS) + 0.5) / ((y == k).sum() + 1) for k in range(len(DOMAINS))])
    rate[[k for k in range(len(DOMAINS)) if not (y == k).any()]] = rate.mean(axis=0)
    spread = (rate.max(axis=0) - rate.min(axis=0)) * np.log(rate.max(axis=0) / rate.min(axis=0))
    best = np.argsort(-spread, kind="stable")[:_PICKED]
    columns[best] = np.arange(len(best))
    x = np.zeros((len(sample), _DENSE + len(best) + 1), np.float32)
    x[:, :_DENSE] = [r.dense for r in sample]
    x[:, -1] = 1
    at = columns[key]
    x[owner[at >= 0], _DENSE + at[at >= 0]] = 1
    target = np.eye(len(DOMAINS), dtype=np.float32)[y]
    balance = (1 / np.maximum(target.sum(axis=0), 1))[y][:, None] / len(set(y.tolist()))
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 301):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ ((p - target) * balance) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    prior = np.log(np.maximum([named.where(F.col("domain") == i).count() for i in range(len(DOMAINS))], 0.5))
    w[-1] += (prior - prior.mean()).astype(np.float32)  # classes were fitted at equal shares
    return Classifier(columns, w.astype(np.float64))


@dataclass
class Mixture:
    """Rates r, from 1 on: r - p.v held between 0 and ``most``, for one step vector v an iteration of the descent.

    With ``snap`` a rate within 0.02 of a whole number is taken as that, so that no document is drawn by chance for a
    trace of another domain; the fit uses it only where targets are met within SNAP_MISS of the total all the same. Rates without a bound are divided by ``scale``, which leaves the shares of domains as they are. ``target`` has the tokens that each domain is to have, ``reached`` those that it is expected to have at these rates.
    """

    classifier: Classifier
    steps: list
    most: float = np.inf
    scale: float = 1.0
    snap: bool = True
    target: dict = field(default_factory=dict)
    reached: dict = field(default_factory=dict)

    def shortfall(self) -> dict:
        """Tokens that a domain lacks to its target, for those that lack any."""
        return {k: t - self.reached[k] for k, t in self.target.items() if t > self.reached[k]}

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for v in self.steps:
            r = np.clip(r - p @ v, 0.0, self.most)
        r = r / self.scale
        return np.where(np.abs(r - np.rint(r)) < 0.02, np.rint(r), r) if self.snap else r


def fit_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float], out: str, max_repeats: float | None = None, iterations: int = 40, tolerance: float = 1e-3) -> Mixture:
    """Projected-gradient least squares for nonnegative document rates whose expected domain tokens meet the targets.

    A document's tokens (words) belong to domains by its posteriors p. Targets are ``weights`` of the total at
    which the domain of the largest weight keeps all it has. Rates are bounded by 0 only, so documents of a domain
    too small for its weight repeat; ``max_repeats`` holds them at that (1 at least), and targets stay what they
    are. Each step is one distributed sum of expected domain tokens and of the posteriors' products over documents
    with a rate above 0 (a few numbers reach the driver), then r - p.v, held at the bounds, for all documents,
    where v is the misfit scaled by those products. Weights are shares, so rates without ``max_repeats`` are then
    divided by the median one of the largest weight's documents: these are drawn once each, as nearly as may be. It ends within ``tolerance`` of the total; where targets can't
    be met it comes to rest near them, and the mixture tells what is reached.
    """
    classifier, names = learn_domains(docs, labels), list(DOMAINS)

    def guess(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, dense, key, owner = features(part.column("text"))
                p = classifier.posteriors(dense, key, owner)
                yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(p[:, k]) for k in range(len(names)))], names=["n", *(f"p{k}" for k in range(len(names)))])

    table = materialize(docs.select("text").mapInArrow(guess, "n long, " + ", ".join(f"p{k} double" for k in range(len(names)))).where("n > 0"), out)
    p = [F.col(f"p{k}") for k in range(len(names))]
    goal = np.array([weights[k] for k in names], float) / sum(weights.values())
    target, steps, best, most = None, [], (np.inf, 0), np.inf if max_repeats is None else max(1.0, max_repeats)
    anchor, rate = int(np.argmax(goal)), F.lit(1.0)
    rates = [rate]
    for _ in range(iterations):
        live = F.when(F.col("r") > 0, F.col("n")).otherwise(0)
        sums = [F.sum(F.col("r") * F.col("n") * p[k]).alias(f"s{k}") for k in range(len(names))] + [F.sum(live * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
        row = table.withColumn("r", rate).agg(*sums).first()
        if row.s0 is None:
            return Mixture(classifier, [], most)
        have = np.array([row[f"s{k}"] for k in range(len(names))])
        if target is None:
            target = goal * have[anchor] / goal[anchor]
        miss = float(np.abs(have - target).sum() / max(target.sum(), 1))
        if miss < best[0]:
            best = (miss, len(steps))
        if miss < tolerance or len(steps) - best[1] > 5:
            break
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
        v = np.linalg.solve(gram + np.eye(len(names)) * (1e-3 * np.trace(gram) + 1e-9), have - target)
        steps.append(v)
        rate = F.least(F.lit(most), F.greatest(F.lit(0.0), rate - sum((p[k] * float(v[k]) for k in range(1, len(names))), p[0] * float(v[0]))))
        rates.append(rate)
    rate, scale = rates[best[1]], 1.0
    if np.isinf(most):
        own = table.where(p[anchor] > 0.5).agg(F.percentile_approx(rate, 0.5, 10_000)).first()[0]
        scale = own or 1.0
    rate = rate / scale
    whole = F.when(F.abs(rate - F.rint(rate)) < 0.02, F.rint(rate)).otherwise(rate)
    row = table.agg(*(F.sum(r * F.col("n") * p[k]).alias(f"{name}{k}") for name, r in (("whole", whole), ("exact", rate)) for k in range(len(names)))).first()
    reached = {name: np.array([row[f"{name}{k}"] for k in range(len(names))]) for name in ("whole", "exact")}
    miss = {name: np.abs(x - target / scale).sum() for name, x in reached.items()}
    snap = bool(miss["whole"] <= miss["exact"] + SNAP_MISS * target.sum() / scale)
    return Mixture(classifier, steps[: best[1]], most, scale, snap, dict(zip(names, (target / scale).tolist())), dict(zip(names, reached["whole" if snap else "exact"].tolist())))


def _draws(batch: pa.RecordBatch, mixture: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, posteriors, rates, copies): copies are the rate rounded up with its fraction's chance, decided by doc_id and text."""
    n, dense, key, owner = features(batch.column("text"))
    p = mixture.classifier.posteriors(dense, key, owner)
    r = mixture.rates(p)
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    raw, offsets = text_bytes(batch.column("text"))
    chance = (mix(mix(ids) ^ np.diff(offsets).astype(np.uint64)) >> _U(11)).astype(np.float64) / 2.0**53
    return n, p, r, np.floor(r + chance).astype(np.int64)


def mixing_rates(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, n_words, the posteriors, rate and copies for each row of ``docs(doc_id, text)``.

    Null text counts as empty and gets the rate of its posteriors; rows that share doc_id and length are drawn alike.
    """
    names = [f"p_{k}" for k in DOMAINS]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, p, r, copies = _draws(part, mixture)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(r), pa.array(copies)], names=["doc_id", "n_words", *names, "rate", "copies"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, " + ", ".join(f"{k} double" for k in names) + ", rate double, copies long")


def mix_documents(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows of ``docs`` with all columns, each as often as it was drawn, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                copies = _draws(part, mixture)[3]
                # A rate has no bound, so copies are given out a few megabytes at a time.
                size = np.diff(text_bytes(part.column("text"))[1]) + 1
                ends = np.cumsum(copies)
                total, step = int(ends[-1]) if len(ends) else 0, max(1, (1 << 22) // int(size.max(initial=1)))
                for at in range(0, max(total, 1), step):
                    yield part.take(pa.array(np.searchsorted(ends, np.arange(at, min(at + step, total)), "right")))

    return docs.mapInArrow(run, docs.schema)
