import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdspark.llm import kneser_ney, mixing, near_dedup, shingles as shingle_sets
from crowdspark.llm.common import id_bucket, run_dir

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_unlike_texts_share_no_coordinate():
    values = np.sort(np.random.default_rng(5).integers(0, 1 << 52, (3000, 500), dtype=np.uint64), axis=1)
    sign = shingle_sets.signatures(values.ravel(), np.arange(0, 500 * 3000 + 1, 500), 64)
    assert all(len(np.unique(column)) == len(column) for column in sign.T)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: find(d) for d, _ in sets}


@pytest.fixture(scope="module")
def copies():
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for group in range(8):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([3, 30, 120, 400]))]
        for _ in range(pick.choice([1, 2, 12, 40])):
            text = list(base)
            for _ in range(pick.randrange(0, 1 + len(base) // 12)):
                text[pick.randrange(len(text))] = pick.choice(vocabulary)
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc, rows[-1][1].upper()), (doc + 1, None), (doc + 2, " \n"), (doc + 3, "one two"), (doc + 4, "ONE\ttwo")]
    return rows


@pytest.mark.parametrize("largest", [16_384, 10])
def test_near_duplicates(spark, copies, monkeypatch, largest):
    """The same groups whether a block is one tile or many."""
    monkeypatch.setattr(near_dedup, "LARGEST", largest)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, run_dir(spark, "t6")).collect()
    want = brute_components(copies)
    text = dict(copies)
    assert len(got) == len(copies)
    for g in got:
        assert (g.n_shingles, g.component_id, g.kept) == (len(shingles(text[g.doc_id])), want[g.doc_id], want[g.doc_id] == g.doc_id)


def test_merged_lists_meet_all_that_match():
    """Every pair that agrees in enough coordinates is met through the prefixes."""
    make = np.random.default_rng(3)
    base = make.integers(0, 1 << 32, (6, 64), dtype=np.uint32)
    rows = np.concatenate([np.where(make.random((25, 64)) < share, b, make.integers(0, 1 << 32, (25, 64), dtype=np.uint32)) for b in base for share in (0.5, 0.8, 1.0)])
    met = list(near_dedup.merge_lists(rows))
    agree = (rows[:, None] == rows[None]).sum(axis=2)
    for i in range(len(rows)):
        assert set(np.flatnonzero(agree[i, :i] >= near_dedup.MATCHES)) <= set(met[i].tolist()) <= set(np.flatnonzero(agree[i, :i] > 0))


def test_words_alike_to_polynomial_hashes_stay_apart(spark):
    """Two words of 1,024 letters that polynomial hashes modulo powers of two confuse: no link, counts of their own."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join(x[k] for k in bits) for x in ("ab", "ba"))
    df = spark.createDataFrame([(1, f"{a} {a} one"), (2, f"{b} {b} one")], "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_duplicates(df, run_dir(spark, "t6")).collect())
    model = kneser_ney.train(df.where("doc_id = 1"), run_dir(spark, "t10"))
    assert {r.doc_id: r.n_known for r in kneser_ney.score(df, model).collect()} == {1: 4, 2: 2}


def test_near_duplicates_edges(spark, docs, rows, empty):
    got = near_dedup.near_duplicates(docs, run_dir(spark, "t6")).collect()
    assert len(got) == len(rows)
    label = {g.doc_id: g.component_id for g in got}
    assert label[1] == label[2] == 1 and label[4] == label[9] == label[10] == 4 and label[5] == 5 and label[None] is None
    assert near_dedup.near_duplicates(empty, run_dir(spark, "t6")).count() == 0


def test_components(spark):
    pick = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(pick.randrange(100, 160), pick.randrange(100, 160)) for _ in range(40)]
    spread = lambda i: (i * 7919) % 100_003
    found = near_dedup.components(spark.createDataFrame([(spread(a), spread(b)) for a, b in edges], "a long, b long"), run_dir(spark, "t6"))
    label = {r.node: r.label for r in found.collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    groups = defaultdict(set)
    for a, b in edges:
        if a != b:
            groups[up[a]] |= {label[spread(a)], label[spread(b)]}
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


class BruteModel:
    """The model by its formulas over dictionaries."""

    def __init__(self, texts):
        sents = [["<s>", *words(t), "</s>"] for t in texts]
        self.two = Counter(p for s in sents for p in zip(s, s[1:]))
        self.one = Counter(w for s in sents for w in s[1:])
        self.context, self.after, self.before = Counter(), defaultdict(list), Counter()
        for (v, w), c in self.two.items():
            self.context[v] += c
            self.after[v].append(c)
            self.before[w] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d2, self.d1 = self.discount(self.two.values()), self.discount(self.before.values())

    @staticmethod
    def discount(counts):
        n = [0, *(sum(c == k for c in counts) for k in (1, 2, 3, 4))]
        if not all(n[1:]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))]

    def low(self, w):
        total = sum(self.before.values())
        gamma = sum(self.d1[min(c, 3)] for c in self.before.values()) / total
        c = self.before[w]
        return max(c - self.d1[min(c, 3)], 0) / total + gamma / (self.v + 1)

    def chance(self, v, w):
        if not self.context[v]:
            return self.low(w)
        c = self.two[v, w]
        gamma = sum(self.d2[min(x, 3)] for x in self.after[v]) / self.context[v]
        return max(c - self.d2[min(c, 3)], 0) / self.context[v] + gamma * self.low(w)


@pytest.mark.parametrize("bucket", [4_000_000, 200])
def test_kneser_ney(spark, rows, bucket):
    pick = random.Random(2)
    vocabulary = ["the"] * 8 + [f"v{i}" for i in range(60)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(pick.randrange(0, 40))) for _ in range(150)] + [None, "", "The NEW word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    taught = id_bucket("doc_id", 7) != 2
    model = kneser_ney.train(df.where(taught), run_dir(spark, "t10"), bucket)
    assert model.buckets == max(1, math.ceil(model.tokens / bucket)) and (bucket > 1000 or len(model.hot))
    got = {g.doc_id: g for g in kneser_ney.score(df, model).collect()}
    ids = {r.doc_id for r in df.where(taught).collect()}
    brute = BruteModel([texts[i] for i in sorted(ids)])
    assert (model.tokens, model.vocabulary) == (brute.n, brute.v)
    for i, text in enumerate(texts):
        s = ["<s>", *words(text), "</s>"]
        g = got[i]
        assert (g.n_tokens, g.n_known) == (len(s) - 1, sum(brute.one[w] > 0 for w in s[1:]))
        assert math.isclose(g.base_score, sum(math.log10((brute.one[w] + 1) / (brute.n + brute.v + 1)) for w in s[1:]), rel_tol=1e-9)
        assert math.isclose(g.score, sum(math.log10(brute.chance(v, w)) for v, w in zip(s, s[1:])), rel_tol=1e-9)
    total = sum(brute.chance("the", w) for w in [*brute.one, "never seen"])
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_kneser_ney_edges(spark, docs, rows, empty):
    model = kneser_ney.train(empty, run_dir(spark, "t10"))
    scored = kneser_ney.score(docs, model).collect()
    assert len(scored) == len(rows) and all(s.n_known == 0 and math.isfinite(s.score) for s in scored)
    assert kneser_ney.score(empty, kneser_ney.train(docs, run_dir(spark, "t10"))).count() == 0


def test_blocks_round_trip():
    import numpy as np

    context, token, count = np.array([3, 3, 9], np.uint64), np.array([1, 2, 1], np.uint64), np.array([1, 400, 255])
    back = kneser_ney._unpack(kneser_ney._pack(context, token, count))
    assert [x.tolist() for x in back] == [[3, 3, 9], [1, 2, 1], [1, 400, 255]]


@pytest.fixture(scope="module")
def small(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_counts_beyond_32_bits(tmp_path):
    keys, count = np.array([3, 5, 8, 13, 21], np.uint64), np.array([1, 2**32 - 2, 2**32 - 1, 7, 2**40], np.int64)
    kneser_ney.write_grams(f"file://{tmp_path}/grams.bin", keys, count)
    wanted = np.array([2, 3, 5, 8, 9, 21, 13, 8, 30], np.uint64)
    assert kneser_ney.gram_counts(f"{tmp_path}/grams.bin", wanted).tolist() == [0, 1, 2**32 - 2, 2**32 - 1, 0, 2**40, 7, 2**32 - 1, 0]


def test_mixing(spark, small):
    documents, labels = small
    fitted = mixing.fit_mixture(documents, labels, mixing.WEIGHTS, run_dir(spark, "t7"))
    rates = mixing.mixing_rates(documents, fitted).join(labels, "doc_id").collect()
    assert all(r.rate >= 0 and math.isclose(r.p_clean + r.p_rough + r.p_toxic, 1, rel_tol=1e-6) for r in rates)
    clean = [r for r in rates if r.quality == 1 and not r.toxic]
    toxic = [r for r in rates if r.toxic]
    assert sum(r.copies == 1 for r in clean) >= 0.98 * len(clean)
    assert sum(r.copies == 0 for r in toxic) >= 0.95 * len(toxic)
    out = mixing.mix_documents(documents, fitted)
    assert out.columns == documents.columns and out.count() == sum(r.copies for r in mixing.mixing_rates(documents, fitted).collect())


def test_mixing_meets_targets(spark, small):
    """With rates free to rise, expected domain tokens come near the weights."""
    documents, labels = small
    weights = {"clean": 0.6, "rough": 0.25, "toxic": 0.15}
    fitted = mixing.fit_mixture(documents, labels, weights, run_dir(spark, "t7"), max_repeats=8.0)
    rows = mixing.mixing_rates(documents, fitted).collect()
    have = {k: sum(r.rate * r.n_words * r[f"p_{k}"] for r in rows) for k in weights}
    assert all(abs(have[k] / sum(have.values()) - w) < 0.02 for k, w in weights.items())


def test_mixing_against_least_squares(spark, small):
    """The fitted rates miss the targets by no more than a long projected gradient over the same posteriors does, and 1 % of the total."""
    documents, labels = small
    for weights in ({"clean": 0.6, "rough": 0.25, "toxic": 0.15}, {"clean": 0.1, "rough": 0.8, "toxic": 0.1}, mixing.WEIGHTS):
        fitted = mixing.fit_mixture(documents, labels, weights, run_dir(spark, "t7"))
        rows = mixing.mixing_rates(documents, fitted).collect()
        a = np.array([[r.n_words * r[f"p_{k}"] for r in rows] for k in weights])
        target = np.array([fitted.target[k] for k in weights])
        brute, step = np.ones(len(rows)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            brute = np.maximum(0, brute - step * (a.T @ (a @ brute - target)))
        miss = lambda r: np.abs(a @ r - target).sum()
        assert miss(np.array([r.rate for r in rows])) <= miss(brute) + 0.01 * target.sum()
        assert np.allclose([fitted.reached[k] for k in weights], a @ [r.rate for r in rows], rtol=1e-6, atol=1)


def test_mixing_short_domain(spark, small):
    """A domain below its weight repeats until it has it; under a cap the target stays and the shortfall is told."""
    documents, labels = small
    few = documents.join(labels.where("quality = 1 OR toxic = 1 OR doc_id % 9 = 0").select("doc_id"), "doc_id", "left_semi")
    total = lambda rows, k: sum(r.rate * r.n_words * r[f"p_{k}"] for r in rows)
    fitted = mixing.fit_mixture(few, labels, mixing.WEIGHTS, run_dir(spark, "t7"))
    rows = mixing.mixing_rates(few, fitted).collect()
    plain = {k: sum(r.n_words * r[f"p_{k}"] for r in rows) for k in mixing.WEIGHTS}
    assert plain["rough"] < plain["clean"] / 9
    have = {k: total(rows, k) for k in mixing.WEIGHTS}
    assert all(abs(have[k] / sum(have.values()) - w) < 0.02 for k, w in mixing.WEIGHTS.items())
    assert max(r.rate for r in rows) > 1.5 and all(math.isclose(fitted.reached[k], have[k], rel_tol=1e-6, abs_tol=1) for k in have)
    assert mixing.mix_documents(few, fitted).count() == sum(r.copies for r in rows)
    capped = mixing.fit_mixture(few, labels, mixing.WEIGHTS, run_dir(spark, "t7"), max_repeats=1.0)
    assert all(r.rate <= 1 for r in mixing.mixing_rates(few, capped).collect())
    assert math.isclose(capped.target["rough"], plain["clean"] / 9, rel_tol=1e-6) and capped.shortfall()["rough"] > 0


def test_mixing_many_copies(spark):
    text = spark.createDataFrame([(1, "a b c"), (2, "x " * 300_000)], "doc_id long, text string")
    heavy = mixing.Mixture(mixing.Classifier(np.full(1 << 16, -1), np.zeros((6, 3))), [np.full(3, -40.0)])
    assert mixing.mix_documents(text, heavy).groupBy("doc_id").count().collect() and mixing.mix_documents(text, heavy).count() == 82


def test_mixing_edges(spark, docs, empty, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted = mixing.fit_mixture(docs, labels, mixing.WEIGHTS, run_dir(spark, "t7"))
    assert mixing.mixing_rates(docs, fitted).count() == len(rows)
    fitted = mixing.fit_mixture(empty, labels, mixing.WEIGHTS, run_dir(spark, "t7"))
    assert mixing.mix_documents(empty, fitted).count() == 0
    n, dense, key, owner = mixing.features(pa.array(["Bad, bad word!", None, ""]))
    assert n.tolist() == [3, 0, 0] and dense.shape == (3, 5) and sorted(Counter(owner.tolist()).items()) == [(0, 2)]


#: Words of which a sum of mixed blocks makes one number.
ALIKE = ("abcdefghijklmnopqrstuvwx", "abcdefghwy$2m.2t@{(\\!>,6")


def test_words_made_to_hash_alike_stay_apart(spark):
    rest = " one two three four five six"
    df = spark.createDataFrame([(1, ALIKE[0] + rest), (2, ALIKE[1] + rest), (3, ALIKE[0]), (4, ALIKE[1])], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in near_dedup.near_duplicates(df, run_dir(spark, "t6")).collect()} == {1: True, 2: True, 3: True, 4: True}
    model = kneser_ney.train(df.where("doc_id = 3"), run_dir(spark, "t10"))
    got = {r.doc_id: r for r in kneser_ney.score(df, model).collect()}
    assert (got[3].n_known, got[4].n_known) == (2, 1) and got[3].score > got[4].score


def test_mixing_repeated_labelled_ids(spark):
    """Rows that share a labelled id teach once, by their least text, in whatever order they come."""
    rows = [(i, f"plain words number {i} of the day") for i in range(40)] + [(7, f"!!! ### {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    fitted = [mixing.learn_domains(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels) for step, n in ((1, 2), (-1, 5))]
    assert np.array_equal(fitted[0].column, fitted[1].column) and np.allclose(fitted[0].weight, fitted[1].weight, atol=1e-6)
