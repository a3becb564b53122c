import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdspark.llm import dual_tree, vectors, zone_mining
from crowdspark.llm.common import run_dir

ROWS = "vec_id long, embedding array<float>, label int, code string, place string, error long, part int"


def table(spark, n=700, dim=16, labels=4, seed=5):
    """Clustered vectors with ties and copies, broken rows of every kind, a null id, null labels, and columns whose names clash."""
    make = np.random.default_rng(seed)
    centre = make.normal(0, 0.3, (6, dim))
    data = [(centre[i % 6] + make.normal(0, 0.05, dim)).astype(np.float32).round(2).tolist() for i in range(n)]
    rows = [(i * 5, v, i % labels if i % 11 else None) for i, v in enumerate(data)]
    rows += [(20, data[4], 1), (20, data[4], 1), (1000003, data[4], 2), (None, data[9], 1)]
    rows += [(7001, None, 1), (7002, [None, *data[0][1:]], 1), (7003, [math.nan, *data[0][1:]], 2), (7004, [math.inf, *data[0][1:]], 2), (7005, [], 1), (7006, data[0][:-1], 1)]
    rows += [(7007, [1e30, *data[0][1:]], 3)]
    return rows, spark.createDataFrame([(*r, "c", "p", 1, 2) for r in rows], ROWS).repartition(3)


def kept(rows, dim=16):
    take = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = lambda x: max(-vectors.MOST, min(vectors.MOST, math.floor(256 * float(np.float32(x)))))
    return [(i, [whole(x) for x in v], label) for i, v, label in take]


def brute_codes(rows, parts=4, entries=8, rounds=2):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((gap(cut(v, p), c), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in rows:
            for p in range(parts):
                groups[p, near(v, p)[1]].append(cut(v, p))
        for (p, e), found in groups.items():
            book[p][e] = [sum(x) // len(found) for x in zip(*found)]
    out = []
    for i, v, label in rows:
        best = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, book


def test_codes_against_brute_force(spark):
    rows, df = table(spark)
    want, book = brute_codes(kept(rows))
    got, found = dual_tree.compress(df, run_dir(spark, "codes"), 4, 8)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in got.collect()) == Counter(want)
    assert found.tolist() == book
    assert dual_tree.book_text(found) == ",".join(str(x) for p in book for e in p for x in e)


@pytest.mark.parametrize("labels", [1 << 16, 0])
def test_label_errors_by_either_join(spark, monkeypatch, labels):
    monkeypatch.setattr(dual_tree, "BROADCAST_LABELS", labels)
    rows, df = table(spark, 150, 32)
    got = dual_tree.vector_codes(df, run_dir(spark, "codes")).collect()
    want, book = brute_codes(kept(rows, 32), 16, 64)
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((i, c, e, total[label]) for i, label, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(dual_tree.book_text(np.array(book)).encode()).hexdigest()}


def test_codes_of_nothing_and_of_odd_lengths(spark):
    _, df = table(spark, 20)
    assert dual_tree.vector_codes(df.where("false"), run_dir(spark, "codes")).count() == 0
    assert dual_tree.vector_codes(df.where("embedding IS NULL"), run_dir(spark, "codes")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        dual_tree.compress(df.where("vec_id = 7006"), run_dir(spark, "codes"))


@pytest.mark.parametrize("n,k,width", [(1, 1, 4), (5, 3, 2), (3000, 64, 4), (1000, 48, 4), (900, 64, 1)])
def test_trees_assign_as_full_comparison_does(n, k, width):
    make = np.random.default_rng(n)
    parts = make.integers(-20, 20, (3, n, width)) + make.integers(-3, 4, (3, n, 1)) * 90
    book = np.concatenate([parts[:, : k - 1], parts[:, :1]], 1)  # an entry twice
    order = dual_tree.grow(parts, 16)
    codes, sums, counts, single = dual_tree.assign(dual_tree.Tree(np.take_along_axis(parts, order[:, :, None], 1), 16), book)
    got = np.empty_like(codes)
    np.put_along_axis(got, order, codes, 1)
    want = ((parts[:, :, None] - book[:, None]) ** 2).sum(3).argmin(2)
    assert (got == want).all()
    for p in range(3):
        assert (counts[p] == np.bincount(want[p], minlength=k)).all()
        assert all((sums[p, e] == parts[p][want[p] == e].sum(0)).all() for e in range(k))
    assert single <= 3 * n


def test_whole_nodes_are_assigned():
    make = np.random.default_rng(1)
    book = make.integers(-2000, 2000, (1, 32, 4))
    parts = book[:, make.integers(0, 32, 4000)] + make.integers(-9, 9, (1, 4000, 4))
    order = dual_tree.grow(parts, 16)
    *_, single = dual_tree.assign(dual_tree.Tree(np.take_along_axis(parts, order[:, :, None], 1), 16), book)
    assert single < 2000  # the others by sums of their nodes


def test_hilbert_curve_steps_to_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = [k.tobytes() for k in zone_mining.hilbert_keys(grid, bits)]
        walk = grid[sorted(range(len(keys)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(keys) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute_mining(rows, every, positives=5, negatives=3, low=50, high=95):
    out = Counter()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    for i, a, label in rows:
        if i % every:
            continue
        others = sorted((-score(a, v), j, kind == label) for j, v, kind in rows if j != i)
        for s, j, _ in [o for o in others if o[2]][:positives]:
            found = [o for o in others if not o[2] and low * -s <= 100 * -o[0] <= high * -s][:negatives]
            out.update((i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(found, 1))
    return out


def test_mining_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(zone_mining, "BLOCK", 16)
    monkeypatch.setattr(zone_mining, "CHUNK", 7)
    rows, df = table(spark)
    got = Counter(tuple(r) for r in zone_mining.mine(df, 10, run_dir(spark, "mine")).collect())
    assert got == brute_mining(kept(rows), 10) and len(got) > 500


def test_mining_edges(spark):
    rows, df = table(spark, 30)
    assert zone_mining.mine(df.where("false"), 10, run_dir(spark, "mine")).count() == 0
    assert zone_mining.mine(df.where("label = 1"), 10, run_dir(spark, "mine")).count() == 0  # no other label
    assert zone_mining.mine(df.withColumn("label", F.col("vec_id").cast("int")), 10, run_dir(spark, "mine")).where("anchor_id <> 20").count() == 0  # no positives
    assert zone_mining.mine(df, 10**9, run_dir(spark, "mine")).where("anchor_id <> 0").count() == 0


def test_zone_maps_leave_blocks_unread(spark):
    """Tight, far clusters: most blocks are out of reach of an anchor's windows."""
    make = np.random.default_rng(3)
    centre = make.normal(0, 1, (12, 8))
    data = [(i, (centre[i % 12] + make.normal(0, 0.01, 8)).tolist(), i % 3) for i in range(6000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    folder = run_dir(spark, "zones")
    files = sorted(r.file for r in zone_mining.write_blocks(df, 8, 50, folder).collect())
    count = [0, 0]
    a = vectors.integers(spark.createDataFrame(data[:1], df.schema).toArrow().column("embedding").combine_chunks(), 8).astype(np.int32)
    zone_mining.mine_chunk(folder, files, np.array([0]), np.array([0]), a, 5, 3, 50, 95, count)
    assert 0 < count[0] < count[1] / 2


def test_inner_products_are_exact():
    make = np.random.default_rng(4)
    for most in (50, 60_000, 1 << 22):
        a, b = make.integers(-most, most, (3, 64)), make.integers(-most, most, (5, 64))
        assert zone_mining.inner(a, b).astype(np.int64).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
