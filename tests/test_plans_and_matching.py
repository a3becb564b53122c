"""Plans, crowds, evidence and scores against known answers and brute force."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdspark.functions import geometry as G
from crowdspark.operators import boxes, counters, graphs, identity, matching, metrics, plans, reports, stays, trajectories


def test_polygons_as_columns(spark):
    """Column tests give what the vectorised one gives, on edges and corners too."""
    pick = random.Random(2)
    shapes = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (9, 2), (4, 7)], [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)], [(2, 0), (2, 5), (5, 5), (5, 0)]]
    points = [(pick.uniform(-1, 10), pick.uniform(-1, 8)) for _ in range(800)] + [(float(x), float(y)) for x in range(-1, 8) for y in range(-1, 8)] + [(4.0 + 5e-7, 2.0), (4.0 + 5e-6, 2.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    got = df.select(*(G.contains(s)("x", "y").alias(f"c{i}") for i, s in enumerate(shapes)), G.quad_holds([(F.lit(a), F.lit(b)) for a, b in map(lambda p: tuple(map(float, p)), shapes[2])], F.col("x"), F.col("y")).alias("q")).collect()
    x, y = np.array(points).T
    for i, s in enumerate(shapes):
        assert [r[f"c{i}"] for r in got] == G.inside(x, y, s).tolist()
    finite = np.isfinite(x) & np.isfinite(y)
    assert [r.q for r, ok in zip(got, finite) if ok] == G.inside(x, y, shapes[2])[finite].tolist()


def test_zone_of_nulls(spark):
    zones = [{"zone_id": 1, "type": "ZONA", "vertices": [(0, 0), (9, 0), (9, 9), (0, 9)]}, {"zone_id": 2, "type": "INTERIOR", "vertices": [(1, 1), (8, 1), (8, 8), (1, 8)]}, {"zone_id": 3, "type": "ZONA", "vertices": [(0, 0), (2, 0), (0, 2)]}]
    df = spark.createDataFrame([(5.0, 5.0), (0.5, 0.5), (8.5, 8.5), (20.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert [r.zone_id for r in stays.assign_zone(df, zones).collect()] == [2, 3, 1, -1, -1, -1]


def test_expand():
    assert np.allclose(sorted(G.expand([(0, 0), (4, 0), (4, 2), (0, 2)], 1.5)), sorted([(-1.5, -1.5), (5.5, -1.5), (5.5, 3.5), (-1.5, 3.5)]))
    assert np.allclose(sorted(G.expand([(0, 2), (4, 2), (4, 0), (0, 0)], 1.5)), sorted([(-1.5, -1.5), (5.5, -1.5), (5.5, 3.5), (-1.5, 3.5)]))
    assert np.allclose(G.expand([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], 1)[1], (2, -1))  # a corner on a straight side
    assert len(G.expand([(0, 0), (4, 0), (4, 0), (0, 4)], 1)) == 3 and G.expand([(0, 0), (1, 1)], 1) == [(0.0, 0.0), (1.0, 1.0)]


def test_floor_known_answers():
    floor = plans.Floor([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    snap = lambda f, *p: tuple(round(float(v[0]), 6) for v in f.snap(*(np.array([c]) for c in p))[:2])
    assert snap(floor, 5.0, 2.0) == (3.8, 2.0) and snap(floor, 1.0, 1.0) == (1.0, 1.0)
    # A gap narrower than two margins: the place a millimetre off is taken only where no edge has one at the margin.
    narrow = plans.Floor([(0.0, 0.0), (2.3, 0.0), (2.3, 4.0), (0.0, 4.0)], [[(0.0, 0.0), (1.15, 0.0), (1.15, 4.0), (0.0, 4.0)]], margin=1.2)
    assert snap(narrow, 1.1, 2.0) == (1.151, 2.0)
    x, y, moved = floor.snap(np.array([np.nan, 9.0, 2.0]), np.array([1.0, 9.0, 2.0]))
    assert moved.tolist() == [False, True, False] and np.isnan(x[0])


def test_snap_trajectories_uses_adjusted_views(spark):
    """Two views on either side of an obstacle, one of them outside the floor: the mean is that of the adjusted points."""
    floor = plans.Floor([(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)], [[(4.0, 1.0), (6.0, 1.0), (6.0, 3.0), (4.0, 3.0)]])
    df = spark.createDataFrame([("s", 1, 0, 3.0, 2.0), ("s", 1, 0, 7.5, 2.0), ("s", 1, 1, 1.0, 9.0), ("s", 1, 1, 1.0, 2.0), ("s", 2, 0, None, 1.0)], "session string, person_id long, tick long, x double, y double")
    got = sorted((r.person_id, r.tick, r.x and round(r.x, 3), round(r.y, 3), r.moved) for r in plans.snap_trajectories(df, floor).collect())
    # 3 and 7.5 are free, their mean 5.25 is not: nearest free is 6.2 or 0.8 below or 3.2 above, of which 6.2 is nearest.
    assert got == [(1, 0, 6.2, 2.0, True), (1, 0, 6.2, 2.0, True), (1, 1, 0.2, 4.0, True), (1, 1, 1.0, 2.0, False), (2, 0, None, 1.0, False)]


def merged(case, interior=frozenset({1, 2})):
    import pandas as pd

    pdf = pd.DataFrame([(*r, i) for i, r in enumerate(case, 1)], columns=["zone_id", "first_t", "last_t", "run"])
    return stays.merge_runs(pdf, 0.2, 1.0, interior)


@pytest.mark.parametrize(
    "case,want",
    [
        ([(1, 0.0, 0.0), (2, 0.2, 0.4), (3, 0.6, 9.0)], [(3, 0.0, 9.0)]),  # short interiors at the start go on
        ([(3, 0.0, 4.0), (1, 4.2, 4.6), (-1, 4.8, 9.0)], [(3, 0.0, 4.6), (-1, 4.8, 9.0)]),  # a short interior goes back
        ([(3, 0.0, 4.0), (1, 4.2, 4.6), (3, 4.8, 9.0)], [(3, 0.0, 9.0)]),  # a short break is bridged
        ([(1, 0.0, 4.0), (3, 4.2, 6.0), (1, 6.2, 9.0)], [(1, 0.0, 4.0), (3, 4.2, 6.0), (1, 6.2, 9.0)]),  # a long one is not
        ([(3, 0.0, 1.0), (1, 1.2, 2.4)], [(3, 0.0, 1.0), (1, 1.2, 2.4)]),  # long enough inside
        ([(1, 0.0, 0.2)], [(1, 0.0, 0.2)]),  # the only stay remains
        ([(3, 0.0, 2.0), (1, 2.2, 2.4), (2, 2.6, 2.8), (3, 3.8, 5.0)], [(3, 0.0, 5.0)]),  # what short interiors parted joins up
    ],
)
def test_merge_runs_known_answers(case, want):
    assert [tuple(g[:3]) for g in merged(case)] == want


def test_merge_runs_properties():
    """Stays are stretches of runs in order; neighbours differ; none is a short interior unless alone; each has the zone of one of its runs; long runs stay as they are."""
    pick = random.Random(1)
    for _ in range(400):
        t, case, zone = 0.0, [], None
        for _ in range(pick.randrange(1, 9)):
            zone = pick.choice([z for z in (-1, 1, 2, 3) if z != zone])
            end = t + pick.choice([0, 0.2, 0.4, 1.2, 3.0])
            case.append((zone, round(t, 3), round(end, 3)))
            t = end + pick.choice([0.2, 0.2, 0.8])
        got = merged(case)
        held = [sorted(g[3]) for g in got]
        assert [r for h in held for r in h] == list(range(1, len(case) + 1))
        assert all((g[1], g[2]) == (case[h[0] - 1][1], case[h[-1] - 1][2]) and g[0] in {case[r - 1][0] for r in h} for g, h in zip(got, held))
        assert all(a[0] != b[0] for a, b in zip(got, got[1:]))
        assert len(got) == 1 or not any(g[0] in (1, 2) and g[2] + 0.2 - g[1] < 1.0 for g in got)
        if all(b + 0.2 - a >= 1.0 for _, a, b in case):
            assert len(got) == len(case)


def test_crowds_against_brute_force(spark):
    pick = random.Random(4)
    data = [("s", float(t), p, round(pick.uniform(0, 6), 1), round(pick.uniform(0, 6), 1)) for t in range(40) for p in range(14) if t % 11 != 10 and pick.random() < 0.8]
    data += [("z", 0.0, p, x, 0.0) for p, x in enumerate((0.0, 0.0, 2.0, 2.0))]  # exactly a radius apart: both centres stay
    df = spark.createDataFrame(data, "session string, t double, person_id long, x double, y double")
    got = sorted((r.session, r.t, r.x, r.y, r["count"], r.since, r.alert) for r in plans.crowd_clusters(df, 2.0, 4, 3.0).where("session = 's'").collect())
    want, before = [], []
    for t in range(40):
        here = [(x, y) for s, u, _, x, y in data if s == "s" and u == t]
        if not here:  # no sample
            continue
        centres = sorted(((sum(math.hypot(x - a, y - b) <= 2.0 for a, b in here), x, y) for x, y in here), reverse=True)
        circles = []
        for n, x, y in centres:
            if n >= 4 and all(math.hypot(x - a, y - b) >= 2.0 for _, a, b, _ in circles):
                circles.append([n, x, y, float(t)])
        for c in circles:
            near = [(math.hypot(c[1] - o[1], c[2] - o[2]), i) for i, o in enumerate(before) if math.hypot(c[1] - o[1], c[2] - o[2]) <= 2.0]
            if near:
                c[3] = before.pop(min(near)[1])[3]
        before = [list(c) for c in circles]
        want += [("s", float(t), x, y, n, since, t - since >= 3.0) for n, x, y, since in circles]
    assert got == sorted(want) and any(w[-1] for w in want)
    assert plans.crowd_clusters(df, 2.0, 2).where("session = 'z'").count() == 2


def test_divisions_by_zero(spark):
    """A line without length, a zero vector, and a zone without area give nothing instead of an error."""
    pixels = spark.createDataFrame([("s", "A", 1, 0.0, 0.4, 0.4), ("s", "A", 1, 0.2, 0.6, 0.6)], "session string, camera string, person_id long, t double, u double, v double")
    line = spark.createDataFrame([("A", 1, 0.5, 0.5, 0.5, 0.5, 1), ("A", 2, 0.2, 0.5, 0.8, 0.5, 1)], "camera string, line_id int, ax double, ay double, bx double, by double, entry_side int")
    assert [r.line_id for r in counters.line_crossings(pixels, line).collect()] == [2]
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "gid long, prototype array<double>")
    got = {(r.gid, r.dim): r.value for r in identity.tracklet_prototype(vectors, ["gid"]).collect()}
    assert got[2, 0] == 0.6 and got[1, 0] is None
    occupancy = spark.createDataFrame([("s", 1, k, 9, 0.0) for k in range(9)], "session string, zone_id int, second long, people long, mean_speed double")
    assert metrics.congestion_episodes(occupancy, spark.createDataFrame([(1, 0.0)], "zone_id int, area double")).count() == 0


def test_bands_and_totals(spark):
    lines = spark.createDataFrame([("A", 1, 0.2, 0.5, 0.8, 0.5, 1, [(0.2, 0.6), (0.8, 0.6)], [(0.2, 0.4), (0.8, 0.4)])], "camera string, line_id int, ax double, ay double, bx double, by double, entry_side int, positive array<struct<x: double, y: double>>, negative array<struct<x: double, y: double>>")
    walk = [(0.0, 0.45), (0.5, 0.55), (1.8, 0.45), (2.0, 0.9), (2.2, 0.55)]  # 0.9 is past the band and doesn't count
    pixels = spark.createDataFrame([("s", "A", 1, t, 0.5, v) for t, v in walk], "session string, camera string, person_id long, t double, u double, v double")
    crossings = counters.line_crossings(pixels, lines)
    assert sorted((r.t, r.direction) for r in crossings.collect()) == [(0.5, "entry"), (1.8, "exit")]
    total, hours = counters.line_totals(crossings)
    assert [tuple(r)[3:] for r in total.collect()] == [(1, 1, 1.8)] and [tuple(r)[3:] for r in hours.collect()] == [(0, 1, 1)]


def test_ranked_series(spark):
    rows = [("a", float(t), t) for t in range(1000)] + [("b", 0.0, 1), ("b", 0.0, 2)] + [("c", float(t * t), t) for t in range(77)]
    df = spark.createDataFrame(rows, "session string, t double, count long")
    got = {}
    for r in trajectories.ranked(df, ["t", "count"]).collect():
        got.setdefault(r.session, []).append((r.i, r.t, r["count"], r.n))
    assert {s: [(i, t, c) for i, t, c, _ in sorted(v)] for s, v in got.items()} == {s: [(i, t, c) for i, (_, t, c) in enumerate(sorted(x for x in rows if x[0] == s))] for s in "abc"}
    assert trajectories.report_series(df, 300).where("session = 'a'").count() == 250


def test_accepted_positions(spark):
    pick = random.Random(8)
    data = [("s", p, k * 0.5, pick.choice([0.0, 1.0, 9.0]) if p else k * 0.1, 0.0) for p in range(6) for k in range(60)]
    df = spark.createDataFrame(data, "session string, person_id long, t double, x double, y double")
    want = set()
    for p in range(6):
        last = None
        for _, q, t, x, y in data:
            if q == p and (last is None or abs(x - last[1]) <= 4.0 * (t - last[0]) + 1.5):
                last = (t, x)
                want.add((p, t))
    assert {(r.person_id, r.t) for r in matching.accepted_positions(df).collect()} == want and len(want) < len(data)


def test_accepted_positions_over_blocks(spark):
    """Small blocks, first rows far outside, blocks that are out of reach, equal times, repeated rows, other columns and nulls."""
    pick = random.Random(9)
    data = []
    for p in range(12):
        x = 40.0 * (p % 3)  # a far first row: whole blocks pass before anything is within reach of it
        for k in range(80):
            t = k * 0.4 + (200.0 if p == 5 and k > 40 else 0.0)
            data.append(("s", p, t, x if k == 0 else pick.choice([0.0, 0.5, 9.0, 30.0]), pick.choice([0.0, 6.0]), k))
            if pick.random() < 0.2:
                data.append(data[-1] if pick.random() < 0.5 else (*data[-1][:3], data[-1][3] + 3.0, 0.0, -k))
    want = []
    for p in range(12):
        last = None
        for r in sorted(r for r in data if r[1] == p):
            if last is None or ((r[3] - last[3]) ** 2 + (r[4] - last[4]) ** 2) ** 0.5 <= 2.0 * (r[2] - last[2]) + 1.5:
                last = r
                want.append(r)
    odd = [("s", 1, 3.0, None, 0.0, 7), ("s", None, 3.0, 1e9, 0.0, 8), ("s", None, 3.1, 0.0, 0.0, 9)]
    schema = "session string, person_id long, t double, x double, y double, first int"
    for block_s in (1.0, 7.0, 600.0):
        got = matching.accepted_positions(spark.createDataFrame(data + odd, schema), 2.0, 1.5, block_s)
        assert got.columns == ["session", "person_id", "t", "x", "y", "first"]
        rows = [tuple(r) for r in got.collect()]
        assert sorted(r for r in rows if r[1] is not None) == sorted(want) and len(want) < len(data) // 2
        assert sorted(r[5] for r in rows if r[1] is None) == [8, 9]
    assert matching.accepted_positions(spark.createDataFrame([], schema)).count() == 0


def iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w)


@pytest.fixture(scope="module")
def frames(spark):
    pick = random.Random(3)
    truth, system = [], []
    for t in range(30):
        for p in range(4):
            x, y = p * 30 + pick.uniform(-12, 12), pick.uniform(0, 10)
            truth.append(("s", "A", t * 0.2, f"p{p}", x, y, x + 20, y + 40))
            if pick.random() < 0.8:
                dx = pick.uniform(-6, 6)
                system.append(("s", "A", t * 0.2 + (0.09 if t % 3 else 0.15), f"i{p if t < 15 or p else 9}", x + dx, y, x + dx + 20, y + 40))
    schema = "session string, camera string, t double, id string, x1 double, y1 double, x2 double, y2 double"
    return truth, system, spark.createDataFrame(truth, schema), spark.createDataFrame(system, schema)


def brute_frames(truth, system):
    found = {}
    for t in sorted({r[2] for r in truth}):
        near = sorted((round(abs(s - t), 9), s) for s in {r[2] for r in system} if abs(s - t) <= 0.11)
        a = sorted((r for r in truth if r[2] == t), key=lambda r: r[3])
        b = sorted((r for r in system if near and r[2] == near[0][1]), key=lambda r: r[3])
        best = (1e9, ())
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        for pick in itertools.permutations(range(len(large)), len(small)):
            pairs = [(small[i], large[j]) if small is a else (large[j], small[i]) for i, j in enumerate(pick)]
            cost = sum(1 - iou(p[4:], q[4:]) for p, q in pairs)
            if cost < best[0] - 1e-12:
                best = (cost, pairs)
        found |= {(t, p[3]): q[3] for p, q in best[1] if iou(p[4:], q[4:]) >= 0.5}
    return found


def test_frames_and_scores_against_brute_force(frames):
    truth, system, df, sf = frames
    matches = matching.match_frames(df, sf)
    got = {(r.t, r.id): r.found for r in matches.collect() if r.found}
    want = brute_frames(truth, system)
    assert got == want and 20 < len(want) < len(truth)
    m = matching.identity_metrics(matches, sf).first()
    seen = {}
    for (t, p), i in sorted(want.items()):
        seen.setdefault(p, []).append(i)
    switches = sum(a != b for v in seen.values() for a, b in zip(v, v[1:]))
    people, ids = sorted({r[3] for r in truth}), sorted({r[3] for r in system})
    table = {(p, i): sum(x == i for x in seen.get(p, [])) for p in people for i in ids}
    named = max(sum(table[p, i] for p, i in zip(people, pick)) for pick in itertools.permutations(ids, len(people)))
    fragments = 0
    for p in people:
        flags = [(t, p) in want for t in sorted({r[2] for r in truth})]
        fragments += sum(b and not a for a, b in zip(flags, flags[1:]))
    often = [i for i in ids if sum(table[p, i] for p in people) >= 3]
    purity = sum(max(table[p, i] for p in people) / sum(table[p, i] for p in people) for i in often) / len(often)
    assert (m.people, m.ids, m.counted, m.excess, m.switches, m.fragments) == (4, len(ids), len(often), len(often) - 4, switches, fragments)
    for value, expected in ((m.idf1, 2 * named / (len(truth) + len(system))), (m.recall, len(want) / len(truth)), (m.precision, len(want) / len(system)), (m.purity, purity), (m.ids_per_person, sum(len(set(v)) for v in seen.values()) / len(seen))):
        assert math.isclose(value, expected)


def test_duplicates_need_an_overlap(spark):
    df = spark.createDataFrame([("s", 0.0, c, p, x, 0.0, sure, size) for c, p, x, sure, size in (("A", 1, 0.0, True, 1.0), ("B", 2, 0.1, False, 5.0), ("C", 3, 0.2, False, 4.0), ("B", 4, 0.25, True, 1.0))], "session string, t double, camera string, person_id long, x double, y double, confirmed boolean, size double")
    flags = lambda overlaps: {r.person_id: r.duplicate for r in matching.duplicate_points(df, 0.3, overlaps).collect()}
    assert flags(None) == {1: False, 2: True, 3: True, 4: False}
    assert flags([("A", "B")]) == {1: False, 2: True, 3: False, 4: False} and flags([]) == {1: False, 2: False, 3: False, 4: False}


def test_suggested_zones(spark):
    """Cells are one group over corners too; visits and peak are the greatest; what lies in commercial or system zones goes."""
    data = [("s", 1, 0, 0, 9.0, 1, 1), ("s", 1, 1, 0, 5.0, 3, 1), ("s", 1, 2, 1, 1.0, 1, 4), ("s", 1, 5, 5, 50.0, 0, 0), ("s", 1, 8, 8, 99.0, 1, 1), ("s", 1, 9, 9, 98.0, 1, 1), ("s", 1, 7, 1, 2.0, 0, 0)]
    cells = spark.createDataFrame(data, "session string, plan_id int, cx int, cy int, seconds double, visits long, peak long")
    box = lambda a, b, c, d: [{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d))]
    zones = [(1, "commercial", None, box(8, 8, 9, 9)), (1, "corridor", "system", [*box(9, 9, 10, 10)]), (1, "corridor", None, box(0, 0, 9, 9)), (2, "commercial", None, box(0, 0, 20, 20)), (1, "commercial", None, box(7, 0, 7.4, 2))]
    drawn = spark.createDataFrame(zones, "plan_id int, kind string, source string, vertices array<struct<x: double, y: double>>")
    got = [(r.x1, r.y1, r.x2, r.y2, r.cells, r.visits, r.peak, r.area, r.score) for r in plans.suggest_zones(cells, drawn, 1.0).orderBy(F.desc("score")).collect()]
    assert got == [(5.0, 5.0, 6.0, 6.0, 1, 0, 0, 1.0, 50.0), (0.0, 0.0, 3.0, 2.0, 3, 3, 4, 6.0, 15.0 + 12 + 8), (7.0, 1.0, 8.0, 2.0, 1, 0, 0, 1.0, 2.0)]


def test_polygon_without_tolerance_is_its_crossings_in_the_order_of_the_sql(spark):
    """A point on an edge but for rounding, one exactly on a corner, and a rectangle."""
    triangle = [(1.0, 1.0), (11.0, 2.0), (5.0, 7.5)]
    points = [(x, 1.0 + (x - 1.0) / 10.0) for x in np.arange(1.1, 11.0, 0.07)] + [(5.0 - 4.0 * k / 97, 7.5 - 6.5 * k / 97) for k in range(98)] + triangle

    def crossed(x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(triangle, triangle[1:] + triangle[:1])) % 2 == 1

    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = df.select("x", "y", G.contains(triangle, 0.0)("x", "y").alias("c")).collect()
    assert [r.c for r in got] == [crossed(r.x, r.y) for r in got]
    square = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (0.5, 0.5)], "x double, y double")
    assert [r.c for r in square.select(G.contains([(0, 0), (1, 0), (1, 1), (0, 1)], 0.0)("x", "y").alias("c")).collect()] == [True, False, True]


def test_events_are_dealt_out_before_they_are_unrolled(spark, monkeypatch):
    """Tasks are as many as events demand, whatever Spark makes of the bytes read, and no position is shuffled."""
    from crowdspark.plans import adapters, flow_queries

    monkeypatch.setattr(adapters, "EVENTS_A_TASK", 20, raising=False)
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    zoned = flow_queries.QUERIES["assign_zone"](spark, folder)
    assert zoned.rdd.getNumPartitions() >= events // 20 > 4
    assert zoned._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # the plan, and once more as it is run
    views = adapters.derive(spark, folder, "obs", "obs")
    union = spark.sql(f"WITH {adapters.TEXT['obs'].replace('{string}', 'STRING').replace('{unroll}', 'explode(sequence(0, n - 1))')} SELECT * FROM obs", events=spark.read.parquet(f"{folder}/events.parquet"))
    assert views.schema.names == union.schema.names and views.count() == union.count()
    assert views.exceptAll(union).isEmpty() and union.exceptAll(views).isEmpty()


def test_unrolled_positions_are_never_broadcast(spark):
    from crowdspark.plans import box_queries, plan_queries, tracking_queries

    for queries, names in ((tracking_queries, ("box_iou", "occluded_tracks")), (plan_queries, ("regroup_pairs", "match_frames", "reliable_views")), (box_queries, ("size_filter", "visible_fraction"))):
        for name in names:
            plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan, name


def test_polygons_in_a_column_as_fixed_ones(spark):
    pick = np.random.default_rng(3)
    for corners in ([(1, 1), (11, 2), (5, 7.5)], [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)], [(2, 2), (2, 2), (4, 4)]):
        points = [(float(x), float(y)) for x, y in pick.uniform(-1, 12, (200, 2))] + [(float(x), float(y)) for x, y in corners] + [(math.nan, 1.0), (math.inf, 1.0)]
        df = spark.createDataFrame(points, "x double, y double").withColumn("vertices", F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in corners)))
        got = df.select("x", "y", plans.holds_point(F.col("vertices"), F.col("x"), F.col("y")).alias("h")).collect()
        assert [r.h for r in got] == G.inside(np.array([r.x for r in got]), np.array([r.y for r in got]), corners).tolist()


def test_businesses_of_the_plan_or_of_none(spark):
    box = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    zones = spark.createDataFrame([(1, 10, "Alpha", box), (2, 20, " beta ", box), (3, 30, "gamma", box)], "plan_id int, zone int, name string, vertices array<struct<x: double, y: double>>")
    shops = spark.createDataFrame([(2, 1, "inside-2", "x", 1.0, 1.0), (None, 2, "anywhere", "y", 2.0, 2.0), (1, 3, "beta-of-1", "beta", 9.0, 9.0), (2, 4, "beta-of-2", "BETA", None, None), (3, 0, "out", "gamma", 9.0, 9.0)], "plan_id int, ordinal int, business_id string, name string, x double, y double")
    assert {r.zone: r.business_id for r in plans.link_business(zones, shops).collect()} == {10: "anywhere", 20: "inside-2", 30: "anywhere"}
    assert {r.zone: r.business_id for r in plans.link_business(zones, shops.where("ordinal > 2 OR ordinal = 0")).collect()} == {10: "zona:10", 20: "beta-of-2", 30: "out"}


def test_first_observation_is_the_state(spark):
    data = [("s", 1, 7, float(t), bool(i)) for t, i in zip((0, 0.2, 0.4, 0.6, 0.8, 1.0, 5.0, 5.2), (1, 0, 0, 1, 0, 0, 1, 1))]
    df = spark.createDataFrame(data, "session string, zone_id int, person_id long, t double, inside boolean")
    assert [(r.t, r.direction) for r in counters.zone_flow(df).orderBy("t").collect()] == [(0.4, "exit")]
    seen = df.withColumn("predicted", F.col("t").isin(0.4, 1.0))
    assert [(r.t, r.direction) for r in counters.zone_flow(seen).orderBy("t").collect()] == []


def test_orientation_by_speed(spark):
    steps = {1: (0.1, 0.0), 2: (0.5, 0.4), 3: (0.05, 0.0), 4: (0.1, -0.09)}
    data = [("s", "c", p, t, 100 + 10 * (dx if t else 0.0), 50 + 10 * (dy if t else 0.0), 10.0) for p, (dx, dy) in steps.items() for t in (0.0, 0.4)]
    df = spark.createDataFrame(data, "session string, camera string, person_id long, t double, u double, v double, h double")
    assert {r.person_id: r.orientation for r in matching.orientation(df).where("t = 0.4").collect()} == {1: "C", 2: "F", 3: "?", 4: "E"}


def test_predicted_people_add_no_heat(spark):
    df = spark.createDataFrame([("s", "c", float(t), p, 0.5, 0.5, p == 2) for t in (0, 1, 2) for p in (1, 2)], "session string, camera string, t double, person_id long, x double, y double, predicted boolean")
    assert [(r.seconds, r.peak, r.visits) for r in counters.heat_cells(df, 1.0).collect()] == [(2.0, 1, 1)]


def test_visible_share_counts_touched_cells(spark):
    boxes_ = [(1, 0.0, 0.0, 12.0, 24.0), (2, 3.5, 4.2, 6.1, 30.0), (3, 0.0, 20.0, 12.0, 23.0), (4, 0.5, 0.5, 12.5, 24.5), (5, 40.0, 0.0, 40.5, 0.5)]
    df = spark.createDataFrame([("s", "A", 0.0, *b) for b in boxes_], "session string, camera string, t double, person_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.person_id: r.visible for r in boxes.visible_fraction(df).collect()}
    cells = {(r, c) for r in range(4, 24) for c in range(3, 7)} | {(r, c) for r in range(20, 23) for c in range(12)}  # 3 is as low within 6 %, 4 is the same box
    assert math.isclose(got[1], 1 - len(cells) / 288) and got[5] == 1.0
    assert boxes.visible_fraction(df.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_index_against_all_people(spark, exact):
    pick = np.random.default_rng(9)
    centre = pick.normal(size=(9, 12))
    rows = [(i, (centre[i % 9] + pick.normal(scale=0.3, size=12)).tolist()) for i in range(400)] + [(1000, (3 * centre[0]).tolist()), (1001, centre[0].tolist()), (1002, [0.0] * 12)]
    people = spark.createDataFrame(rows, "person_id long, vector array<double>")
    queries = people.where("person_id % 20 = 0").withColumnRenamed("person_id", "query_id")
    got = {}
    for r in boxes.nearest_people(queries, people, 8, probes=2, exact=exact).collect():
        got.setdefault(r.query_id, {})[r.k] = r.person_id
    v = np.array([x for _, x in rows])
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    ids, hit, all_ = np.array([i for i, _ in rows]), 0, 0
    for q, own in got.items():
        s = np.round(v @ v[ids.tolist().index(q)], 12)
        want = ids[np.lexsort((ids, -s))][:8].tolist()
        mine = [own[k] for k in sorted(own)]
        hit, all_ = hit + len(set(want) & set(mine)), all_ + 8
        assert not exact or mine == want
    assert len(got) == queries.count() and hit >= 0.9 * all_
    assert boxes.nearest_people(queries, people.limit(0)).count() == 0 and boxes.nearest_people(queries.limit(0), people).count() == 0


def test_points_in_chains(spark):
    """A duplicate hides nothing: the third of a chain is drawn again."""
    df = spark.createDataFrame([("s", 0.0, c, p, x, 0.0, False, 9.0 - p) for p, (c, x) in enumerate((("A", 0.0), ("B", 0.2), ("A", 0.4), ("B", 0.6), ("A", 0.8), ("A", 5.0)))], "session string, t double, camera string, person_id long, x double, y double, confirmed boolean, size double")
    assert {r.person_id: r.duplicate for r in matching.duplicate_points(df, 0.25).collect()} == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}
    assert matching.duplicate_points(df.limit(0), 0.25).count() == 0


def test_crossings_by_place(spark):
    flows = spark.createDataFrame([("s", 1, 7, 2.0, "entry"), ("s", 1, 7, 9.0, "exit"), ("s", 1, 8, 4.0, "entry")], "session string, zone_id int, person_id long, t double, direction string")
    lines = spark.createDataFrame([("s", "A", 2, 7, 3.0, "exit")], "session string, camera string, line_id int, person_id long, t double, direction string")
    places = spark.createDataFrame([("s", "5", "zone"), ("s", "1", "zone")], "session string, place string, kind string")
    assert sorted(tuple(r) for r in reports.report_crossings(flows, lines, places).collect()) == [("s", "1", "zone", 2, 1, 9.0), ("s", "5", "zone", 0, 0, None), ("s", "A/2", "line", 0, 1, 3.0)]


def test_handoffs_with_positions(spark):
    base = "session string, camera string, uid long, start_s double, end_s double"
    tracks = spark.createDataFrame([("s", "A", 1, 0.0, 10.0), ("s", "B", 2, 5.0, 15.0), ("s", "B", 3, 5.0, 15.0), ("s", "C", 4, 2.0, 9.0)], base)
    at = spark.createDataFrame([("s", u, k, float(x), 0.0) for u, x in ((1, 0), (2, 1), (3, 9)) for k in range(5)], "session string, uid long, tick long, x double, y double")
    ways = spark.createDataFrame([], "from_camera string, to_camera string, t_min double, t_max double")
    got = {(r.a, r.b): r.pos for r in matching.handoff_candidates(tracks, ways, overlaps=[("B", "A")], positions=at).collect()}
    assert set(got) == {(1, 2)} and math.isclose(got[1, 2], 1 - 1 / 1.5)


def test_tiled_join(spark):
    """Two keys hold all rows: each pair comes once, and tasks go by pairs, none with more than a few tiles."""
    from crowdspark.operators.tiles import tiled_join

    rows = spark.range(600).select((F.col("id") % 2).alias("key"), "id")
    found = tiled_join(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), ["key"], "a", "b", tile=50, pairs=5000)
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 2 * 300 * 300 and found.distinct().count() == 2 * 300 * 300
    assert len(parts) > 20 and max(parts) < 25_000
    lone = rows.where("key = 1").withColumnRenamed("id", "b")
    assert tiled_join(rows.limit(0).withColumnRenamed("id", "a"), lone, ["key"], "a", "b").count() == 0


@pytest.mark.parametrize("kind", ["plain", "live", "together"])
def test_regroup_in_rounds_against_one_call(spark, kind):
    """Groups of large sessions (here: of more than 8 tracklets) are those of the whole session in one call, on vectors with many near pairs."""
    make = np.random.default_rng(5)
    centres = make.normal(size=(6, 8))
    rows = [(f"s{i % 2}", int(i), "AB"[i // 2 % 2], float(i * 3 % 50), float(i * 3 % 50 + 1 + i % 4), int(i % 9 // 2), int(1 + i % 7), (centres[i % 6] + make.normal(scale=0.45, size=8)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "session string, uid long, camera string, start_s double, end_s double, gid long, views int, prototype array<double>")
    df = df if kind == "live" else df.drop("gid")
    conflicts = identity.conflict_pairs(df)
    pairs = spark.createDataFrame([("s0", 2 * i, 2 * j, 12 + i, 0.3 + j / 99, "conflict" if (i + j) % 5 == 0 else "together") for i in range(12) for j in range(i + 1, 12, 3)], "session string, a long, b long, ticks long, median double, kind string") if kind == "together" else None
    got = {(r.session, r.uid): r.public_id for r in identity.regroup_people(df, conflicts, pairs=pairs, one_call=8).collect()}
    whole = {(r.session, r.uid): r.public_id for r in identity.regroup_people(df, conflicts, pairs=pairs).collect()}
    assert got == whole and len({(s, p) for (s, _), p in got.items()}) > 6


@pytest.mark.parametrize("kind", ["live", "together"])
def test_regroup_by_spans(spark, kind):
    """Conflicts told by cameras and times where groups meet are those of the pairs, in one call and in rounds of small blocks; no such pair is made."""
    make = np.random.default_rng(7)
    centres = make.normal(size=(5, 8))
    rows = [(f"s{i % 2}", int(i), None if i % 17 == 0 else "AB"[i // 2 % 2], float(i * 7 % 60), float(i * 7 % 60 + i % 5), int(i % 5 // 2), int(1 + i % 7), (centres[i % 5] + make.normal(scale=0.4, size=8) * (i % 6 > 0)).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "session string, uid long, camera string, start_s double, end_s double, gid long, views int, prototype array<double>")
    df = df if kind == "live" else df.drop("gid")
    pairs = spark.createDataFrame([("s0", 2 * i, 2 * j, 12 + i, 0.3 + j / 99, "conflict" if (i + j) % 5 == 0 else "together") for i in range(12) for j in range(i + 1, 12, 3)], "session string, a long, b long, ticks long, median double, kind string") if kind == "together" else None
    took = lambda *conflicts, **more: {(r.session, r.uid): r.public_id for r in identity.regroup_people(df, *conflicts, pairs=pairs, **more).collect()}
    want = took(identity.conflict_pairs(df))
    assert took() == want == took(one_call=8, block=7)
    assert 6 < len({(s, p) for (s, _), p in want.items()}) < 50


def test_regroup_holds_no_pairs():
    """A live id of many tracklets takes memory for each, not for pairs: 6,000 of them once took a matrix of 36 MB."""
    make = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"session": "s", "uid": np.arange(n), "camera": "A", "start_s": np.arange(n) % 97.0, "end_s": np.arange(n) % 97 + 5.0, "gid": 1, "views": 3, "prototype": list(make.normal(size=(n, 8)))})
    tracemalloc.start()
    found = identity.regroup_session(pdf, set(), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6 and 97 < found["group"].nunique() < n


def test_components(spark):
    pick = random.Random(4)
    edges = [(i * 7919 % 10_007, (i + 1) * 7919 % 10_007) for i in range(50)] + [(pick.randrange(20_000, 20_090), pick.randrange(20_000, 20_090)) for _ in range(40)]
    label = {r.node: r.label for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(label) == linked and all((label[a] == label[b]) == (up[a] == up[b]) for a in linked for b in linked)


def test_recognition(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], "A"), (2, [0.0, 1.0], "A"), (3, [1.0, 1.0], "A"), (4, [-1.0, 0.0], "A")], "query_id long, vector array<double>, camera string")
    people = spark.createDataFrame([(10, [1.0, 0.05], 9, ["B"], [[1.0, 0.0]], False), (11, [0.0, 1.0], 9, ["B"], [[0.0, 1.0]], True), (12, [1.0, 1.02], 2, ["B"], [[1.0, 1.0]], False)], "person_id long, vector array<double>, views int, cameras array<string>, bank array<array<double>>, busy boolean")
    got = {r.query_id: (r.person_id, r.doubt) for r in boxes.appearance_recognize(queries, people).collect()}
    # 1 is found; 2 is busy elsewhere; 3 has two as good; 4 is like nobody.
    assert got == {1: (10, False), 2: (None, True), 3: (None, True), 4: (None, False)}
    assert boxes.appearance_recognize(queries.limit(0), people).count() == 0


def test_business_report(spark):
    zones = spark.createDataFrame([("s", 1, 100.0, 10, 3, False), ("s", 2, 10.0, 20, 3, False), ("s", 3, 50.0, 1, 3, True)], "session string, zone_id int, seconds double, visits long, peak long, alert boolean")
    ranking = reports.business_report(zones)
    assert {r.zone_id: (r.rank, r.verdict) for r in ranking.collect()} == {1: (1, reports.VERDICTS["both"]), 2: (3, reports.VERDICTS["traffic"]), 3: (2, reports.VERDICTS["alert"])}
    cameras = spark.createDataFrame([("s", 1, 2), ("none", 2, 2)], "session string, active long, total long")
    got = sorted((r.session, r.kind, r.zones) for r in reports.business_recommendations(ranking, cameras).collect())
    assert got == [("none", "none", ""), ("s", "alert", "3"), ("s", "coverage", ""), ("s", "passing", "2"), ("s", "top", "1")]


def test_a_border_is_part_of_the_polygon(spark, tmp_path):
    """(3, 1.2) is on the lowest edge, where crossings alone say no."""
    from crowdspark.plans import tracking_queries

    events = [(0, "2024-01-01 00:00:00", 0, "view", 3.0, '{"k": 15}'), (1, "2024-01-01 00:00:01", 120, "view", 3.0, '{"k": 14}')]
    rows = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = tracking_queries.QUERIES["point_in_polygon"](spark, str(tmp_path)).groupBy("person_id").agg(F.min("inside").alias("a"), F.max("inside").alias("b")).collect()
    assert {r.person_id: (r.a, r.b) for r in got} == {0: (True, True), 120: (False, False)}


def test_overlaps_are_held_against_positions(spark):
    """Two cameras see a person at once in one place: the query's overlapping tracklets are near each other at every second they share."""
    from crowdspark.plans import plan_queries

    rows = plan_queries.QUERIES["handoff_candidates"](spark, "/root/testdata/sf0.001").where("kind = 'overlap'").collect()
    assert rows and all(r.pos is not None and 0 <= r.pos <= 1 for r in rows)
    place = lambda u, k, n: tuple(f + (t - f) * k / n for f, t in ((u % 13, u * 3 % 13), (u % 7, u * 5 % 7)))
    for r in rows:
        starts = [u % 97 for u in (r.a, r.b)]
        ends = [u % 97 + 1 + u % 11 for u in (r.a, r.b)]
        away = [math.dist(*(place(u, t - s, e - s) for u, s, e in zip((r.a, r.b), starts, ends))) for t in range(max(starts), min(ends) + 1)]
        assert max(away) <= 1.5 + 1e-9 and math.isclose(r.pos, 1 - sum(away) / len(away) / 1.5, abs_tol=1e-4)


def test_best_pairs_as_the_whole_assignment():
    """Of given pairs only, with equal weights or not: as much in total as over all pairs."""
    rng = np.random.default_rng(0)
    for trial in range(400):
        n, m = rng.integers(1, 9, 2)
        w = np.where(rng.random((n, m)) < rng.uniform(0.1, 1), rng.integers(1, 6, (n, m)) if trial % 2 else rng.random((n, m)), 0).astype(float)
        a, b = np.nonzero(w)
        k = matching.best_pairs(a, b, w[a, b])
        assert len(set(a[k])) == len(k) == len(set(b[k]))
        assert math.isclose(w[a[k], b[k]].sum(), sum(w[i, j] for i, j in matching.assignment(-w)), abs_tol=1e-9)
    even = matching.best_pairs(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.ones(4))
    assert sorted(even.tolist()) == [0, 3]
    assert len(matching.best_pairs(a[:0], b[:0], w[a, b][:0])) == 0


def test_matched_frames_move_boxes_once(spark):
    """The nearest instant of the system in another block, of two as near the earlier; nothing is joined."""
    from crowdspark.plans import plan_queries

    at = lambda x: (x, 0.0, x + 4.0, 10.0)
    truth = [("s", "c", t, f"p{k}", *at(3.0 * k)) for t in (59.95, 70.0, 80.0) for k in range(3)] + [(None, "c", 1.0, "p9", *at(0.0))]
    system = [("s", "c", t, f"{n}{k}", *at(3.0 * k + 0.5)) for t, n in ((60.02, "a"), (69.9, "b"), (70.1, "c"), (80.2, "d")) for k in range(2)]
    schema = "session string, camera string, t double, id string, x1 double, y1 double, x2 double, y2 double"
    found = matching.match_frames(spark.createDataFrame(truth, schema), spark.createDataFrame(system, schema))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # boxes were joined with the instants, and dealt out after that
    got = {(r.t, r.id): r.found for r in found.collect()}
    assert got == {**{(t, f"p{k}"): None for t in (59.95, 70.0, 80.0) for k in range(3)}, (1.0, "p9"): None, (59.95, "p0"): "a0", (59.95, "p1"): "a1", (70.0, "p0"): "b0", (70.0, "p1"): "b1"}
    truth, system = plan_queries._labelled(spark, "/root/testdata/sf0.001")
    whole = matching.match_frames(truth, system).collect()
    assert sorted(map(str, whole)) == sorted(map(str, plan_queries.QUERIES["match_frames"](spark, "/root/testdata/sf0.001").collect()))


def test_identity_metrics_put_matches_in_order_once(spark):
    from crowdspark.operators import matching as M

    rows = [("s", "c", float(t), i, f) for i, found in (("p", "a.ab.b"), ("q", "bb..a.")) for t, f in enumerate(x if x != "." else None for x in found)]
    matches = spark.createDataFrame(rows, "session string, camera string, t double, id string, found string")
    system = spark.createDataFrame([("s", "a")] * 4 + [("s", "b")] * 4, "session string, id string")
    read = []
    whole = M.stored
    try:
        M.stored = lambda df, name: read.append(df) or whole(df, name)
        m = M.identity_metrics(matches, system, 2).first()
    finally:
        M.stored = whole
    assert (m.people, m.ids, m.counted, m.switches, m.fragments) == (2, 2, 2, 2, 3) and math.isclose(m.idf1, 2 * 4 / 20) and math.isclose(m.recall, 7 / 12)
    assert len(read) == 1  # one pass over matches; all else reads the counts
