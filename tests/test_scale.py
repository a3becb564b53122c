"""That steps which grew faster than their input no longer do: what is joined, moved or written."""

import io
import math
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from crowdspark.operators import boxes, counters, identity, matching, near, plans, stays
from crowdspark.plans import adapters
from crowdspark.sources import recordings


def plan(df) -> str:
    with redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


def dealt(df):
    """Tracks dealt out by ranges of session and track, as the queries' positions are."""
    return df.repartitionByRange(4, "session", "track")


def test_link_business_joins_answers_not_pairs(spark, monkeypatch):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    zones = spark.range(300).select((F.col("id") % 3).alias("plan_id"), F.col("id").alias("zone"), F.lit("z").alias("name"), square.alias("vertices"))
    shops = spark.range(300).select(F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("plan_id"), F.col("id").alias("ordinal"), F.concat(F.lit("n"), "id").alias("business_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit("other").alias("name"))
    met, whole = [], plans.points_in_polygons
    monkeypatch.setattr(plans, "points_in_polygons", lambda *a: met.append(whole(*a)) or met[-1])
    found = {r.zone: r.business_id for r in plans.link_business(zones, shops).collect()}
    assert found == {z: "n0" for z in range(300)}
    assert sum(df.count() for df in met) <= 6  # pairs of plan, place and shape; it was a row for every business in every zone of its plan
    apart = {r.zone: r.business_id for r in plans.link_business(zones, shops.where("plan_id IS NOT NULL")).collect()}
    assert apart == {z: ("n3", "n1", "n2")[z % 3] for z in range(300)}


def test_manifests_many_to_a_file(spark, tmp_path):
    one, two = '{"session": "a",\n "config": {"password": "x", "radius": 2}}', '{"session": "b", "config": {}}'
    (tmp_path / "all.json").write_text(recordings.RECORD_END.join((one, "broken", two)) + recordings.RECORD_END)
    rows = recordings.read_manifests(spark, str(tmp_path), "all.json", recordings.RECORD_END)
    assert {r.session: r.c for r in rows.select("session", F.to_json("config").alias("c")).collect()} == {"a": '{"radius":2}', "b": "{}"}


def test_static_clutter_moves_no_positions(spark):
    rows = [("s", "c", float(t), k, 5.0, 5.0, 10.0, 0.3, False) for t in range(8) for k in (1, 2) if (t, k) != (4, 2)]
    tracks = dealt(spark.createDataFrame(rows, "session string, camera string, t double, track long, u double, v double, w double, score double, border boolean"))
    found = boxes.static_clutter(tracks)
    told = {(r.track, r.t): r.suppressed for r in found.collect()}
    assert [told[1, float(t)] for t in range(8)] == [t >= 2 for t in range(8)]
    assert [told[2, float(t)] for t in (3, 5, 6, 7)] == [True, False, False, True]  # it misses a sample and starts anew
    assert "hashpartitioning" not in plan(found)  # dealt by track once; a camera's session was put in order by one task


def test_band_of_a_line_is_tested_by_numbers(spark):
    at = lambda *ps: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ps))
    lines = spark.createDataFrame([("c", 1, 0.2, 0.5, 0.8, 0.5, 1)], "camera string, line_id int, ax double, ay double, bx double, by double, entry_side int")
    banded = lines.withColumns({"positive": at((0.2, 0.8), (0.8, 0.8)), "negative": at((0.2, 0.3), (0.8, 0.3))})
    steps = [(1, 0.4, 0.6), (2, 0.2, 0.6), (3, 0.4, 0.9), (4, 0.31, 0.79)]  # the second and third begin or end beyond the band
    pixels = spark.createDataFrame([("s", "c", p, float(k), 0.5, v) for p, *vs in steps for k, v in enumerate(vs)], "session string, camera string, person_id long, t double, u double, v double")
    found = counters.crossing_candidates(pixels, banded)
    assert sorted(r.person_id for r in found.collect()) == [1, 4]
    half = counters.crossing_candidates(pixels, banded.withColumn("negative", F.when(F.lit(False), F.col("negative"))))
    assert sorted(r.person_id for r in half.collect()) == [1, 2, 4]
    assert "[1].y" not in plan(found)  # no array is looked into for a point


def test_snap_trajectories_moves_no_positions(spark):
    floor = plans.Floor([(0.0, 0.0), (12.0, 0.0), (12.0, 8.0), (0.0, 8.0)], [[(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]])
    rows = [("s", 1, 1, "a", 3.0, 5.0), ("s", 1, 1, "b", 7.0, 5.0), ("s", 1, 2, "a", 4.1, 5.0), ("s", 2, 1, "a", 1.0, 1.0), ("s", 2, 1, "b", None, 1.0), (None, 2, 1, "a", 3.0, 5.0), (None, 2, 1, "b", 7.0, 5.0)]
    df = spark.createDataFrame(rows, "session string, person_id long, tick long, camera string, x double, y double").repartitionByRange(3, "session", "person_id")
    found = plans.snap_trajectories(df, floor)
    got = {(r.session, r.person_id, r.tick, r.camera): (None if r.x is None or r.x != r.x else round(r.x, 4), round(r.y, 4), r.moved) for r in found.collect()}
    assert found.columns == [*df.columns, "moved"] and len(got) == 7
    a, b = got["s", 1, 1, "a"], got["s", 1, 1, "b"]  # both are free, their mean is in the obstacle
    assert a == b and a[2] and (round(abs(a[0] - 5), 4), round(abs(a[1] - 5), 4)) in {(1.2, 0.0), (0.0, 1.2)}
    assert got["s", 1, 2, "a"] == (3.8, 5.0, True)
    assert got["s", 2, 1, "a"] == (1.0, 1.0, False) and got["s", 2, 1, "b"][0] is None
    assert got[None, 2, 1, "a"] == (3.0, 5.0, False) and got[None, 2, 1, "b"] == (7.0, 5.0, False)
    assert "hashpartitioning" not in plan(found)  # it was dealt out anew for the means, and again, with all rows, for their join


def test_people_of_an_instant_are_moved_once(spark):
    """Pairs, duplicates and crowds: no row is copied to the cells around before it is moved."""
    rng = np.random.default_rng(5)
    rows = [("s", "c" if k % 2 else "d", float(t), k, *map(float, rng.uniform(0, 3, 2)), bool(k % 3), float(k % 4)) for t in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "session string, camera string, t double, person_id long, x double, y double, confirmed boolean, size double")
    whole = df.withColumns({"x1": F.col("x") * 10, "y1": F.col("y") * 10, "x2": F.col("x") * 10 + 4, "y2": F.col("y") * 10 + 10})
    at = {(r[1], r[2], r[3]): r[4:6] for r in rows}
    apart = lambda a, b: math.dist(a, b)

    def iou(a, b):
        over = max(0.0, 4 - abs(a[0] - b[0]) * 10) * max(0.0, 10 - abs(a[1] - b[1]) * 10)
        return over / (80 - over)

    found = counters.collapsed_pairs(whole, 0.5, 0.3)
    want = {(c, t, p, q) for (c, t, p), a in at.items() for (d, u, q), b in at.items() if (c, t) == (d, u) and p < q and apart(a, b) < 0.5 and iou(a, b) <= 0.3}
    assert {(r.camera, r.t, r.person_id, r.person_id_b) for r in found.collect()} == want and want
    crowds = plans.crowd_clusters(df, 0.5, 4).collect()
    for t in range(3):
        here = [a for (_, u, _), a in at.items() if u == t]
        full = sorted(((-sum(apart(a, b) <= 0.5 for b in here), -a[0], -a[1]) for a in here))
        chosen = []
        for n, x, y in full:
            if n <= -4 and all(apart((-x, -y), c) >= 0.5 for c in chosen):
                chosen.append((-x, -y))
        assert {(r.x, r.y) for r in crowds if r.t == t} == set(chosen)
    twice = {(r.camera, r.t, r.person_id) for r in matching.duplicate_points(df, 0.4).where("duplicate").collect()}
    place = {(r[1], r[2], r[3]): (not r[6], -r[7], r[1], r[3]) for r in rows}
    drawn, gone = [], set()
    for me in sorted(at, key=lambda k: (k[1], place[k])):
        hit = place[me][0] and any(o[1] == me[1] and o[0] != me[0] and apart(at[o], at[me]) <= 0.4 for o in drawn)
        (gone.add if hit else drawn.append)(me)
    assert twice == gone and gone
    assert "Join" not in plan(found)  # people went out once for each of nine cells, and were joined


def test_close_in_pieces(monkeypatch):
    monkeypatch.setattr(near, "PIECE", 7)
    rng = np.random.default_rng(1)
    g, x, y = rng.integers(0, 3, 200), rng.uniform(-2, 2, 200), rng.uniform(-2, 2, 200)
    x[5], y[9] = np.nan, np.inf
    got = [tuple(sorted(p)) for a, b in near.close(g, x, y, 0.3) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(200) for j in range(i + 1, 200) if g[i] == g[j] and np.hypot(x[i] - x[j], y[i] - y[j]) < 0.3}


def test_heat_of_instants_stays_in_its_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", c, 0.2 * tick + (7 if tick > 40 else 0), p, *map(float, rng.uniform(0, 3, 2)), tick % 10 == 4) for tick in range(60) if tick % 7 for p in range(9) for c in "ab" if rng.random() < 0.4]
    obs = spark.createDataFrame(rows, "session string, camera string, t double, person_id long, x double, y double, predicted boolean")
    instants = obs.withColumn("block", F.floor(F.col("t") / 1.6)).repartitionByRange(3, "session", "block")
    kept, write = [], counters.stored
    monkeypatch.setattr(counters, "stored", lambda df, name: kept.append(df) or write(df, name))
    at = sorted({r[2] for r in rows})
    step = {b: min(b - a, 2.0) for a, b in zip(at, at[1:])} | {at[0]: 0.0}
    place = {}
    for _, c, t, p, x, y, guess in rows:
        if not guess:
            place[t, p] = max(place.get((t, p), ("",)), (c, x, y))
    want = {}
    for (t, p), (_, x, y) in place.items():
        want.setdefault((math.floor(x), math.floor(y)), []).append((t, p))
    for given in (instants, None):
        got = {(r.cx, r.cy): (round(r.seconds, 6), r.peak, r.visits) for r in counters.heat_cells(obs, 1.0, instants=given).collect()}
        assert got == {c: (round(sum(step[t] for t, _ in v), 6), max(sum(u == t for u, _ in v) for t, _ in v), len({p for _, p in v})) for c, v in want.items()}
    assert "hashpartitioning" not in plan(kept[0])  # counts by cell and instant were moved twice: as many as there are positions, where walks are long


def test_positions_by_instant_are_those_by_person(spark):
    sf = "/root/testdata/sf0.001"
    own, other = (adapters.derive(spark, sf, "obs", "obs", by) for by in ("person", "instant"))
    assert own.count() == other.count() and own.exceptAll(other.drop("block")).isEmpty()
    assert other.where(f"block <> tick div {adapters.BLOCK_TICKS}").isEmpty()
    steps = [line for line in plan(other).splitlines() if "Exchange" in line or "Generate" in line]
    assert "Exchange" not in "".join(steps[:2]) and "Exchange" in "".join(steps)  # events are moved, before they become positions


def test_occupancy_counts_stay_in_their_task(spark):
    rng = np.random.default_rng(4)
    rows = [("s", 0.2 * tick, p, *map(float, rng.uniform(0, 4, 2)), tick % 10 == 4) for tick in range(40) if tick % 7 for p in range(6) for _ in range(2) if rng.random() < 0.6]
    people = spark.createDataFrame(rows + [("s", None, 1, 1.0, 1.0, False)], "session string, t double, person_id long, x double, y double, predicted boolean")
    instants = people.withColumn("block", F.floor(F.col("t") / 1.6)).repartitionByRange(3, "session", "block")
    zones = [{"zone_id": 1, "vertices": [(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)]}, {"zone_id": 2, "vertices": [(1.0, 0.0), (3.0, 0.0), (3.0, 4.0), (1.0, 4.0)]}]
    found = counters.zone_occupancy(people, zones, {1: (3, 0.4)}, instants)
    got = {(r.zone_id, r.t): r for r in found.where("t IS NOT NULL").collect()}
    held = lambda z, at: {r[2] for r in rows if r[1] == at and not r[5] and z - 1 - 1e-6 <= r[3] <= z + 1 + 1e-6}
    at = sorted({r[1] for r in rows})
    for z in (1, 2):
        seconds, seen = 0.0, set()
        for before, t in zip([at[0], *at], at):
            seconds, seen = seconds + len(held(z, t)) * (t - before), seen | held(z, t)
            r = got[z, t]
            assert (r["count"], round(r.seconds, 6), r.visits) == (len(held(z, t)), round(seconds, 6), len(seen))
    assert found.exceptAll(counters.zone_occupancy(people, zones, {1: (3, 0.4)})).isEmpty()
    moved = [line for line in plan(found).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("block" in line for line in moved)  # counts by zone and instant were moved: as many as there are positions, where walks are long


def test_pairs_are_scored_in_tiles(spark):
    rng = np.random.default_rng(6)
    vectors = {g: [float(x) for x in rng.normal(size=5)] for g in range(30)}
    vectors[7] = vectors[3]
    vectors[9] = [0.0] * 5
    group = spark.createDataFrame([("s", g, v, 1 + g % 3, "c" if g % 2 else "d", "c" if g % 5 else "d") for g, v in vectors.items()], "session string, g long, sum array<double>, n long, lo string, hi string")
    told = [(a, b) for a in range(32) for b in range(30) if a != b and rng.random() < 0.5]  # two are unknown
    pairs = spark.createDataFrame([("s", a, b) for a, b in told + told[:40]], "session string, a long, b long")
    found = matching.scored_pairs(pairs, group, 0.1, 0.0, 0.5, 8)
    got = {(r.a, r.b): r.score for r in found.collect()}
    assert found.count() == len(got)
    want, cam = {}, lambda g: ("c" if g % 2 else "d", "c" if g % 5 else "d")
    for a, b in told:
        if a < 30 and 9 not in (a, b):
            dot = np.dot(vectors[a], vectors[b])
            cos = dot / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
            need = 0.5 if min(cam(a)[0], cam(b)[0]) == max(cam(a)[1], cam(b)[1]) else 0.1
            if cos >= need and dot / ((1 + a % 3) * (1 + b % 3)) >= need - 0.1:
                want[a, b] = cos
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(got[3, b] == got[7, b] for b in range(30) if (3, b) in got and (7, b) in got)


def boxes_in_blocks(spark, seed=7, people=40):
    """Boxes of several sizes in instants, as rows and as a frame whose tasks have one block of instants after the other."""
    rng = np.random.default_rng(seed)
    rows = [("s", t // 2, float(t), "c" if k % 5 else "d", k, *map(float, rng.uniform(10, 90, 2)), *map(float, rng.uniform(8, 50, 2))) for t in range(6) for k in range(people)]
    rows = [(s, b, t, c, k, x, y, x - w / 2, y - h / 2, x + w / 2, y + h / 2) for s, b, t, c, k, x, y, w, h in rows]
    df = spark.createDataFrame(rows, "session string, block int, t double, camera string, person_id long, x double, y double, x1 double, y1 double, x2 double, y2 double")
    return rows, df.repartitionByRange(3, "session", "block").sortWithinPartitions("session", "block")


def area_and_iou(a, b):
    over = max(0.0, min(a[9], b[9]) - max(a[7], b[7])) * max(0.0, min(a[10], b[10]) - max(a[8], b[8]))
    return over, over / ((a[9] - a[7]) * (a[10] - a[8]) + (b[9] - b[7]) * (b[10] - b[8]) - over)


def test_occluded_tracks_join_nothing(spark, monkeypatch):
    """Boxes meet those of the cells around; blocks that come dealt out are not moved, and many rows go to the work in parts."""
    rows, df = boxes_in_blocks(spark)
    want = {(a[2], a[4], b[4]) for a in rows for b in rows if (a[2], a[3]) == (b[2], b[3]) and a[4] < b[4] and area_and_iou(a, b)[1] > 0.2}
    monkeypatch.setattr(near, "ROWS", 50)
    for found, moved in ((identity.occluded_tracks(df.drop("block")), 1), (identity.occluded_tracks(df, dealt=["session", "block"]), 0)):
        assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") == moved  # each pair of an instant was joined
        got = [(r.t, r.person_id, r.person_id_b) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 50


def test_collapsed_pairs_of_the_query_move_events_only(spark):
    from crowdspark.plans import tracking_queries

    found = tracking_queries.QUERIES["collapsed_pairs"](spark, "/root/testdata/sf0.001")
    moved = plan(found)
    assert "hashpartitioning" not in moved[: moved.index("Generate explode(sequence(lo")]  # positions were dealt out by instant
    rows, df = boxes_in_blocks(spark)
    want = {(a[2], a[4], b[4]) for a in rows for b in rows if (a[2], a[3]) == (b[2], b[3]) and a[4] < b[4] and math.dist(a[5:7], b[5:7]) < 20 and area_and_iou(a, b)[1] <= 0.3}
    assert {(r.t, r.person_id, r.person_id_b) for r in counters.collapsed_pairs(df, 20.0, 0.3, ["session", "block"]).collect()} == want and want


def test_covered_views_of_blocks(spark, monkeypatch):
    """Reliable views and visible shares join nothing, and move nothing of blocks that come dealt out."""
    rows, df = boxes_in_blocks(spark)
    monkeypatch.setattr(near, "ROWS", 50)
    df = df.withColumn("confidence", F.lit(0.9))
    cover = lambda a, b: area_and_iou(a, b)[0] / ((a[9] - a[7]) * (a[10] - a[8]))
    near_by = {a[2:5]: [b for b in rows if a[2:4] == b[2:4] and a[4] != b[4]] for a in rows}
    fit = lambda r: r[10] - r[8] >= 40 and r[9] - r[7] >= 8 and min(r[7:9]) >= 4 and max(r[9:11]) <= 96
    want = {r[2:5] for r in rows if fit(r) and not any(cover(r, b) > 0.2 or area_and_iou(r, b)[1] > 0.2 for b in near_by[r[2:5]])}
    found = matching.reliable_views(df, 100, 100, ["session", "block"])
    assert "hashpartitioning" not in plan(found) and "Join" not in plan(found)
    assert {(r.t, r.camera, r.person_id) for r in found.collect()} == want and want

    def visible(a):
        seen = np.ones((24, 12), bool)
        high, wide = max(a[10] - a[8], 1.0), max(a[9] - a[7], 1.0)
        for b in near_by[a[2:5]]:
            if area_and_iou(a, b)[0] > 0 and b[10] >= a[10] - 0.06 * high and any(abs(a[k] - b[k]) > 1 + 1e-5 * abs(b[k]) for k in range(7, 11)):
                r = [f((g(a[k], b[k]) - a[8]) / high * 24) for f, g, k in ((math.floor, max, 8), (math.ceil, min, 10))]
                c = [f((g(a[k], b[k]) - a[7]) / wide * 12) for f, g, k in ((math.floor, max, 7), (math.ceil, min, 9))]
                seen[r[0] : r[1], c[0] : c[1]] = False
        return seen.sum() / 288

    found = boxes.visible_fraction(df, dealt=["session", "block"])
    assert "hashpartitioning" not in plan(found) and "Join" not in plan(found)
    got = {(r.t, r.camera, r.person_id): r.visible for r in found.collect()}
    assert len(got) == len(rows) and all(math.isclose(got[r[2:5]], visible(r), abs_tol=1e-12) for r in rows)


def test_duplicates_are_settled_in_the_task(spark, monkeypatch):
    """No table of neighbours is written and no round is a join; rows that miss something stay."""
    written = []
    monkeypatch.setattr(matching, "stored", lambda *a: written.append(a))
    chain = [("s", 0, 0.0, "AB"[k % 2], k, 0.2 * k, False, 9.0 - k) for k in range(7)]
    odd = [("s", 0, 0.0, None, 7, 0.0, False, 1.0), (None, 0, 0.0, "A", 8, 0.0, False, 1.0), ("s", 0, 0.0, "B", 9, None, False, 1.0), ("s", 1, 9.0, "A", 0, 0.0, True, 1.0), ("s", 1, 9.0, "B", 1, 0.1, False, 5.0)]
    df = spark.createDataFrame(chain + odd, "session string, block int, t double, camera string, person_id long, x double, confirmed boolean, size double").withColumn("y", F.lit(0.0))
    for found in (matching.duplicate_points(df, 0.25), matching.duplicate_points(df.repartition(2, "session", "block").sortWithinPartitions("session", "block"), 0.25, dealt=["session", "block"])):
        got = {(r.t, r.person_id): r.duplicate for r in found.collect()}
        assert got == {**{(0.0, k): k in (1, 3, 5) for k in range(10)}, (9.0, 0): False, (9.0, 1): True}
    assert not written


def test_regroup_pairs_in_tiles(spark):
    """Two blocks of tracklets are a tile; several rows of a tracklet and tick all count, and no pair of an instant is moved."""
    rng = np.random.default_rng(2)
    rows = [("s", "ABC"[k % 3], k, t, *map(float, rng.uniform(0, 6, 2))) for k in range(30) for t in range(k % 7, k % 7 + 12)] + [("s", "B", 0, 5, 1.0, 1.0), ("s", "C", 1, 6, None, 1.0), (None, "C", 1, 6, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "session string, camera string, uid long, tick long, x double, y double")
    found = matching.regroup_pairs(df, 3.0, block=8)
    assert "percentile" not in plan(found)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] and b[0] and a[2] < b[2] and a[3] == b[3] and a[1] != b[1]:
                want.setdefault((a[2], b[2]), []).append(None if None in (a[4], b[4]) else math.dist(a[4:], b[4:]))
    got = {(r.a, r.b): r for r in found.collect()}
    assert set(got) == {k for k, d in want.items() if len(d) >= 5} and len(got) > 100
    for k, r in got.items():
        d = [x for x in want[k] if x is not None]
        assert r.ticks == len(want[k]) and math.isclose(r.median, float(np.median(d)), abs_tol=1e-12) and math.isclose(r.near, np.mean(np.array(d) < 0.67 * 3), abs_tol=1e-12)
        assert r.kind == ("conflict" if r.median > 1.33 * 3 else "together" if r.ticks >= 10 and r.median <= 0.47 * 3 and r.near >= 0.9 else "unclear")


def test_runs_of_many_people_are_merged_at_once(spark):
    """No call a person, and merged stays read their positions once."""
    rng = np.random.default_rng(4)
    zones = [{"zone_id": 1, "type": "INTERIOR"}, {"zone_id": 2, "type": "ZONA"}]
    pos = []
    for who in range(12):
        zone = 1
        for t in range(60):
            zone = int(rng.integers(-1, 3)) if rng.random() < 0.25 else zone
            pos.append(("s", who, 0.2 * t, zone, float(rng.uniform()), None if t % 7 == 0 else float(rng.uniform())))
    df = spark.createDataFrame(pos, "session string, person_id long, t double, zone_id int, confidence double, speed double").repartition(3, "session", "person_id")
    runs = stays.zone_runs(df)
    merged = stays.merge_stays(runs, zones)
    assert "FlatMapGroups" not in plan(merged)
    table = stays.run_table(runs).toPandas().sort_values(["person_id", "run"])
    want = {(who, run, k, zone) for who, one in table.groupby("person_id") for k, (zone, _, _, held) in enumerate(stays.merge_runs(one, 0.2, 1.0, {1}), 1) for run in held}
    assert {(r.person_id, r.run, r.stay, r.zone_id) for r in merged.collect()} == want
    once = stays.merged_stays(runs, zones)
    assert "Join" not in plan(once) and plan(once).count("Scan ") == 1  # positions were made twice and joined
    number = lambda rows: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in (r.person_id, r.stay, r.zone_id, r.start_s, r.end_s, r.confidence, r.median_speed)) for r in rows)
    assert number(once.collect()) == number(stays.stays(runs, merged).collect())
