"""Small inputs with known answers."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdspark.functions import geometry as G
from crowdspark.operators import annotations, commerce, counters, density, identity, metrics, plans, stays, trajectories
from crowdspark.sources import recordings, sales

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_polygons(spark):
    x, y = pd.Series([2, 5, 4, 0, 4.0000001]), pd.Series([2.0, 2, 2, 0, 5])
    assert G.inside(x.to_numpy(), y.to_numpy(float), SQUARE).tolist() == [True, False, True, True, False]
    want = {(-1, -1), (5, -1), (5, 3), (-1, 3)}
    box = [(0, 0), (4, 0), (4, 2), (0, 2)]
    for polygon in (box, box[::-1]):
        assert {(round(a, 6), round(b, 6)) for a, b in G.expand(polygon, 1)} == want
    assert G.area(SQUARE) == 16


def test_assign_zone(spark):
    rect = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    zones = [{"zone_id": 1, "type": "ZONA", "vertices": rect(0, 0, 10, 10)}, {"zone_id": 2, "type": "FRONTAGE", "vertices": rect(0, 0, 4, 2)}, {"zone_id": 3, "type": "INTERIOR", "vertices": rect(1, 1, 3, 5)}]
    df = spark.createDataFrame([(2.0, 1.5), (3.5, 0.5), (8.0, 8.0), (math.nan, 1.0), (20.0, 1.0)], "x double, y double")
    assert [r.zone_id for r in stays.assign_zone(df, zones).collect()] == [3, 2, 1, -1, -1]


def test_consolidation(spark):
    data = [("s", 1, t, x, 0.0, c) for t, x, c in zip((0, 0.05, 0.2, 0.4, 0.6), (0.0, 1.0, 0.1, 30.0, 0.3), (0.9, 0.3, 0.9, 0.9, 0.9))]
    df = spark.createDataFrame([(a, b, float(t), x, y, c) for a, b, t, x, y, c in data], "session string, person_id long, t double, x double, y double, confidence double")
    pos = trajectories.speed(trajectories.drop_jumps(trajectories.consolidate(df, 0.2, bin_epsilon=1e-9)))
    got = pos.orderBy("t").collect()
    assert len(got) == 3 and math.isclose(got[0].x, 0.25) and all(r.x < 30 for r in got)
    assert trajectories.speed(trajectories.consolidate(df.limit(1))).first().speed is None


def test_unique_people(spark):
    data = [("s", 1.0, "P1", True, False), ("s", 1.0, "P2", True, False), ("s", 1.0, "T3", None, False), ("s", 1.0, "P1", True, False), ("s", 1.0, "P4", True, True), ("s", 2.0, None, None, False), ("s", 2.0, None, None, False)]
    df = spark.createDataFrame(data, "session string, t double, person_id string, confirmed boolean, duplicate boolean").withColumn("predicted", F.lit(False))
    assert sorted(rows(trajectories.unique_confirmed_people(df), "t", "count")) == [(1.0, 2), (2.0, 2)]


def runs_of(*runs):
    at, out = 0, []
    for k, (zone, n) in enumerate(runs, 1):
        out.append((zone, at * 0.2, (at + n - 1) * 0.2, k))
        at += n
    return pd.DataFrame(out, columns=["zone_id", "first_t", "last_t", "run"])


def test_merge_stays():
    merge = lambda runs, interior: [s[0] for s in stays.merge_runs(runs, 0.2, 1.0, interior)]
    assert merge(runs_of((3, 20), (-1, 3), (3, 20)), {3}) == [3]
    data = runs_of((2, 15), (3, 3), (1, 15), (2, 10), (3, 2), (2, 10))
    assert merge(data, {3}) == [2, 1, 2]
    assert merge(data, set()) == [2, 3, 1, 2]


def test_events(spark):
    plan = [(1, "INTERIOR", "a"), (2, "FRONTAGE", "a"), (3, "ZONA", None), (4, "COLA", None)]
    zones = spark.createDataFrame(plan, "zone_id int, type string, local_id string")
    times = [(2, 0, 3), (1, 3, 4), (3, 4, 10), (1, 10, 22), (3, 22, 24), (1, 24, 26)]
    data = [("s", 1, k, z, float(a), float(b), 1.0, 0.5) for k, (z, a, b) in enumerate(times, 1)]
    schema = "session string, person_id long, stay long, zone_id int, start_s double, end_s double, confidence double, median_speed double"
    got = stays.spatial_events(spark.createDataFrame(data, schema), zones).collect()
    kinds = [r.event_type for r in got]
    assert sorted(kinds) == sorted(["EXPOSURE", "ENTER", "EXIT", "ENTER", "DWELL", "EXIT", "ENTER"])
    slow = spark.createDataFrame([("s", 1, 1, 4, 0.0, 12.0, 1.0, 0.1), ("s", 2, 1, 4, 0.0, 12.0, 1.0, 1.5)], schema)
    assert [(r.person_id, r.event_type) for r in stays.spatial_events(slow, zones).collect()] == [(1, "QUEUE")]


def test_capture(spark):
    data = [("s", "n", "a", "EXPOSURE", 1.0), ("s", "n", "a", "ENTER", 2.0), ("s", "n", "b", "EXPOSURE", 1.0), ("s", "n", "c", "ENTER", 0.5), ("s", "m", "c", "ENTER", 0.5)]
    got = metrics.capture_rate(spark.createDataFrame(data, "session string, local_id string, person_id string, event_type string, start_s double"))
    assert sorted(rows(got, "local_id", "exposed", "visits", "captured", "rate")) == [("m", 0, 1, 0, None), ("n", 2, 2, 1, 50.0)]


def test_routes(spark):
    df = spark.createDataFrame([("s", i, z) for i, z in enumerate([[1, 2, 3], [1, 3], [1, 2, 3], [2, 3]])], "session string, person_id long, zones array<int>")
    got = {r.pattern: r.support for r in density.frequent_routes(df).collect()}
    assert got == {"1>2": 2, "1>3": 3, "2>3": 3, "1>2>3": 2}
    df = spark.createDataFrame([("s", i, z) for i, z in enumerate([[1, 2, 1, 2], [1, 2], [2, 3]])], "session string, person_id long, zones array<int>")
    assert sorted(rows(density.origin_destination(df), "from_zone", "to_zone", "people")) == [(1, 2, 2), (2, 1, 1), (2, 3, 1)]


def test_kde(spark):
    df = spark.createDataFrame([("s", 5.1, 5.1, 3.0)], "session string, x double, y double, weight double")
    got = density.kde(df, 10.0, 10.0, 0.25, 1.0).collect()
    assert math.isclose(sum(r.value for r in got) * 0.25**2, 3.0, rel_tol=1e-3)
    top = max(got, key=lambda r: r.value)
    assert (top.row, top.col) == (20, 20)


def test_nice_step(spark):
    df = spark.createDataFrame([(126.0,), (3600.0,), (28800.0,)], "d double")
    assert [r.s for r in df.select(metrics.nice_step(F.col("d")).alias("s")).collect()] == [10, 300, 1800]


def test_line_crossings(spark):
    lines = spark.createDataFrame([("A", 1, 0.2, 0.5, 0.8, 0.5, 1)], "camera string, line_id int, ax double, ay double, bx double, by double, entry_side int")
    seen = [(0.5, 0.4, 0.0), (0.5, 0.504, 0.2), (0.5, 0.6, 0.4), (0.5, 0.4, 1.6), (0.9, 0.4, 3.0), (0.9, 0.6, 3.2), (0.5, 0.4, 7.0)]
    pixels = spark.createDataFrame([("s", "A", "p", t, u, v) for u, v, t in seen], "session string, camera string, person_id string, t double, u double, v double")
    assert sorted(rows(counters.line_crossings(pixels, lines), "t", "direction")) == [(0.4, "entry"), (1.6, "exit")]


def test_cooldown(spark):
    df = spark.createDataFrame([("k", float(t)) for t in (0, 60, 119, 120, 200, 241)], "key string, t double")
    assert sorted(rows(counters.alert_cooldown(df), "t", "send")) == [(0.0, True), (60.0, False), (119.0, False), (120.0, True), (200.0, False), (241.0, True)]


def test_crowd_episodes(spark):
    counts = [3, 3, 3, 1, 4, 4, 4]
    df = spark.createDataFrame([("s", "A", float(t), n) for t, n in zip((0, 1, 2, 3, 4, 5, 6), counts)], "session string, camera string, t double, n int")
    got = counters.crowd_episodes(df, 3, 2.0, 1.0).orderBy("start").collect()
    assert [(r.start, r.confirmed, r.end, r.peak, r.reason) for r in got] == [(0.0, 2.0, 3.0, 3, "umbral despejado"), (4.0, 6.0, 6.0, 4, "fin")]


def test_flow_field(spark):
    df = spark.createDataFrame([("s", "A", 0.0, 1.0, 1.0), ("s", "A", 0.2, 1.2, 1.0), ("s", "B", 0.0, 1.8, 1.0), ("s", "B", 0.2, 1.6, 1.0), ("s", "B", 5.2, 1.0, 1.0)], "session string, person_id string, t double, x double, y double")
    assert sorted(r.direction for r in density.flow_field(df, 2.0).collect()) == [0, 4]


def test_forecast(spark):
    import datetime

    days = [datetime.date(2026, 8, 2) + datetime.timedelta(7 * k) for k in range(5)]
    traffic = spark.createDataFrame([("s1", "n", d, 10, 10, 3600.0, "real") for d in days[:4]], "session string, business_id string, date date, hour int, entries int, coverage double, dataset string")
    sold = spark.createDataFrame([("n", d, 10, 200.0, 5, "real") for d in days[:4]], "business_id string, date date, hour int, amount double, transactions int, dataset string")
    ask = spark.createDataFrame([("real", "n", days[4], 10, 5), ("demo", "n", days[4], 10, 5)], "dataset string, business_id string, date date, hour int, entries int")
    got = {r.dataset: (r.estimate, r.days) for r in commerce.forecast(ask, traffic, sold).collect()}
    assert got == {"real": (100.0, 4), "demo": (None, 0)}
    assert commerce.forecast(ask, traffic.withColumn("coverage", F.lit(10.0)), sold).where("estimate IS NOT NULL").count() == 0


def test_spearman(spark):
    df = spark.createDataFrame([("k", i, i, 2 * i) for i in range(8)] + [("c", i, 1, i) for i in range(8)], "k string, o int, a int, b int")
    assert dict(rows(commerce.spearman_ordinal(df, ["k"], "a", "b", ["o"]), "k", "rho")) == {"k": 1.0, "c": None}


def test_sales_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿business_id;date;hour;amount;currency;transactions\nn;2026-09-20;10;25,50;PEN;2\n\nn;2026-09-20;;1;PEN;\nn;2026-09-20;10;5;PEN;\nx;2026-09-20;11;5;PEN;\nn;2026-09-20;12;NaN;PEN;\n")
    lines = sales.read_sales_csv(spark, str(tmp_path))
    shops = spark.createDataFrame([("n",)], "business_id string")
    good, bad = sales.parse_sales(lines, shops)
    assert rows(good, "business_id", "hour", "amount", "transactions") == [("n", 10, 25.5, 2)]
    assert sorted(r.message for r in bad.collect()) == ["amount", "business", "duplicate", "hour"]
    none = good.limit(0).withColumn("dataset", F.lit("real"))
    assert sales.import_sales(good, bad, none, "real")[0].count() == 0
    fits, report = sales.import_sales(good, bad.limit(0), none, "real")
    assert fits.count() == 1 and report.first().imported == 1
    again, report = sales.import_sales(good, bad.limit(0), fits, "real")
    assert again.count() == 0 and report.first().taken == 1
    assert sales.import_sales(good, bad.limit(0), fits, "demo")[0].count() == 1


def test_recordings(spark, tmp_path):
    folder = tmp_path / "s1"
    folder.mkdir()
    person = '{"id": "P1", "local": 1, "point": [1, 2], "confirmed": true}, {"id": "T9", "point": [1, 2], "confirmed": false}, {"id": "P2", "point": null}'
    line = lambda t: '{"t": %s, "cameras": [{"id": "A", "t": %s, "people": [%s]}]}' % (t, t, person)
    (folder / "samples.jsonl").write_text("\n".join([line(1), line(3), '{"t": 4, "cam', line(5)]) + "\n")
    assert sorted(rows(recordings.read_recordings(spark, str(tmp_path)), "t", "person_id", "x")) == [(1.0, "P1", 1.0), (3.0, "P1", 1.0)]
    assert recordings.read_recordings(spark, str(tmp_path), "skip_bad").count() == 3
    sessions = spark.createDataFrame([("s1", "running", None)], "session string, status string, end_s double")
    assert rows(recordings.recover_interrupted(sessions, recordings.read_samples(spark, str(tmp_path))), "status", "end_s") == [("error", 3.0)]
    assert recordings.last_sample(recordings.read_samples(spark, str(tmp_path))).first().t == 5.0


def test_regroup(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    schema = "session string, uid long, camera string, start_s double, end_s double, prototype array<double>"
    six = spark.createDataFrame([("s", i, "A", 0.0, 5.0, a) for i in range(6)] + [("s", 9, "B", 1.0, 2.0, a)], schema)
    got = identity.regroup_people(six, identity.conflict_pairs(six)).collect()
    assert len({r.public_id for r in got}) == 6
    two = spark.createDataFrame([("s", 1, "A", 0.0, 8.0, a), ("s", 2, "A", 10.0, 20.0, a), ("s", 3, "A", 30.0, 31.0, b)], schema)
    assert {r.uid: r.public_id for r in identity.regroup_people(two, identity.conflict_pairs(two)).collect()} == {1: 1, 2: 1, 3: 2}


def test_clock_offset(spark):
    pairs = [("A", "B", float(t), t + 0.8) for t in range(5)] + [("A", "C", float(t), t - 0.4) for t in range(5)] + [("A", "D", float(t), float(t + t % 3)) for t in range(5)]
    got = {r.target: r for r in identity.clock_offset(spark.createDataFrame(pairs, "base string, target string, ta double, tb double")).collect()}
    assert math.isclose(got["B"].sync_target, 0.8) and math.isclose(got["C"].sync_base, 0.4) and not got["D"].reliable


def test_audit_edges(spark):
    images = spark.createDataFrame([("train", "i", 100, 100, True, True, True), ("train", "q", 100, 100, True, True, True)], "split string, image string, width int, height int, readable boolean, has_annotation boolean, format_ok boolean")
    points = spark.createDataFrame([("train", i, float(x), 5.0) for i in "iq" for x in (-1, 0, 99.5, 100, 105, 105.1, 151)], "split string, image string, x double, y double")
    quarantine = spark.createDataFrame([("train", "q", "r")], "split string, image string, reason string")
    assert dict(rows(annotations.severity_counts(points.where("image = 'i'"), images), "severity", "points")) == {"minor": 2, "moderate": 1, "severe": 1}
    assert annotations.clean_annotations(images, points, quarantine).count() == 2
    assert sorted(rows(annotations.cleaning_manifest(images, points, quarantine), "image", "status", "before", "after")) == [("i", "cleaned", 7, 2), ("q", "quarantined", None, None)]


@pytest.mark.parametrize("times,keep", [([0, 0.5, 1.0, 1.9, 2.1], [True, False, True, False, True])])
def test_spaced(times, keep):
    assert counters.spaced(times, 1.0) == keep


def test_visit_matching_long(spark):
    """A business's visits in many batches and parts: as matched one by one, and no call takes them all."""
    v = lambda i: [math.cos(i), math.sin(i)]
    visits = [("s", b, 50.0 * i + (9000.0 if i >= 150 else 0.0), "entry", v(i * 0.9), i % 2 == 0) for b in "xy" for i in range(300)]
    visits += [(s, b, t + 601.0, "exit", vector, True) for s, b, t, _, vector, _ in visits if t % 100 == 0]
    want = set()
    for b in "xy":
        held = []
        for s, _, t, kind, vector, bag in sorted((r for r in visits if r[1] == b), key=lambda r: (r[2], r[3])):
            if kind == "entry":
                held.append((t, vector, bag))
                continue
            near = sorted(((vector[0] * e[1][0] + vector[1] * e[1][1], i) for i, e in enumerate(held) if 2 <= t - e[0] <= 900), reverse=True)
            ok = bool(near) and near[0][0] >= 0.94 and (len(near) < 2 or near[0][0] - near[1][0] >= 0.01)
            entry = held.pop(near[0][1]) if ok else None
            want.add((b, t, ok, bool(ok and not entry[2])))
    df = spark.createDataFrame(visits, "session string, business_id string, t double, kind string, vector array<double>, bag boolean").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = plans.visit_matching(df, 900.0, 0.94, 0.01)
        got = set(rows(found, "business_id", "t", "matched", "changed"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and {True, False} == {w[2] for w in want}
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_regroup_evidence(spark):
    """Positions join and part people whatever they look like, rivals join nobody, live ids join alike ones, and brief groups have no number."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    far = [("s", 1, "A", 10, 0.0, 9.0, 9, a), ("s", 2, "B", 11, 0.0, 9.0, 9, b), ("s", 3, "A", 12, 20.0, 29.0, 9, [0.0, 0.0, 1.0]), ("s", 4, "B", 13, 20.0, 29.0, 9, [0.0, 0.0, 1.0])]
    live = [("l", 1, "A", 7, 0.0, 9.0, 9, a), ("l", 2, "A", 7, 20.0, 29.0, 9, [0.6, 0.8, 0.0]), ("l", 3, "A", 8, 40.0, 41.0, 9, b), ("l", 4, "A", 9, 50.0, 59.0, 1, [0.0, 0.0, 1.0])]
    rival = [("r", 1, "A", 1, 0.0, 9.0, 9, a), ("r", 2, "B", 2, 0.0, 9.0, 9, b), ("r", 3, "B", 3, 10.0, 19.0, 9, [0.0, 0.0, 1.0])]
    tracks = spark.createDataFrame(far + live + rival, "session string, uid long, camera string, gid long, start_s double, end_s double, views int, prototype array<double>")
    pairs = spark.createDataFrame([("s", 1, 2, 20, 0.1, "together"), ("s", 3, 4, 20, 9.0, "conflict"), ("r", 1, 2, 20, 0.5, "together"), ("r", 1, 3, 8, 0.6, "unclear")], "session string, a long, b long, ticks long, median double, kind string")
    got = {(r.session, r.uid): r.public_id for r in identity.regroup_people(tracks, identity.conflict_pairs(tracks), 0.9, pairs).collect()}
    assert {k[1]: n for k, n in got.items() if k[0] == "s"} == {1: 1, 2: 1, 3: 2, 4: 3}
    assert {k[1]: n for k, n in got.items() if k[0] == "l"} == {1: 1, 2: 1, 3: None, 4: None}
    assert {k[1]: n for k, n in got.items() if k[0] == "r"} == {1: 1, 2: 2, 3: 3}
