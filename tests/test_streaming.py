"""Streams over split files give what the batch forms give."""

import random

from pyspark.sql import functions as F

from crowdspark.operators import boxes, commerce, counters, plans, trajectories
from crowdspark.streaming import counters as S
from crowdspark.streaming import live as L
from crowdspark.streaming import states as T


def split_files(df, path, order, n=4):
    """Files of ascending time, whole instants each, rows within each shuffled."""
    rows = df.orderBy(order).collect()
    pick = random.Random(1)
    times = sorted({r[order] for r in rows})
    for k in range(n):
        own = set(times[len(times) * k // n : len(times) * (k + 1) // n])
        part = [r for r in rows if r[order] in own]
        pick.shuffle(part)
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))


def test_cooldown(spark, tmp_path):
    df = timed(spark.range(300).select((F.col("id") % 5).cast("string").alias("key"), (F.col("id") * 7.0).alias("t")))
    got = drain(S.stream_alert_cooldown(split_files(df, tmp_path / "a", "t")), "cooldown")
    want = counters.alert_cooldown(df.select("key", "t")).where("send").collect()
    assert sorted((r.key, r.t) for r in got) == sorted((r.key, r.t) for r in want)


def test_line_crossings(spark, tmp_path):
    pick = random.Random(5)
    data = [("s", "A", p, k * 0.2, 0.5 + pick.uniform(-0.2, 0.2), 0.5 + pick.uniform(-0.2, 0.2)) for p in range(4) for k in range(60)]
    df = timed(spark.createDataFrame(data, "session string, camera string, person_id long, t double, u double, v double"))
    lines = spark.createDataFrame([("A", 1, 0.2, 0.5, 0.8, 0.5, 1), ("A", 2, 0.5, 0.45, 0.5, 0.9, -1)], "camera string, line_id int, ax double, ay double, bx double, by double, entry_side int")
    got = drain(S.stream_line_crossings(split_files(df, tmp_path / "a", "t"), lines), "crossings")
    want = counters.line_crossings(df.drop("ts"), lines).collect()
    key = lambda r: (r.line_id, r.person_id, round(r.t, 6), r.direction)
    assert len(want) > 10 and sorted(map(key, got)) == sorted(map(key, want))


def test_traffic_minutes(spark, tmp_path):
    df = timed(spark.range(2000).select((F.col("id") % 3).alias("zone"), (F.col("id") * 2.0).alias("t"), (F.col("id") * 7 % 11).alias("n")))
    got = drain(S.stream_traffic_minutes(split_files(df, tmp_path / "a", "t"), "1 minute"), "minutes")
    want = {(r.zone, r.minute): r.mean for r in df.groupBy("zone", F.date_trunc("MINUTE", "ts").alias("minute")).agg(F.bround(F.avg("n")).cast("long").alias("mean")).collect()}
    assert len(got) >= len(want) - 9 and all(want[r.zone, r.minute] == r.mean for r in got)
    assert commerce.traffic_history(df).agg(F.sum("samples")).first()[0] == len(want)


def test_alert_log(spark, tmp_path):
    df = timed(spark.range(200).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").cast("double").alias("t"), (F.col("id") * 13 % 31).cast("double").alias("peak"), F.col("id").cast("double").alias("duration")))
    stream = split_files(df, tmp_path / "a", "t")
    query = stream.writeStream.foreachBatch(S.upsert_alert_log(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in S.read_alert_log(spark, str(tmp_path / "log")).select("key", "start", "peak", "duration").collect()}
    assert got == {tuple(r) for r in counters.alert_log(df).select("key", "start", "peak", "duration").collect()}


def walks(spark, people=6, ticks=80):
    pick = random.Random(7)
    at = {p: [pick.uniform(0, 6), pick.uniform(0, 6)] for p in range(people)}
    data = []
    for k in range(ticks):
        for p, xy in at.items():
            xy[0], xy[1] = (min(6.0, max(0.0, v + pick.uniform(-0.5, 0.5))) for v in xy)
            if pick.random() < 0.9:
                data.append(("s", "AB"[p % 2], p, k * 0.5, xy[0], xy[1]))
    return timed(spark.createDataFrame(data, "session string, camera string, person_id long, t double, x double, y double"))


def same(a, b, *columns, digits=6):
    take = lambda rows: sorted(tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in columns) for r in rows)
    assert take(a) == take(b) and a


def last_rows(rows, *keys):
    found = {}
    for r in sorted(rows, key=lambda r: r.t):
        found[tuple(r[k] for k in keys)] = r
    return list(found.values())


def test_live_heat_and_zones(spark, tmp_path):
    df = walks(spark)
    got = last_rows(drain(T.stream_heat_cells(split_files(df, tmp_path / "a", "t"), 1.0), "heat"), "cx", "cy")
    same(got, counters.heat_cells(df, 1.0).collect(), "cx", "cy", "seconds", "peak", "visits")
    zones = [{"zone_id": 1, "vertices": [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]}, {"zone_id": 2, "vertices": [(2.0, 2.0), (6.0, 2.0), (4.0, 6.0)]}]
    got = drain(T.stream_zone_occupancy(split_files(df, tmp_path / "b", "t"), zones, {1: (2, 1.0)}), "zones")
    same(got, counters.zone_occupancy(df, zones, {1: (2, 1.0)}).fillna(False, ["alert"]).collect(), "zone_id", "t", "count", "seconds", "peak", "visits", "duration", "alert")
    got = drain(L.stream_crowd_clusters(split_files(df, tmp_path / "c", "t"), 2.0, 3, 1.0), "crowds")
    same(got, plans.crowd_clusters(df, 2.0, 3, 1.0).collect(), "t", "x", "y", "count", "since", "duration", "alert")


def test_live_counts(spark, tmp_path):
    df = walks(spark).where("NOT (t BETWEEN 12 AND 14)")
    counts = timed(df.groupBy("session", "camera", "t").agg(F.count("*").alias("n")))
    got = last_rows(drain(L.stream_camera_counting(split_files(counts, tmp_path / "a", "t"), 0.5), "cameras"), "camera")
    same(got, counters.camera_counting(counts, 0.5).collect(), "camera", "count", "peak", "peak_at", "person_seconds", "observed_s")
    got = drain(L.stream_crowd_episodes(split_files(counts, tmp_path / "b", "t"), 3, 1.0, 0.5), "episodes")
    want = [r for r in counters.crowd_episodes(counts, 3, 1.0, 0.5).collect() if r.reason != "fin"]
    same(got, want, "camera", "start", "confirmed", "end", "peak", "duration", "reason")
    samples = timed(counts.groupBy("session", "t").agg(F.sum("n").alias("people"), F.max("n").alias("alerts")))
    got = last_rows(drain(L.stream_session_metrics(split_files(samples, tmp_path / "c", "t")), "metrics"), "session")
    same(got, trajectories.session_metrics(samples, df).collect(), "person_seconds", "observed_s", "alerts")


def test_live_flow_and_visits(spark, tmp_path):
    df = walks(spark).withColumn("zone_id", F.lit(1)).withColumn("inside", F.col("x") < 3).select("session", "zone_id", "person_id", "t", "inside", "ts")
    same(drain(L.stream_zone_flow(split_files(df, tmp_path / "a", "t")), "flow"), counters.zone_flow(df).collect(), "person_id", "t", "direction")
    pick = random.Random(3)
    data = []
    for i in range(60):
        v, b = [pick.uniform(-1, 1) for _ in range(4)], "xy"[i % 2]
        data += [("s", b, i * 10.0, "entry", v, i % 3 == 0), ("s", b, i * 10.0 + 95.0, "exit", [a + pick.uniform(-0.1, 0.1) for a in v], True)]
    visits = timed(spark.createDataFrame(data, "session string, business_id string, t double, kind string, vector array<double>, bag boolean"))
    got = drain(T.stream_visit_matching(split_files(visits, tmp_path / "b", "t"), 300.0), "visits")
    same(got, plans.visit_matching(visits.drop("ts"), 300.0).collect(), "business_id", "t", "matched", "changed", "similarity")


def test_live_boxes(spark, tmp_path):
    pick = random.Random(5)
    data = [("s", "A", k * 0.5, p, 100.0 + p * 50 + (pick.uniform(-30, 30) if p % 2 else 0.5), 50.0, 40.0, pick.uniform(40, 160), pick.choice([0.3, 0.5, 0.7, 0.9]) if p != 2 else 0.4, pick.random() < 0.1) for k in range(40) for p in range(5) if pick.random() < 0.95]
    df = timed(spark.createDataFrame(data, "session string, camera string, t double, track long, u double, v double, w double, h double, score double, border boolean"))
    same(drain(L.stream_size_filter(split_files(df, tmp_path / "a", "t")), "sizes"), boxes.size_filter(df).collect(), "t", "track", "keep")
    same(drain(L.stream_static_clutter(split_files(df, tmp_path / "b", "t")), "clutter"), boxes.static_clutter(df).collect(), "t", "track", "suppressed")


def test_line_crossings_in_bands(spark, tmp_path):
    pick = random.Random(6)
    data = [("s", "A", p, k * 0.2, 0.5 + pick.uniform(-0.3, 0.3), 0.5 + pick.uniform(-0.4, 0.4)) for p in range(4) for k in range(60)]
    df = timed(spark.createDataFrame(data, "session string, camera string, person_id long, t double, u double, v double"))
    at = lambda y: [{"x": x, "y": y} for x in (0.2, 0.8)]
    band = "array<struct<x: double, y: double>>"
    lines = spark.createDataFrame([("A", 1, 0.2, 0.5, 0.8, 0.5, 1, at(0.7), at(0.3)), ("A", 2, 0.5, 0.45, 0.5, 0.9, -1, None, None), ("A", 3, 0.5, 0.5, 0.5, 0.5, 1, None, None)], f"camera string, line_id int, ax double, ay double, bx double, by double, entry_side int, positive {band}, negative {band}")
    got = drain(S.stream_line_crossings(split_files(df, tmp_path / "a", "t"), lines), "bands")
    want = counters.line_crossings(df.drop("ts"), lines).collect()
    key = lambda r: (r.line_id, r.person_id, round(r.t, 6), r.direction)
    assert len(want) > 10 and sorted(map(key, got)) == sorted(map(key, want))


def test_state_by_what_is_touched(spark, tmp_path):
    """A micro-batch that touches one cell writes as much after 900 cells as after none; predicted people and rows without a place don't count."""
    schema = "session string, camera string, person_id long, t double, x double, y double, predicted boolean"
    path = str(tmp_path / "a")
    data = [[("s", "A", k, 0.0, k % 30 + 0.5, k // 30 + 0.5, False) for k in range(900)]]
    data += [[("s", "A", 1, 1.0 * i, 0.5, 0.5, False), ("s", "A", 2, 1.0 * i, 0.5, 0.5, True), ("s", "A", 3, 1.0 * i, None, 0.5, None)] for i in range(1, 4)]
    for part in data:
        timed(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed(spark.createDataFrame([], schema)).schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = T.stream_heat_cells(stream, 1.0).writeStream.format("memory").queryName("touched").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    puts = [p.stateOperators[0].customMetrics["rocksdbPutCount"] for p in query.recentProgress if p.numInputRows]
    assert len(puts) == 4 and puts[0] >= 1800 and max(puts[1:]) < 20
    last = spark.table("touched").orderBy("t").collect()[-1]
    assert (last.cx, last.cy, last.seconds, last.peak, last.visits) == (0, 0, 3.0, 1, 2)
    assert spark.table("touched").count() == 903
