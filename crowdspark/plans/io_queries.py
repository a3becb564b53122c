"""Queries over sources, sinks and reports; files are derived from the tables first, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters as K
from ..operators import reports as R
from ..operators.trajectories import ranked
from ..sources import recordings as S
from ..sources import sales as V
from ..sources.shared import shared_folder, stored
from . import adapters as A
from . import commerce_queries as C
from .flow_queries import rounded
from .tracking_queries import CAMERAS, _CAMERAS, _CNT, _OCCUPIED, _SESSION, _counts, _heat, _heat_cells, _occupied, _session_metrics

QUERIES, ORACLE, _register = A.registry()


def query(sql=None, kind="none", dates=()):
    return _register(sql, kind, dates)


def _folder(spark) -> str:
    return shared_folder(spark, "files")


def _recorded(spark, sf):
    """Sample lines by session, derived from events: every 41st line is broken."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    person = F.struct(F.concat(F.when(F.col("event_id") % 13 == 0, "T").otherwise("P"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("id"), F.col("user_id").cast("int").alias("local"), F.array(F.col("value") % 12, F.col("value") % 8).alias("point"), F.when(F.col("event_id") % 3 != 0, F.array(F.col("value"), F.col("value") * 2)).alias("pixel"), F.array(F.col("value") - 20, F.col("value") * 2 - 100, F.col("value") + 20, F.col("value") * 2).alias("box"), (F.col("event_id") % 13 != 0).alias("confirmed"))
    rows = e.select(F.to_date("ts").cast("string").alias("session"), "event_id", F.struct(F.col("event_id").cast("double").alias("t"), F.array(F.struct(F.col("event_type").alias("id"), F.col("event_id").cast("double").alias("t"), F.array(person).alias("people"))).alias("cameras")).alias("s"))
    text = F.when(F.col("event_id") % 41 == 40, F.lit('{"t": 1, "cam')).otherwise(F.to_json("s"))
    path = _folder(spark)
    rows.select("session", "event_id", text.alias("value")).repartition("session").sortWithinPartitions("session", "event_id").select("session", "value").write.partitionBy("session").text(path)
    return path


_LAYOUT = {"files": "session=*/*", "session": "session=([^/]+)/"}


def _samples(spark, sf):
    return S.read_samples(spark, _recorded(spark, sf), **_LAYOUT)


_EV = ", ev AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_id, event_type AS camera, user_id, value, event_id % 41 = 40 AS bad FROM events), fb AS (SELECT session, min(event_id) FILTER (bad) AS first_bad FROM ev GROUP BY session)"


@query(_EV + " SELECT session, camera, CAST(event_id AS DOUBLE) AS t, concat('P', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS person_id, round(value % 12e0, 3) AS x, round(value % 8e0, 3) AS y, CASE WHEN event_id % 3 <> 0 THEN round(value, 3) END AS u, CASE WHEN event_id % 3 <> 0 THEN round(value * 2, 3) END AS v, round(value - 20, 3) AS x1, round(value * 2 - 100, 3) AS y1, round(value + 20, 3) AS x2, round(value * 2, 3) AS y2, row_number() OVER (PARTITION BY session ORDER BY event_id) AS nth FROM ev JOIN fb USING (session) WHERE event_id < coalesce(first_bad, 1e18) AND event_id % 13 <> 0")
def read_recordings(spark, sf):
    rows = ranked(S.read_recordings(spark, _recorded(spark, sf), **_LAYOUT), ["t", "ordinal"]).withColumn("nth", F.col("i") + 1)
    numbers = ("x", "y", "u", "v", "x1", "y1", "x2", "y2")
    return rounded(rows.select("session", "camera", "t", "person_id", *numbers, "nth"), 3, *numbers)


@query(_EV + " SELECT session, count(*) AS n FROM ev WHERE NOT bad AND event_id % 13 <> 0 GROUP BY session")
def read_recordings_skipping(spark, sf):
    return S.read_recordings(spark, _recorded(spark, sf), "skip_bad", **_LAYOUT).groupBy("session").agg(F.count("*").alias("n"))


@query(_EV + " SELECT session, CAST(max(event_id) AS DOUBLE) AS t, CAST(1 AS INT) AS cameras FROM ev WHERE NOT bad GROUP BY session")
def last_sample(spark, sf):
    return S.last_sample(_samples(spark, sf))


@query(_EV + " SELECT session, CASE WHEN right(session, 1) = '3' THEN 'error' ELSE 'done' END AS status, CASE WHEN right(session, 1) = '3' THEN CAST(coalesce(max(event_id) FILTER (event_id < coalesce(first_bad, 1e18)), 0) AS DOUBLE) ELSE 9e0 END AS end_s FROM ev JOIN fb USING (session) GROUP BY session")
def recover_interrupted(spark, sf):
    samples = _samples(spark, sf)
    sessions = samples.select("session").distinct().select("session", F.when(F.col("session").endswith("3"), "running").otherwise("done").alias("status"), F.lit(9.0).alias("end_s"))
    return S.recover_interrupted(sessions, samples)


@query(_EV + " SELECT session FROM (SELECT session, max(event_id) AS c FROM ev WHERE camera <> 'none' GROUP BY session) ORDER BY c DESC, session LIMIT 10")
def session_history(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    sessions = e.groupBy(F.to_date("ts").cast("string").alias("session")).agg(F.max("event_id").alias("created")).withColumn("project_id", F.lit(None).cast("string"))
    return S.session_history(sessions, None, 10).select("session")


@query(_EV + ", i AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM ev), s AS (SELECT *, CASE WHEN n > 16 THEN CAST(ceil(n / 12e0) AS BIGINT) ELSE 1 END AS step FROM i) SELECT session, event_id, i, step, i % step = 0 OR i = n - 1 AS keep_full FROM s")
def thin_samples(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").cast("string").alias("session"), "event_id", F.col("event_id").alias("t"))
    return S.thin_samples(e, 12, 4).select("session", "event_id", "i", "step", "keep_full")


@query(", f AS (SELECT p_partkey AS feature_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'retail' WHEN p_size % 3 = 1 THEN 'food_and_drink' ELSE 'other' END AS class, p_retailprice % 100e0 AS x, p_size * 1e0 AS y FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CAST(feature_id AS VARCHAR)) AS i, count(*) OVER (PARTITION BY name) AS c FROM f WHERE class <> 'other' AND trim(name) <> '') SELECT concat('map-', CAST(CAST(floor(x) AS INT) AS VARCHAR), '-', CAST(feature_id AS VARCHAR)) AS business_id, CASE WHEN c > 1 THEN concat(name, ' (local ', CAST(i AS VARCHAR), ')') ELSE name END AS name, feature_id, round(x, 3) AS x, y FROM n WHERE feature_id % 10 <> 0")
def map_catalog_to_businesses(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "retail").when(F.col("p_size") % 3 == 1, "food_and_drink").otherwise("other")
    f = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), kind.alias("class"), (F.col("p_retailprice") % 100).alias("x"), F.col("p_size").cast("double").alias("y"))
    return rounded(S.map_catalog_to_businesses(f, f.where("feature_id % 10 = 0").select("feature_id")), 3, "x")


_LINES = """, li AS (SELECT o_orderkey AS line, concat('b', CAST(o_custkey % 20 AS VARCHAR)) AS business_id, CASE WHEN o_orderkey % 17 = 0 THEN '2024-13-40' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date, CASE WHEN o_orderkey % 19 = 0 THEN '25' ELSE CAST(o_orderkey % 24 AS VARCHAR) END AS hour,
    CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS amount, CASE WHEN o_orderkey % 29 = 0 THEN 'USD' ELSE 'PEN' END AS currency FROM orders),
    fa AS (SELECT *, CASE WHEN business_id = 'b19' THEN 'business' WHEN date = '2024-13-40' THEN 'date' WHEN hour = '25' THEN 'hour' WHEN amount = 'x' THEN 'amount' WHEN currency <> 'PEN' THEN 'currency' END AS fault FROM li),
    du AS (SELECT *, row_number() OVER (PARTITION BY business_id, date, hour, fault IS NULL ORDER BY line) AS nth FROM fa)"""


def _lines(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(k.alias("line"), F.concat(F.lit("b"), F.col("o_custkey") % 20).alias("business_id"), F.when(k % 17 == 0, "2024-13-40").otherwise(F.to_date("o_orderdate").cast("string")).alias("date"), F.when(k % 19 == 0, "25").otherwise((k % 24).cast("string")).alias("hour"), F.when(k % 23 == 0, "x").otherwise(F.bround("o_totalprice").cast("long").cast("string")).alias("amount"), F.when(k % 29 == 0, "USD").otherwise("PEN").alias("currency"), F.lit("").alias("transactions"))


@query(_LINES + " SELECT coalesce(fault, CASE WHEN nth > 1 THEN 'duplicate' ELSE 'ok' END) AS message, count(*) AS n FROM du GROUP BY ALL")
def parse_sales_csv(spark, sf):
    good, bad = V.parse_sales(_lines(spark, sf), spark.range(19).select(F.concat(F.lit("b"), "id").alias("business_id")))
    return bad.select("message").union(good.select(F.lit("ok"))).groupBy("message").agg(F.count("*").alias("n"))


@query(_LINES + " SELECT count(*) FILTER (fault IS NOT NULL OR nth > 1) AS errors, count(*) FILTER (fault IS NULL AND nth = 1 AND business_id = 'b3') AS taken, count(*) FILTER (fault IS NULL AND nth = 1) AS rows, CAST(0 AS BIGINT) AS imported FROM du")
def import_sales(spark, sf):
    good, bad = V.parse_sales(_lines(spark, sf), spark.range(19).select(F.concat(F.lit("b"), "id").alias("business_id")))
    existing = good.where("business_id = 'b3'").select("business_id", "date", "hour", F.lit("real").alias("dataset"))
    return V.import_sales(good, bad, existing, "real")[1].withColumn("imported", F.col("imported").cast("long"))


@query(" SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('''=', c_name) WHEN c_custkey % 3 = 1 THEN concat('''  @', c_name) ELSE c_name END AS name FROM customer")
def report_csv_sink(spark, sf):
    path = _folder(spark)
    lead = F.when(F.col("c_custkey") % 3 == 0, "=").when(F.col("c_custkey") % 3 == 1, "  @").otherwise("")
    V.report_csv_sink(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(lead, "c_name").alias("name")), path)
    return spark.read.schema("c_custkey long, name string").option("header", True).csv(path)


@query(" SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_id, value + CASE WHEN day(ts) % 2 = 0 THEN 1 ELSE 0 END AS value FROM events")
def save_insights(spark, sf):
    path = _folder(spark)
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").cast("string").alias("session"), "event_id", "value", F.dayofmonth("ts").alias("d"))
    V.save_by_session(rows.drop("d"), path)
    V.save_by_session(rows.where("d % 2 = 0").withColumn("value", F.col("value") + 1).drop("d"), path)
    return spark.read.schema("event_id long, value double, session string").parquet(path)


@query(", ob AS (SELECT event_id, user_id AS local, CASE WHEN event_id % 10 = 0 THEN 'M1' ELSE concat('T', CAST(user_id AS VARCHAR)) END AS person_id, event_id % 7 = 0 AS manual FROM events) SELECT event_id AS t, CASE WHEN manual OR person_id = 'M1' OR event_id % 3 <> 0 THEN person_id ELSE concat('P', lpad(CAST(local % 50 AS VARCHAR), 5, '0')) END AS person_id, CASE WHEN manual OR person_id = 'M1' THEN NULL ELSE event_id % 3 = 0 END AS confirmed FROM ob")
def rewrite_final_ids(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    obs = e.select(F.lit("s").alias("session"), "event_type", F.col("user_id").alias("local"), F.col("event_id").alias("t"), F.when(F.col("event_id") % 10 == 0, "M1").otherwise(F.concat(F.lit("T"), F.col("user_id"))).alias("person_id"), F.when(F.col("event_id") % 7 == 0, "manual").alias("association"), F.lit(None).cast("boolean").alias("confirmed")).withColumnRenamed("event_type", "camera")
    numbers = obs.where("t % 3 = 0").select("session", "camera", "local", "t", (F.col("local") % 50).alias("public_id"))
    return S.rewrite_final_ids(obs, numbers).select("t", "person_id", "confirmed")


@query(_CNT + ", x AS (SELECT session, t, CAST(sum(n) AS BIGINT) AS count FROM cnt GROUP BY session, t) SELECT session, CAST(floor(t / 3600) AS BIGINT) AS hour, round(avg(count), 4) AS mean, max(count) AS peak, count(*) AS samples FROM x GROUP BY ALL", "legs")
def report_flow(spark, sf):
    return rounded(R.report_flow(_counts(spark, sf).groupBy("session", "t").agg(F.sum("n").alias("count"))), 4, "mean")


_TABLE = _OCCUPIED + ", zt AS (SELECT * FROM zo QUALIFY row_number() OVER (PARTITION BY session, zone_id ORDER BY t DESC) = 1)"


def _zones(spark, sf):
    return R.report_occupancy(_occupied(spark, sf).fillna(False, ["alert"]))


@query(_TABLE + " SELECT session, zone_id, count, round(seconds, 3) AS seconds, peak, visits, round(duration, 3) AS duration, alert FROM zt", "legs")
def report_occupancy(spark, sf):
    return rounded(_zones(spark, sf), 3, "seconds", "duration")


_RANKED = _TABLE + """, bm AS (SELECT *, median(round(seconds, 3)) OVER (PARTITION BY session) AS ms, median(visits) OVER (PARTITION BY session) AS mv FROM zt), br AS (SELECT session, zone_id, round(seconds, 3) AS seconds, visits, peak, alert, round(round(seconds, 3) / nullif(visits, 0), 4) AS mean_stay,
    CASE WHEN alert THEN '{alert}' WHEN round(seconds, 3) >= ms AND visits >= mv THEN '{both}' WHEN visits >= mv THEN '{traffic}' WHEN round(seconds, 3) >= ms THEN '{dwell}' ELSE '{none}' END AS verdict, row_number() OVER (PARTITION BY session ORDER BY round(seconds, 3) DESC, zone_id) AS rank, visits >= mv AND round(seconds, 3) < ms AS pass FROM bm)""".format(**R.VERDICTS)


def _ranking(spark, sf):
    return R.business_report(rounded(_zones(spark, sf), 3, "seconds"))


@query(_RANKED + " SELECT * EXCLUDE (pass), pass AND rank > 1 AS passing FROM br", "legs")
def business_report(spark, sf):
    return rounded(_ranking(spark, sf), 4, "mean_stay").drop("count", "duration")


@query(_RANKED + _SESSION + """, kx AS (SELECT session, t, CAST(sum(n) AS BIGINT) AS c FROM cnt GROUP BY session, t), kp AS (SELECT session, max(c) AS peak, min_by(t, {'a': -c, 'b': t}) AS peak_t FROM kx GROUP BY session)
    SELECT se.session, round(person_seconds / greatest(1, identities), 4) AS mean_observed, alerts, peak, round(peak_t, 3) AS peak_t, zone_id AS top_zone, seconds AS top_seconds FROM se LEFT JOIN kp USING (session) LEFT JOIN (SELECT session, zone_id, seconds FROM br WHERE rank = 1) USING (session)""", "legs")
def business_kpis(spark, sf):
    counts = stored(_counts(spark, sf), "counts")
    series = counts.groupBy("session", "t").agg(F.sum("n").alias("count"))
    return rounded(rounded(R.business_kpis(series, _ranking(spark, sf), _session_metrics(spark, sf, counts)), 4, "mean_observed"), 3, "peak_t")


@query(_RANKED + """, bc AS (SELECT session, count(DISTINCT camera) AS active, CAST(5 AS BIGINT) AS total FROM pos GROUP BY session),
    bk AS (SELECT session, 'top' AS kind, CAST(zone_id AS VARCHAR) AS zones, seconds AS number FROM br WHERE rank = 1 AND seconds > 0 UNION ALL SELECT session, 'alert', string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY rank), NULL FROM br WHERE alert GROUP BY session
      UNION ALL SELECT session, 'passing', string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY rank), NULL FROM br WHERE pass AND rank > 1 GROUP BY session UNION ALL SELECT session, 'coverage', '', CAST(active AS DOUBLE) FROM bc WHERE active < total)
    SELECT * FROM bk UNION ALL SELECT session, 'none', '', NULL FROM bc WHERE session NOT IN (SELECT session FROM bk)""", "legs")
def business_recommendations(spark, sf):
    cameras = A.derive(spark, sf, "legs", "pos").groupBy("session").agg(F.count_distinct("camera").alias("active")).withColumn("total", F.lit(5).cast("long"))
    return R.business_recommendations(_ranking(spark, sf), cameras)


@query(_TABLE + " SELECT session, zone_id, visits, CASE WHEN visits < 5 THEN 'low' WHEN 2 * visits >= max(visits) OVER (PARTITION BY session) THEN 'high' ELSE 'partial' END AS confidence FROM zt", "legs")
def sample_confidence(spark, sf):
    return R.sample_confidence(_zones(spark, sf)).select("session", "zone_id", "visits", "confidence")


@query(_heat("obs") + ", " + _CAMERAS + """, rs AS (SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY seconds DESC, cx, cy) AS INT) AS rank, cx * 1e0 AS x, cy * 1e0 AS y, seconds, peak, visits FROM he)
    SELECT session, rank, arg_min(camera, {'d': pow(x - ca.cx, 2) + pow(y - ca.cy, 2), 'c': camera}) AS camera, x, y, seconds, peak, visits FROM rs CROSS JOIN ca GROUP BY ALL""", "obs")
def report_sectors(spark, sf):
    return R.report_sectors(_heat_cells(spark, sf), 1.0, CAMERAS)


@query(_CNT + ", cr AS (SELECT session, camera, count(*) FILTER (event_id % 2 = 0) AS entries, count(*) FILTER (event_id % 2 = 1) AS exits FROM pos GROUP BY ALL) SELECT session, camera, round(last_t, 3) AS last_t, count, peak, round(peak_at, 3) AS peak_at, round(mean, 4) AS mean, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits FROM (SELECT session, camera, max(t) AS last_t, max_by(n, t) AS count, max(n) AS peak, min_by(t, {'a': -n, 'b': t}) AS peak_at, sum(n * dt) / nullif(sum(dt), 0) AS mean FROM (SELECT *, CASE WHEN lead(t) OVER w - t <= 0.3e0 THEN lead(t) OVER w - t ELSE 0 END AS dt FROM cnt WINDOW w AS (PARTITION BY session, camera ORDER BY t)) GROUP BY ALL) LEFT JOIN cr USING (session, camera)", "legs")
def report_cameras(spark, sf):
    crossings = A.derive(spark, sf, "legs", "pos").select("session", "camera", F.when(F.col("event_id") % 2 == 0, "entry").otherwise("exit").alias("direction"))
    return rounded(rounded(R.report_cameras(K.camera_counting(_counts(spark, sf), 0.2), crossings), 3, "last_t", "peak_at"), 4, "mean")


@query(" SELECT session, camera, event_id, CASE WHEN event_id % 2 = 0 THEN 'entry' ELSE 'exit' END AS direction, row_number() OVER (PARTITION BY session ORDER BY tick, event_id, person_id) AS nth FROM pos", "legs")
def report_access_events(spark, sf):
    rows = A.derive(spark, sf, "legs", "pos").withColumn("direction", F.when(F.col("event_id") % 2 == 0, "entry").otherwise("exit"))
    return R.report_access_events(rows, ["tick", "event_id", "person_id"]).select("session", "camera", "event_id", "direction", "nth")


_MINE = "right(session, 1) <> '7' AND right(session, 1) <> '9'"


def _reported(spark, sf):
    """(sessions, series): those that end in 7 still run, those in 9 are another project's."""
    series = _counts(spark, sf).groupBy("session", "t").agg(F.sum("n").alias("count"))
    ends = lambda k: F.col("session").endswith(k)
    return series.select("session").distinct().select("session", F.when(ends("7"), "running").otherwise("done").alias("status"), F.when(ends("9"), "q").otherwise("p").alias("project_id"), F.when(ends("4"), 9).cast("long").alias("final_people")), series


@query(_CNT + f", x AS (SELECT session, t, CAST(sum(n) AS BIGINT) AS count FROM cnt GROUP BY session, t), f AS (SELECT session, round(max(t), 3) AS last_t, max(count) AS peak, count(*) AS samples FROM x GROUP BY session) SELECT session, 'done' AS status, last_t, peak, samples, CASE WHEN right(session, 1) = '4' THEN 9 ELSE peak END AS people FROM f WHERE {_MINE}", "legs")
def session_report(spark, sf):
    return rounded(R.session_report(*_reported(spark, sf), "p"), 3, "last_t")


@query(_CNT + f""", x AS (SELECT session, t, CAST(sum(n) AS BIGINT) AS count FROM cnt GROUP BY session, t), i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM x)
    SELECT session, round(t, 3) AS t, count FROM i WHERE i % CAST(greatest(1, pow(2, ceil(log2(n / 100e0)))) AS BIGINT) = 0 AND {_MINE}""", "legs")
def session_series(spark, sf):
    return rounded(R.session_series(*_reported(spark, sf), "p", 100), 3, "t")


_SCOPED = ", ob AS (SELECT concat(session, '|', unnest([concat('level:', CAST(person_id % 2 AS VARCHAR)), concat('camera:', camera)])) AS session, camera, t, person_id, x, y FROM pos WHERE right(session, 1) IN ('1', '2'))"
_SPLIT = "split_part(session, '|', 1) AS session, split_part(session, '|', 2) AS scope"


def _maps(spark, sf):
    pos = A.derive(spark, sf, "legs", "pos").withColumn("plan_id", (F.col("person_id") % 2).cast("string"))
    sessions = pos.select("session").distinct().select("session", F.when(F.col("session").endswith("2"), "error").otherwise("done").alias("status"), F.when(F.col("session").rlike("[12]$"), 1).otherwise(2).alias("version"))
    return R.rebuild_maps(sessions, pos, 1.0)


@query(_SCOPED + _heat("ob") + f" SELECT {_SPLIT}, cx, cy, seconds, peak, visits FROM he", "legs")
def rebuild_maps(spark, sf):
    return rounded(_maps(spark, sf)[0], 3, "seconds")


@query(_SCOPED + """, fp AS (SELECT session, t, person_id, max({'camera': camera, 'x': x, 'y': y}) AS p FROM ob GROUP BY ALL), f0 AS (SELECT session, p.x AS x, p.y AS y, p.x - lag(p.x) OVER w AS dx, p.y - lag(p.y) OVER w AS dy, t - lag(t) OVER w AS dt FROM fp WINDOW w AS (PARTITION BY session, person_id ORDER BY t)), f1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM f0),
    f2 AS (SELECT session, CAST(floor(x / 1e0) AS INT) AS cx, CAST(floor(y / 1e0) AS INT) AS cy, CAST((round_even(atan2(dy, dx) / (pi() / 4), 0) + 8) % 8 AS INT) AS direction, round(sum(d), 3) AS distance, count(*) AS samples FROM f1 WHERE dt > 0 AND dt <= 2 AND d > 0.02e0 AND d <= 5 * dt GROUP BY 1, 2, 3, 4)
    SELECT """ + _SPLIT + ", cx, cy, direction, distance, samples FROM f2", "legs")
def rebuild_flows(spark, sf):
    return rounded(_maps(spark, sf)[1], 3, "distance")


@query(" SELECT CAST(c_custkey AS VARCHAR) AS session, CASE WHEN c_custkey % 4 = 0 THEN 'p1' END AS project_id, 'done' AS status, CAST(c_custkey % 100 AS DOUBLE) AS end_s, c_custkey % 5 = 0 AS test_run, CASE WHEN c_custkey % 3 = 0 THEN 'live' ELSE 'file' END AS source_mode, CAST(c_custkey % 7 AS INT) AS radius, concat('cam', CAST(c_custkey % 9 AS VARCHAR)) AS camera, false AS leaks, CAST(c_custkey % 50 AS BIGINT) AS people FROM customer")
def read_manifests(spark, sf):
    """A manifest a customer, many to a file, with keys that must not come out."""
    c, path = F.col("c_custkey"), _folder(spark)
    camera = F.struct(F.concat(F.lit("cam"), c % 9).alias("id"), F.lit("rtsp://user:pass@host").alias("source"), F.lit("pw").alias("password"))
    config = F.struct((c % 5 == 0).alias("testRun"), F.when(c % 3 == 0, "live").otherwise("file").alias("sourceMode"), F.lit("rtsp://user:pass@host").alias("source"), (c % 7).alias("radius"), F.array(camera).alias("cameras"))
    value = F.to_json(F.struct(c.cast("string").alias("session"), F.when(c % 4 == 0, "p1").alias("projectId"), F.lit("done").alias("status"), (c % 100).cast("double").alias("end"), config.alias("config"), F.struct((c % 50).alias("people")).alias("identity")))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(value.alias("value"))
    rows.repartition(16).write.text(path, lineSep=S.RECORD_END)
    found = S.read_manifests(spark, path, "part-*", S.RECORD_END)
    get = lambda column, at, kind: F.expr(f"variant_get({column}, '{at}', '{kind}')")
    leaks = F.to_json("config").rlike("rtsp|password")
    return found.select("session", "project_id", "status", "end_s", "test_run", "source_mode", get("config", "$.radius", "int").alias("radius"), get("config", "$.cameras[0].id", "string").alias("camera"), leaks.alias("leaks"), get("identity", "$.people", "long").alias("people"))


@query(" SELECT * FROM (" + C.SUMMARY_SQL + ")", "sales", dates=("date",))
def commercial_export(spark, sf):
    path = _folder(spark)
    V.report_csv_sink(C.exported(spark, sf), path)
    names = "business_id string, date string, hour int, dataset string, entries long, amount double, estimate double, days long, bag_matched long, bag_changed long, bag_unmatched long"
    return spark.read.schema(names).option("header", True).csv(path)
