"""Queries over sales and traffic, and over annotated points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as N
from ..operators import commerce as C
from . import adapters as A
from .flow_queries import rounded

QUERIES, ORACLE, _register = A.registry()


def query(sql=None, kind="sales", dates=()):
    return _register(sql, kind, dates)


def _sales(spark, sf):
    rows = A.derive(spark, sf, "sales", "sales")
    return rows.groupBy(*C.KEY).agg(F.sum("amount").alias("amount"), F.sum("transactions").alias("transactions"))


def _traffic(spark, sf):
    return A.derive(spark, sf, "sales", "traffic")


def _targets(spark, sf):
    return C.best_hours(_traffic(spark, sf)).select(*C.KEY, "entries")


_B = """, sal AS (SELECT dataset, business_id, date, hour, sum(amount) AS amount, CAST(sum(transactions) AS BIGINT) AS transactions FROM sales GROUP BY ALL),
    best AS (SELECT * FROM traffic QUALIFY row_number() OVER (PARTITION BY dataset, business_id, date, hour ORDER BY coverage DESC, session) = 1)"""
_GOOD = _B + """, good AS (SELECT best.dataset, best.business_id, best.date, best.hour, amount / entries AS ratio FROM best JOIN sal USING (dataset, business_id, date, hour) WHERE coverage >= 3300 AND entries > 0)"""


def _forecast(targets: str, p: str = "") -> str:
    return f"""ra{p} AS (SELECT t.dataset, t.business_id, t.date, t.hour, median(g.ratio) AS per_entry, count(*) AS days, min(g.ratio) AS lo, max(g.ratio) AS hi
        FROM {targets} t JOIN good g ON t.dataset = g.dataset AND t.business_id = g.business_id AND t.hour = g.hour AND dayofweek(t.date) = dayofweek(g.date) AND g.date < t.date GROUP BY ALL HAVING count(*) >= 3),
        fo{p} AS (SELECT t.dataset, t.business_id, t.date, t.hour, t.entries, per_entry, coalesce(days, 0) AS days, entries * per_entry AS estimate, entries * lo AS low, entries * hi AS high FROM {targets} t LEFT JOIN ra{p} USING (dataset, business_id, date, hour))"""


_ROUND = ", ".join(f"round({c}, 3) AS {c}" for c in ("per_entry", "estimate", "low", "high"))
_MONEY = ("per_entry", "estimate", "low", "high")


@query(_GOOD + ", " + _forecast("best") + f" SELECT dataset, business_id, date, hour, entries, days, {_ROUND} FROM fo", dates=("date",))
def forecast(spark, sf):
    return rounded(C.forecast(_targets(spark, sf), _traffic(spark, sf), _sales(spark, sf)), 3, *_MONEY)


_NEXT = """, nx AS (SELECT DISTINCT dataset, business_id, CAST(date + to_hours(hour + 1) AS DATE) AS date, CAST((hour + 1) % 24 AS INT) AS hour FROM best),
    ex AS (SELECT n.dataset, n.business_id, n.date, n.hour, CAST(round_even(median(t.entries), 0) AS BIGINT) AS entries FROM nx n JOIN traffic t ON n.dataset = t.dataset AND n.business_id = t.business_id AND n.hour = t.hour AND dayofweek(n.date) = dayofweek(t.date) AND t.date < n.date
      WHERE t.coverage >= 3300 GROUP BY ALL), tg AS (SELECT nx.*, ex.entries FROM nx LEFT JOIN ex USING (dataset, business_id, date, hour)), """ + _forecast("tg", "n")
_LABEL = "CASE WHEN {0} >= 7 THEN 'alta' WHEN {0} >= 3 THEN 'media' ELSE 'baja' END"


@query(_GOOD + _NEXT + f" SELECT dataset, business_id, date, hour, entries AS expected_entries, days, {_ROUND}, {_LABEL.format('days')} AS label FROM fon", dates=("date",))
def next_hour_forecast(spark, sf):
    return rounded(C.next_hour_forecast(_targets(spark, sf), _traffic(spark, sf), _sales(spark, sf)), 3, *_MONEY)


@query(_GOOD + ", " + _forecast("best") + f" SELECT days, {_LABEL.format('days')} AS label, count(*) AS hours FROM fo GROUP BY ALL")
def confidence_label(spark, sf):
    told = C.forecast(_targets(spark, sf), _traffic(spark, sf), _sales(spark, sf))
    return told.groupBy("days", C.confidence_label(F.col("days")).alias("label")).agg(F.count("*").alias("hours"))


_SUM = _B + """, su AS (SELECT best.dataset, best.business_id, best.date, best.hour, entries, amount, sal.transactions, CASE WHEN entries > 0 THEN 100e0 * sal.transactions / entries END AS conversion FROM best LEFT JOIN sal USING (dataset, business_id, date, hour))"""


def _summary(spark, sf):
    return C.commercial_summary(_targets(spark, sf), _traffic(spark, sf), _sales(spark, sf))


def _bags(spark, sf):
    e, k, u = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id"), F.col("user_id")
    return e.select(F.when(u % 7 == 0, "demo").otherwise("real").alias("dataset"), F.concat(F.lit("b"), u % 5).alias("business_id"), F.concat(F.lit("s"), k % 4).alias("session"), (k % 3 == 0).alias("matched"), (k % 6 == 0).alias("changed"))


_WHOLE = _SUM + _GOOD[len(_B):] + ", " + _forecast("best") + _NEXT + """, bg AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'demo' ELSE 'real' END AS dataset, concat('b', CAST(user_id % 5 AS VARCHAR)) AS business_id, concat('s', CAST(event_id % 4 AS VARCHAR)) AS session, count(*) AS exits, count(*) FILTER (event_id % 3 = 0) AS matched, count(*) FILTER (event_id % 6 = 0) AS changed FROM events GROUP BY ALL),
    bd AS (SELECT dataset, business_id, date, CAST(sum(exits) AS BIGINT) AS bag_exits, CAST(sum(matched) AS BIGINT) AS bag_matched, CAST(sum(changed) AS BIGINT) AS bag_changed FROM (SELECT DISTINCT dataset, business_id, session, date FROM traffic) JOIN bg USING (dataset, business_id, session) GROUP BY ALL),
    wh AS (SELECT su.*, fo.days, fo.estimate, fo.low, fo.high, fon.entries AS next_entries, fon.estimate AS next_estimate, fon.days AS nd, coalesce(bag_exits, 0) AS bag_exits, coalesce(bag_matched, 0) AS bag_matched, coalesce(bag_changed, 0) AS bag_changed
      FROM su JOIN fo ON su.dataset = fo.dataset AND su.business_id = fo.business_id AND su.date = fo.date AND su.hour = fo.hour
      LEFT JOIN fon ON fon.dataset = su.dataset AND fon.business_id = su.business_id AND fon.date = CAST(su.date + to_hours(su.hour + 1) AS DATE) AND fon.hour = (su.hour + 1) % 24 LEFT JOIN bd ON bd.dataset = su.dataset AND bd.business_id = su.business_id AND bd.date = su.date)"""
SUMMARY_SQL = A.oracle("sales", _WHOLE + " SELECT business_id, date, hour, dataset, entries, round(amount, 2) AS amount, round(estimate, 3) AS estimate, days, bag_matched, bag_changed, bag_exits - bag_matched AS bag_unmatched FROM wh")


def _whole(spark, sf):
    return C.commercial_summary(_targets(spark, sf), _traffic(spark, sf), _sales(spark, sf), _bags(spark, sf))


def exported(spark, sf):
    return C.commercial_export(rounded(rounded(_whole(spark, sf), 2, "amount"), 3, "estimate"))


@query(_WHOLE + f""" SELECT dataset, business_id, date, hour, entries, round(amount, 2) AS amount, transactions, round(conversion, 3) AS conversion, days, round(estimate, 3) AS estimate, round(low, 3) AS low, round(high, 3) AS high, {_LABEL.format('days')} AS label, next_entries, round(next_estimate, 3) AS next_estimate, {_LABEL.format('nd')} AS next_label,
    bag_exits, bag_matched, bag_changed, bag_exits - bag_matched AS bag_unmatched, round(100e0 * bag_matched / nullif(bag_exits, 0), 4) AS bag_coverage FROM wh""", dates=("date",))
def commercial_summary(spark, sf):
    return rounded(rounded(rounded(_whole(spark, sf), 2, "amount"), 3, "conversion", "estimate", "low", "high", "next_estimate"), 4, "bag_coverage")


@query(_GOOD + ", tk AS (SELECT DISTINCT dataset, business_id, date, hour, 1 AS entries FROM traffic), " + _forecast("tk") + f""" SELECT t.dataset, t.business_id, t.date, t.hour, t.session, t.entries, t.exits, CAST(round(t.coverage) AS BIGINT) AS coverage, round(amount, 2) AS amount, transactions, round(t.entries * per_entry, 3) AS estimate, {_LABEL.format('days')} AS label
    FROM traffic t LEFT JOIN sal USING (dataset, business_id, date, hour) LEFT JOIN fo USING (dataset, business_id, date, hour)""", dates=("date",))
def hourly_table(spark, sf):
    return rounded(rounded(C.hourly_table(_traffic(spark, sf), _sales(spark, sf)), 2, "amount"), 3, "estimate")


_ESTIMATED = _SUM + _GOOD[len(_B):] + ", " + _forecast("best") + ", sx AS (SELECT su.*, fo.estimate FROM su JOIN fo USING (dataset, business_id, date, hour))"
_ADDED = "coalesce(CAST(sum(entries) AS BIGINT), 0) AS entries, sum(amount) AS amount, sum(estimate) AS estimate, CAST(sum(transactions) AS BIGINT) AS transactions"
_TOTALS = "entries, transactions, round(amount, 2) AS amount, round(estimate) AS estimate, round(CASE WHEN entries > 0 THEN 100e0 * transactions / entries END, 3) AS conversion"


@query(_ESTIMATED + """, co AS (SELECT *, coalesce(CASE WHEN business_id <> 'b4' THEN concat('c', CAST(CAST(substr(business_id, 2) AS INT) % 2 AS VARCHAR)) END, 'Sin empresa') AS company FROM sx),
    cr AS (SELECT dataset, date, hour, company, business_id, CAST(GROUPING(company, business_id) AS INT) AS level, count(DISTINCT business_id) AS businesses, """ + _ADDED + f" FROM co GROUP BY GROUPING SETS ((dataset, date, hour), (dataset, date, hour, company), (dataset, date, hour, company, business_id))) SELECT dataset, date, hour, company, business_id, level, businesses, {_TOTALS} FROM cr", dates=("date",))
def company_rollup(spark, sf):
    companies = spark.range(4).select(F.concat(F.lit("b"), "id").alias("business_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("company"))
    return rounded(rounded(rounded(C.company_rollup(_summary(spark, sf), companies), 2, "amount"), 0, "estimate"), 3, "conversion")


@query(_ESTIMATED + ", dt AS (SELECT dataset, date, hour, max(conversion) AS best_conversion, " + _ADDED + f""" FROM sx GROUP BY ALL)
    SELECT dataset, date, hour, {_TOTALS}, round(best_conversion, 3) AS best_conversion, row_number() OVER (PARTITION BY dataset, date ORDER BY entries DESC, hour) = 1 AS peak FROM dt""", dates=("date",))
def dashboard_totals(spark, sf):
    return rounded(rounded(rounded(C.dashboard_totals(_summary(spark, sf)), 2, "amount"), 0, "estimate"), 3, "conversion", "best_conversion")


#: Line items as people exposed (all passages) and visits (those in); a session covers an hour or half of it.
_REL = _B + """, re AS (SELECT dataset, business_id, date, hour, session, entries + exits AS exposure, entries AS visits, round(amount, 2) AS amount, 100e0 * entries / nullif(entries + exits, 0) AS capture, 100e0 * transactions / nullif(entries, 0) AS conversion, round(amount, 2) / nullif(entries, 0) AS per_visit FROM traffic JOIN sal USING (dataset, business_id, date, hour) WHERE coverage >= 3300)"""


def _relation(spark, sf):
    hourly = _traffic(spark, sf).withColumnsRenamed({"entries": "visits"}).withColumn("exposure", F.col("visits") + F.col("exits"))
    return C.sales_relation(hourly, rounded(_sales(spark, sf), 2, "amount"))


@query(_REL + " SELECT dataset, business_id, date, hour, session, exposure, visits, amount, round(capture, 3) AS capture, round(conversion, 3) AS conversion, CAST(round(per_visit * visits * 100) AS BIGINT) // visits AS per_visit_cents FROM re", dates=("date",))
def sales_relation(spark, sf):
    """Sales a visit in whole cents, for quotients of cents often lie half-way between two roundings."""
    rows = rounded(_relation(spark, sf), 3, "capture", "conversion")
    return rows.withColumn("per_visit_cents", F.expr("CAST(round(per_visit * visits * 100) AS BIGINT) div visits")).drop("per_visit")


def _rank_sql(name: str) -> str:
    return f"rk_{name} AS (SELECT dataset, business_id, count(*) AS n, CASE WHEN count(*) >= 3 AND min({name}) <> max({name}) AND min(amount) <> max(amount) THEN round(corr(a, b), 3) END AS rho FROM (SELECT *, row_number() OVER (PARTITION BY dataset, business_id ORDER BY {name}, date, hour, session) AS a, row_number() OVER (PARTITION BY dataset, business_id ORDER BY amount, date, hour, session) AS b FROM re) GROUP BY ALL)"


@query(_REL + ", " + _rank_sql("visits") + " SELECT * FROM rk_visits")
def spearman_ordinal(spark, sf):
    return C.spearman_ordinal(_relation(spark, sf), ["dataset", "business_id"], "visits", "amount", ["date", "hour", "session"])


@query(_REL + ", " + _rank_sql("visits") + ", " + _rank_sql("exposure") + """, md AS (SELECT dataset, business_id, count(*) AS hours, median(capture) AS m FROM re GROUP BY ALL)
    SELECT dataset, business_id, hours, CASE WHEN hours >= 6 THEN round(m, 3) END AS capture_median, CASE WHEN hours >= 6 THEN e.rho END AS exposure_sales, CASE WHEN hours >= 6 THEN v.rho END AS visits_sales FROM md JOIN rk_visits v USING (dataset, business_id) JOIN rk_exposure e USING (dataset, business_id)""")
def sales_correlation(spark, sf):
    return rounded(C.sales_correlation(_relation(spark, sf)), 3, "capture_median")


@query(" SELECT business_id, date, hour, round(sum(amount), 2) AS amount FROM sales WHERE hour BETWEEN 0 AND 23 AND amount >= 0 GROUP BY ALL HAVING (business_id, date, hour) NOT IN (SELECT (business_id, date, hour) FROM traffic WHERE dataset = 'demo')", dates=("date",))
def legacy_sales_migration(spark, sf):
    return rounded(C.legacy_sales_migration(A.derive(spark, sf, "sales", "sales"), _traffic(spark, sf).where("dataset = 'demo'").select("business_id", "date", "hour")), 2, "amount")


@query(" SELECT business_id, date, hour, dataset, round(amount, 2) AS amount, transactions FROM sales", dates=("date",))
def load_sales(spark, sf):
    rows = A.derive(spark, sf, "sales", "sales")
    return rounded(C.load_sales(rows, rows.select("business_id").distinct()), 2, "amount")


_INC = ", inc AS (SELECT event_id AS incident_id, date_trunc('second', ts) AS start, CAST(event_id % 1500 AS DOUBLE) AS duration, concat('b', CAST(user_id % 5 AS VARCHAR)) AS business_id, CASE WHEN user_id % 7 = 0 THEN 'demo' ELSE 'real' END AS dataset, concat('z', CAST(user_id % 6 AS VARCHAR)) AS zone, CASE WHEN event_id % 3 = 0 THEN 'pendiente' ELSE 'resuelto' END AS state FROM events)"


def _incidents(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("incident_id"), F.date_trunc("second", "ts").alias("start"), (F.col("event_id") % 1500).cast("double").alias("duration"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("business_id"),
        F.when(F.col("user_id") % 7 == 0, "demo").otherwise("real").alias("dataset"), F.concat(F.lit("z"), F.col("user_id") % 6).alias("zone"), F.when(F.col("event_id") % 3 == 0, "pendiente").otherwise("resuelto").alias("state"), F.col("ts").alias("created"),
    )


@query(_B + _INC + """, i2 AS (SELECT *, CAST(start AS DATE) AS date, CAST(hour(start) AS INT) AS hour, CAST(epoch(start) AS BIGINT) % 3600 AS off FROM inc),
    sh AS (SELECT dataset, business_id, date, hour, amount FROM sal),
    us AS (SELECT i.dataset, i.business_id, i.date, i.hour, median(s.amount) AS usual, count(*) AS days FROM (SELECT DISTINCT dataset, business_id, date, hour FROM i2) i JOIN sh s ON i.dataset = s.dataset AND i.business_id = s.business_id AND i.hour = s.hour AND dayofweek(i.date) = dayofweek(s.date) AND s.date < i.date GROUP BY ALL HAVING count(*) >= 3)
    SELECT incident_id, dataset, business_id, CAST(start AS VARCHAR) AS start, duration, date, hour, round(amount, 2) AS amount, round(usual, 2) AS usual, coalesce(days, 0) AS days, round(CASE WHEN duration < 3600 AND off + duration <= 3600 AND usual > 0 THEN 100e0 * (amount / usual - 1) END, 2) AS impact FROM i2 LEFT JOIN sh USING (dataset, business_id, date, hour) LEFT JOIN us USING (dataset, business_id, date, hour)
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY start DESC, incident_id) <= 100""", dates=("date",))
def incident_sales_impact(spark, sf):
    return rounded(C.incident_sales_impact(_incidents(spark, sf), _sales(spark, sf)), 2, "impact", "amount", "usual").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(_INC + ", up AS (SELECT incident_id, CASE WHEN incident_id % 5 = 0 THEN 'descartado' ELSE 'nada' END AS new FROM inc WHERE incident_id % 2 = 0) SELECT incident_id, zone, 'pendiente' AS state FROM inc LEFT JOIN up USING (incident_id) WHERE coalesce(CASE WHEN new = 'descartado' THEN new END, state) = 'pendiente' ORDER BY start DESC, incident_id LIMIT 200")
def incident_status(spark, sf):
    rows = _incidents(spark, sf)
    updates = rows.where("incident_id % 2 = 0").select("incident_id", F.when(F.col("incident_id") % 5 == 0, "descartado").otherwise("nada").alias("state"), F.col("start").alias("at"))
    return C.incident_status(rows, updates, "pendiente").select("incident_id", "zone", "state")


@query(_INC + ", d AS (SELECT DISTINCT zone, CAST(floor(hour(start) / 2) AS BIGINT) AS slot, CAST(start AS DATE) AS day FROM inc) SELECT zone, slot, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM d GROUP BY ALL HAVING count(*) >= 2")
def incident_recurrence(spark, sf):
    return C.incident_recurrence(_incidents(spark, sf)).withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


_HIST = """, mi AS (SELECT user_id % 6 AS zone, date_trunc('minute', ts) AS m, CAST(round_even(avg(floor(value)), 0) AS BIGINT) AS mean FROM events GROUP BY 1, 2),
    hi AS (SELECT zone, CAST(m AS DATE) AS date, CAST(hour(m) AS INT) AS hour, CAST(isodow(m) - 1 AS INT) AS weekday, CAST(sum(mean) AS BIGINT) AS total, count(*) AS samples, max(mean) AS peak FROM mi GROUP BY ALL)"""


def _history(spark, sf):
    return C.traffic_history(spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 6).alias("zone"), "ts", F.floor("value").alias("n")))


@query(_HIST + " SELECT * FROM hi", dates=("date",))
def traffic_history(spark, sf):
    return _history(spark, sf)


@query(_HIST + " SELECT zone, hour, weekday, round(sum(total) / sum(samples), 4) AS mean, max(peak) AS peak, count(DISTINCT date) AS days FROM hi WHERE date <> DATE '2024-01-05' GROUP BY ALL")
def traffic_baseline(spark, sf):
    import datetime

    return rounded(C.traffic_baseline(_history(spark, sf), datetime.date(2024, 1, 5)), 4, "mean")


@query(" SELECT concat('v', CAST(user_id % 3 AS VARCHAR)) AS session, concat('b', CAST(user_id % 5 AS VARCHAR)) AS business_id, count(*) AS exits, count(*) FILTER (event_id % 3 = 0) AS matched, count(*) FILTER (event_id % 6 = 0) AS changed, count(*) - count(*) FILTER (event_id % 3 = 0) AS unmatched, round(100e0 * count(*) FILTER (event_id % 3 = 0) / count(*), 4) AS coverage FROM events GROUP BY ALL")
def bag_totals(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    visits = e.select(F.concat(F.lit("v"), F.col("user_id") % 3).alias("session"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("business_id"), (F.col("event_id") % 3 == 0).alias("matched"), (F.col("event_id") % 6 == 0).alias("changed"))
    return rounded(C.bag_totals(visits), 4, "coverage")


#: Events as crossings of four lines a camera; the lines of "click" were moved in the middle of the month, line 1 has a recorded place, and line 3 no door.
_OWNERS = """, cr AS (SELECT event_type AS camera, CAST(user_id % 4 AS INT) AS line_id, CASE WHEN event_id % 2 = 0 THEN 'entry' ELSE 'exit' END AS direction, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, epoch(ts) - epoch(CAST(ts AS DATE)) AS t, event_id FROM events),
    lo AS (SELECT DISTINCT session, camera, line_id, CASE WHEN camera = 'click' AND session < '2024-01-15' THEN 0.7e0 ELSE 0.8e0 END AS bx, CASE WHEN line_id = 1 THEN 'b5' END AS place FROM cr),
    ow AS (SELECT session, camera, line_id, CASE WHEN bx = 0.8e0 AND camera <> 'error' AND line_id < 3 THEN concat('b', CAST(line_id AS VARCHAR)) ELSE place END AS business_id FROM lo)"""


def _doors(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    crossings = e.select(F.to_date("ts").cast("string").alias("session"), F.col("event_type").alias("camera"), (F.col("user_id") % 4).cast("int").alias("line_id"), F.when(F.col("event_id") % 2 == 0, "entry").otherwise("exit").alias("direction"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_date("ts").cast("timestamp"))) / 1e6).alias("t"), "event_id")
    drawn = lambda bx: {"ax": F.lit(0.2), "ay": F.lit(0.5), "bx": bx, "by": F.lit(0.5), "entry_side": F.lit(1), "bands": F.lit(None).cast("string")}
    old = (F.col("camera") == "click") & (F.col("session") < "2024-01-15")
    lines = crossings.select("session", "camera", "line_id").distinct()
    observed = lines.withColumns(drawn(F.when(old, 0.7).otherwise(0.8)) | {"place_id": F.when(F.col("line_id") == 1, "b5")})
    current = lines.select("camera", "line_id").distinct().where("camera <> 'error'").withColumns(drawn(F.lit(0.8)))  # the lines of "error" are gone
    doors = current.where("line_id < 3").select("camera", "line_id", F.concat(F.lit("b"), "line_id").alias("business_id"))
    return crossings, C.line_owners(observed, current, doors)


@query(_OWNERS + """, k AS (SELECT business_id, camera, line_id, count(*) FILTER (direction = 'entry') AS n, count(*) FILTER (direction = 'exit') AS m FROM cr JOIN ow USING (session, camera, line_id) WHERE business_id IS NOT NULL GROUP BY ALL),
    h AS (SELECT business_id, string_agg(concat(CAST(hour AS VARCHAR), ':', CAST(n AS VARCHAR), ':', CAST(m AS VARCHAR)), ' ' ORDER BY hour) AS hours FROM (SELECT business_id, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) FILTER (direction = 'entry') AS n, count(*) FILTER (direction = 'exit') AS m FROM cr JOIN ow USING (session, camera, line_id) WHERE business_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT business_id, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(m) AS BIGINT) AS exits, string_agg(concat(camera, '/', CAST(line_id AS VARCHAR), ':', CAST(n AS VARCHAR), ':', CAST(m AS VARCHAR)), ' ' ORDER BY camera, line_id) AS accesses FROM k GROUP BY ALL)
    SELECT b.business_id, entries, exits, accesses, hours FROM (SELECT concat('b', CAST(b AS VARCHAR)) AS business_id FROM range(7) r(b)) b LEFT JOIN a USING (business_id) LEFT JOIN h USING (business_id)""", "none")
def business_traffic(spark, sf):
    crossings, owners = _doors(spark, sf)
    rows = C.business_traffic(crossings, owners, spark.range(7).select(F.concat(F.lit("b"), "id").alias("business_id")))
    told = lambda *c: F.concat_ws(":", *(x.cast("string") for x in c))
    accesses = F.array_join(F.transform("accesses", lambda a: told(F.concat_ws("/", a["camera"], a["line_id"].cast("string")), a["entries"], a["exits"])), " ")
    hours = F.array_join(F.transform(F.map_entries("hours"), lambda h: told(h["key"], h["value"]["entries"], h["value"]["exits"])), " ")
    return rows.select("business_id", "entries", "exits", accesses.alias("accesses"), hours.alias("hours"))


@query(_OWNERS + " SELECT event_id, session, camera, line_id, direction, business_id FROM cr JOIN ow USING (session, camera, line_id) WHERE business_id IS NOT NULL", "none")
def business_events(spark, sf):
    crossings, owners = _doors(spark, sf)
    return C.business_events(crossings, owners).select("event_id", "session", "camera", "line_id", "direction", "business_id")


def _tables(spark, sf):
    return tuple(A.derive(spark, sf, "points", t) for t in ("images", "points", "quarantine"))


_DIST = ", di AS (SELECT p.split, p.image, x, y, width, height, greatest(-x, x - width, 0e0, -y, y - height) AS distance FROM points p JOIN images USING (split, image))"
_SEV = "CASE WHEN distance <= 5 THEN 'minor' WHEN distance <= 50 THEN 'moderate' ELSE 'severe' END"


@query(" SELECT split, count(*) AS points FROM points GROUP BY ROLLUP (split)", "points")
def annotation_totals(spark, sf):
    return N.annotation_totals(_tables(spark, sf)[1])


@query(_DIST + " SELECT split, image, round(x, 3) AS x, round(y, 3) AS y, round(distance, 3) AS distance FROM di", "points")
def oob_distance(spark, sf):
    images, points, _ = _tables(spark, sf)
    rows = points.join(images.select("split", "image", "width", "height"), ["split", "image"])
    return rounded(rows.select("split", "image", "x", "y", N.oob_distance(*map(F.col, ("x", "y", "width", "height"))).alias("distance")), 3, "x", "y", "distance")


@query(_DIST + f" SELECT split, {_SEV} AS severity, count(*) AS points, count(DISTINCT image) AS images FROM di WHERE distance > 0 GROUP BY ALL", "points")
def oob_severity(spark, sf):
    images, points, _ = _tables(spark, sf)
    return N.severity_counts(points, images)


_AUD = _DIST + """, bad AS (SELECT split, image, count(*) AS n FROM di WHERE distance > 0 GROUP BY ALL),
    au AS (SELECT split, image, CASE WHEN q.reason IS NOT NULL THEN 'quarantined' WHEN NOT readable THEN 'corrupted' WHEN NOT has_annotation THEN 'missing_annotation' WHEN NOT format_ok THEN 'bad_format' WHEN n > 0 THEN 'out_of_bounds' ELSE 'ok' END AS issue, n FROM images LEFT JOIN quarantine q USING (split, image) LEFT JOIN bad USING (split, image))"""


@query(_AUD + " SELECT split, image, issue, CASE WHEN issue = 'out_of_bounds' THEN n ELSE 0 END AS count FROM au", "points")
def audit_issues(spark, sf):
    return N.audit_issues(*_tables(spark, sf))


@query(_AUD + " SELECT split, issue, count(*) AS images, CAST(sum(CASE WHEN issue = 'out_of_bounds' THEN n ELSE 0 END) AS BIGINT) AS points FROM au GROUP BY ALL", "points")
def audit_by_issue(spark, sf):
    return N.audit_by_issue(*_tables(spark, sf))


@query(_AUD + """, rd AS (SELECT split, image FROM au WHERE issue IN ('ok', 'out_of_bounds')), ap AS (SELECT count(*) AS total_points, count(*) FILTER (distance > 0) AS oob_points, count(*) FILTER (distance > 0 AND distance <= 5) AS oob_le_5px, count(*) FILTER (distance > 5 AND distance <= 50) AS oob_5_to_50px, count(*) FILTER (distance > 50) AS oob_gt_50px FROM di SEMI JOIN rd USING (split, image))
    SELECT count(*) AS images, count(*) FILTER (issue IN ('ok', 'out_of_bounds')) AS annotation_files, count(*) FILTER (issue = 'quarantined') AS quarantined_images, count(*) FILTER (issue = 'corrupted') AS corrupted_images, count(*) FILTER (issue = 'missing_annotation') AS missing_annotations, count(*) FILTER (issue = 'bad_format') AS invalid_annotation_format, count(*) FILTER (issue = 'out_of_bounds') AS images_with_oob_points,
      any_value(total_points) AS total_points, any_value(oob_points) AS oob_points, any_value(oob_le_5px) AS oob_le_5px, any_value(oob_5_to_50px) AS oob_5_to_50px, any_value(oob_gt_50px) AS oob_gt_50px FROM au CROSS JOIN ap""", "points")
def audit_dataset(spark, sf):
    return N.audit_dataset(*_tables(spark, sf))


@query(_DIST + " SELECT split, image, count(*) AS points, round(max(distance), 3) AS worst FROM di WHERE distance > 0 GROUP BY ALL ORDER BY points DESC, split, image LIMIT 20", "points")
def rank_oob(spark, sf):
    images, points, _ = _tables(spark, sf)
    return rounded(N.rank_oob(images, points), 3, "worst")


@query(_DIST + " SELECT split, image, count(*) AS points, round(max(distance), 3) AS worst FROM di WHERE distance > 50 AND (split, image) NOT IN (SELECT (split, image) FROM quarantine) GROUP BY ALL ORDER BY points DESC, split, image LIMIT 20", "points")
def rank_severe_oob(spark, sf):
    images, points, quarantine = _tables(spark, sf)
    return rounded(N.rank_oob(images, points, quarantine, 50.0), 3, "worst")


@query(_DIST + f" , sv AS (SELECT split, {_SEV} AS severity, count(*) AS points, count(DISTINCT image) AS images FROM di WHERE distance > 0 AND (split, image) NOT IN (SELECT (split, image) FROM quarantine) GROUP BY ALL) SELECT sv.*, excluded FROM sv LEFT JOIN (SELECT split, count(*) AS excluded FROM quarantine GROUP BY split) USING (split)", "points")
def qa_after_quarantine(spark, sf):
    return N.qa_after_quarantine(*_tables(spark, sf))


_IN = "x >= 0 AND x < width AND y >= 0 AND y < height"


@query(_DIST + f" SELECT split, image, round(x, 3) AS x, round(y, 3) AS y FROM di WHERE {_IN} AND (split, image) NOT IN (SELECT (split, image) FROM quarantine)", "points")
def clean_annotations(spark, sf):
    return rounded(N.clean_annotations(*_tables(spark, sf)), 3, "x", "y")


@query(_DIST + f""", ct AS (SELECT split, image, count(*) AS b, count(*) FILTER ({_IN}) AS a FROM di GROUP BY ALL)
    SELECT split, image, CASE WHEN q.reason IS NOT NULL THEN 'quarantined' WHEN coalesce(a, 0) < coalesce(b, 0) THEN 'cleaned' ELSE 'valid' END AS status, CASE WHEN q.reason IS NULL THEN coalesce(b, 0) END AS before, CASE WHEN q.reason IS NULL THEN coalesce(a, 0) END AS after FROM images LEFT JOIN ct USING (split, image) LEFT JOIN quarantine q USING (split, image)""", "points")
def cleaning_manifest(spark, sf):
    return N.cleaning_manifest(*_tables(spark, sf))


@query(_DIST + f" SELECT split, count(DISTINCT image) AS images, count(*) AS points, CAST(0 AS BIGINT) AS outside FROM di WHERE {_IN} AND (split, image) NOT IN (SELECT (split, image) FROM quarantine) GROUP BY ALL", "points")
def audit_processed(spark, sf):
    images, points, quarantine = _tables(spark, sf)
    return N.audit_processed(images, N.clean_annotations(images, points, quarantine))
