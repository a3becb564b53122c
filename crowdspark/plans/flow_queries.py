"""Queries over recorded positions: consolidation, stays, events, density and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, metrics, stays, trajectories
from ..sources.shared import stored
from . import adapters as A

QUERIES, ORACLE, _register = A.registry()


def query(sql=None, kind="obs", dates=()):
    return _register(sql, kind, dates)


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _obs(spark, sf):
    return A.derive(spark, sf, "obs", "obs")


def _pos(spark, sf):
    return trajectories.speed(trajectories.drop_jumps(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True)))


def _zoned(spark, sf):
    return stays.assign_zone(_pos(spark, sf), A.ZONES)


def _stays(spark, sf):
    return stays.stays(stays.zone_runs(_zoned(spark, sf)))


def _events(spark, sf):
    return stays.spatial_events(_stays(spark, sf), A.zones(spark))


def _sessions(spark, sf):
    rows = A.derive(spark, sf, "legs", "e2").groupBy("session").agg((F.max(F.col("tick0") + F.col("n")) * 0.2).alias("duration"), F.min("ts").alias("origin_ts"))
    return rows


_CONS = """, c0 AS (SELECT session, person_id, tick, sum(greatest(confidence, 1e-3) * t) / sum(greatest(confidence, 1e-3)) AS t,
        sum(greatest(confidence, 1e-3) * x) / sum(greatest(confidence, 1e-3)) AS x, sum(greatest(confidence, 1e-3) * y) / sum(greatest(confidence, 1e-3)) AS y,
        avg(confidence) AS confidence, count(*) AS n_obs FROM obs GROUP BY ALL)"""


def _jump(source: str, target: str) -> str:
    w = "(PARTITION BY session, person_id ORDER BY t)"
    pace = lambda f: f"sqrt(pow(x - {f}(x) OVER w, 2) + pow(y - {f}(y) OVER w, 2)) / greatest(abs(t - {f}(t) OVER w), 1e-3)"
    return f", {target} AS (SELECT session, person_id, tick, t, x, y, confidence, n_obs FROM (SELECT *, {pace('lag')} AS a, {pace('lead')} AS b FROM {source} WINDOW w AS {w}) WHERE NOT coalesce(a > 4 AND b > 4, false))"


_JUMPS = _CONS + _jump("c0", "c1") + _jump("c1", "c2") + _jump("c2", "c3")
_P = "PARTITION BY session, person_id ORDER BY t ROWS BETWEEN"
_SPEED = _JUMPS + f""", p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY session, person_id) > 1 THEN
        sqrt(pow(last_value(x) OVER b - first_value(x) OVER a, 2) + pow(last_value(y) OVER b - first_value(y) OVER a, 2)) / greatest(last_value(t) OVER b - first_value(t) OVER a, 1e-3) END AS speed
        FROM c3 WINDOW a AS ({_P} 2 PRECEDING AND CURRENT ROW), b AS ({_P} CURRENT ROW AND 2 FOLLOWING))"""
_ZONED = _SPEED + f", {A.ZONES_SQL}, z AS (SELECT *, {A.ZONE_OF_SQL} AS zone_id FROM p)"
_RUNS = _ZONED + """, r0 AS (SELECT *, CASE WHEN lag(zone_id) OVER (PARTITION BY session, person_id ORDER BY t) = zone_id THEN 0 ELSE 1 END AS new FROM z),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session, person_id ORDER BY t) AS BIGINT) AS run FROM r0)"""
_STAYS = _RUNS + """, s AS (SELECT session, person_id, run AS stay, zone_id, min(t) AS start_s, max(t) + 0.2e0 AS end_s, avg(confidence) AS confidence, quantile_cont(speed, 0.5) AS median_speed FROM r GROUP BY ALL)"""
_EVENTS = _STAYS + """, s1 AS (SELECT s.*, zones.type, zones.local_id, row_number() OVER (PARTITION BY session, person_id ORDER BY stay) AS nth, count(*) OVER (PARTITION BY session, person_id) AS many FROM s LEFT JOIN zones USING (zone_id)),
        s2 AS (SELECT *, CASE WHEN type = 'INTERIOR' THEN lag(end_s) OVER (PARTITION BY session, person_id, local_id, type ORDER BY stay) END AS left_at FROM s1),
        ev AS (SELECT session, person_id, zone_id, local_id, stay, 'EXPOSURE' AS event_type, start_s, end_s, confidence FROM s2 WHERE type = 'FRONTAGE'
          UNION ALL SELECT session, person_id, zone_id, local_id, stay, 'ENTER', start_s, NULL, confidence * CASE WHEN nth = 1 THEN 0.5e0 ELSE 1e0 END FROM s2 WHERE type = 'INTERIOR'
          UNION ALL SELECT session, person_id, zone_id, local_id, stay, 'RETURN', start_s, NULL, confidence FROM s2 WHERE type = 'INTERIOR' AND start_s - left_at >= 10
          UNION ALL SELECT session, person_id, zone_id, local_id, stay, 'DWELL', start_s, end_s, confidence FROM s2 WHERE type = 'INTERIOR' AND end_s - start_s >= 5
          UNION ALL SELECT session, person_id, zone_id, local_id, stay, 'EXIT', end_s, NULL, confidence FROM s2 WHERE type = 'INTERIOR' AND nth < many
          UNION ALL SELECT session, person_id, zone_id, local_id, stay, 'QUEUE', start_s, end_s, confidence FROM s2 WHERE type = 'COLA' AND end_s - start_s >= 8 AND median_speed <= 0.35e0)"""
_OCC = _ZONED + """, o AS (SELECT session, zone_id, CAST(floor(t) AS BIGINT) AS second, count(DISTINCT person_id) AS people, avg(speed) AS mean_speed FROM z WHERE zone_id >= 0 GROUP BY ALL)"""
_SLOW = """, g0 AS (SELECT o.*, people / area AS density, coalesce(mean_speed, 0) AS v FROM o JOIN zones USING (zone_id)),
        g1 AS (SELECT *, second - row_number() OVER (PARTITION BY session, zone_id ORDER BY second) AS island FROM g0 WHERE people >= 3 AND density >= 0.25e0 AND v <= 0.5e0),
        g AS (SELECT session, zone_id, min(second) AS start_s, max(second) + 1 AS end_s, max(people) AS people_max, max(density) AS density_max, avg(v) AS mean_speed FROM g1 GROUP BY session, zone_id, island HAVING max(second) + 1 - min(second) >= 5)"""
_SEQ = _STAYS + """, q0 AS (SELECT *, lag(zone_id) OVER (PARTITION BY session, person_id ORDER BY stay) AS b FROM s WHERE zone_id >= 0),
        q AS (SELECT session, person_id, list(zone_id ORDER BY stay) AS zones FROM q0 WHERE b IS NULL OR b <> zone_id GROUP BY ALL)"""
_DUR = ", ses AS (SELECT session, max(tick0 + n) * 0.2e0 AS duration, min(ts) AS origin_ts FROM e2 GROUP BY session)"


@query(_CONS + " SELECT session, person_id, tick, round(t, 4) AS t, round(x, 4) AS x, round(y, 4) AS y, round(confidence, 4) AS confidence, n_obs FROM c0")
def consolidate(spark, sf):
    return rounded(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True), 4, "t", "x", "y", "confidence")


@query(_JUMPS + " SELECT session, person_id, tick, round(x, 4) AS x, round(y, 4) AS y FROM c3")
def drop_jumps(spark, sf):
    return rounded(trajectories.drop_jumps(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True)), 4, "x", "y").select("session", "person_id", "tick", "x", "y")


@query(_SPEED + " SELECT session, person_id, tick, round(speed, 4) AS speed FROM p")
def speed(spark, sf):
    return rounded(_pos(spark, sf), 4, "speed").select("session", "person_id", "tick", "speed")


@query(_ZONED + " SELECT session, person_id, tick, zone_id FROM z")
def assign_zone(spark, sf):
    return _zoned(spark, sf).select("session", "person_id", "tick", "zone_id")


@query(_RUNS + " SELECT session, person_id, run, zone_id, round(min(t), 4) AS first_t, round(max(t), 4) AS last_t, count(*) AS n FROM r GROUP BY ALL")
def zone_runs(spark, sf):
    return rounded(stays.run_table(stays.zone_runs(_zoned(spark, sf))), 4, "first_t", "last_t")


@query()
def merge_stays(spark, sf):
    return stays.merge_stays(stays.zone_runs(_zoned(spark, sf)), A.ZONES)


@query(_STAYS + " SELECT session, person_id, stay, zone_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, round(confidence, 4) AS confidence, round(median_speed, 4) AS median_speed FROM s", )
def stays_of_runs(spark, sf):
    return rounded(rounded(_stays(spark, sf), 4, "confidence", "median_speed"), 3, "start_s", "end_s")


@query()
def merged_stays(spark, sf):
    return stays.merged_stays(stays.zone_runs(_zoned(spark, sf)), A.ZONES)


@query(_EVENTS + " SELECT session, person_id, zone_id, local_id, stay, event_type, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, round(confidence, 4) AS confidence FROM ev")
def spatial_events(spark, sf):
    return rounded(rounded(_events(spark, sf), 4, "confidence"), 3, "start_s", "end_s")


@query(_EVENTS + " SELECT session, event_type, count(*) AS n FROM ev GROUP BY ALL")
def event_counts(spark, sf):
    return stays.event_counts(_events(spark, sf))


#: Mean length of the stays inside a business; by one more column of ``s`` and tables to join where given.
_INSIDE = "inn AS (SELECT session, local_id{0}, " + A.mean_seconds_sql("end_s - start_s") + " AS mean_stay FROM s JOIN zones USING (zone_id){1} WHERE type = 'INTERIOR' GROUP BY ALL)"


@query(_EVENTS + """, m AS (SELECT session, local_id, person_id, min(start_s) FILTER (event_type = 'EXPOSURE') AS seen, max(start_s) FILTER (event_type = 'ENTER') AS entered, count(*) FILTER (event_type = 'RETURN') AS returns
        FROM ev WHERE local_id IS NOT NULL GROUP BY ALL), m2 AS (SELECT session, local_id, count(seen) AS exposed, count(entered) AS visits, count(*) FILTER (entered >= seen) AS captured, CAST(sum(returns) AS BIGINT) AS returns FROM m GROUP BY ALL),
        """ + _INSIDE.format("", "") + """ SELECT session, local_id, exposed, visits, captured, returns, round(CASE WHEN exposed > 0 THEN 100e0 * captured / exposed END, 4) AS rate, round(mean_stay, 3) AS mean_stay FROM m2 LEFT JOIN inn USING (session, local_id)""")
def capture_rate(spark, sf):
    stay, zones = stored(_stays(spark, sf), "stays"), A.zones(spark)
    return rounded(rounded(metrics.capture_rate(stays.spatial_events(stay, zones), stay, zones), 4, "rate"), 3, "mean_stay")


@query(_OCC + " SELECT session, zone_id, second, people, round(mean_speed, 4) AS mean_speed FROM o")
def occupancy_per_second(spark, sf):
    return rounded(metrics.occupancy_per_second(_zoned(spark, sf)), 4, "mean_speed")


@query(_OCC + _SLOW + " SELECT session, zone_id, start_s, end_s, people_max, round(density_max, 4) AS density_max, round(mean_speed, 4) AS mean_speed FROM g")
def congestion_episodes(spark, sf):
    return rounded(metrics.congestion_episodes(metrics.occupancy_per_second(_zoned(spark, sf)), A.zones(spark)), 4, "density_max", "mean_speed")


@query(_EVENTS + _OCC[len(_ZONED):] + _SLOW + ", f AS (SELECT session, zone_id, count(DISTINCT person_id) AS visitors, " + A.mean_seconds_sql("end_s - start_s") + """ AS mean_stay, quantile_cont(end_s - start_s, 0.5) AS median_stay FROM s WHERE zone_id >= 0 GROUP BY ALL),
        h AS (SELECT session, zone_id, count(DISTINCT CASE WHEN event_type = 'ENTER' THEN person_id END) AS visits, count(DISTINCT CASE WHEN event_type = 'EXPOSURE' THEN person_id END) AS exposure, count(*) FILTER (event_type = 'RETURN') AS returns, count(*) FILTER (event_type = 'QUEUE') AS queues FROM ev GROUP BY ALL),
        b AS (SELECT session, zone_id, max(people) AS max_occupancy, avg(mean_speed) AS mean_speed FROM o GROUP BY ALL),
        w AS (SELECT session, zone_id, CAST(sum(end_s - start_s) AS BIGINT) AS congestion_s FROM g GROUP BY ALL)
        SELECT session, zone_id, coalesce(visitors, 0) AS visitors, coalesce(visits, 0) AS visits, coalesce(exposure, 0) AS exposure, coalesce(returns, 0) AS returns, coalesce(queues, 0) AS queues, coalesce(max_occupancy, 0) AS max_occupancy, coalesce(congestion_s, 0) AS congestion_s,
          round(mean_stay, 3) AS mean_stay, round(median_stay, 3) AS median_stay, round(b.mean_speed, 4) AS mean_speed, round(coalesce(max_occupancy, 0) / area, 4) AS max_density
        FROM (SELECT DISTINCT session FROM e2) CROSS JOIN zones LEFT JOIN f USING (session, zone_id) LEFT JOIN h USING (session, zone_id) LEFT JOIN b USING (session, zone_id) LEFT JOIN w USING (session, zone_id)""")
def zone_metrics(spark, sf):
    pos = stored(_zoned(spark, sf), "zoned")
    occupancy = stored(metrics.occupancy_per_second(pos), "occupancy")
    stay = stored(stays.stays(stays.zone_runs(pos)), "stays")
    zones = A.zones(spark)
    rows = metrics.zone_metrics(_sessions(spark, sf), zones, stay, stays.spatial_events(stay, zones), occupancy, metrics.congestion_episodes(occupancy, zones))
    return rounded(rounded(rows, 3, "mean_stay", "median_stay"), 4, "mean_speed", "max_density")


@query(_SEQ + " SELECT session, person_id, array_to_string(zones, '>') AS zones FROM q")
def zone_sequences(spark, sf):
    return density.zone_sequences(_stays(spark, sf)).withColumn("zones", F.array_join("zones", ">"))


@query(_SEQ + """, od AS (SELECT DISTINCT session, person_id, zones[i] AS from_zone, zones[i + 1] AS to_zone FROM (SELECT *, unnest(range(1, len(zones))) AS i FROM q)) SELECT session, from_zone, to_zone, count(*) AS people FROM od GROUP BY ALL""")
def origin_destination(spark, sf):
    return density.origin_destination(density.zone_sequences(_stays(spark, sf)))


def _grown(k: int) -> str:
    """Patterns of k zones, each with its earliest end in a sequence."""
    return f"p{k} AS (SELECT p.session, p.person_id, list_append(p.p, i.zone) AS p, min(i.k) AS k FROM p{k - 1} p JOIN i ON p.session = i.session AND p.person_id = i.person_id AND i.k > p.k GROUP BY ALL), "


@query(_SEQ + """, i AS (SELECT session, person_id, zones[k] AS zone, k FROM (SELECT *, unnest(range(1, len(zones) + 1)) AS k FROM q)), n AS (SELECT session, count(*) AS n, greatest(2, ceil(count(*) * 0.1e0)) AS need FROM q GROUP BY session),
        p1 AS (SELECT session, person_id, [zone] AS p, min(k) AS k FROM i GROUP BY ALL), """ + "".join(map(_grown, range(2, 6))) + """
        u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5), v AS (SELECT session, p, count(*) AS support FROM u GROUP BY ALL),
        x AS (SELECT v.*, n.n, row_number() OVER (PARTITION BY v.session ORDER BY support DESC, len(p) DESC, p) AS k FROM v JOIN n USING (session) WHERE support >= need AND len(list_filter(range(1, len(p)), lambda j: p[j] = p[j + 1])) = 0)
        SELECT session, array_to_string(p, '>') AS pattern, support, round(100e0 * support / n, 4) AS percent FROM x WHERE k <= 15""")
def frequent_routes(spark, sf):
    sequences = stored(density.zone_sequences(_stays(spark, sf)), "sequences")
    return rounded(density.frequent_routes(sequences), 4, "percent")


@query(_JUMPS + """, f0 AS (SELECT session, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM c3 WINDOW w AS (PARTITION BY session, person_id ORDER BY t)), f1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM f0)
        SELECT session, CAST(floor(x / 1e0) AS INT) AS cx, CAST(floor(y / 1e0) AS INT) AS cy, CAST((round_even(atan2(dy, dx) / (pi() / 4), 0) + 8) % 8 AS INT) AS direction, round(sum(d), 3) AS distance, count(*) AS samples
        FROM f1 WHERE dt > 0 AND dt <= 2 AND d > 0.02e0 AND d <= 5 * dt GROUP BY 1, 2, 3, 4""")
def flow_field(spark, sf):
    pos = trajectories.drop_jumps(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True))
    return rounded(density.flow_field(pos, 1.0), 3, "distance")


def _bell(d: str) -> str:
    return f"CASE WHEN abs({d}) <= 4e0 THEN exp(-0.5e0 * ({d}) * ({d})) ELSE 0 END / sqrt(2 * pi())"


@query(_JUMPS + f""", w AS (SELECT session, x, y, 0.2e0 AS weight FROM c3), cells AS (SELECT r, c FROM range(8) a(r), range(12) b(c)),
        v AS (SELECT session, CAST(r AS INT) AS row, CAST(c AS INT) AS col, sum(weight * ({_bell('x - (c + 0.5e0)')}) * ({_bell('y - (r + 0.5e0)')})) AS value FROM w CROSS JOIN cells GROUP BY ALL)
        SELECT session, row, col, round(value, 6) AS value FROM v WHERE round(value, 6) > 0""")
def kde_occupancy(spark, sf):
    pos = trajectories.drop_jumps(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True))
    return rounded(density.kde(pos.withColumn("weight", F.lit(0.2)), 12.0, 8.0, 1.0, 1.0), 6, "value").where("value > 0")


@query(_JUMPS + f""", w AS (SELECT session, x, y, 1e0 / count(*) OVER (PARTITION BY session, person_id) AS weight FROM c3), cells AS (SELECT r, c FROM range(8) a(r), range(12) b(c)),
        v AS (SELECT session, CAST(r AS INT) AS row, CAST(c AS INT) AS col, sum(weight * ({_bell('x - (c + 0.5e0)')}) * ({_bell('y - (r + 0.5e0)')})) AS value FROM w CROSS JOIN cells GROUP BY ALL)
        SELECT session, row, col, round(value, 6) AS value FROM v WHERE round(value, 6) > 0""")
def kde_visitors(spark, sf):
    pos = trajectories.drop_jumps(trajectories.consolidate(_obs(spark, sf), tick=F.col("tick"), dealt=True))
    pos = pos.withColumn("weight", 1.0 / F.count("*").over(trajectories.Window.partitionBy("session", "person_id")))
    return rounded(density.kde(pos, 12.0, 8.0, 1.0, 1.0), 6, "value").where("value > 0")


_STEP = "CASE " + " ".join(f"WHEN duration <= {s * 24} THEN {s}" for s in metrics.ROUND_STEPS) + " ELSE 86400 END"


@query(_DUR + f" SELECT session, {_STEP} AS step FROM ses", kind="legs")
def nice_step(spark, sf):
    return _sessions(spark, sf).select("session", metrics.nice_step(F.col("duration")).alias("step"))


@query(_EVENTS + _OCC[len(_ZONED):] + _DUR + f""", t0 AS (SELECT session, {_STEP} AS step, CAST(greatest(1, ceil(duration / ({_STEP}))) AS BIGINT) AS n FROM ses),
        sc AS (SELECT concat('zone:', CAST(zone_id AS VARCHAR)) AS scope, area FROM zones UNION ALL SELECT DISTINCT concat('local:', local_id), CAST(NULL AS DOUBLE) FROM zones WHERE local_id IS NOT NULL UNION ALL SELECT 'total', NULL),
        spine AS (SELECT session, step, n, scope, area, unnest(range(n)) AS bucket FROM t0 CROSS JOIN sc),
        pp AS (SELECT session, 'total' AS scope, floor(t) AS second, count(DISTINCT person_id) AS people FROM z GROUP BY ALL UNION ALL SELECT session, concat('zone:', CAST(zone_id AS VARCHAR)), second, people FROM o),
        mm AS (SELECT session, scope, least(CAST(floor(second / step) AS BIGINT), n - 1) AS bucket, max(people) AS people FROM pp JOIN t0 USING (session) GROUP BY ALL),
        sx AS (SELECT session, unnest(['total', concat('zone:', CAST(zone_id AS VARCHAR))]) AS scope, least(CAST(floor(start_s / step) AS BIGINT), n - 1) AS bucket, end_s - start_s AS d FROM s JOIN t0 USING (session) WHERE zone_id >= 0),
        ss AS (SELECT session, scope, bucket, count(*) AS entries, {A.mean_seconds_sql("d")} AS mean_stay FROM sx GROUP BY ALL),
        cx AS (SELECT session, unnest(['total', concat('zone:', CAST(zone_id AS VARCHAR))]) AS scope, least(CAST(floor(start_s / step) AS BIGINT), n - 1) AS bucket, event_type FROM ev JOIN t0 USING (session)),
        cc AS (SELECT session, scope, bucket, count(*) FILTER (event_type = 'ENTER') AS visits, count(*) FILTER (event_type = 'EXPOSURE') AS exposure FROM cx GROUP BY ALL),
        f0 AS (SELECT session, local_id, person_id, min(start_s) AS t0 FROM ev WHERE local_id IS NOT NULL AND event_type = 'EXPOSURE' GROUP BY ALL),
        w0 AS (SELECT session, local_id, person_id, min(start_s) AS t0 FROM ev JOIN (SELECT session, local_id, person_id, t0 AS ts FROM f0) USING (session, local_id, person_id) WHERE event_type = 'ENTER' AND start_s >= ts GROUP BY ALL),
        f1 AS (SELECT session, unnest(['total', concat('local:', local_id)]) AS scope, least(CAST(floor(f0.t0 / step) AS BIGINT), n - 1) AS bucket FROM f0 JOIN t0 USING (session)), f2 AS (SELECT session, scope, bucket, count(*) AS seen FROM f1 GROUP BY ALL),
        w1 AS (SELECT session, unnest(['total', concat('local:', local_id)]) AS scope, least(CAST(floor(w0.t0 / step) AS BIGINT), n - 1) AS bucket FROM w0 JOIN t0 USING (session)), w2 AS (SELECT session, scope, bucket, count(*) AS won FROM w1 GROUP BY ALL),
        j AS (SELECT session, scope, bucket, step, area, scope LIKE 'local:%' AS shop, coalesce(people, 0) AS people, coalesce(entries, 0) AS entries, coalesce(visits, 0) AS visits, coalesce(exposure, 0) AS exposure, mean_stay, sum(coalesce(seen, 0)) OVER w AS a, sum(coalesce(won, 0)) OVER w AS b,
                max(CASE WHEN scope LIKE 'zone:%' THEN coalesce(people, 0) / area END) OVER (PARTITION BY session, bucket) AS densest
          FROM spine LEFT JOIN mm USING (session, scope, bucket) LEFT JOIN ss USING (session, scope, bucket) LEFT JOIN cc USING (session, scope, bucket) LEFT JOIN f2 USING (session, scope, bucket) LEFT JOIN w2 USING (session, scope, bucket) WINDOW w AS (PARTITION BY session, scope ORDER BY bucket))
        SELECT session, scope, bucket, step, CASE WHEN NOT shop THEN people END AS people, CASE WHEN NOT shop THEN entries END AS entries, CASE WHEN NOT shop THEN visits END AS visits, CASE WHEN NOT shop THEN exposure END AS exposure,
          round(CASE WHEN scope = 'total' THEN densest WHEN NOT shop THEN people / area END, 4) AS density, round(mean_stay, 3) AS mean_stay, round(CASE WHEN scope NOT LIKE 'zone:%' AND a > 0 THEN 100e0 * b / a END, 4) AS capture FROM j""")
def time_series(spark, sf):
    pos = stored(_zoned(spark, sf), "zoned")
    zones = A.zones(spark)
    stay = stored(stays.stays(stays.zone_runs(pos)), "stays")
    rows = metrics.time_series(_sessions(spark, sf), zones, metrics.people_per_second(pos), metrics.occupancy_per_second(pos), stay, stays.spatial_events(stay, zones))
    return rounded(rounded(rows, 4, "capture", "density"), 3, "mean_stay")


@query(_EVENTS + _DUR + """, k0 AS (SELECT session, duration, floor(epoch(origin_ts)) - 18000 AS o FROM ses), k1 AS (SELECT *, unnest(range(CAST(floor(o / 3600) AS BIGINT), CAST(floor((o + duration) / 3600) AS BIGINT) + 1)) AS h FROM k0),
        k2 AS (SELECT session, local_id, CAST(floor((o + start_s) / 3600) AS BIGINT) AS h, count(DISTINCT CASE WHEN event_type = 'EXPOSURE' THEN person_id END) AS exposure, count(DISTINCT CASE WHEN event_type = 'ENTER' THEN person_id END) AS visits FROM ev JOIN k0 USING (session) WHERE local_id IS NOT NULL GROUP BY ALL), """ + _INSIDE.format(", CAST(floor((o + start_s) / 3600) AS BIGINT) AS h", " JOIN k0 USING (session)") + """
        SELECT k1.session, 'L1' AS local_id, CAST(make_timestamp(k1.h * 3600000000) AS DATE) AS date, CAST(k1.h % 24 AS INT) AS hour, coalesce(exposure, 0) AS exposure, coalesce(visits, 0) AS visits, round(mean_stay, 3) AS mean_stay, round(greatest(0, least(k1.o + duration, (k1.h + 1) * 3600) - greatest(k1.o, k1.h * 3600)), 3) AS coverage_s
        FROM k1 LEFT JOIN k2 ON k1.session = k2.session AND k1.h = k2.h LEFT JOIN inn ON k1.session = inn.session AND k1.h = inn.h""", dates=("date",))
def hourly_by_business(spark, sf):
    stay, zones = stored(_stays(spark, sf), "stays"), A.zones(spark)
    return rounded(metrics.hourly_by_business(_sessions(spark, sf), stays.spatial_events(stay, zones), zones.where("local_id IS NOT NULL"), stay), 3, "coverage_s", "mean_stay")


@query(_EVENTS + """, ic AS (SELECT session, count(*) AS events FROM ev GROUP BY session) SELECT z.session, count(DISTINCT person_id) AS people, count(*) AS positions, count(*) FILTER (zone_id >= 0) AS in_zone, count(*) FILTER (x < 1) AS moved,
        CAST(4 AS BIGINT) AS zones, CAST(1 AS BIGINT) AS businesses, CAST(2 AS INT) AS obstacles, coalesce(any_value(events), 0) AS events FROM z LEFT JOIN ic USING (session) GROUP BY z.session""")
def insights_summary(spark, sf):
    pos = stored(_zoned(spark, sf), "zoned").withColumn("moved", F.col("x") < 1)
    zones = A.zones(spark)
    return metrics.insights_summary(pos, zones, stays.spatial_events(stays.stays(stays.zone_runs(pos)), zones), 2)


@query(_EVENTS + """, m AS (SELECT session, local_id, person_id, min(start_s) FILTER (event_type = 'EXPOSURE') AS seen, max(start_s) FILTER (event_type = 'ENTER') AS entered FROM ev WHERE local_id IS NOT NULL GROUP BY ALL)
        SELECT count(seen) AS exposed, count(entered) AS visits, round(100e0 * count(*) FILTER (entered >= seen) / nullif(count(seen), 0), 4) AS capture FROM m""")
def insights_totals(spark, sf):
    return rounded(metrics.insights_totals(metrics.capture_rate(_events(spark, sf))), 4, "capture")
