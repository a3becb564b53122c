"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counters import heat_cells
from .density import flow_field
from .trajectories import ranked, report_series


def report_cameras(counting: DataFrame, crossings: DataFrame) -> DataFrame:
    """Camera table: last time and count, peak and its time, mean, entries and exits (0 where nothing crossed)."""
    sums = crossings.groupBy("session", "camera").agg(*(F.sum((F.col("direction") == d).cast("long")).alias(n) for d, n in (("entry", "entries"), ("exit", "exits"))))
    return counting.join(sums, ["session", "camera"], "left").fillna(0, ["entries", "exits"]).select("session", "camera", "last_t", "count", "peak", "peak_at", "mean", "entries", "exits")


def nearest_camera(x: Column, y: Column, cameras: list[tuple[str, float, float]]) -> Column:
    """The name of the camera (name, x, y) nearest to a position, ties by name. A plan has few cameras."""
    away = [F.struct((F.pow(x - cx, 2) + F.pow(y - cy, 2)).alias("d"), F.lit(name).alias("camera")) for name, cx, cy in cameras]
    return F.array_min(F.array(*away))["camera"]


def report_sectors(cells: DataFrame, grid: float, cameras: list[tuple[str, float, float]]) -> DataFrame:
    """Heat cells ranked by time, with their corner and the camera nearest to it."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seconds"), "cx", "cy"))
    x, y = F.col("cx") * grid, F.col("cy") * grid
    return cells.select("session", rank.alias("rank"), nearest_camera(x, y, cameras).alias("camera"), x.alias("x"), y.alias("y"), "seconds", "peak", "visits")


def report_occupancy(occupancy: DataFrame) -> DataFrame:
    """Zone table of a session: the last sample's people, and person-seconds, peak and visitors up to it."""
    last = occupancy.groupBy("session", "zone_id").agg(F.max_by(F.struct("count", "seconds", "peak", "visits", "duration", "alert"), "t").alias("z"))
    return last.select("session", "zone_id", "z.*")


def crossing_list(flows: DataFrame, lines: DataFrame) -> DataFrame:
    """Zone flows and line crossings as one list."""
    a = flows.select("session", F.col("zone_id").cast("string").alias("place"), "person_id", "t", "direction", F.lit("zone").alias("kind"))
    return a.unionByName(lines.select("session", F.concat_ws("/", "camera", "line_id").alias("place"), "person_id", "t", "direction", F.lit("line").alias("kind")))


def report_crossings(flows: DataFrame, lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """By place (a zone, or camera/line): entries, exits and the last crossing.

    With ``places`` (session, place, kind) those that nothing crossed are there too, with 0, 0 and null.
    """
    ways = [F.sum((F.col("direction") == d).cast("long")).alias(n) for d, n in (("entry", "entries"), ("exit", "exits"))]
    key = ["session", "place", "kind"]
    found = crossing_list(flows, lines).groupBy(*key).agg(*ways, F.max("t").alias("last_crossing"))
    return found if places is None else places.select(*key).distinct().join(found, key, "full").fillna(0, ["entries", "exits"]).select(*found.columns)


def report_flow(series: DataFrame) -> DataFrame:
    """Mean, peak and samples of a count series by hour since the session began."""
    return series.groupBy("session", F.floor(F.col("t") / 3600).alias("hour")).agg(F.avg("count").alias("mean"), F.max("count").alias("peak"), F.count("*").alias("samples"))


#: The verdicts of the zone ranking.
VERDICTS = {"alert": "Aglomeración recurrente, revisar flujo", "both": "Mayor tráfico y permanencia", "traffic": "Zona de paso, poca permanencia", "dwell": "Punto de permanencia, poco tráfico", "none": "Tráfico moderado"}


def business_report(zones: DataFrame) -> DataFrame:
    """Zones (session, zone_id, seconds, visits, peak, alert) ranked by time, with mean stay and a verdict against the session's medians."""
    mid = zones.groupBy("session").agg(F.percentile("seconds", F.lit(0.5)).alias("ms"), F.percentile("visits", F.lit(0.5)).alias("mv"))
    rows = zones.join(mid, "session").withColumn("mean_stay", F.try_divide(F.col("seconds"), F.col("visits")))
    long, many = F.col("seconds") >= F.col("ms"), F.col("visits") >= F.col("mv")
    verdict = F.when(F.col("alert"), VERDICTS["alert"]).when(long & many, VERDICTS["both"]).when(many, VERDICTS["traffic"]).when(long, VERDICTS["dwell"]).otherwise(VERDICTS["none"])
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seconds"), "zone_id"))
    return rows.withColumn("verdict", verdict).withColumn("rank", rank).withColumn("passing", many & ~long & (F.col("rank") > 1)).drop("ms", "mv")


def business_kpis(series: DataFrame, ranking: DataFrame, metrics: DataFrame) -> DataFrame:
    """By session: peak and its time (the first), top zone and its seconds, mean observed seconds, alerts."""
    peak = series.groupBy("session").agg(F.max("count").alias("peak"), F.min_by("t", F.struct(-F.col("count"), "t")).alias("peak_t"))
    top = ranking.where("rank = 1").select("session", F.col("zone_id").alias("top_zone"), F.col("seconds").alias("top_seconds"))
    return metrics.select("session", "mean_observed", "alerts").join(peak, "session", "left").join(top, "session", "left")


def business_recommendations(ranking: DataFrame, cameras: DataFrame) -> DataFrame:
    """(session, kind, zones, number): what the ranking and ``cameras`` (session, active, total) give reason for.

    ``top``: the zone of most time, if any; ``alert``: zones with crowds; ``passing``: zones of much traffic and short
    stays; ``coverage``: fewer cameras gave results than there are; ``none`` where nothing else holds.
    """
    zones = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("rank", "zone_id")))), lambda z: z["zone_id"].cast("string")), ",")
    found = ranking.groupBy("session").agg(*(zones(on).alias(k) for k, on in (("top", (F.col("rank") == 1) & (F.col("seconds") > 0)), ("alert", F.col("alert")), ("passing", F.col("passing")))), F.max(F.when(F.col("rank") == 1, F.col("seconds"))).alias("s"))
    rows = cameras.join(found, "session", "left")
    kinds = F.array_compact(F.array(*(F.when(F.col(k) != "", F.struct(F.lit(k).alias("kind"), F.col(k).alias("zones"), (F.round("s", 3) if k == "top" else F.lit(None).cast("double")).alias("number"))) for k in ("top", "alert", "passing")),
        F.when(F.col("active") < F.col("total"), F.struct(F.lit("coverage").alias("kind"), F.lit("").alias("zones"), F.col("active").cast("double").alias("number")))))
    nothing = F.array(F.struct(F.lit("none").alias("kind"), F.lit("").alias("zones"), F.lit(None).cast("double").alias("number")))
    return rows.select("session", F.inline(F.when(F.size(kinds) > 0, kinds).otherwise(nothing)))


def sample_confidence(zones: DataFrame) -> DataFrame:
    """Low under five visits, high from half of the most visited on, partial between."""
    most = zones.groupBy("session").agg(F.max("visits").alias("most"))
    return zones.join(most, "session").withColumn("confidence", F.when(F.col("visits") < 5, "low").when(2 * F.col("visits") >= F.col("most"), "high").otherwise("partial")).drop("most")


def report_access_events(crossings: DataFrame, order: list[str]) -> DataFrame:
    """Crossing log of each session, numbered in order; places are counted in stretches of a session."""
    return ranked(crossings, order).withColumn("nth", F.col("i") + 1).drop("i", "n")


def session_report(sessions: DataFrame, series: DataFrame, project: str | None = None) -> DataFrame:
    """Totals of the project's sessions that are not running: last time, peak, samples, people.

    People are the final number (``final_people``) where identities were closed, else the peak. A running session and
    one of another project have no report.
    """
    sums = series.groupBy("session").agg(F.max("t").alias("last_t"), F.max("count").alias("peak"), F.count("*").alias("samples"))
    rows = sessions.where((F.col("status") != "running") & F.col("project_id").eqNullSafe(F.lit(project))).join(sums, "session")
    return rows.select("session", "status", "last_t", "peak", "samples", F.coalesce("final_people", "peak").alias("people"))


def session_series(sessions: DataFrame, series: DataFrame, project: str | None = None, cap: int = 3600) -> DataFrame:
    """The count series that goes with ``session_report``, thinned to ``cap`` rows a session."""
    mine = sessions.where((F.col("status") != "running") & F.col("project_id").eqNullSafe(F.lit(project))).select("session")
    return report_series(series.join(mine, "session", "left_semi"), cap)


def stale_observations(sessions: DataFrame, observations: DataFrame, version: int = 2) -> DataFrame:
    """Observations of finished sessions whose maps are older than ``version``, to make them anew from."""
    old = sessions.where(F.col("status").isin("done", "error") & (F.coalesce("version", F.lit(0)) < version)).select("session")
    return observations.join(old, "session", "left_semi")


def rebuild_maps(sessions: DataFrame, observations: DataFrame, grid: float, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(heat cells, flow cells) anew for finished sessions whose maps are older than ``version``.

    ``observations`` has session, plan_id, camera, t, person_id, x, y. Both are by session and scope: ``level:<plan>``
    and ``camera:<id>``.
    """
    old = stale_observations(sessions, observations, version)
    scopes = F.explode(F.array(F.concat(F.lit("level:"), "plan_id"), F.concat(F.lit("camera:"), "camera"))).alias("scope")
    rows = old.select("*", scopes).withColumn("session", F.concat_ws("|", "session", "scope"))
    apart = lambda df: df.withColumn("scope", F.substring_index("session", "|", -1)).withColumn("session", F.substring_index("session", "|", 1))
    people = rows.groupBy("session", "t", "person_id").agg(F.max(F.struct("camera", "x", "y")).alias("p")).select("session", "t", "person_id", "p.*")
    return apart(heat_cells(people, grid)), apart(flow_field(people, grid))
