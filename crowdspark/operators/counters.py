"""Live counters in batch form: heat, occupancy, crowding, crossings and flows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import stored
from . import near


def observed(rows: DataFrame) -> DataFrame:
    """Rows of people who were seen: those marked ``predicted``, where there is such a column, go."""
    return rows.where(~F.coalesce("predicted", F.lit(False))) if "predicted" in rows.columns else rows


#: Seconds of a block of instants, where rows do not tell their own.
BLOCK_S = 12.8


def in_blocks(obs: DataFrame) -> DataFrame:
    """Rows with ``block``, which grows with t: their own, or else blocks of BLOCK_S seconds."""
    return obs if "block" in obs.columns else obs.withColumn("block", F.floor(F.col("t") / BLOCK_S))


def heat_cells(obs: DataFrame, grid: float, top: int = 80, instants: DataFrame | None = None) -> DataFrame:
    """Person-seconds (this sample's people times the time since the last, 2 s at most), peak and visitors by cell; ``top`` a session.

    Predicted people don't count, but their samples are samples. ``instants`` are the rows of ``obs`` once more, with ``block`` (a number
    that grows with t) and dealt out by session and block: then people, counts and steps of a block stay in its task, and one row
    a block and cell leaves it, with what its first sample holds apart, as that step begins in the block before.
    """
    place = lambda c: F.floor(c / grid).cast("int")
    rows = in_blocks(obs if instants is None else instants).where("session IS NOT NULL AND t IS NOT NULL")
    seen = ~F.coalesce("predicted", F.lit(False)) if "predicted" in rows.columns else F.lit(True)
    people = rows.groupBy("session", "block", "t", "person_id").agg(F.max(F.when(seen, F.struct("camera", "x", "y"))).alias("p"))
    counts = people.groupBy("session", "block", "t", place(F.col("p.x")).alias("cx"), place(F.col("p.y")).alias("cy")).agg(F.count("p").alias("n"))
    own = Window.partitionBy("session", "block").orderBy("t")
    counts = counts.withColumns({"gap": F.col("t") - F.lag("t").over(own), "t0": F.first("t").over(own)})
    counts = counts.withColumn("dt", F.least(F.max("gap").over(Window.partitionBy("session", "block", "t")), F.lit(2.0)))  # rows of one sample have no gap between them
    begins = F.col("t") == F.col("t0")
    seconds, begun = F.sum(F.when(begins, 0.0).otherwise(F.col("n") * F.col("dt"))), F.sum(F.when(begins, F.col("n")).otherwise(0))
    parts = counts.groupBy("session", "block", "cx", "cy").agg(seconds.alias("seconds"), begun.alias("begun"), F.max("n").alias("peak"), F.min("t0").alias("t0"), F.max("t").alias("t1"))
    parts = stored(parts, "heat-blocks")
    blocks = parts.groupBy("session", "block").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    since = F.col("t0") - F.lag("t1").over(Window.partitionBy("session").orderBy("block"))
    blocks = blocks.select("session", "block", F.least(F.coalesce(since, F.lit(0.0)), F.lit(2.0)).alias("step"))
    cells = parts.where("cx IS NOT NULL AND cy IS NOT NULL").join(blocks, ["session", "block"]).groupBy("session", "cx", "cy").agg(F.sum(F.col("seconds") + F.col("begun") * F.col("step")).alias("seconds"), F.max("peak").alias("peak"))
    mine = observed(obs).where("session IS NOT NULL AND t IS NOT NULL").groupBy("session", "t", "person_id").agg(F.max(F.struct("camera", "x", "y")).alias("p"))
    visits = mine.select("session", place(F.col("p.x")).alias("cx"), place(F.col("p.y")).alias("cy"), "person_id").distinct().groupBy("session", "cx", "cy").agg(F.count("*").alias("visits"))
    rank = Window.partitionBy("session").orderBy(F.desc(F.round("seconds", 3)), "cx", "cy")
    return cells.join(visits, ["session", "cx", "cy"]).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top).drop("k")


def islands(rows: DataFrame, keys: list[str], on: Column, order: str = "t") -> DataFrame:
    """Number runs of rows where ``on`` holds without a break; other rows go."""
    own = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_start", F.col("_on") & ~F.coalesce(F.lag("_on").over(own), F.lit(False)))
    return marked.withColumn("run", F.sum(F.col("_start").cast("int")).over(own)).where("_on").drop("_on", "_start")


def sample_steps(obs: DataFrame) -> DataFrame:
    """Each sample of a session with the time since the one before: 0 for the first, 2 s at most."""
    own = Window.partitionBy("session").orderBy("t")
    step = F.least(F.greatest(F.col("t") - F.lag("t").over(own), F.lit(0.0)), F.lit(2.0))
    return obs.select("session", "t").distinct().withColumn("dt", F.coalesce(step, F.lit(0.0)))


def zone_occupancy(people: DataFrame, zones: list[dict], rules: dict[int, tuple[int, float]], instants: DataFrame | None = None) -> DataFrame:
    """By session, zone and sample of (session, t, person_id, x, y): people, and so far person-seconds, peak and visitors.

    A person counts in every zone that holds the position. ``rules`` has the number of people and the seconds after
    which a zone's crowd is an alert; ``duration`` starts anew when fewer are there. A plan's zones are a hundred at
    most; people are reduced to one row a sample before anything is put in order. ``instants`` are those of ``heat_cells``: then
    that row leaves the task, with the people of each zone, however few of a sample's people a task of ``people`` would have.
    """
    x, y = F.col("x"), F.col("y")
    at = F.array_compact(F.array(*(F.when(G.holds(z["vertices"], x, y), F.lit(z["zone_id"])) for z in zones)))
    whole = in_blocks(people if instants is None else instants)
    counted = F.col("session").isNotNull() & F.col("t").isNotNull()
    if "predicted" in whole.columns:  # their samples are samples
        counted = counted & ~F.coalesce("predicted", F.lit(False))
    held = whole.select("session", "block", "t", "person_id", F.explode_outer(F.when(counted, at)).alias("zone_id")).distinct()
    samples = held.groupBy("session", "block", "t").agg(*(F.count_if(F.col("zone_id") == z["zone_id"]).alias(f"_{i}") for i, z in enumerate(zones)))
    step = F.least(F.coalesce(F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("t")), F.lit(0.0)), F.lit(2.0))
    each = F.inline(F.array(*(F.struct(F.lit(z["zone_id"]).alias("zone_id"), F.col(f"_{i}").alias("n")) for i, z in enumerate(zones))))
    spine = samples.withColumn("dt", step).select("session", "t", "dt", each)
    inside = observed(people).select("session", "t", "person_id", F.explode(at).alias("zone_id"))
    first = inside.groupBy("session", "zone_id", "person_id").agg(F.min("t").alias("t")).groupBy("session", "zone_id", "t").agg(F.count("*").alias("new"))
    key = ["session", "zone_id", "t"]
    rows = spine.join(first, key, "left").fillna(0, ["new"])
    least, dwell = (F.coalesce(*(F.when(F.col("zone_id") == k, F.lit(r[i])) for k, r in rules.items()), F.lit(None)) for i in (0, 1))
    hit = F.coalesce(F.col("n") >= least, F.lit(False))
    so_far = Window.partitionBy("session", "zone_id").orderBy("t")
    rows = rows.withColumn("hit", hit).withColumn("below", F.max(F.when(~F.col("hit"), F.col("t"))).over(so_far))
    rows = rows.withColumns({"seconds": F.sum(F.col("n") * F.col("dt")).over(so_far), "peak": F.max("n").over(so_far), "visits": F.sum("new").over(so_far)})
    since = F.min(F.when(F.col("hit"), F.col("t"))).over(Window.partitionBy("session", "zone_id", "below"))
    rows = rows.withColumn("duration", F.when(F.col("hit"), F.col("t") - since).otherwise(0.0))
    return rows.select(*key, F.col("n").alias("count"), "seconds", "peak", "visits", "duration", (F.col("hit") & (F.col("duration") >= dwell)).alias("alert"))


def camera_counting(counts: DataFrame, interval: float) -> DataFrame:
    """By camera of (session, camera, t, n): person-seconds and seconds up to each next sample, none over a gap of 1.5 intervals."""
    own = Window.partitionBy("session", "camera").orderBy("t")
    ahead = F.lead("t").over(own) - F.col("t")
    dt = F.when(ahead <= 1.5 * interval, ahead).otherwise(0.0)
    rows = counts.select("session", "camera", "t", "n", dt.alias("dt"))
    found = rows.groupBy("session", "camera").agg(F.max("t").alias("last_t"), F.max_by("n", "t").alias("count"), F.max("n").alias("peak"), F.min_by("t", F.struct(-F.col("n"), "t")).alias("peak_at"), F.sum(F.col("n") * F.col("dt")).alias("person_seconds"), F.sum("dt").alias("observed_s"))
    return found.withColumn("mean", F.col("person_seconds") / F.nullif(F.col("observed_s"), F.lit(0.0)))


def camera_heat(points: DataFrame, interval: float, rows: int = 24, cols: int = 40) -> DataFrame:
    """Person-seconds by camera and cell of a ``rows`` x ``cols`` grid over the image, of (session, camera, t, u, v) in 0..1.

    A sample's people count up to the next sample of the camera, not over a gap of 1.5 intervals.
    """
    own = Window.partitionBy("session", "camera").orderBy("t")
    ahead = F.lead("t").over(own) - F.col("t")
    steps = points.select("session", "camera", "t").distinct().withColumn("dt", F.when(ahead <= 1.5 * interval, ahead).otherwise(0.0))
    seen = points.where("u >= 0 AND u < 1 AND v >= 0 AND v < 1")
    cells = seen.groupBy("session", "camera", "t", F.floor(F.col("v") * rows).cast("int").alias("row"), F.floor(F.col("u") * cols).cast("int").alias("col")).agg(F.count("*").alias("n"))
    found = cells.join(steps, ["session", "camera", "t"]).groupBy("session", "camera", "row", "col").agg(F.sum(F.col("n") * F.col("dt")).alias("seconds"))
    return found.where("seconds > 0")


def crowd_episodes(counts: DataFrame, threshold: int, dwell: float, interval: float, reason: str = "fin") -> DataFrame:
    """Runs of samples with ``threshold`` people; confirmed at the first that is ``dwell`` after the start.

    A run ends with the sample below the threshold, or with its last sample where a gap of 1.5 intervals or the end
    of the data follows; runs that were never confirmed are left out.
    """
    keys = ["session", "camera"]
    own = Window.partitionBy(*keys).orderBy("t")
    rows = counts.withColumn("on", F.col("n") >= threshold).withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(own) > 1.5 * interval, F.lit(True)))
    rows = rows.withColumn("next_t", F.lead("t").over(own)).withColumn("start", F.col("on") & (F.col("gap") | ~F.coalesce(F.lag("on").over(own), F.lit(False))))
    rows = rows.withColumn("run", F.sum(F.col("start").cast("int")).over(own)).where("on")
    rows = rows.withColumn("since", F.min("t").over(Window.partitionBy(*keys, "run")))
    found = rows.groupBy(*keys, "run").agg(F.min("t").alias("start"), F.min(F.when(F.col("t") - F.col("since") >= dwell, F.col("t"))).alias("confirmed"), F.max("t").alias("last"), F.max_by("next_t", "t").alias("next_t"), F.max("n").alias("peak"))
    ends = F.when(F.col("next_t").isNull(), reason).when(F.col("next_t") - F.col("last") > 1.5 * interval, "interrupción").otherwise("umbral despejado")
    end = F.when(ends == "umbral despejado", F.col("next_t")).otherwise(F.col("last"))
    return found.where("confirmed IS NOT NULL").select(*keys, "start", "confirmed", end.alias("end"), "peak", (end - F.col("start")).alias("duration"), ends.alias("reason"))


def crossing_candidates(pixels: DataFrame, lines: DataFrame, near: float = 0.008, memory: float = 2.0) -> DataFrame:
    """Steps of a person (session, camera, person_id, t, u, v) from one side of a line to the other, across its segment.

    Points closer than ``near`` to a line do not count; the side before is that of the last counted point, if that
    is at most ``memory`` seconds old. ``lines`` has camera, line_id, ax, ay, bx, by, entry_side; a camera has few.
    Where it has ``positive`` and ``negative`` (arrays of two points, or null), points on a side count only within the
    band between the line and those points. Lines shorter than 0.001 are left out.
    """
    lines, banded = lines.where("hypot(bx - ax, by - ay) >= 0.001"), {"positive", "negative"} <= set(lines.columns)
    if banded:  # a line twice, once a side, with the corners of that side's band as numbers: every point is tested, so the test has to be small
        quad = lambda band: [(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), *((F.col(band)[i]["x"], F.col(band)[i]["y"]) for i in (1, 0))]
        half = lambda side, band: F.struct(F.lit(side).alias("_of"), F.col(band).isNull().alias("_open"), *G.quad_edges(quad(band)))
        lines = lines.select("*", F.inline(F.array(half(1, "positive"), half(-1, "negative")))).drop("positive", "negative")
    number = lambda e: F.coalesce(e, F.lit(0.0))  # noqa: E731  (none is null here, and so Spark writes no code for nulls)
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    lines = lines.withColumns({"_ax": number(F.col("ax")), "_ay": number(F.col("ay")), "_dx": number(F.col("bx") - F.col("ax")), "_dy": number(F.col("by") - F.col("ay")), "_size": F.coalesce(size, F.lit(1.0))})
    placed = pixels.where("u IS NOT NULL AND v IS NOT NULL").withColumns({"u": number(F.col("u")), "v": number(F.col("v"))})
    rows = placed.join(F.broadcast(lines), "camera").withColumn("d", (F.col("_dx") * (F.col("v") - F.col("_ay")) - F.col("_dy") * (F.col("u") - F.col("_ax"))) / F.col("_size"))
    if banded:
        rows = rows.where((F.col("_of") * F.col("d") >= near) & (F.col("_open") | G.edges_hold(F.col("u"), F.col("v")))).withColumn("side", F.col("_of"))
    else:
        rows = rows.where(F.abs("d") >= near).withColumn("side", F.signum("d").cast("int"))
    own = Window.partitionBy("session", "camera", "line_id", "person_id").orderBy("t")
    before = {c: F.lag(c).over(own) for c in ("side", "t", "u", "v", "d")}
    rows = rows.select("*", *(c.alias(f"{k}0") for k, c in before.items())).where((F.col("side0") != F.col("side")) & (F.col("t") - F.col("t0") <= memory))
    dx, dy, size = F.col("_dx"), F.col("_dy"), F.col("_size")
    k = F.abs("d0") / (F.abs("d0") + F.abs("d"))
    at = ((F.col("u0") + k * (F.col("u") - F.col("u0")) - F.col("ax")) * dx + (F.col("v0") + k * (F.col("v") - F.col("v0")) - F.col("ay")) * dy) / (size * size)
    rows = rows.withColumn("at", at).where("at BETWEEN 0 AND 1")
    return rows.select("session", "camera", "line_id", "person_id", "t", F.when(F.col("side") == F.col("entry_side"), "entry").otherwise("exit").alias("direction"))


def spaced(times: list[float], gap: float) -> list[bool]:
    """Which of ascending times are kept if each must be ``gap`` after the last kept."""
    last, keep = float("-inf"), []
    for t in times:
        keep.append(t - last >= gap)
        if keep[-1]:
            last = t
    return keep


def keep_spaced(rows: DataFrame, keys: list[str], gap: float, flag: str | None = None) -> DataFrame:
    """Rows of a key at least ``gap`` seconds after the last kept one; with ``flag`` all rows and a column that says so."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        keep = spaced(pdf["t"].tolist(), gap)
        return pdf[keep] if flag is None else pdf.assign(**{flag: keep})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *([f"`{flag}` boolean"] if flag else [])])
    return rows.groupBy(*keys).applyInPandas(pick, schema)


def line_crossings(pixels: DataFrame, lines: DataFrame, pause: float = 1.0) -> DataFrame:
    """Crossings of lines, at most one a second by line and person. Only candidates, which are few, reach the helper."""
    return keep_spaced(crossing_candidates(pixels, lines), ["session", "camera", "line_id", "person_id"], pause)


def line_totals(crossings: DataFrame, hour: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """(entries, exits and last crossing by line; entries and exits by line and hour since the session began)."""
    key = ["session", "camera", "line_id"]
    ways = [F.sum((F.col("direction") == d).cast("long")).alias(n) for d, n in (("entry", "entries"), ("exit", "exits"))]
    return crossings.groupBy(*key).agg(*ways, F.max("t").alias("last_crossing")), crossings.groupBy(*key, F.floor(F.col("t") / hour).alias("hour")).agg(*ways)


def alert_cooldown(alerts: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Alerts (key, t, ...) with ``send``: false within ``seconds`` of the last sent one of the key."""
    return keep_spaced(alerts, ["key"], seconds, "send")


#: The states of an alert; a new one is the first.
STATES = ("pendiente", "en_proceso", "resuelto", "descartado")


def alert_log(alerts: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row a key of alerts (key, t, peak, duration): first time, greatest peak, last duration, state, and the time of the last alert.

    With the ``log`` so far (of the same columns) unknown keys are put in as pending, pending ones follow their alerts, and ones that someone
    has looked at stay as they are. Alerts up to the last one of a key change nothing, so a replayed batch gives the same log.
    """
    new = alerts.groupBy("key").agg(F.min("t").alias("start"), F.max("peak").alias("peak"), F.max_by("duration", "t").alias("duration"), F.max("t").alias("last_t"))
    if log is None:
        return new.select("key", "start", "peak", "duration", F.lit(STATES[0]).alias("state"), "last_t")
    both = log.join(new.toDF("key", *(f"_{c}" for c in new.columns[1:])), "key", "full")
    fresh, open_ = F.col("state").isNull(), F.col("state") == STATES[0]
    later = open_ & (F.col("_last_t") > F.col("last_t"))
    pick = lambda c, joined: F.when(fresh, F.col(f"_{c}")).when(later, joined).otherwise(F.col(c)).alias(c)
    return both.select("key", pick("start", F.col("start")), pick("peak", F.greatest("peak", "_peak")), pick("duration", F.col("_duration")), F.coalesce("state", F.lit(STATES[0])).alias("state"), pick("last_t", F.col("_last_t")))


def zone_flow(pos: DataFrame, gap: float = 1.0) -> DataFrame:
    """Entries and exits of (session, zone_id, person_id, t, inside) that two observations in a row confirm.

    The first observation is the state at once; a longer pause than ``gap`` forgets it. Rows that are ``predicted`` go.
    """
    keys = ["session", "zone_id", "person_id"]
    own = Window.partitionBy(*keys).orderBy("t")
    rows = observed(pos).withColumn("_cut", F.coalesce(F.col("t") - F.lag("t").over(own) > gap, F.lit(True)).cast("int")).withColumn("part", F.sum("_cut").over(own))
    mine = Window.partitionBy(*keys, "part").orderBy("t")
    rows = rows.withColumn("_new", F.coalesce((F.col("inside") != F.lag("inside").over(mine)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(mine))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "part", "run").orderBy("t"))).where("nth = 2 OR (nth = 1 AND run = 1)")
    before = F.lag("inside").over(Window.partitionBy(*keys, "part").orderBy("t"))
    found = rows.withColumn("before", before).where("nth = 2 AND before <> inside")
    return found.select(*keys, "t", F.when(F.col("inside"), "entry").otherwise("exit").alias("direction"))


def collapsed_pairs(obs: DataFrame, radius: float = 0.15, most: float = 0.1, dealt: list[str] | None = None) -> DataFrame:
    """Pairs of people in one camera and instant closer than ``radius`` on the plan whose boxes hardly overlap.

    People are moved once, by instant (not at all where they come ``dealt`` out by blocks of instants), and meet those of the cells
    around; what leaves a task are pairs that count.
    """
    return near.box_pairs(obs, lambda group, x, y, *_: near.close(group, x, y, radius), lambda iou: iou <= most, ("x", "y"), dealt)
