"""Sales against traffic, by business, day and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of an hour that must be covered for it to count.
COVERED = 3300
KEY = ["dataset", "business_id", "date", "hour"]


def load_sales(rows: DataFrame, businesses: DataFrame) -> DataFrame:
    """All rows, or none if one names no known business or has a negative amount."""
    known = rows.join(businesses.select("business_id").distinct().withColumn("known", F.lit(True)), "business_id", "left")
    wrong = known.select(F.max((F.col("known").isNull() | F.coalesce(F.col("amount") < 0, F.lit(True))).cast("int")).alias("wrong"))
    return rows.join(F.broadcast(wrong), F.coalesce("wrong", F.lit(0)) == 0).drop("wrong")  # one row


def legacy_sales_migration(old: DataFrame, existing: DataFrame) -> DataFrame:
    """Old rows with an hour of the day and an amount summed by business, date and hour, where none exists yet."""
    key = ["business_id", "date", "hour"]
    rows = old.where("hour BETWEEN 0 AND 23 AND amount >= 0 AND date IS NOT NULL").groupBy(*key).agg(F.sum("amount").alias("amount"))
    return rows.join(existing, key, "left_anti")


def confidence_label(days):
    return F.when(days >= 7, "alta").when(days >= 3, "media").otherwise("baja")


def best_hours(traffic: DataFrame) -> DataFrame:
    """Of the sessions of an hour the one that covers most of it, ties by session."""
    rank = Window.partitionBy(*KEY).orderBy(F.desc("coverage"), "session")
    return traffic.withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")


def _history(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Earlier days of the same weekday and hour for each target row."""
    past = history.withColumn("weekday", F.dayofweek("date")).withColumnRenamed("date", "past")
    rows = targets.select(*KEY).distinct().withColumn("weekday", F.dayofweek("date"))
    return rows.join(past, ["dataset", "business_id", "hour", "weekday"]).where("past < date")


def forecast(targets: DataFrame, traffic: DataFrame, sales: DataFrame) -> DataFrame:
    """Estimated sales of each (dataset, business_id, date, hour, entries) from sales per entry on earlier like days.

    A day counts with its best covered session, if that covers COVERED seconds, has entries and a sale; three days
    at least. The estimate is entries times the median ratio, its range the least and the greatest.
    """
    good = best_hours(traffic).where((F.col("coverage") >= COVERED) & (F.col("entries") > 0)).join(sales.select(*KEY, "amount"), KEY)
    ratios = _history(targets, good.select(*KEY, (F.col("amount") / F.col("entries")).alias("ratio")))
    told = ratios.groupBy(*KEY).agg(F.percentile("ratio", F.lit(0.5)).alias("per_entry"), F.count("*").alias("days"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).where("days >= 3")
    rows = targets.join(told, KEY, "left")
    times = lambda c, name: (F.col("entries") * F.col(c)).alias(name)
    return rows.select(*KEY, "entries", "per_entry", F.coalesce("days", F.lit(0)).alias("days"), times("per_entry", "estimate"), times("lo", "low"), times("hi", "high"))


def next_hour_forecast(targets: DataFrame, traffic: DataFrame, sales: DataFrame) -> DataFrame:
    """Forecast of the hour after each target: expected entries are the rounded median of all sessions of earlier like days."""
    later = F.expr("timestampadd(HOUR, hour + 1, CAST(date AS TIMESTAMP))")
    following = targets.select("dataset", "business_id", F.to_date(later).alias("date"), F.hour(later).alias("hour")).distinct()
    past = _history(following, traffic.where(F.col("coverage") >= COVERED).select(*KEY, "entries"))
    expected = past.groupBy(*KEY).agg(F.bround(F.percentile("entries", F.lit(0.5))).cast("long").alias("entries"))
    found = forecast(following.join(expected, KEY, "left"), traffic, sales)
    return found.withColumnRenamed("entries", "expected_entries").withColumn("label", confidence_label(F.col("days")))


def commercial_summary(targets: DataFrame, traffic: DataFrame, sales: DataFrame, bags: DataFrame | None = None) -> DataFrame:
    """By (dataset, business, date, hour) asked for: entries, sales, conversion, forecast, the next hour's, bags of the day."""
    rows = targets.select(*KEY).distinct().join(best_hours(traffic).select(*KEY, "entries"), KEY, "left").join(sales.select(*KEY, "amount", "transactions"), KEY, "left")
    rows = rows.withColumn("conversion", F.when(F.col("entries") > 0, 100.0 * F.col("transactions") / F.col("entries")))
    now = forecast(rows.select(*KEY, "entries"), traffic, sales).select(*KEY, "days", "estimate", "low", "high", confidence_label(F.col("days")).alias("label"))
    rows = rows.join(now, KEY)
    later = F.expr("timestampadd(HOUR, hour + 1, CAST(date AS TIMESTAMP))")
    following = next_hour_forecast(targets, traffic, sales).select("dataset", "business_id", F.col("date").alias("next_date"), F.col("hour").alias("next_hour"), F.col("expected_entries").alias("next_entries"), F.col("estimate").alias("next_estimate"), F.col("label").alias("next_label"))
    rows = rows.withColumn("next_date", F.to_date(later)).withColumn("next_hour", F.hour(later)).join(following, ["dataset", "business_id", "next_date", "next_hour"], "left").drop("next_date", "next_hour")
    if bags is None:
        return rows
    return rows.join(bags_of_day(bags, traffic), ["dataset", "business_id", "date"], "left").fillna(0, ["bag_exits", "bag_matched", "bag_changed", "bag_unmatched"])


def bags_of_day(bags: DataFrame, traffic: DataFrame) -> DataFrame:
    """Bag matches (dataset, business_id, session, matched, changed) of the sessions that a business had traffic from on a day."""
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    key = ["dataset", "business_id", "session"]
    summed = bags.groupBy(*key).agg(F.count("*").alias("exits"), count("matched"), count("changed"))
    rows = traffic.select(*key, "date").distinct().join(summed, key).groupBy("dataset", "business_id", "date")
    found = rows.agg(*(F.sum(c).alias(f"bag_{c}") for c in ("exits", "matched", "changed")))
    return found.withColumn("bag_unmatched", F.col("bag_exits") - F.col("bag_matched")).withColumn("bag_coverage", F.try_divide(100.0 * F.col("bag_matched"), F.col("bag_exits")))


def hourly_table(traffic: DataFrame, sales: DataFrame) -> DataFrame:
    """Every session row of a day's hours with its sales and the forecast for its own entries."""
    rates = forecast(traffic.select(*KEY).distinct().withColumn("entries", F.lit(1)), traffic, sales).select(*KEY, "per_entry", "days")
    rows = traffic.join(sales.select(*KEY, "amount", "transactions"), KEY, "left").join(rates, KEY, "left")
    return rows.select(*KEY, "session", "entries", "exits", F.round("coverage").cast("long").alias("coverage"), "amount", "transactions", (F.col("entries") * F.col("per_entry")).alias("estimate"), confidence_label(F.col("days")).alias("label"))


def commercial_export(summary: DataFrame) -> DataFrame:
    """The summary under the headings of its CSV file, for ``report_csv_sink``. The headings."""
    headings = {"Negocio": "business_id", "Fecha": "date", "Hora": "hour", "Origen": "dataset", "Entradas": "entries", "Ventas PEN": "amount", "Proyección PEN": "estimate", "Días históricos": "days", "Salidas emparejadas": "bag_matched", "Objetos nuevos": "bag_changed", "Salidas sin emparejar": "bag_unmatched"}
    return summary.select(*(F.col(c).alias(h) for h, c in headings.items()))


def incident_export(impact: DataFrame) -> DataFrame:
    """Incidents with their hour's sales under the headings of their CSV file. The headings."""
    headings = {"Negocio": "business_id", "Origen": "dataset", "Inicio": "start", "Duración segundos": "duration", "Ventas de la hora PEN": "amount", "Referencia histórica PEN": "usual", "Días comparables": "days", "Diferencia descriptiva %": "impact"}
    return impact.select(*(F.col(c).alias(h) for h, c in headings.items()))


#: What is added up over businesses: null only where all of them are.
ADDED = ("amount", "estimate", "transactions")


def _totals(rows, extra=()):
    found = rows.agg(*extra, F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), *(F.sum(c).alias(c) for c in ADDED))
    return found.withColumn("conversion", F.when(F.col("entries") > 0, 100.0 * F.col("transactions") / F.col("entries")))


def company_rollup(summary: DataFrame, companies: DataFrame) -> DataFrame:
    """Sums by hour over all companies, by company and by business (``level`` 3, 1 and 0), with the number of businesses.

    ``summary`` is that of ``commercial_summary``; businesses without a company go under "Sin empresa". Entries become 0 where none are known.
    """
    key = ["dataset", "date", "hour"]
    rows = summary.select(*key, "business_id", "entries", *ADDED).join(companies.select("business_id", "company"), "business_id", "left").fillna("Sin empresa", ["company"])
    by = [[*key], [*key, "company"], [*key, "company", "business_id"]]
    sets = rows.groupingSets([[F.col(c) for c in g] for g in by], *key, "company", "business_id")
    found = _totals(sets, [F.grouping_id().cast("int").alias("level"), F.count_distinct(F.col("business_id")).alias("businesses")])
    return found.withColumn("businesses", F.when(F.col("level") == 0, 1).otherwise(F.col("businesses")).cast("long"))


def dashboard_totals(summary: DataFrame) -> DataFrame:
    """Per hour of a day over all businesses: entries, sales, estimate, transactions, conversion, the best conversion of one, and whether it is the day's busiest."""
    rows = _totals(summary.groupBy("dataset", "date", "hour"), [F.max("conversion").alias("best_conversion")])
    rank = Window.partitionBy("dataset", "date").orderBy(F.desc("entries"), "hour")
    return rows.withColumn("peak", F.row_number().over(rank) == 1)


def spearman_ordinal(rows: DataFrame, keys: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """Rank correlation by key with ties ranked in ``order``; null for fewer than three rows or a constant column."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumn("ra", F.row_number().over(own.orderBy(a, *order))).withColumn("rb", F.row_number().over(own.orderBy(b, *order)))
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"), (F.min(a) == F.max(a)).alias("flat_a"), (F.min(b) == F.max(b)).alias("flat_b"))
    return found.select(*keys, "n", F.when((F.col("n") >= 3) & ~F.col("flat_a") & ~F.col("flat_b"), F.round("rho", 3)).alias("rho"))


def sales_relation(hourly: DataFrame, sales: DataFrame) -> DataFrame:
    """Hours (dataset, business_id, date, hour, session, exposure, visits, coverage) with enough coverage against their sales.

    Capture is visits by exposed people, conversion transactions by visits, both in percent, and sales by visit.
    """
    rows = hourly.where(F.col("coverage") >= COVERED).join(sales.select(*KEY, "amount", "transactions"), KEY)
    per = lambda top, below: F.when(F.col(below) > 0, top / F.col(below))
    return rows.select(*KEY, "session", "exposure", "visits", "amount", per(100.0 * F.col("visits"), "exposure").alias("capture"), per(100.0 * F.col("transactions"), "visits").alias("conversion"), per(F.col("amount"), "visits").alias("per_visit"))


def sales_correlation(relation: DataFrame, least: int = 6) -> DataFrame:
    """By business: hours, and from ``least`` of them on the median capture and the rank correlations of exposure and visits with sales."""
    keys, order = ["dataset", "business_id"], ["date", "hour", "session"]
    rows = relation.groupBy(*keys).agg(F.count("*").alias("hours"), F.percentile("capture", F.lit(0.5)).alias("capture_median"))
    for name in ("exposure", "visits"):
        rows = rows.join(spearman_ordinal(relation, keys, name, "amount", order).select(*keys, F.col("rho").alias(f"{name}_sales")), keys)
    return rows.select(*keys, "hours", *(F.when(F.col("hours") >= least, F.col(c)).alias(c) for c in ("capture_median", "exposure_sales", "visits_sales")))


def incident_sales_impact(incidents: DataFrame, sales: DataFrame, top: int = 100) -> DataFrame:
    """Sale of the hour of each incident against the median of earlier like hours (three at least), in percent.

    Null if the incident crosses its hour or lasts an hour; the latest ``top`` of a data set.
    """
    start = F.unix_timestamp("start")
    rows = incidents.withColumn("date", F.to_date("start")).withColumn("hour", F.hour("start"))
    rows = rows.withColumn("whole", (F.col("duration") < 3600) & (start % 3600 + F.col("duration") <= 3600))
    usual = _history(rows, sales.select(*KEY, "amount")).groupBy(*KEY).agg(F.percentile("amount", F.lit(0.5)).alias("usual"), F.count("*").alias("days")).where("days >= 3")
    found = rows.join(sales.select(*KEY, "amount"), KEY, "left").join(usual, KEY, "left")
    rank = Window.partitionBy("dataset").orderBy(F.desc("start"), "incident_id")
    found = found.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top)
    return found.select("incident_id", "dataset", "business_id", "start", "duration", "date", "hour", "amount", "usual", F.coalesce("days", F.lit(0)).alias("days"), F.when(F.col("whole") & (F.col("usual") > 0), 100.0 * (F.col("amount") / F.col("usual") - 1)).alias("impact"))


def bag_totals(visits: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    found = visits.groupBy("session", "business_id").agg(F.count("*").alias("exits"), count(F.col("matched")).alias("matched"), count(F.col("changed")).alias("changed"))
    return found.withColumn("unmatched", F.col("exits") - F.col("matched")).withColumn("coverage", 100.0 * F.col("matched") / F.col("exits"))


def incident_status(incidents: DataFrame, updates: DataFrame, state: str, n: int = 200) -> DataFrame:
    """Incidents in a state, newest first, after the latest valid update of each."""
    valid = updates.where(F.col("state").isin("pendiente", "en_proceso", "resuelto", "descartado"))
    last = valid.groupBy("incident_id").agg(F.max_by("state", F.struct("at", "state")).alias("new"))
    rows = incidents.join(last, "incident_id", "left").withColumn("state", F.coalesce("new", "state")).drop("new")
    return rows.where(F.col("state") == state).orderBy(F.desc("start"), "incident_id").limit(n)


def incident_recurrence(incidents: DataFrame, hours: int = 2, least_days: int = 2) -> DataFrame:
    """Slots of ``hours`` hours in which a zone's incidents were created on ``least_days`` days or more, with the days."""
    rows = incidents.groupBy("zone", F.floor(F.hour("created") / hours).alias("slot")).agg(F.array_sort(F.collect_set(F.to_date("created"))).alias("days"))
    return rows.where(F.size("days") >= least_days)


def traffic_history(counts: DataFrame) -> DataFrame:
    """Zone counts (zone, ts, n) to hours: each minute adds its rounded mean as one sample, the peak is the largest of these."""
    minute = counts.groupBy("zone", F.date_trunc("MINUTE", "ts").alias("m")).agg(F.bround(F.avg("n")).cast("long").alias("mean"))
    return minute.groupBy("zone", F.to_date("m").alias("date"), F.hour("m").alias("hour"), (F.pmod(F.dayofweek("m") + 5, F.lit(7))).alias("weekday")).agg(F.sum("mean").alias("total"), F.count("*").alias("samples"), F.max("mean").alias("peak"))


def traffic_baseline(history: DataFrame, exclude=None) -> DataFrame:
    """Mean, peak and days by (zone, hour, weekday), without a date."""
    rows = history if exclude is None else history.where(F.col("date") != F.lit(exclude))
    return rows.groupBy("zone", "hour", "weekday").agg((F.sum("total") / F.nullif(F.sum("samples"), F.lit(0))).alias("mean"), F.max("peak").alias("peak"), F.count_distinct("date").alias("days"))


#: What a line is measured by; where any of it differs from the current line, doors of today say nothing about the session.
MEASURED = ("ax", "ay", "bx", "by", "entry_side", "bands")


def line_owners(observed: DataFrame, current: DataFrame, doors: DataFrame) -> DataFrame:
    """(session, camera, line_id, business_id): whose line it was in each session.

    ``observed`` are the lines as a session had them (session, camera, line_id, MEASURED, place_id), ``current`` those of today, ``doors``
    (camera, line_id, business_id) today's owners. A line with the same measures belongs to today's owner, or else, like a changed
    or removed line, to the place that was recorded with it.
    """
    line = ["camera", "line_id"]
    now = current.select(*line, *(F.col(c).alias(f"{c}_now") for c in MEASURED), F.lit(True).alias("_known"))
    rows = observed.join(now, line, "left").join(doors.select(*line, F.col("business_id").alias("_door")), line, "left")
    same = F.coalesce("_known", F.lit(False))
    for c in MEASURED:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_now"))
    return rows.select("session", *line, F.coalesce(F.when(same, F.col("_door")), "place_id").alias("business_id"))


def business_events(crossings: DataFrame, owners: DataFrame) -> DataFrame:
    """Crossings (session, camera, line_id, t, direction) of businesses, each with the business whose line it was."""
    return crossings.join(owners.where("business_id IS NOT NULL"), ["session", "camera", "line_id"])


def business_traffic(crossings: DataFrame, owners: DataFrame, businesses: DataFrame, hour: float = 3600.0) -> DataFrame:
    """By business: entries and exits, accesses (camera, line_id, entries, exits), and a map of hours since the sessions' begin.

    A business without a measured line has null entries and exits; a line that nobody crossed counts with 0. Counts are reduced by session, line and hour before they
    are gathered.
    """
    line = ["session", "camera", "line_id"]
    ways = [F.sum((F.col("direction") == d).cast("long")).alias(n) for d, n in (("entry", "entries"), ("exit", "exits"))]
    owned = owners.where("business_id IS NOT NULL")
    counts = crossings.groupBy(*line, F.floor(F.col("t") / hour).alias("hour")).agg(*ways)
    rows = owned.join(counts, line, "left").fillna(0, ["entries", "exits"])
    sums = [F.sum(c).alias(c) for c in ("entries", "exits")]
    access = rows.groupBy("business_id", "camera", "line_id").agg(*sums)
    listed = access.groupBy("business_id").agg(*sums, F.array_sort(F.collect_list(F.struct("camera", "line_id", "entries", "exits"))).alias("accesses"))  # a business's doors
    hours = rows.where("hour IS NOT NULL").groupBy("business_id", "hour").agg(*sums)
    hours = hours.groupBy("business_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", F.struct("entries", "exits"))))).alias("hours"))
    return businesses.select("business_id").join(listed, "business_id", "left").join(hours, "business_id", "left")
