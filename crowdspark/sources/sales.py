"""Sales files in, reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_sales(lines: DataFrame, businesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of sales lines (line, business_id, date, hour, amount, currency, transactions), all text.

    Each line is checked in order and fails by its first fault: unknown business, date not YYYY-MM-DD, hour not 0 to
    23, amount not a finite number from 0 on, currency not PEN, transactions neither empty nor a number from 0 on,
    and a business, date and hour that an earlier good line has.
    """
    known = businesses.select("business_id").distinct().withColumn("known", F.lit(True))
    rows = lines.join(F.broadcast(known), "business_id", "left")
    date, hour, amount, sold = F.expr("try_to_date(date, 'yyyy-MM-dd')"), F.expr("try_cast(hour AS INT)"), F.expr("try_cast(amount AS DOUBLE)"), F.expr("try_cast(transactions AS INT)")
    good = lambda c: F.coalesce(c, F.lit(False))
    fault = (
        F.when(F.col("known").isNull(), "business")
        .when(~good(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & date.isNotNull()), "date")
        .when(~good(F.trim("hour").rlike("^[0-9]+$") & hour.between(0, 23)), "hour")
        .when(~good((amount >= 0) & (amount < float("inf"))), "amount")
        .when(~good(F.col("currency") == "PEN"), "currency")
        .when(~(F.coalesce(F.trim("transactions"), F.lit("")) == "") & ~good(sold >= 0), "transactions")
    )
    rows = rows.select("line", "business_id", date.alias("date"), hour.alias("hour"), amount.alias("amount"), sold.alias("transactions"), fault.alias("fault"))
    nth = F.row_number().over(Window.partitionBy("business_id", "date", "hour", F.col("fault").isNull()).orderBy("line"))
    rows = rows.withColumn("fault", F.when(F.col("fault").isNull() & (nth > 1), "duplicate").otherwise(F.col("fault")))
    return rows.where("fault IS NULL").drop("fault"), rows.where("fault IS NOT NULL").select("line", F.col("fault").alias("message"))


def read_sales_csv(spark, path: str) -> DataFrame:
    """Lines of sales files with ``,`` or ``;``; a decimal comma only with ``;``. Blank lines are left out."""
    names = ["business_id", "date", "hour", "amount", "currency", "transactions"]
    text = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    semi = F.contains("value", F.lit(";"))
    cells = F.when(semi, F.split("value", ";")).otherwise(F.split("value", ","))
    rows = text.select("line", semi.alias("semi"), cells.alias("c")).where(F.lower(F.trim(F.get("c", F.lit(0)))) != "business_id")
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    value = {n: at(i) for i, n in enumerate(names)}
    value["amount"] = F.when(F.col("semi"), F.replace(value["amount"], F.lit(","), F.lit("."))).otherwise(value["amount"])
    return rows.select("line", *(c.alias(n) for n, c in value.items()))


def import_sales(rows: DataFrame, errors: DataFrame, existing: DataFrame, dataset: str, preview: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to append, report): all rows or none. One error, or one hour that exists in the data set, stops the import."""
    key = ["business_id", "date", "hour"]
    taken = rows.join(existing.where(F.col("dataset") == dataset).select(*key), key, "left_semi")
    report = errors.agg(F.count("*").alias("errors")).crossJoin(taken.agg(F.count("*").alias("taken"))).crossJoin(rows.agg(F.count("*").alias("rows")))  # one row each
    report = report.withColumn("imported", F.when((F.col("errors") == 0) & (F.col("taken") == 0) & F.lit(not preview), F.col("rows")).otherwise(0))
    fits = rows.crossJoin(F.broadcast(report.select("imported"))).where("imported > 0").drop("imported").withColumn("dataset", F.lit(dataset))
    return fits, report


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(F.ltrim(c).rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def report_csv_sink(df: DataFrame, path: str) -> None:
    """Write any report as CSV, text columns guarded."""
    df.withColumns({c: guarded(F.col(c)) for c, t in df.dtypes if t == "string"}).write.mode("overwrite").option("header", True).csv(path)


def save_by_session(df: DataFrame, path: str) -> None:
    """Replace the sessions that ``df`` has, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
