"""Quality rules: statistics of a text by DataFrame functions, and a decision list learned from labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_bucket, materialize, text_or_empty

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Bound of the learner's sample: labelled documents, taken by the hash of their id.
SAMPLE_ROWS = 20_000


def text_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and statistics of ``text`` for each row, by built-in functions only.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
    (words in runs of eight that occur twice or more, each word once), n_lines, n_upper (A-Z), n_marks (! and ?).
    Null text has no word and all counts are 0. Only texts in which a run of eight recurs are looked at for its
    places: windows are sorted by hash with their positions, so that takes n log n for any repetition.
    """
    text = text_or_empty()
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    kept = F.struct(*(docs[c] for c in keep or ["doc_id"])).alias("kept_columns")
    staged = docs.select(kept, text.alias("text")).withColumn("words", words)
    staged = staged.withColumn("windows", F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    staged = staged.withColumn("lines", lines).withColumn("recurs", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.withColumn("ordered", F.when(F.col("recurs"), ordered))

    def twin(x: Column, k: Column) -> Column:
        near = lambda at: F.get("ordered", at)["h"] == x["h"]
        return F.struct(x["i"].alias("i"), (F.coalesce(near(k - 1), F.lit(False)) | F.coalesce(near(k + 1), F.lit(False))).alias("twice"))

    places = F.array_sort(F.transform(F.filter(F.transform("ordered", twin), lambda x: x["twice"]), lambda x: x["i"]))
    staged = staged.withColumn("places", F.when(F.col("recurs"), places))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return staged.select(
        "kept_columns.*",
        count(F.size("words")).alias("n_words"),
        count(F.length(F.regexp_replace("text", f"[{SPACE_CLASS}]+", ""))).alias("word_chars"),
        count(without(SYMBOLS)).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        count(F.when(F.col("recurs"), covered)).alias("n_repeat_words"),
        count(F.size("lines")).alias("n_lines"),
        count(F.length(F.regexp_replace("text", "[^A-Z]+", ""))).alias("n_upper"),
        count(without("!?")).alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))


#: What rules may test, from the statistics.
FEATURES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_words_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    return F.col(top).cast("double") if below is None else _share(top, below)


def _clause(name: str, side: str, at: float) -> Column:
    return feature(name) >= at if side == ">=" else feature(name) < at


class DecisionList:
    """Ordered rules, each a conjunction of (feature, side, threshold); a text that any rule fits is rejected."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def verdict(self) -> Column:
        """The list as one ordered conditional: false at the first rule that fits, true past all."""
        if not self.rules:
            return F.lit(True)
        chain = None
        for rule in self.rules:
            fits = reduce(lambda a, b: a & b, (_clause(*c) for c in rule))
            chain = F.when(fits, F.lit(False)) if chain is None else chain.when(fits, F.lit(False))
        return chain.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {s} {t:g}" for n, s, t in rule) for rule in self.rules) or "keep all"


def learn_rules(labelled: DataFrame, work: str, bins: int = 32, max_rules: int | None = None, max_clauses: int | None = None, min_precision: float = 0.95, min_support: int = 5) -> DecisionList:
    """Sequential covering over ``labelled`` (doc_id, the statistics, quality 0/1): rules for quality 0.

    Thresholds are the quantiles of each feature over all rows, finer at both ends, and those over the bad rows and
    over the values that are not 0, so that what few rows have can be told apart. Two of three rows grow a rule, a
    clause at a time by FOIL's gain, until it covers no good text; the third prunes it from its end for the best
    (p - n) / (p + n). A rule stays if its precision on the pruning rows is ``min_precision`` and it covers
    ``min_support`` of them; rows that a rule covers leave the table for the next. If it fails, the feature and
    side that it opened with open no further rule, and the next best opening is tried, until none is left. Every
    step is one aggregate over binned rows that sends ``features * cuts`` counts to the driver, whatever the number
    of rows. No usable label gives an empty list. ``max_rules`` and ``max_clauses`` bound the list where they are set.
    """
    names = list(FEATURES)
    values = labelled.where("quality IN (0, 1)").select((F.col("quality") == 0).alias("bad"), (id_bucket("doc_id", 3) != 0).alias("grow"), *(feature(n).alias(n) for n in names))
    shares = [i / bins for i in range(1, bins)]
    tails = [1 / (bins << k) for k in range(1, 6)]
    fine = sorted({0.0, *shares, *tails, *(1 - x for x in tails), 1.0})
    at = lambda c, q: F.percentile_approx(c, F.array(*map(F.lit, q)), 10_000)
    asked = [(f"{n}_{i}", c) for n in names for i, c in enumerate((at(F.col(n), fine), at(F.when(F.col("bad"), F.col(n)), fine), at(F.when(F.col(n) != 0, F.col(n)), fine), F.min(n)))]
    cut_row = values.agg(*(c.alias(a) for a, c in asked)).first()
    if cut_row is None or cut_row[f"{names[0]}_0"] is None:
        return DecisionList([])
    cuts = {n: sorted({c for i in range(3) for c in cut_row[f"{n}_{i}"] or [] if c > cut_row[f"{n}_3"]}) for n in names}
    # By a literal array: as a sum of comparisons so many cuts are too large a method to compile.
    below = lambda x, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c <= x)) if at else F.lit(0)
    binned = [below(F.col(n), cuts[n]).alias(n) for n in names]
    rows = materialize(values.select("bad", "grow", *binned).groupBy("bad", "grow", *names).count(), work)
    fits = lambda c: (F.col(c[0]) >= c[2]) if c[1] == ">=" else (F.col(c[0]) < c[2])
    all_of = lambda clauses: reduce(lambda a, b: a & b, map(fits, clauses), F.lit(True))
    rules: list[list[tuple[str, str, int]]] = []
    left, failed, opening = rows, set(), None
    while max_rules is None or len(rules) < max_rules:
        rule: list[tuple[str, str, int]] = []
        while max_clauses is None or len(rule) < max_clauses:
            seen = left.where("grow").where(all_of(rule))
            pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names)))
            if rule or opening is None:  # after a failure the table is as it was
                counts = seen.select("bad", "count", pairs.alias("f")).groupBy("f.name", "f.bin").agg(F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))).alias("n")).collect()
                opening = opening if rule else counts
            else:
                counts = opening
            by = {n: {} for n in names}
            for r in counts:
                by[r["name"]][r["bin"]] = (r.p, r.n)
            p0, n0 = (sum(x[k] for x in by[names[0]].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for n in names:
                for k in range(1, len(cuts[n]) + 1):
                    for side in (">=", "<"):
                        if not rule and (n, side) in failed:
                            continue
                        inside = [x for b, x in by[n].items() if (b >= k) == (side == ">=")]
                        p, m = sum(x[0] for x in inside), sum(x[1] for x in inside)
                        if p >= min_support:
                            gain = p * (math.log2(p / (p + m)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (n, side, k))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = left.where("NOT grow")
        sums = [F.sum(F.when(all_of(rule[:k]) & (F.col("bad") == F.lit(bad)), F.col("count")).otherwise(0)).alias(f"{'np'[bad]}{k}") for k in range(1, len(rule) + 1) for bad in (False, True)]
        told = held.agg(*sums).first()
        score = lambda k: ((told[f"p{k}"] or 0) - (told[f"n{k}"] or 0)) / max(1, (told[f"p{k}"] or 0) + (told[f"n{k}"] or 0))
        keep = max(range(1, len(rule) + 1), key=lambda k: (round(score(k), 9), -k))
        p, n = told[f"p{keep}"] or 0, told[f"n{keep}"] or 0
        if p < min_support or p < min_precision * (p + n):
            failed.add(rule[0][:2])
            continue
        rules.append(rule[:keep])
        opening = None
        left = left.where(~all_of(rule[:keep]))
    return DecisionList([[(n, side, cuts[n][k - 1]) for n, side, k in rule] for rule in rules])


def labelled_sample(labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality) of at most ``most`` labelled documents, the least quality where labels differ."""
    one = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _taught(statistics: DataFrame, sample: DataFrame) -> DataFrame:
    return statistics.where(~base_failed()).join(F.broadcast(sample), "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, work: str) -> DataFrame:
    """The rows of ``docs`` that pass the base limits and the rules, all columns, without a shuffle of texts.

    Rules are learned from SAMPLE_ROWS labelled rows, whose statistics alone are written; every row is then judged
    where it is read.
    """
    sample = materialize(labelled_sample(labels), f"{work}/sample")
    named = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rules = learn_rules(_taught(materialize(text_statistics(named), f"{work}/statistics"), sample), f"{work}/bins")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all_columns"), "text")
    judged = text_statistics(whole, ["all_columns"])
    # As rows of a generator the statistics are computed once; a filter would repeat them for each test.
    judged = judged.select("all_columns", F.inline(F.array(F.struct(*judged.columns[1:]))))
    return judged.where(~base_failed() & F.coalesce(rules.verdict(), F.lit(True))).select("all_columns.*")


def quality_rules(docs: DataFrame, labels: DataFrame, work: str) -> DataFrame:
    """Statistics, base_failed and kept for each row of ``docs(doc_id, text)``, by rules learned from ``labels``.

    ``labels(doc_id, quality)`` teach through the rows they name that pass the base limits, SAMPLE_ROWS of them at
    most; labels without a document, and documents without a label, teach nothing. ``work`` gets the statistics,
    computed once.
    """
    statistics = materialize(text_statistics(docs), f"{work}/statistics")
    rules = learn_rules(_taught(statistics, materialize(labelled_sample(labels), f"{work}/sample")), f"{work}/bins")
    verdict = F.coalesce(rules.verdict(), F.lit(True))
    return statistics.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"))
