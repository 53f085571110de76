"""Observation sequences of a site: order, neighbours, running values.

A site may hold a large share of all observations, so no window runs over a whole
site. Rows are ordered inside (site, month); a small table with one row per site and
month carries the running count, the running sums and the first row of the next month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import elapsed_days, elapsed_years
from ..session import cut_lineage


def in_sequence(rows: DataFrame, site: list[str], when: str, tie: str, carry: list[str],
                sums: list[str] | None = None, span: str = "month") -> DataFrame:
    """Add ``epoch_index``, ``first_row`` and ``next_row`` (structs of when, tie and ``carry``),
    and for every column in ``sums`` the running sum and count of its non-null values."""
    sums = sums or []
    rows = rows.withColumn("_span", F.date_trunc(span, F.col(when)))
    row = F.struct(when, tie, *carry)
    local = Window.partitionBy(*site, "_span").orderBy(when, tie)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {"_number": F.row_number().over(local), "_next": F.lead(row).over(local)}
    marks = {"_rows": F.count(F.lit(1)), "_first": F.min_by(row, F.struct(when, tie))}
    for name in sums:
        inside[f"_sum_{name}"], inside[f"_n_{name}"] = F.sum(name).over(upto), F.count(name).over(upto)
        marks[f"_s_{name}"], marks[f"_c_{name}"] = F.sum(name), F.count(name)
    spans = rows.groupBy(*site, "_span").agg(*[e.alias(n) for n, e in marks.items()])
    across = Window.partitionBy(*site).orderBy("_span")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    columns = {
        "_offset": zero("_rows"),
        "first_row": F.first("_first").over(across),
        "_next_span": F.lead("_first").over(across),
    }
    for name in sums:
        columns[f"_ps_{name}"], columns[f"_pc_{name}"] = zero(f"_s_{name}"), zero(f"_c_{name}")
    spans = spans.select(*site, "_span", *[e.alias(n) for n, e in columns.items()])
    same = F.col("_span").eqNullSafe(F.col("_of_span"))  # rows without a date form a span of their own, the first
    for i, k in enumerate(site):
        same = same & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    spans = spans.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(site)], F.col("_span").alias("_of_span"), *columns)
    joined = rows.withColumns(inside).join(spans, same)
    result = joined.withColumns({
        "epoch_index": (F.col("_offset") + F.col("_number") - 1).cast("bigint"),
        "next_row": F.coalesce("_next", "_next_span"),
        **{f"running_sum_{n}": F.coalesce(F.col(f"_sum_{n}"), F.lit(0.0)) + F.col(f"_ps_{n}") for n in sums},
        **{f"running_count_{n}": F.col(f"_n_{n}") + F.col(f"_pc_{n}") for n in sums},
    })
    return result.drop(*[c for c in result.columns if c.startswith("_")])


def epoch_stack(rows: DataFrame, site: list[str], when: str, tie: str) -> DataFrame:
    """Chronological stack: index, label T1…, time since the first observation."""
    df = in_sequence(rows, site, when, tie, [])
    days = F.greatest(elapsed_days(F.col("first_row")[when], F.col(when)), F.lit(0))
    return df.withColumns({
        "epoch_label": F.concat(F.lit("T"), (F.col("epoch_index") + 1).cast("string")),
        "elapsed_days": days,
        "elapsed_years": elapsed_years(days),
    }).drop("first_row", "next_row")


def consecutive_pairs(rows: DataFrame, site: list[str], when: str, tie: str, indices: list[str]) -> DataFrame:
    """The N-1 neighbouring observations of a site with the change of each index."""
    df = in_sequence(rows, site, when, tie, indices).where(F.col("next_row").isNotNull())
    days = elapsed_days(F.col(when), F.col("next_row")[when])
    number = lambda shift: F.concat(F.lit("T"), (F.col("epoch_index") + shift).cast("string"))
    return df.select(
        *site, F.col("epoch_index").alias("step_index"),
        F.concat(number(1), F.lit(" → "), number(2)).alias("transition_label"),
        F.col(tie).alias("before_id"), F.col("next_row")[tie].alias("after_id"),
        F.col(when).alias("date_before"), F.col("next_row")[when].alias("date_after"),
        days.alias("elapsed_days"), elapsed_years(days).alias("elapsed_years"),
        *[F.bround(F.col("next_row")[n] - F.col(n), 4).alias(f"delta_{n}") for n in indices],
    )


def trajectory(rows: DataFrame, site: list[str], when: str, tie: str, indices: list[str]) -> DataFrame:
    """Running mean of each index and its change from the first observation."""
    df = in_sequence(rows, site, when, tie, indices, sums=indices)
    return df.select(
        *site, tie, "epoch_index",
        *[F.when(F.col(f"running_count_{n}") > 0, F.round(F.col(f"running_sum_{n}") / F.col(f"running_count_{n}"), 12)).alias(f"mean_{n}") for n in indices],
        *[F.round(F.col(n) - F.col("first_row")[n], 6).alias(f"change_{n}") for n in indices],
    )


def fill_gaps(stack: DataFrame, profiles: DataFrame, site: list[str], indices: list[str]) -> DataFrame:
    """Missing indices of an epoch from its own pair's before side; only the last epoch,
    which opens no pair, takes the previous pair's after side."""
    profiles = cut_lineage(profiles)  # used twice, few rows
    own = profiles.select(*site, F.col("step_index").alias("epoch_index"), F.lit(True).alias("_own"),
                          *[F.col(f"{n}_before").alias(f"_own_{n}") for n in indices])
    previous = profiles.select(*site, (F.col("step_index") + 1).alias("epoch_index"),
                               *[F.col(f"{n}_after").alias(f"_prev_{n}") for n in indices])
    df = stack.join(own, [*site, "epoch_index"], "left").join(previous, [*site, "epoch_index"], "left")
    return df.withColumns({
        n: F.coalesce(F.col(n), F.when(F.col("_own"), F.col(f"_own_{n}")).otherwise(F.col(f"_prev_{n}"))) for n in indices
    }).drop("_own", *[f"_own_{n}" for n in indices], *[f"_prev_{n}" for n in indices])


def earliest_confirmed(rows: DataFrame, site: list[str], when: str, tie: str, usable: str, state: str) -> DataFrame:
    """Backward walk: earliest date of the unbroken run of usable observations that show
    the state seen last. Two aggregates per site, no ordering of a whole site."""
    seen = rows.where(F.col(usable))
    order = F.struct(when, tie)
    last = seen.groupBy(*site).agg(F.max_by(state, order).alias("confirmed_state"), F.max(when).alias("last_date"))
    tagged = seen.join(last, site)
    broken = F.when(F.col(state) != F.col("confirmed_state"), order)
    breaks = tagged.groupBy(*site).agg(F.max(broken).alias("_break"))
    run = tagged.join(breaks, site).where(F.col("_break").isNull() | (order > F.col("_break")))
    return run.groupBy(*site, "confirmed_state", "last_date").agg(
        F.min(when).alias("earliest_date"), F.count(F.lit(1)).alias("supporting_observations"))


def nearest_observation(rows: DataFrame, wanted: DataFrame, site: list[str], when: str, tie: str,
                        tolerance_days: int, min_quality: float) -> DataFrame:
    """As-of join: per wanted (site, label, target date) the closest usable observation
    within the tolerance, else ``insufficient_coverage``.

    Both sides are keyed by site and time cell as wide as the tolerance, so a hot site
    spreads over its cells; a target looks into its own cell and the two beside it.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    cell = lambda c: F.floor(day(c) / tolerance_days)
    good = rows.where(F.col("quality_confidence") >= min_quality).select(*site, F.col(when), F.col(tie), cell(when).alias("_cell"))
    asked = wanted.withColumn("_cell", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("target") + i)))
    distance = F.abs(F.datediff(F.col(when), F.col("target")))
    hit = asked.join(good, [*site, "_cell"]).withColumn("_distance", distance).where(F.col("_distance") <= tolerance_days)
    keys = [*site, "label", "target"]
    best = hit.groupBy(*keys).agg(F.min_by(F.struct(F.col(tie), F.col("_distance")), F.struct("_distance", tie)).alias("_best"))
    return wanted.join(best, keys, "left").select(
        *keys, F.col("_best")[tie].alias("nearest_id"), F.col("_best")["_distance"].alias("distance_days"),
        F.when(F.col("_best").isNull(), "insufficient_coverage").otherwise("ok").alias("status"))
