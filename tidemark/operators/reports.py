"""Summaries, status rows and logs over scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scores
from tidemark.functions.images import long_image
from tidemark.plans.joins import join_per_key
from tidemark.plans.running import running_sums
from tidemark.plans.segments import DEFAULT_SPLIT, Split, join_keys
from tidemark.session import stored

TINY = 1e-12


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def _medians_of_counts(df: DataFrame, keys: Sequence[str], value: str, split: Split) -> DataFrame:
    """Exact medians from value counts: no task has to hold all values of a key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, keys, [value], {"_upto": F.col("_c")}, split=split)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    if keys:
        ranked = join_per_key(ranked, totals, keys, [value], split=split)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    below = F.col("_upto") - F.col("_c")
    low, high = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((below < place) & (place <= F.col("_upto")), F.col(value)))

    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def _medians(df: DataFrame, keys: Sequence[str], value: str, split: Split) -> DataFrame:
    """Exact medians; values without a long image are counted and ranked one by one."""
    image = long_image(F.col(value), df.schema[value].dataType)
    if image is None:
        return _medians_of_counts(df, keys, value, split)
    return _medians_by_selection(df.withColumn("_image", image), keys, value, split)


def _medians_by_selection(rows: DataFrame, keys: Sequence[str], value: str, split: Split) -> DataFrame:
    """Both middle values of every key by counting, sixteen bits of the image at a time.

    A round counts the rows of each key in the cell that holds a middle place, by
    the next bits of their images: at most 65,536 counts per key and round, pre-summed
    before the shuffle, and four rounds whatever the values are.  Values are
    never sorted; ``rows`` is read once per round.
    """
    places = None
    for shift in (48, 32, 16, 0):
        cell = F.shiftright("_image", shift)
        if places is None:
            found = rows.withColumn("_cell", cell)
            scope = list(keys)
        else:
            scope = [*keys, "_upper"]
            found = rows.select(*keys, value, cell.alias("_cell"), F.shiftright("_image", shift + 16).alias("_upper"))
            known = places.select(*scope, F.col("_c").alias("_rows")).distinct()
            held = known.drop("_rows")
            found = join_per_key(found, held, scope, ["_cell"], how="inner", split=split, counts=known)
        measures = [F.count(F.lit(1)).alias("_c"), F.max(value).alias("_value")]
        counts = found.groupBy(*scope, "_cell").agg(*measures)
        inside = Window.partitionBy(*scope)
        upto = F.sum("_c").over(inside.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto)
        if places is None:
            counts = counts.withColumn("_total", F.sum("_c").over(inside))
            middle = F.array(F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2))
            counts = counts.withColumn("_place", F.explode(F.array_distinct(middle)))
        else:
            counts = join_keys(counts, places.drop("_c"), scope, "inner")
        held = counts.filter((F.col("_upto") - F.col("_c") < F.col("_place")) & (F.col("_place") <= F.col("_upto")))
        rest = (F.col("_place") - F.col("_upto") + F.col("_c")).alias("_place")
        # at most two rows per key; written, so that no round repeats the earlier ones
        places = stored(held.select(*keys, F.col("_cell").alias("_upper"), rest, "_c", "_value"), "middles")
        if shift:
            places = places.drop("_value")
    low, high = F.min("_value"), F.max("_value")
    if isinstance(rows.schema[value].dataType, T.FloatType):
        low, high = low.cast("double"), high.cast("double")
    return places.groupBy(*keys).agg(((low + high) / 2).alias("median"))


def distribution_summary(
    df: DataFrame, value: str, keys: Sequence[str] = (), *, split: Split = DEFAULT_SPLIT
) -> DataFrame:
    """``mean median std min max`` (population std); NULLs skipped, no row without values."""
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    medians = _medians(rows, keys, value, split)
    if keys:
        joined = join_per_key(stats, medians, keys, keys, how="inner", split=Split(hot_rows=None))
    else:
        joined = stats.withColumn("median", medians.scalar())
    found = joined.filter(F.col("_n") > 0)
    return found.select(*keys, "mean", "median", "std", "min", "max")


def value_entropy(
    df: DataFrame, keys: Sequence[str], value: str, *, split: Split = DEFAULT_SPLIT
) -> DataFrame:
    """Shannon entropy in bits of the values of each key as column ``entropy``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    rows = join_per_key(counts, totals, keys, [value], split=split)
    p = F.col("_c") / F.col("_total")
    return rows.groupBy(*keys).agg((-F.sum(p * F.log2(p + TINY))).alias("entropy"))


def review_summary(reviewed: DataFrame) -> DataFrame:
    """One row: ``total anomalies avg_confidence``, zeros on empty input."""
    return reviewed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomalous").alias("anomalies"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def report_rows(reviewed: DataFrame, id_column: str, digits: int = 4) -> DataFrame:
    """Rows of the report: rounded metrics, missing ones as 0, and the status word."""

    def metric(name: str) -> Column:
        if name not in reviewed.columns:
            return F.lit(0.0).alias(name)
        return F.round(F.coalesce(F.col(name), F.lit(0.0)), digits).alias(name)

    ident = F.coalesce(F.col(id_column).cast("string"), F.lit("N/A"))
    status = F.when(F.col("is_anomalous"), "ANOMALY").otherwise("NORMAL")
    metrics = ["mahalanobis_distance", "entropy", "z_score", "confidence"]
    return reviewed.select(
        ident.alias("source_id"), *[metric(m) for m in metrics], status.alias("status")
    )


def confidence_alerts(reviewed: DataFrame, limit: float = scores.ALERT_CONFIDENCE) -> DataFrame:
    """ERROR rows for confidence below the limit, with level, message and threshold."""
    low = reviewed.filter(F.col("confidence") < limit)
    # fixed value: the wording of the alert
    message = F.concat(F.lit("Confidence dropped to "), F.format_string("%.4f", "confidence"))
    return low.select(
        *reviewed.columns,
        F.lit("ERROR").alias("level"),
        message.alias("message"),
        F.lit(limit).alias("threshold"),
    )


def metric_status(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("status", scores.metric_status(F.col(value)))


def recent_logs(
    df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = (), count: int = 25
) -> DataFrame:
    """The latest entries, over all rows or per key (limited before the shuffle)."""
    latest = [F.desc(c) for c in order_by]
    if not keys:
        return df.orderBy(*latest).limit(count)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))
    return df.withColumn("_place", place).filter(F.col("_place") <= count).drop("_place")


def metric_statistics(
    df: DataFrame, metric: str, value: str, order_by: Sequence[str]
) -> DataFrame:
    """Per metric its latest value, mean and sample variance of all values so far."""
    return df.groupBy(metric).agg(
        F.max_by(value, F.struct(*order_by)).alias("current"),
        F.avg(value).alias("rolling_mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"),
    )
