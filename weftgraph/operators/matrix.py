"""Cleaning and scaling of data matrices in long form (row, col, x); a missing cell is a row with NULL ``x``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

X = F.col


def long_form(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, col, x) of a wide table; ``col`` numbers the columns from 0."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("col", "x")
    return df.select(F.col(row).alias("row"), cells)


def impute_constant(m: DataFrame, value: float) -> DataFrame:
    return m.withColumn("x", F.coalesce("x", F.lit(float(value))))


def impute_column_average(m: DataFrame) -> DataFrame:
    """Missing cells get the mean of their column's present ones, 0 if it has none."""
    means = m.groupBy(F.col("col").alias("c_")).agg(F.avg("x").alias("mean_"))
    return m.join(means, F.col("col") == F.col("c_")).select("row", "col", F.coalesce("x", "mean_", F.lit(0.0)).alias("x"))


def impute_row_interpolation(m: DataFrame) -> DataFrame:
    """Linear between the nearest present cells of the row; one-sided gaps take that cell, empty rows 0."""
    left = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("row").orderBy("col").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("x").isNotNull(), F.col("col"))
    near = m.select("row", "col", "x", F.last("x", True).over(left).alias("a"), F.last(at, True).over(left).alias("ca"), F.first("x", True).over(right).alias("b"), F.first(at, True).over(right).alias("cb"))
    between = F.col("a") + (F.col("b") - F.col("a")) * F.try_divide(F.col("col") - F.col("ca"), F.col("cb") - F.col("ca"))
    return near.select("row", "col", F.coalesce("x", between, "a", "b", F.lit(0.0)).alias("x"))


def clip_constant(m: DataFrame, most: float) -> DataFrame:
    return m.withColumn("x", F.when(F.col("x").isNotNull(), F.least("x", F.lit(float(most)))))


def clip_winsorize(m: DataFrame, percentile: float) -> DataFrame:
    """Per row: cells above the value at index ``floor(percentile * (width - 1) / 100)`` of the sorted row become it."""
    sorted_ = m.where("x is not null").groupBy(F.col("row").alias("r_")).agg(F.sort_array(F.collect_list("x")).alias("v_"))
    most = F.element_at("v_", (F.floor((F.size("v_") - 1) * percentile / 100) + 1).cast("int"))
    return m.join(sorted_.select("r_", most.alias("most_")), F.col("row") == F.col("r_"), "left").select("row", "col", F.when(F.col("x").isNotNull(), F.least("x", "most_")).alias("x"))


def scale_log(m: DataFrame, base: int = 2) -> DataFrame:
    """log(x + e), e being half the smallest positive cell of all; NULL where that has no logarithm."""
    least = m.agg((F.min(F.when(F.col("x") > 0, F.col("x"))) * 0.5).alias("e_"))
    shifted = F.col("x") + F.coalesce("e_", F.lit(0.0))
    value = F.when(shifted > 0, F.log2(shifted) if base == 2 else F.log10(shifted))
    return m.crossJoin(F.broadcast(least)).select("row", "col", value.alias("x"))  # one row


def scale_antilog(m: DataFrame, base: int = 2) -> DataFrame:
    return m.withColumn("x", F.pow(F.lit(float(base)), "x"))


def scale_arcsin(m: DataFrame) -> DataFrame:
    """Inverse sine; NaN outside [-1, 1]."""
    return m.withColumn("x", F.asin("x"))


def _by_column(m: DataFrame, stats: list[Column], value: Column) -> DataFrame:
    held = m.groupBy(F.col("col").alias("c_")).agg(*stats)
    return m.join(held, F.col("col") == F.col("c_")).select("row", "col", F.when(F.col("x").isNotNull(), F.coalesce(value, F.lit(0.0))).alias("x"))


def _over(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def normalise_minmax(m: DataFrame) -> DataFrame:
    return _by_column(m, [F.min("x").alias("lo_"), F.max("x").alias("hi_")], _over(X("x") - X("lo_"), X("hi_") - X("lo_")))


def normalise_mean(m: DataFrame) -> DataFrame:
    return _by_column(m, [F.min("x").alias("lo_"), F.max("x").alias("hi_"), F.avg("x").alias("mean_")], _over(X("x") - X("mean_"), X("hi_") - X("lo_")))


def normalise_standardise(m: DataFrame) -> DataFrame:
    return _by_column(m, [F.avg("x").alias("mean_"), F.stddev_pop("x").alias("dev_")], _over(X("x") - X("mean_"), X("dev_")))


def normalise_unit(m: DataFrame) -> DataFrame:
    return _by_column(m, [F.sqrt(F.sum(X("x") * X("x"))).alias("norm_")], _over(X("x"), X("norm_")))


def normalise_softmax(m: DataFrame) -> DataFrame:
    """exp(x - max) over its column's sum."""
    top = m.groupBy(F.col("col").alias("c_")).agg(F.max("x").alias("top_"))
    raised = m.join(top, F.col("col") == F.col("c_")).select("row", "col", F.exp(X("x") - X("top_")).alias("x"))
    return _by_column(raised, [F.sum("x").alias("sum_")], _over(X("x"), X("sum_")))


def _ranks(m: DataFrame, dense: bool) -> DataFrame:
    """``m`` with ``k_``: the place (1, 2, ...) of each present cell in its column, rows ranged over the cluster.

    Cells are ranged by (col, x), so no task holds a column.  A range's cells of one column are
    numbered there, and the counts of the ranges before are added.
    """
    from weftgraph.plans.iterate import cut

    counted = m.where("x is not null")
    if dense:
        counted = counted.select("col", "x").distinct()
    ranged = cut(counted.repartitionByRange("col", "x", *([] if dense else ["row"])).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy("range_", "col").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.partitionBy("col").orderBy("range_")) - F.col("n_")).select(F.col("range_").alias("r2_"), F.col("col").alias("c2_"), "before_")
    local = ranged.withColumn("l_", F.row_number().over(Window.partitionBy("range_", "col").orderBy("x", *([] if dense else ["row"]))))
    ranked = local.join(before, (F.col("range_") == F.col("r2_")) & (F.col("col") == F.col("c2_"))).withColumn("k_", F.col("l_") + F.col("before_"))
    return ranked.select("col", "x", "k_") if dense else ranked.select("row", "col", "x", "k_")


def normalise_quantile(m: DataFrame) -> DataFrame:
    """A cell becomes the mean of the cells at its dense rank in the sorted columns; ties share a rank."""
    means = _ranks(m, dense=False).groupBy("k_").agg(F.avg("x").alias("mean_"))
    dense = _ranks(m, dense=True).join(means, "k_").select(F.col("col").alias("c_"), F.col("x").alias("v_"), "mean_")
    return m.join(dense, (F.col("col") == F.col("c_")) & (F.col("x") == F.col("v_")), "left").select("row", "col", F.col("mean_").alias("x"))


def row_statistics(m: DataFrame) -> DataFrame:
    """Per row: n, sum, sum of squares, low, high, range, mean, variance, deviation, coefficient of variation, magnitude, variability, column of the largest |x|."""
    x = X("x")
    n, total, squares, mean = F.count("x").cast("double"), F.sum("x"), F.sum(x * x), F.avg("x")
    return m.groupBy("row").agg(
        F.count("x").alias("n"), total.alias("sum"), squares.alias("squares"), F.min("x").alias("low"), F.max("x").alias("high"), (F.max("x") - F.min("x")).alias("range"), mean.alias("mean"), F.var_pop("x").alias("variance"), F.stddev_pop("x").alias("deviation"),
        F.when((F.min("x") >= 0) & (mean > 0), F.stddev_pop("x") / mean).alias("variation"), F.sqrt(squares).alias("magnitude"), F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))).alias("variability"),
        F.max_by("col", F.when(x.isNotNull(), F.struct(F.abs(x), -F.col("col")))).alias("largest"),
    )


def median_and_mad(m: DataFrame) -> DataFrame:
    """(row, median, mad): exact; of two middle values their mean."""
    medians = m.groupBy(F.col("row").alias("r_")).agg(F.median("x").alias("median"))
    return m.join(medians, F.col("row") == F.col("r_")).groupBy("row").agg(F.min("median").alias("median"), F.median(F.abs(X("x") - X("median"))).alias("mad"))


def tokenise_discrete(value: Column) -> Column:
    """A number for each text; missing, empty, ``0`` and ``false`` are 0."""
    return F.when(value.isNull() | value.isin("", "0", "false"), F.lit(0).cast("long")).otherwise(F.xxhash64(value))
