"""Cohort benchmarks: age buckets, grouped measures, rates by population, full grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_cohort(df: DataFrame, cohorts: DataFrame, season: str = "season", birth_year: str = "birth_year") -> DataFrame:
    """df with age and cohort; rows in no cohort go. cohorts (cohort, youngest, oldest) has a few rows and is broadcast."""
    aged = df.withColumn("age", F.col(season) - F.col(birth_year))
    return aged.join(F.broadcast(cohorts), F.col("age").between(F.col("youngest"), F.col("oldest"))).drop("youngest", "oldest")


def cohort_table(df: DataFrame, population: DataFrame, keys=("country", "position", "cohort"), rate: str = "rate", games: str = "gp") -> DataFrame:
    """By keys: n, n by million inhabitants, median, mean and highest rate, games. population (country, million) is a configuration's size."""
    made = df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.median(rate), 3).alias("median_rate"), F.round(F.avg(rate), 3).alias("mean_rate"), F.round(F.max(rate), 3).alias("top_rate"), F.sum(games).alias("games"))
    return made.join(F.broadcast(population), "country", "left").withColumn("per_million", F.round(F.try_divide("n", "million"), 3)).drop("million")


def per_million(table: DataFrame, population: DataFrame) -> DataFrame:
    """By country: persons, by million inhabitants, and the rank of that."""
    sums = table.groupBy("country").agg(F.sum("n").alias("n")).join(F.broadcast(population), "country")
    return sums.withColumn("per_million", F.round(F.col("n") / F.col("million"), 2)).drop("million").orderBy(F.desc("per_million"), "country")


def grid(table: DataFrame, dims: dict[str, list[str]], counts: list[str]) -> DataFrame:
    """A row for each combination of the dimensions' given values; missing ones have counts 0 and null measures."""
    spark, cells = table.sparkSession, [()]
    for values in dims.values():
        cells = [(*c, v) for c in cells for v in values]
    full = spark.createDataFrame(cells, ", ".join(f"{d} string" for d in dims))
    return full.join(table, list(dims), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def matrix(table: DataFrame, row: str, column: str, values: list[str], cell: str) -> DataFrame:
    """A row for each `row`, a column for each of the given values of `column`."""
    return table.groupBy(row).pivot(column, values).agg(F.first(cell, ignorenulls=True))
