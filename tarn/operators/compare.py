"""Comparison over time, under changed multipliers, and with nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarn.operators.features import present, primary_stint
from tarn.sources.shared import materialize


def latest(df: DataFrame, season: str = "season") -> DataFrame:
    """Rows of the latest season; the season is one aggregate row, joined back."""
    return df.join(F.broadcast(df.agg(F.max(season).alias(season))), season, "left_semi")  # one row


def latest_of(df: DataFrame, key: str, season: str = "season") -> DataFrame:
    """Each key's row of its latest season."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, season).alias("__row")).select("__row.*")


def last_seasons(df: DataFrame, key: str, n: int = 3, season: str = "season") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(season)))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def top(df: DataFrame, n: int, by: str, tie: str, descending: bool = True) -> DataFrame:
    """The n rows of highest (or lowest) `by`; nulls last."""
    return df.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), tie).limit(n)


def top_of_each(df: DataFrame, keys: list[str], n: int, by: Column, tie: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(by, tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def scenario_ranks(features: DataFrame, scenarios: DataFrame, rate: str = "points_per_gp_shrunk", key: str = "canonical_id", games: str = "gp") -> DataFrame:
    """Rank of each person of the latest season in each scenario (scenario, source, multiplier; a configuration's size): one join and one
    window for all scenarios. A person counts with the source of most games; ties go by id."""
    current = primary_stint(latest(features), [key], games).select(key, "source", rate)
    scored = current.join(F.broadcast(scenarios), "source").withColumn("value", F.col(rate) * F.col("multiplier"))
    return scored.select("scenario", key, "value", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc_nulls_last("value"), F.asc(key))).alias("rank"))


def scenario_ranks_by_counting(features: DataFrame, scenarios: DataFrame, rate: str = "points_per_gp_shrunk", key: str = "canonical_id", games: str = "gp", parts: int = 200) -> DataFrame:
    """scenario_ranks without a window over a whole scenario: rows are range-partitioned by scenario and value, numbered within, and each
    part's first rank comes from prefix sums over the parts' counts (a row a part and scenario). For tables beyond one task's memory."""
    current = primary_stint(latest(features), [key], games).select(key, "source", rate)
    scored = current.join(F.broadcast(scenarios), "source").withColumn("value", F.col(rate) * F.col("multiplier"))
    order = [F.asc("scenario"), F.desc_nulls_last("value"), F.asc(key)]
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranks")  # both uses below must see the same bounds
    sizes = placed.groupBy("scenario", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("scenario").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.withColumn("before", before)), ["scenario", "part"]).select("scenario", key, "value", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("rank"))


def rank_changes(ranks: DataFrame, key: str = "canonical_id", baseline: str = "baseline") -> DataFrame:
    """scenario, person, rank_baseline, rank_scenario, rank_delta of persons in both."""
    base = ranks.where(F.col("scenario") == baseline).select(key, F.col("rank").alias("rank_baseline"))
    other = ranks.where(F.col("scenario") != baseline).select("scenario", key, F.col("rank").alias("rank_scenario"))
    return other.join(base, key).withColumn("rank_delta", F.col("rank_scenario") - F.col("rank_baseline"))


def sensitivity_summary(changes: DataFrame, n: int = 10, wide: int = 20) -> DataFrame:
    """By scenario: how many of the baseline's top n stay, how many don't, and the mean absolute change of rank of its top `wide`."""
    overlap = F.count_if((F.col("rank_baseline") <= n) & (F.col("rank_scenario") <= n))
    return changes.groupBy("scenario").agg(
        overlap.alias("overlap"), (F.count_if(F.col("rank_baseline") <= n) - overlap).alias("churn"),
        F.round(F.avg(F.when(F.col("rank_baseline") <= wide, F.abs("rank_delta"))), 2).alias("mean_abs_delta"),
    )


def two_seasons(df: DataFrame, season: str = "season") -> DataFrame:
    """Rows of the two latest seasons with __age 1 (latest) or 2; the seasons are a distinct list of a few rows."""
    seasons = df.select(season).distinct().orderBy(F.desc(season)).limit(2)
    aged = seasons.withColumn("__age", F.row_number().over(W.orderBy(F.desc(season))))
    return df.join(F.broadcast(aged), season)


def trajectory(features: DataFrame, metrics: list[str], key: str = "canonical_id", games: str = "gp", band: float = 0.5, one_stint: bool = False, judged: str = "points_per_gp_shrunk") -> DataFrame:
    """Latest against previous season: metric_old, metric_new and d_metric, min_gp, ci_band = band / sqrt(min_gp), and the direction of `judged` beyond the band. With
    one season there are no rows. A person of several sources has a row for each pair; one_stint keeps the source of most games."""
    rows = two_seasons(features)
    if one_stint:
        rows = primary_stint(rows, [key, "season"], games)
    side = lambda age, tag: rows.where(F.col("__age") == age).select(key, F.col("source").alias(f"source_{tag}"), F.col("season").alias(f"season_{tag}"), F.col(games).alias(f"{games}_{tag}"), *[F.col(m).alias(f"{m}_{tag}") for m in metrics])
    both = side(2, "old").join(side(1, "new"), key)
    both = both.withColumns({f"d_{m}": F.col(f"{m}_new") - F.col(f"{m}_old") for m in metrics}).withColumn("min_gp", F.least(f"{games}_old", f"{games}_new"))
    both = both.withColumn("ci_band", F.try_divide(F.lit(band), F.sqrt("min_gp")))
    d = F.col(f"d_{judged}")
    return both.withColumn("direction", F.when(d > F.col("ci_band"), "improving").when(d < -F.col("ci_band"), "declining").otherwise("stable"))


def with_places(paths: DataFrame, coords: DataFrame, persons: DataFrame, columns: list[str], position: str, key: str = "canonical_id", shown=("first_name", "last_name", "source", "appearances", "birth_year")) -> DataFrame:
    """trajectory's rows with each coordinate of the old and the new season (column_old, column_new; null where there is none), the person's data of
    the new season, once each, and the position. A person of several sources in a season has its coordinates of the first one by name."""

    def at(age, tag):
        rows = two_seasons(coords).where(F.col("__age") == age)
        first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "source").alias("c")) if "source" in coords.columns else rows.select(key, F.struct(*columns).alias("c")).dropDuplicates([key])
        return first.select(key, *[F.col(f"c.{c}").alias(f"{c}_{tag}") for c in columns])

    kept = present(persons, shown)
    names = latest(persons).groupBy(key).agg(F.min_by(F.struct(*kept), "source" if "source" in kept else F.lit(0)).alias("p"))
    clash = [c for c in kept if c in paths.columns]
    out = paths.drop(*clash).join(at(2, "old"), key, "left").join(at(1, "new"), key, "left").join(names.select(key, "p.*"), key, "left")
    return out.withColumn("position", F.lit(position))


def top_movers(paths: DataFrame, n: int = 5, by: str = "d_points_per_gp_quality", key: str = "canonical_id") -> DataFrame:
    """The n largest rises among the improving and the n largest falls among the declining."""
    up = top(paths.where("direction = 'improving'"), n, by, key)
    return up.unionByName(top(paths.where("direction = 'declining'"), n, by, key, descending=False))


def neighbours(targets: DataFrame, corpus: DataFrame, on: list[str], columns: list[str], k: int, key: str = "id", scale: bool = True) -> DataFrame:
    """The k rows of corpus nearest to each target among those equal in `on`, itself excluded: target, key, distance, rank.

    Scaled by the sample deviation of the target's candidates (0 counts as 1, one candidate contributes nothing). Targets are few (a stated
    query set); the equi-join on `on` is hashed, moments come from a grouped aggregate, and the ranking window is by target."""
    t = targets.select(F.col(key).alias("target"), *on, *[F.col(c).alias(f"t_{c}") for c in columns])
    pairs = corpus.join(t, on).where(F.col(key) != F.col("target"))
    if scale:
        moments = pairs.groupBy("target").agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
        pairs = pairs.join(moments, "target")
        deviation = lambda c: F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
        parts = [F.coalesce((F.col(c) - F.col(f"t_{c}")) / deviation(c), F.lit(0.0)) for c in columns]
    else:
        parts = [F.col(c) - F.col(f"t_{c}") for c in columns]
    far = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    ranked = pairs.withColumn("distance", far).withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.asc_nulls_last("distance"), F.asc(key))))
    return ranked.where(F.col("rank") <= k).select("target", key, "distance", "rank")


def comparables(features: DataFrame, targets: DataFrame, columns: list[str], k: int = 3, key: str = "canonical_id", cluster: str = "cluster", same_position: bool = True) -> DataFrame:
    """Nearest persons of the same season and cluster, and position unless told otherwise, over standard scores."""
    on = ["season", cluster, *(["position"] if same_position else [])]
    return neighbours(targets, features, on, columns, k, key, scale=False)


def future_path(analogs: DataFrame, careers: DataFrame, years: int = 4, key: str = "id", games: str = "gp") -> DataFrame:
    """Careers of analogs (target, key, age) at the ages after theirs, up to `years` more; per age the stint of most games."""
    c = careers.select(F.col(key), F.col("age").alias("future_age"), *[x for x in careers.columns if x not in (key, "age")])
    hits = analogs.select("target", key, "age").join(c, key).where((F.col("future_age") > F.col("age")) & (F.col("future_age") <= F.col("age") + years))
    rank = F.row_number().over(W.partitionBy("target", key, "future_age").orderBy(F.desc_nulls_last(games), F.asc("source")))
    return hits.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def career_table(landings: DataFrame, multipliers: DataFrame, least_games: int = 5) -> DataFrame:
    """Seasons by age from nested career records: id, birth_date, position and seasons (array of season, source, kind, gp, points). Regular seasons
    (kind 2) of known sources with games enough; rates to three places."""
    rows = landings.select("id", "position", F.substring("birth_date", 1, 4).try_cast("int").alias("born"), F.inline("seasons")).where((F.col("kind") == 2) & F.col("season").isNotNull())
    rows = rows.where(F.col("born").isNotNull() & (F.col("gp") >= least_games)).join(F.broadcast(multipliers), "source")  # a configuration's size
    start = F.substring(F.col("season").cast("string"), 1, 4).cast("int")
    rate = F.coalesce("points", F.lit(0)) / F.col("gp")
    return rows.select("id", "position", start.alias("season"), (start - F.col("born")).alias("age"), "source", "gp", F.coalesce("points", F.lit(0)).alias("points"), F.round(rate, 3).alias("rate"), F.round(rate * F.col("multiplier"), 3).alias("rate_quality"), F.col("multiplier").alias("source_quality"))


def position_group(x: Column) -> Column:
    """F of C, L, R and F; D of D; G of all else."""
    return F.when(x.isin("C", "L", "R", "F"), "F").when(x == "D", "D").otherwise("G")
