"""From source rows to features: unified stats, identities, rates, shrinkage, quality adjustment, standard scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

METRICS = ("goals", "assists", "points", "shots", "pim")
#: Metrics that a source's quality doesn't scale.
UNSCALED = ("pim",)


def unified(df: DataFrame, columns: dict[str, str | None], **constants) -> DataFrame:
    """Columns renamed (new: old); old None gives a typed null; constants are literal columns."""
    made = [F.lit(None).cast("double").alias(new) if old is None else F.col(f"`{old}`").alias(new) for new, old in columns.items()]
    return df.select(*made, *[F.lit(v).alias(k) for k, v in constants.items()])


def present(df: DataFrame, columns) -> list[str]:
    """Those of columns that df has, in the order given."""
    return [c for c in columns if c in df.columns]


def season_totals(df: DataFrame, keys: list[str], metrics) -> DataFrame:
    """Sums a key; rows with a null key go, and a sum of nulls alone is 0."""
    return df.na.drop(subset=keys).groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics])


def first_and_sums(df: DataFrame, keys: list[str], first: list[str], sums: list[str], order: str) -> DataFrame:
    """A key's first non-null value of some columns, in the given order, and sums of others; a sum of nulls alone is 0."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return df.na.drop(subset=keys).groupBy(*keys).agg(*firsts, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def of_countries(df: DataFrame, countries: list[str], column: str = "country") -> DataFrame:
    """Rows of persons of some nationalities; unknown ones go."""
    return df.where(F.col(column).isin(*countries))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def id_map(persons: DataFrame, id_columns: dict[str, str], person: str = "canonical_id") -> DataFrame:
    """(source, source_id, person) of persons' ids by source; without nulls."""
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(c).cast("string").alias("source_id")) for s, c in id_columns.items()])
    return persons.select(person, F.inline(pairs)).where("source_id is not null").select("source", "source_id", person)


def attach_ids(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """stats with the person of (source, source_id); unmatched rows go."""
    return stats.join(ids, ["source", "source_id"], "inner")


def unmatched(stats: DataFrame, ids: DataFrame) -> DataFrame:
    return stats.join(ids, ["source", "source_id"], "left_anti")


def with_position(df: DataFrame, positions: DataFrame, code: str = "code") -> DataFrame:
    """df with the position of its (source, code), white space around the code aside; an unknown code or source gives null. positions has a
    configuration's size."""
    key = F.broadcast(positions.withColumnRenamed("code", "__code"))
    return df.withColumn("__code", F.trim(code)).join(key, ["source", "__code"], "left").drop("__code")


def pool(persons: DataFrame, position: str) -> DataFrame:
    """Persons of a position whose eligibility isn't 'no'; an unknown flag stays."""
    return persons.where((F.col("position") == position) & ~F.col("eligible").eqNullSafe("no"))


def restricted(df: DataFrame, to: DataFrame, key: str = "canonical_id") -> DataFrame:
    return df.join(to.select(key), key, "left_semi")


def per_game_rates(df: DataFrame, metrics=METRICS, games: str = "gp") -> DataFrame:
    """metric_per_gp for rows with a game at least; a null metric gives a null rate."""
    return df.where(F.col(games) >= 1).withColumns({f"{m}_per_gp": F.col(m) / F.col(games) for m in present(df, metrics)})


def per_60(x, seconds) -> Column:
    """A count by the hour of time on ice; no time gives null."""
    return F.try_divide(F.col(x), F.try_divide(F.col(seconds), F.lit(3600.0)))


def with_prior(df: DataFrame, metrics=METRICS, cohort: str = "source", k: int = 10, games: str = "gp") -> DataFrame:
    """metric_prior: the exact median rate of the cohort's rows of k games at least, over all seasons. One aggregate for all metrics, then a join
    with one row a cohort."""
    medians = df.groupBy(cohort).agg(*[F.median(F.when(F.col(games) >= k, F.col(f"{m}_per_gp"))).alias(f"{m}_prior") for m in metrics])
    return df.join(F.broadcast(medians), cohort, "left")  # one row a cohort


def shrink(df: DataFrame, metrics=METRICS, cohort: str = "source", k: int = 10, games: str = "gp") -> DataFrame:
    """metric_per_gp_shrunk = (count + k * prior) / (games + k); null without prior or count."""
    out = with_prior(df, metrics, cohort, k, games)
    return out.withColumns({f"{m}_per_gp_shrunk": (F.col(m) + k * F.col(f"{m}_prior")) / (F.col(games) + k) for m in metrics}).drop(*[f"{m}_prior" for m in metrics])


def quality_adjusted(df: DataFrame, multipliers: DataFrame, metrics=METRICS, unscaled=UNSCALED) -> DataFrame:
    """metric_per_gp_quality: the shrunk rate by the source's multiplier (source, multiplier; a configuration's size); unscaled ones as they
    are; an unknown source gives null."""
    out = df.join(F.broadcast(multipliers), "source", "left")
    return out.withColumns({f"{m}_per_gp_quality": F.col(f"{m}_per_gp_shrunk") * (F.lit(1.0) if m in unscaled else F.col("multiplier")) for m in metrics})


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_z over all rows, by the sample deviation; a constant or single column gives 0.0 for every row, null rows included. The moments
    are one aggregate row, joined back, so no window gathers all rows."""
    moments = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(moments), F.lit(True), "left")  # one row
    flat = lambda c: F.coalesce(F.col(f"__s_{c}") == 0, F.lit(True))
    return out.withColumns({f"{c}_z": F.when(flat(c), 0.0).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c in columns}).drop(*moments.columns)


def situation_pivot(df: DataFrame, keys: list[str], situation: str, metrics: list[str], situations: list[str]) -> DataFrame:
    """One row a key with {metric}_{situation}: the first non-null value of each cell."""
    cells = [F.first(F.when(F.col(situation) == s, F.col(m)), ignorenulls=True).alias(f"{m}_{s}") for m in metrics for s in situations]
    return df.groupBy(*keys).agg(*cells)


def primary_stint(df: DataFrame, keys: list[str], games: str = "gp", tie: str = "source") -> DataFrame:
    """A key's row of most games, the first source by name on a tie."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(games), F.asc(tie)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def feature_table(stats: DataFrame, multipliers: DataFrame, metrics=METRICS, k: int = 10) -> DataFrame:
    """stats (person, source, season, gp, metrics) to rates, shrunk rates, quality-adjusted rates and their standard scores."""
    out = quality_adjusted(shrink(per_game_rates(stats, metrics), metrics, k=k), multipliers, metrics)
    return zscores(out, [f"{m}_per_gp_{kind}" for m in metrics for kind in ("shrunk", "quality")])
