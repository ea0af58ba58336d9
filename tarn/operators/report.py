"""Report tables and texts: cluster cards, dashboards, contexts, narratives. Drawing is left to the caller; inputs are small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarn.functions.text import full_name
from tarn.operators.compare import latest


def cluster_cards(coords: DataFrame, features: DataFrame, cluster: str = "cluster", key: str = "canonical_id", n: int = 5, rank_by: str = "points_per_gp_quality_z") -> DataFrame:
    """By cluster of the latest season: members, members with an appearance, median birth year, a map of sources, the top n names, and median
    shrunk rates."""
    members = latest(coords).where(F.col(cluster).isNotNull())
    feats = latest(features).join(members.select(key, cluster).distinct(), key)
    top = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc_nulls_last(rank_by), F.asc(key)))
    named = feats.withColumn("__rank", top).groupBy(cluster).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("__rank") <= n, F.struct("__rank", full_name("first_name", "last_name").alias("name"))))), lambda x: x["name"]).alias("top_names"),
        F.round(F.median("goals_per_gp_shrunk"), 3).alias("median_goals"), F.round(F.median("assists_per_gp_shrunk"), 3).alias("median_assists"),
    )
    base = members.groupBy(cluster).agg(F.count("*").alias("n_members"), F.count_if(F.coalesce("appearances", F.lit(0)) >= 1).alias("n_appeared"), F.median("birth_year").cast("int").alias("median_birth_year"))
    mix = members.groupBy(cluster, "source").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"))
    return base.join(mix, cluster).join(named, cluster, "left")


def plot_table(coords: DataFrame, features: DataFrame, key: str = "canonical_id", rank_by: str = "points_per_gp_quality_z") -> DataFrame:
    """Points of the latest season: unknown ranks -99, unknown clusters -1, ring where there is an appearance."""
    z = latest(features).select(key, F.col(rank_by).alias("rank_value"))
    out = latest(coords).join(z, key, "left")
    return out.withColumns({"rank_value": F.coalesce("rank_value", F.lit(-99.0)), "cluster": F.coalesce("cluster", F.lit(-1)), "ring": F.coalesce("appearances", F.lit(0)) >= 1})


def labelled(df: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """df with the label of its cluster ('Cluster n' where there is none); labels has a configuration's size."""
    return df.join(F.broadcast(labels), cluster, "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))))


def dashboard(showcase: DataFrame, features: DataFrame, coords: DataFrame, paths: DataFrame, analogs: DataFrame, briefs: DataFrame, key: str = "canonical_id") -> DataFrame:
    """A row for each person of the showcase that has features and coordinates, with path, up to three analogs and brief where there are any."""
    place = F.row_number().over(W.partitionBy(key).orderBy("rank", "name"))  # only the first three of a person of the showcase are gathered
    three = analogs.select(key, "rank", "name").join(showcase.select(key).distinct(), key, "left_semi").withColumn("__place", place).where("__place <= 3")
    three = three.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("analogs"))
    out = showcase.join(latest(features), key).join(latest(coords).select(key, "cluster"), key)
    return out.join(paths.select(key, "direction", "d_points_per_gp_quality"), key, "left").join(three, key, "left").join(briefs.select(key, "excerpt"), key, "left").withColumn("has_brief", F.col("excerpt").isNotNull())


def brief_targets(coords: DataFrame, features: DataFrame, n: int | None = None, key: str = "canonical_id", rank_by: str = "points_per_gp_quality_z") -> DataFrame:
    """Eligible persons of the latest season by standard score, nulls last; the first n."""
    rows = latest(coords).where("eligible = 'yes'").join(latest(features).select(key, rank_by), key, "left").orderBy(F.desc_nulls_last(rank_by), key)
    return rows if n is None else rows.limit(n)


def context(fields: list[tuple[str, str]], title: Column) -> Column:
    """A text block: a title line, then 'label: value' lines of the columns that aren't null."""
    return F.concat_ws("\n", title, *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in fields])


def narrative(table: DataFrame, line: Column, order: list) -> DataFrame:
    """One row with a Markdown list of a small table's lines, in the given order."""
    ranked = table.select(F.row_number().over(W.orderBy(*order)).alias("i"), F.concat(F.lit("- "), line).alias("line"))  # a report table: some dozens of rows
    return ranked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def usage_cost(usage: DataFrame, per_million: dict[str, float]) -> DataFrame:
    """Summed token counts and their cost, by prices for a million of each kind."""
    sums = usage.agg(*[F.sum(c).alias(c) for c in per_million])
    return sums.withColumn("cost", F.round(sum((F.col(c) * p / 1e6 for c, p in list(per_million.items())[1:]), F.col(next(iter(per_million))) * next(iter(per_million.values())) / 1e6), 4))


def with_generated(df: DataFrame, context_col: str, generate=None) -> DataFrame:
    """df with `generated`: null, or what the caller's function (an expression of a column) makes of the context."""
    return df.withColumn("generated", F.lit(None).cast("string") if generate is None else generate(F.col(context_col)))


def spotlight(table: DataFrame, key: str, value: str, measure: str) -> DataFrame:
    """One row: `measure` of the row whose key is value (null where there is none), and the highest of all rows."""
    return table.agg(F.max(F.when(F.col(key) == value, F.col(measure))).alias("own"), F.max(measure).alias("highest"))


def _table(df: DataFrame, most: int) -> str:
    from html import escape

    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    more = f"<p>The first {most} rows.</p>\n" if len(rows) > most else ""
    return f"<table><tr>{head}</tr>\n{body}</table>\n{more}"


def page(title: str, sections: list[tuple[str, DataFrame | str]], most: int = 500) -> str:
    """An HTML page of sections: texts (as HTML) and small tables, of each the first `most` rows, a report's limit that the page states where it cuts."""
    from html import escape

    parts = "".join(f"<section><h2>{escape(name)}</h2>\n{what if isinstance(what, str) else _table(what, most)}</section>\n" for name, what in sections)
    links = "".join(f"<li>{escape(name)}</li>" for name, _ in sections)
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>\n<ol>{links}</ol>\n{parts}</body></html>\n"


def html_table(df: DataFrame, title: str, most: int = 500) -> str:
    """A page of one small table."""
    return page(title, [(title, df)], most)
