"""The cohort queries over the driver's tables, and their SQL.

Roles: a person is a customer, a season the year of an order, a source the market segment; games are orders, goals those of status F, assists those
of status O, pim the urgent ones. Other queries read the other tables in the roles that their operators need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarn.functions import text
from tarn.operators import cohort, compare, features, project, report, resolve
from tarn.plans import dims
from tarn.sources import html, tables
from tarn.sources.shared import materialize

METRICS = ("goals", "assists", "points", "pim")
#: A multiplier for each market segment but one, which stays unknown; inhabitants by region; the share of the scenarios; least games of a prior.
SEGMENTS = {"AUTOMOBILE": 1.0, "BUILDING": 0.55, "FURNITURE": 0.45, "MACHINERY": 0.42}
REGIONS = {"AFRICA": 14.0, "AMERICA": 10.0, "ASIA": 47.0, "EUROPE": 7.5}
CHANGED, SHARE, K = ["BUILDING", "FURNITURE", "MACHINERY"], 0.2, 2
BUCKETS = [("low", -2000, -1), ("mid", 0, 4999), ("high", 5000, 20000)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    goal, assist = (F.col("o_orderstatus") == "F").cast("long"), (F.col("o_orderstatus") == "O").cast("long")
    unified = rows.select(F.col("o_custkey").alias("canonical_id"), F.year("o_orderdate").alias("season"), F.col("c_mktsegment").alias("source"), F.lit(1).cast("long").alias("gp"), goal.alias("goals"), assist.alias("assists"), (goal + assist).alias("points"), F.col("o_orderpriority").startswith("1").cast("long").alias("pim"))
    return features.season_totals(unified, ["canonical_id", "season", "source"], ["gp", *METRICS])


STATS = """WITH stats AS (SELECT o_custkey AS canonical_id, CAST(year(o_orderdate) AS INTEGER) AS season, c_mktsegment AS source, count(*) AS gp,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS goals, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS assists,
 CAST(sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS pim
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2, 3)"""
RATES = STATS + ", rates AS (SELECT *, " + ", ".join(f"{m} / CAST(gp AS DOUBLE) AS {m}_per_gp" for m in METRICS) + " FROM stats WHERE gp >= 1)"
SHRUNK = RATES + ", prior AS (SELECT source, " + ", ".join(f"median(CASE WHEN gp >= {K} THEN {m}_per_gp END) AS {m}_prior" for m in METRICS) + f""" FROM rates GROUP BY source),
 shrunk AS (SELECT rates.*, {", ".join(f"({m} + {K} * {m}_prior) / (gp + {K}) AS {m}_per_gp_shrunk" for m in METRICS)} FROM rates LEFT JOIN prior USING (source))"""
VALUES = ", ".join(f"('{s}', CAST({m} AS DOUBLE))" for s, m in SEGMENTS.items())
QUALITY = SHRUNK + f", dim(source, multiplier) AS (VALUES {VALUES}), quality AS (SELECT shrunk.*, multiplier, " + ", ".join(f"{m}_per_gp_shrunk * {'1.0' if m == 'pim' else 'multiplier'} AS {m}_per_gp_quality" for m in METRICS) + " FROM shrunk LEFT JOIN dim USING (source))"
SCENARIOS = QUALITY + ", scenarios(scenario, source, multiplier) AS (VALUES " + ", ".join(f"('{n}', '{s}', CAST({v} AS DOUBLE))" for n, _, vs in dims.scenarios(SEGMENTS, CHANGED, SHARE) for s, v in vs.items()) + """),
 ranks AS (SELECT sc.scenario, canonical_id, round(points_per_gp_shrunk * sc.multiplier, 9) AS value, row_number() OVER (PARTITION BY sc.scenario ORDER BY points_per_gp_shrunk * sc.multiplier DESC NULLS LAST, canonical_id) AS rank
  FROM shrunk JOIN scenarios sc USING (source) WHERE season = (SELECT max(season) FROM shrunk))"""
CHANGES = SCENARIOS + """, changes AS (SELECT o.scenario, canonical_id, b.rank AS rank_baseline, o.rank AS rank_scenario, o.rank - b.rank AS rank_delta
 FROM ranks o JOIN (SELECT * FROM ranks WHERE scenario = 'baseline') b USING (canonical_id) WHERE o.scenario <> 'baseline')"""
PATHS = QUALITY + """, pair AS (SELECT season, row_number() OVER (ORDER BY season DESC) AS age FROM (SELECT DISTINCT season FROM quality)),
 o AS (SELECT * FROM quality WHERE season = (SELECT season FROM pair WHERE age = 2)), n AS (SELECT * FROM quality WHERE season = (SELECT season FROM pair WHERE age = 1)),
 paths AS (SELECT canonical_id, o.gp AS gp_old, n.gp AS gp_new, n.points_per_gp_shrunk - o.points_per_gp_shrunk AS d_shrunk, n.points_per_gp_quality - o.points_per_gp_quality AS d_quality, least(o.gp, n.gp) AS min_gp, 0.5 / sqrt(least(o.gp, n.gp)) AS ci_band FROM o JOIN n USING (canonical_id)),
 judged AS (SELECT *, CASE WHEN d_shrunk > ci_band THEN 'improving' WHEN d_shrunk < -ci_band THEN 'declining' ELSE 'stable' END AS direction FROM paths)"""


def shrunk(spark, sf_dir):
    return features.shrink(features.per_game_rates(stats(spark, sf_dir), METRICS), METRICS, k=K)


def quality(spark, sf_dir):
    return features.quality_adjusted(shrunk(spark, sf_dir), dims.mapping(spark, SEGMENTS, "source", "multiplier"), METRICS)


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(STATS + " SELECT * FROM stats")
def season_totals(spark, sf_dir):
    return stats(spark, sf_dir)


@query("""SELECT o_custkey AS canonical_id, 'closed' AS source, CAST(o_totalprice AS DOUBLE) AS shots FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_custkey, 'open', CAST(NULL AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'""")
def source_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = features.unified(orders.where("o_orderstatus = 'F'"), {"canonical_id": "o_custkey", "shots": "o_totalprice"}, source="closed")
    b = features.unified(orders.where("o_orderstatus = 'O'"), {"canonical_id": "o_custkey", "shots": None}, source="open")
    return features.stacked([a, b]).select("canonical_id", "source", "shots")


PERSON_IDS = "ids AS (SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS source_id, c_name AS canonical_id FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"
PERSON_ROWS = """rows AS (SELECT 'customer' AS source, CAST(o_custkey AS VARCHAR) AS source_id, count(*) AS gp FROM orders GROUP BY 2 UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2
 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)"""


def _identities(spark, sf_dir):
    """Persons are customers and suppliers; users of events have no identity."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("canonical_id"), F.col("c_custkey").alias("customer_id"), F.lit(None).cast("bigint").alias("supplier_id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("canonical_id"), F.lit(None).cast("bigint").alias("customer_id"), F.col("s_suppkey").alias("supplier_id"))
    ids = features.id_map(c.unionByName(s), {"customer": "customer_id", "supplier": "supplier_id"})
    of = lambda name, key, source: table(spark, sf_dir, name).groupBy(F.col(key).cast("string").alias("source_id")).agg(F.count("*").alias("gp")).withColumn("source", F.lit(source))
    return ids, features.stacked([of("orders", "o_custkey", "customer"), of("lineitem", "l_suppkey", "supplier"), of("events", "user_id", "user")])


@query(f"WITH {PERSON_IDS}, {PERSON_ROWS} SELECT source, source_id, gp, canonical_id FROM rows JOIN ids USING (source, source_id)")
def attach_ids(spark, sf_dir):
    ids, rows = _identities(spark, sf_dir)
    return features.attach_ids(rows, ids).select("source", "source_id", "gp", "canonical_id")


@query(f"WITH {PERSON_IDS}, {PERSON_ROWS} SELECT source, count(*) AS n FROM rows WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.source = rows.source AND ids.source_id = rows.source_id) GROUP BY source")
def unmatched_ids(spark, sf_dir):
    ids, rows = _identities(spark, sf_dir)
    return features.unmatched(rows, ids).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND (CASE WHEN c_acctbal < 0 THEN 'no' WHEN c_acctbal > 5000 THEN 'yes' END) IS DISTINCT FROM 'no')""")
def pool_semi(spark, sf_dir):
    flag = F.when(F.col("c_acctbal") < 0, "no").when(F.col("c_acctbal") > 5000, "yes")
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("position"), flag.alias("eligible"))
    return features.restricted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), features.pool(persons, "BUILDING"), "o_custkey")


@query(RATES + ", r AS (SELECT * FROM rates WHERE gp >= 2) SELECT canonical_id, season, source, gp, " + ", ".join(f"round({m}_per_gp, 6) AS {m}_per_gp" for m in METRICS) + " FROM r")
def per_game_rates(spark, sf_dir):
    got = features.per_game_rates(stats(spark, sf_dir), METRICS).where("gp >= 2")
    return rounded(got.select("canonical_id", "season", "source", "gp", *[f"{m}_per_gp" for m in METRICS]), [f"{m}_per_gp" for m in METRICS])


@query(SHRUNK + " SELECT canonical_id, season, source, " + ", ".join(f"round({m}_per_gp_shrunk, 6) AS {m}_per_gp_shrunk" for m in METRICS) + " FROM shrunk")
def cohort_median_shrink(spark, sf_dir):
    made = [f"{m}_per_gp_shrunk" for m in METRICS]
    return rounded(shrunk(spark, sf_dir).select("canonical_id", "season", "source", *made), made)


@query(QUALITY + " SELECT canonical_id, season, source, multiplier, " + ", ".join(f"round({m}_per_gp_quality, 6) AS {m}_per_gp_quality" for m in METRICS) + " FROM quality")
def quality_adjust(spark, sf_dir):
    made = [f"{m}_per_gp_quality" for m in METRICS]
    return rounded(quality(spark, sf_dir).select("canonical_id", "season", "source", "multiplier", *made), made)


Z = ["points_per_gp_shrunk", "points_per_gp_quality"]


@query(QUALITY + " SELECT canonical_id, season, source, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in Z) + " FROM quality")
def global_z(spark, sf_dir):
    got = features.zscores(quality(spark, sf_dir), Z)
    return rounded(got.select("canonical_id", "season", "source", *[f"{c}_z" for c in Z]), [f"{c}_z" for c in Z])


@query("SELECT n_nationkey, CAST(0.0 AS DOUBLE) AS same_z, round((n_regionkey - avg(n_regionkey) OVER ()) / stddev_samp(n_regionkey) OVER (), 6) AS region_z FROM nation")
def zero_variance_z(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1.5).alias("same"), F.col("n_regionkey").alias("region"))
    return rounded(features.zscores(nations, ["same", "region"]).select("n_nationkey", "same_z", "region_z"), ["region_z"])


TOP = QUALITY + " SELECT canonical_id, source, gp, round(points_per_gp_quality, 6) AS points_per_gp_quality FROM quality WHERE season = (SELECT max(season) FROM quality) ORDER BY quality.points_per_gp_quality DESC NULLS LAST, canonical_id LIMIT 50"


@query(TOP)
def top_persons(spark, sf_dir):
    """The flagship: the latest season's persons by quality-adjusted shrunk rate."""
    best = compare.top(compare.latest(quality(spark, sf_dir)), 50, "points_per_gp_quality", "canonical_id")
    return rounded(best.select("canonical_id", "source", "gp", "points_per_gp_quality"), ["points_per_gp_quality"])


TYPES = ["click", "view", "purchase"]


@query("SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 4) AS value_{t}, CAST(nullif(count(CASE WHEN event_type = '{t}' THEN 1 END), 0) AS BIGINT) AS n_{t}" for t in TYPES) + " FROM events GROUP BY user_id")
def situation_pivot(spark, sf_dir):
    long = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))
    return features.situation_pivot(long, ["user_id"], "event_type", ["value", "n"], TYPES)


@query("SELECT user_id, event_type, round(count(*) / nullif(sum(value) / 3600.0, 0), 4) AS per_60 FROM events GROUP BY 1, 2")
def per_60(spark, sf_dir):
    long = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("seconds"))
    return long.select("user_id", "event_type", F.round(features.per_60("n", "seconds"), 4).alias("per_60"))


@query("SELECT l_partkey, source, gp FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY gp DESC, source) AS r FROM (SELECT l_partkey, CAST(l_suppkey AS VARCHAR) AS source, count(*) AS gp FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def primary_stint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_suppkey").cast("string").alias("source")).agg(F.count("*").alias("gp"))
    return features.primary_stint(rows, ["l_partkey"])


def _scenarios(spark):
    return dims.scenario_dim(spark, SEGMENTS, CHANGED, SHARE)


@query(SCENARIOS + " SELECT scenario, canonical_id, value, CAST(rank AS INTEGER) AS rank FROM ranks")
def scenario_ranks(spark, sf_dir):
    return rounded(compare.scenario_ranks(shrunk(spark, sf_dir), _scenarios(spark)), ["value"], 9)


@query(SCENARIOS + " SELECT scenario, canonical_id, value, CAST(rank AS INTEGER) AS rank FROM ranks")
def scenario_ranks_by_counting(spark, sf_dir):
    return rounded(compare.scenario_ranks_by_counting(shrunk(spark, sf_dir), _scenarios(spark), parts=16), ["value"], 9)


@query(CHANGES + """ SELECT scenario, CAST(sum(CASE WHEN rank_baseline <= 10 AND rank_scenario <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS overlap, CAST(sum(CASE WHEN rank_baseline <= 10 THEN 1 ELSE 0 END) - sum(CASE WHEN rank_baseline <= 10 AND rank_scenario <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS churn,
 round(avg(CASE WHEN rank_baseline <= 20 THEN abs(rank_delta) END), 2) AS mean_abs_delta FROM changes GROUP BY scenario""")
def sensitivity_summary(spark, sf_dir):
    return compare.sensitivity_summary(compare.rank_changes(compare.scenario_ranks(shrunk(spark, sf_dir), _scenarios(spark))))


MOVED = ["points_per_gp_shrunk", "points_per_gp_quality"]


@query(PATHS + " SELECT canonical_id, gp_old, gp_new, round(d_shrunk, 6) AS d_shrunk, round(d_quality, 6) AS d_quality, min_gp, round(ci_band, 6) AS ci_band, direction FROM judged")
def trajectory(spark, sf_dir):
    got = compare.trajectory(quality(spark, sf_dir), MOVED)
    return got.select("canonical_id", "gp_old", "gp_new", F.round("d_points_per_gp_shrunk", 6).alias("d_shrunk"), F.round("d_points_per_gp_quality", 6).alias("d_quality"), "min_gp", F.round("ci_band", 6).alias("ci_band"), "direction")


@query(PATHS + """, up AS (SELECT * FROM judged WHERE direction = 'improving' ORDER BY d_quality DESC NULLS LAST, canonical_id LIMIT 5), down AS (SELECT * FROM judged WHERE direction = 'declining' ORDER BY d_quality ASC NULLS LAST, canonical_id LIMIT 5)
 SELECT canonical_id, direction, round(d_quality, 6) AS d_quality FROM (SELECT * FROM up UNION ALL SELECT * FROM down)""")
def top_movers(spark, sf_dir):
    got = compare.top_movers(compare.trajectory(quality(spark, sf_dir), MOVED))
    return got.select("canonical_id", "direction", F.round("d_points_per_gp_quality", 6).alias("d_quality"))


@query(QUALITY + " SELECT canonical_id, season, source, gp FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY season DESC) AS r FROM quality) WHERE r = 1")
def latest_row(spark, sf_dir):
    return compare.latest_of(stats(spark, sf_dir), "canonical_id").select("canonical_id", "season", "source", "gp")


@query(QUALITY + " SELECT canonical_id, season, gp FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY season DESC) AS r FROM quality) WHERE r <= 3")
def last_seasons(spark, sf_dir):
    return compare.last_seasons(stats(spark, sf_dir), "canonical_id", 3).select("canonical_id", "season", "gp")


NATIONS = """WITH dim(country, million) AS (VALUES """ + ", ".join(f"('{r}', CAST({m} AS DOUBLE))" for r, m in REGIONS.items()) + """),
 buckets(cohort, youngest, oldest) AS (VALUES """ + ", ".join(f"('{c}', {a}, {b})" for c, a, b in BUCKETS) + """),
 rows AS (SELECT r_name AS country, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'O' END AS position, cohort, c_acctbal AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN buckets ON CAST(floor(c_acctbal) AS INTEGER) BETWEEN youngest AND oldest),
 made AS (SELECT country, position, cohort, count(*) AS n, round(median(rate), 3) AS median_rate, round(avg(rate), 3) AS mean_rate, round(max(rate), 3) AS top_rate, count(*) AS games FROM rows GROUP BY 1, 2, 3),
 t AS (SELECT made.*, round(n / million, 3) AS per_million FROM made LEFT JOIN dim USING (country))"""


def _cohort_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(F.col("r_name").alias("country"), F.when(F.col("c_mktsegment") == "BUILDING", "B").otherwise("O").alias("position"), F.floor("c_acctbal").cast("int").alias("season"), F.lit(0).alias("birth_year"), F.col("c_acctbal").alias("rate"), F.lit(1).cast("long").alias("games_"))
    return cohort.cohort_table(cohort.with_cohort(rows, dims.cohorts(spark, BUCKETS)), dims.mapping(spark, REGIONS, "country", "million"), games="games_")


@query(NATIONS + " SELECT * FROM t")
def cohort_benchmark(spark, sf_dir):
    return _cohort_table(spark, sf_dir)


@query(NATIONS + " SELECT country, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / any_value(million), 2) AS per_million FROM made JOIN dim USING (country) GROUP BY country")
def per_million(spark, sf_dir):
    return cohort.per_million(_cohort_table(spark, sf_dir), dims.mapping(spark, REGIONS, "country", "million"))


GRID = {"country": ["AFRICA", "EUROPE", "NOWHERE"], "position": ["B", "O"], "cohort": ["low", "mid", "high"]}


@query(NATIONS + """, g AS (SELECT * FROM (SELECT unnest(['AFRICA', 'EUROPE', 'NOWHERE']) AS country) CROSS JOIN (SELECT unnest(['B', 'O']) AS position) CROSS JOIN (SELECT unnest(['low', 'mid', 'high']) AS cohort))
 SELECT country, position, cohort, coalesce(n, 0) AS n, median_rate FROM g LEFT JOIN t USING (country, position, cohort)""")
def cohort_grid(spark, sf_dir):
    return cohort.grid(_cohort_table(spark, sf_dir), GRID, ["n"]).select("country", "position", "cohort", "n", "median_rate")


@query(NATIONS + " SELECT country, " + ", ".join(f"max(CASE WHEN cohort = '{c}' THEN median_rate END) AS {c}" for c, _, _ in BUCKETS) + " FROM t WHERE position = 'B' GROUP BY country")
def heatmap_pivot(spark, sf_dir):
    return cohort.matrix(_cohort_table(spark, sf_dir).where("position = 'B'"), "country", "cohort", [c for c, _, _ in BUCKETS], "median_rate")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_name("text", strip_marker=False).cast("binary")).alias("digest"))


@query(r"SELECT page_id, trim(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug("url").alias("slug"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_a, CAST(year(o_orderdate) AS INTEGER) AS year_a, strftime(o_orderdate, '%Y-%m-%d') AS iso_b, CAST(NULL AS VARCHAR) AS iso_c FROM orders")
def parse_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    a, b, c = text.birth_date(F.date_format(d, "yyyy-M-d")), text.birth_date(F.date_format(d, "d.M.yyyy")), text.birth_date(F.date_format(d, "yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a["iso"].alias("iso_a"), a["year"].alias("year_a"), b["iso"].alias("iso_b"), c["iso"].alias("iso_c"))


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS price, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS DOUBLE) AS brand FROM part")
def coerce_numeric(spark, sf_dir):
    comma = F.concat(F.lit("€ "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "part").select("p_partkey", text.number(comma).alias("price"), text.number("p_brand").alias("brand"))


@query("""WITH c AS (SELECT c_custkey, CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 'nhl' WHEN 1 THEN 'liiga' WHEN 2 THEN 'extraliga' ELSE 'other' END AS source, CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'MV' WHEN 2 THEN 'O' WHEN 3 THEN 'D' END AS code FROM customer)
 SELECT c_custkey, CASE WHEN source = 'nhl' AND code = 'C' THEN 'F' WHEN source = 'nhl' AND code = 'D' THEN 'D' WHEN source = 'liiga' AND code = 'MV' THEN 'G' WHEN source = 'extraliga' AND code = 'O' THEN 'D' END AS position FROM c""")
def position_codes(spark, sf_dir):
    source = F.element_at(F.array(*map(F.lit, ["nhl", "liiga", "extraliga", "other"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    code = F.element_at(F.array(F.lit("C "), F.lit(" MV"), F.lit("O"), F.lit("D"), F.lit(None)), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", source.alias("source"), code.alias("code"))
    return features.with_position(rows, dims.positions(spark)).select("c_custkey", "position")


@query("SELECT conv_id, turn, role AS title, CAST(turn AS VARCHAR) AS meta, CAST(2 AS INTEGER) AS n_sections, '<p><strong>' || role || '</strong></p>' AS second FROM conversations")
def text_sections(spark, sf_dir):
    made = F.concat(F.lit("```markdown\n# "), "role", F.lit(" ("), F.col("turn").cast("string"), F.lit(")\n## One\nfirst\n\nmore\n## Two\n**"), "role", F.lit("**\n```"))
    brief = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.brief(made).alias("b"))
    return brief.select("conv_id", "turn", "b.title", "b.meta", F.size("b.sections").alias("n_sections"), F.get("b.sections", F.lit(1))["html"].alias("second"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tables.json_field("props", "$.k", "bigint").alias("k"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def html_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title("html").alias("title"))


@query(r"SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN (CASE WHEN contains(left(text, 60), ' ') THEN regexp_replace(left(text, 60), ' [^ ]*$', '') ELSE left(text, 60) END) || '…' ELSE text END AS excerpt FROM conversations")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.excerpt("text", 60).alias("excerpt"))


@query("""WITH l AS (SELECT c_custkey, c_nationkey AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 END AS year FROM customer), r AS (SELECT s_suppkey, s_nationkey AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END AS year FROM supplier)
 SELECT c_custkey, CAST(count(s_suppkey) AS INTEGER) AS n_matches, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS matches FROM l LEFT JOIN r ON l.name = r.name AND (l.year IS NULL OR r.year IS NULL OR abs(l.year - r.year) <= 1) GROUP BY c_custkey""")
def tolerance_match(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 7).alias("birth_year"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 7).alias("birth_year"), F.col("s_suppkey").cast("string").alias("label"), F.col("s_suppkey").alias("position"))
    return resolve.tolerance_matches(left, right, "c_custkey", joined_by=",").select("c_custkey", "n_matches", "matches")


#: Components of the embeddings.
DIMENSIONS = 64
AXES = [f"x{i}" for i in range(DIMENSIONS)]


def _points(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(AXES)])
    return materialize(rows, "points")  # as columns: the optimiser's constraints over so many aliases of one array grow without end


POINTS = "WITH p AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
FAR = "list_distance(a.v, b.v)"


@query(POINTS + f" SELECT target, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT b.id AS target, a.id, round({FAR}, 6) AS distance, row_number() OVER (PARTITION BY b.id ORDER BY {FAR}, a.id) AS rank FROM p a JOIN p b ON a.cluster = b.cluster AND a.id <> b.id WHERE b.id % 20 = 0) WHERE rank <= 3")
def knn_cluster(spark, sf_dir):
    points = _points(spark, sf_dir)
    return rounded(compare.neighbours(points.where("id % 20 = 0"), points, ["cluster"], AXES, 3, scale=False), ["distance"])


@query(POINTS + """, pairs AS (SELECT b.id AS target, a.id, a.v AS va, b.v AS vb FROM p a JOIN p b ON a.cluster = b.cluster AND a.id <> b.id WHERE b.id % 20 = 0),
 each AS (SELECT target, id, unnest(va) - unnest(vb) AS d, unnest(range(64)) AS i FROM pairs), s AS (SELECT target, i, stddev_samp(d) AS s FROM each GROUP BY 1, 2),
 far AS (SELECT target, id, sqrt(sum(coalesce(pow(d / (CASE WHEN s = 0 THEN 1 ELSE s END), 2), 0))) AS distance FROM each JOIN s USING (target, i) GROUP BY 1, 2)
 SELECT target, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, id) AS rank FROM far) WHERE rank <= 3""")
def knn_analogs(spark, sf_dir):
    points = _points(spark, sf_dir)
    return rounded(compare.neighbours(points.where("id % 20 = 0"), points, ["cluster"], AXES, 3), ["distance"])


@query("""WITH c AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS age, o_orderpriority AS source, count(*) AS gp FROM orders GROUP BY 1, 2, 3),
 a AS (SELECT DISTINCT id AS target, id, min(age) OVER (PARTITION BY id) AS age FROM c WHERE id % 20 = 0)
 SELECT target, id, age, future_age, source, gp FROM (SELECT a.target, a.id, a.age, c.age AS future_age, c.source, c.gp, row_number() OVER (PARTITION BY a.target, a.id, c.age ORDER BY gp DESC, source) AS r FROM a JOIN c ON a.id = c.id AND c.age > a.age AND c.age <= a.age + 4) WHERE r = 1""")
def future_path(spark, sf_dir):
    careers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("age"), F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("gp"))
    analogs = careers.where("id % 20 = 0").groupBy("id").agg(F.min("age").alias("age")).withColumn("target", F.col("id"))
    return compare.future_path(analogs, careers).select("target", "id", "age", "future_age", "source", "gp")


@query(POINTS + f""", d AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb, sum({FAR}) AS d, count(*) AS n FROM p a CROSS JOIN p b GROUP BY 1, 2, 3),
 e AS (SELECT id, sum(CASE WHEN ca = cb AND n > 1 THEN d / (n - 1) END) AS m, min(CASE WHEN ca <> cb THEN d / n END) AS o FROM d GROUP BY id)
 SELECT round(avg(coalesce((o - m) / nullif(greatest(m, o), 0), 0)), 6) AS silhouette FROM e""")
def exact_silhouette(spark, sf_dir):
    return rounded(project.silhouette(_points(spark, sf_dir), AXES), ["silhouette"])


@query(POINTS + """, e AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM p), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i),
 z AS (SELECT id, i, round((x - m) / (CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS z FROM e JOIN m USING (i))
 SELECT id, """ + ", ".join(f"max(CASE WHEN i = {i} THEN z END) AS {x}_scaled" for i, x in enumerate(AXES)) + " FROM z GROUP BY id")
def scaled_matrix(spark, sf_dir):
    made = [f"{x}_scaled" for x in AXES]
    return rounded(project.scaled(_points(spark, sf_dir), AXES).select("id", *made), made)


@query(POINTS + """, n AS (SELECT unnest(range(64)) AS i), pairs AS (SELECT n.i, m.i AS j FROM n JOIN n m ON n.i <= m.i)
 SELECT 'x' || i AS a, 'x' || j AS b, round(covar_pop(v[CAST(i AS INTEGER) + 1], v[CAST(j AS INTEGER) + 1]), 6) + 0.0 AS covariance FROM p, pairs GROUP BY i, j""")
def covariance(spark, sf_dir):
    return rounded(project.covariances(_points(spark, sf_dir), AXES), ["covariance"]).withColumn("covariance", F.col("covariance") + F.lit(0.0))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)
 SELECT c_mktsegment AS cluster, count(*) AS n_members, CAST(median(c_nationkey) AS DOUBLE) AS median_birth_year, string_agg(CASE WHEN k <= 5 THEN c_name END, ', ' ORDER BY k) AS examples FROM r GROUP BY 1""")
def cluster_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("birth_year"), F.col("c_mktsegment").alias("cluster"))
    return project.cluster_summary(rows)


@query(QUALITY + """, cur AS (SELECT * FROM quality WHERE season = (SELECT max(season) FROM quality)), named AS (SELECT cur.*, c_name, row_number() OVER (PARTITION BY gp % 3 ORDER BY points_per_gp_quality DESC NULLS LAST, canonical_id) AS k FROM cur JOIN customer ON canonical_id = c_custkey)
 SELECT CAST(gp % 3 AS INTEGER) AS cluster, count(*) AS n_members, CAST(sum(CASE WHEN pim >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_appeared, string_agg(CASE WHEN k <= 5 THEN c_name END, ', ' ORDER BY k) AS top_names, round(median(goals_per_gp_shrunk), 3) AS median_goals, round(median(assists_per_gp_shrunk), 3) AS median_assists FROM named GROUP BY 1""")
def cluster_cards(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("canonical_id"), F.col("c_name").alias("first_name"))
    f = quality(spark, sf_dir).join(names, "canonical_id").withColumns({"last_name": F.lit(None).cast("string"), "cluster": (F.col("gp") % 3).cast("int"), "appearances": F.col("pim"), "birth_year": F.lit(None).cast("int")})
    cards = report.cluster_cards(f.select("canonical_id", "season", "source", "cluster", "appearances", "birth_year"), f.drop("cluster", "appearances", "birth_year"), rank_by="points_per_gp_quality")
    return cards.select("cluster", "n_members", "n_appeared", F.array_join("top_names", ", ").alias("top_names"), "median_goals", "median_assists")


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_ids FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_ids"))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_ids, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS situations FROM events")
def season_summary(spark, sf_dir):
    return tables.season_summary(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(NATIONS + ", s AS (SELECT country, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / any_value(million), 2) AS per_million FROM made JOIN dim USING (country) GROUP BY country) SELECT string_agg('- ' || country || ': ' || n, chr(10) ORDER BY per_million DESC, country) AS text FROM s")
def narrative(spark, sf_dir):
    sums = cohort.per_million(_cohort_table(spark, sf_dir), dims.mapping(spark, REGIONS, "country", "million"))
    return report.narrative(sums, F.concat("country", F.lit(": "), F.col("n").cast("string")), [F.desc("per_million"), F.asc("country")])


@query()
def pca_coordinates(spark, sf_dir):
    return project.pca_coordinates(_points(spark, sf_dir), AXES, ["id"])[0]


@query()
def pca_loadings(spark, sf_dir):
    return project.pca_coordinates(_points(spark, sf_dir), AXES, ["id"])[1]


#: Of two scaled columns the components are their sum and difference, in the order of 1 + r and 1 - r.
TWO = """WITH m AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mb, stddev_pop(c_nationkey) AS sb, corr(c_acctbal, c_nationkey) AS r FROM customer),
 z AS (SELECT c_custkey, r, (c_acctbal - ma) / sa AS a, (c_nationkey - mb) / sb AS b FROM customer, m)"""


def _two(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return project.pca_coordinates(rows, ["c_acctbal", "c_nationkey"], ["c_custkey"])


@query(TWO + " SELECT c_custkey, round(CASE WHEN r >= 0 THEN a + b ELSE a - b END / sqrt(2), 5) + 0.0 AS pca_x, round(CASE WHEN r >= 0 THEN a - b ELSE a + b END / sqrt(2), 5) + 0.0 AS pca_y FROM z")
def pca_of_two(spark, sf_dir):
    return _two(spark, sf_dir)[0].select("c_custkey", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("pca_x", "pca_y")])


LOADINGS = TWO + """, l AS (SELECT unnest(['PC1', 'PC2']) AS pc, unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]) AS share, unnest([sign(r), -sign(r)]) AS s FROM m),
 e AS (SELECT pc, 'c_acctbal' AS feature, sqrt(0.5) AS loading, share FROM l UNION ALL SELECT pc, 'c_nationkey', s * sqrt(0.5), share FROM l)"""


@query(LOADINGS + " SELECT pc, feature, round(loading, 6) AS loading, round(share, 6) AS explained_variance_ratio FROM e")
def loadings_of_two(spark, sf_dir):
    return rounded(_two(spark, sf_dir)[1], ["loading", "explained_variance_ratio"])


@query(LOADINGS + " SELECT pc, round(100 * any_value(share), 1) AS explained_pct, string_agg(feature || '=' || CAST(round(loading, 3) AS VARCHAR), ',' ORDER BY feature) AS loadings FROM e GROUP BY pc")
def loadings_map(spark, sf_dir):
    got = project.loadings_by_component(_two(spark, sf_dir)[1])
    return got.select("pc", "explained_pct", F.array_join(F.transform(F.map_entries("loadings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("loadings"))


@query()
def kmeans(spark, sf_dir):
    return project.kmeans(_points(spark, sf_dir).drop("cluster"), AXES, 4).select("id", "cluster")


@query("SELECT vec_id AS id, TRUE AS nearest FROM embeddings")
def kmeans_is_settled(spark, sf_dir):
    """Whether each point's cluster is the one of the nearest mean: what k-means ends at."""
    got = project.kmeans(_points(spark, sf_dir).drop("cluster"), AXES, 4)
    means = got.groupBy("cluster").agg(*[F.avg(f"{x}_scaled").alias(f"m_{x}") for x in AXES]).select(F.col("cluster").alias("other"), F.array(*[f"m_{x}" for x in AXES]).alias("mean"))
    vec = F.array(*[f"{x}_scaled" for x in AXES])
    far = F.aggregate(F.zip_with("v", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    # the means are k rows
    each = got.select("id", "cluster", vec.alias("v")).join(F.broadcast(means), F.lit(True)).withColumn("far", far)
    return each.groupBy("id").agg(F.min("far").alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), F.col("far"))).alias("own")).select("id", (F.col("own") <= F.col("least") + 1e-6).alias("nearest"))


def _select_k(spark, sf_dir):
    k, by = project.select_k(_points(spark, sf_dir).drop("cluster"), AXES, range(4, 9))
    return spark.createDataFrame([(i, s, i == k) for i, s in by.items()], "k int, silhouette double, chosen boolean")


@query("SELECT unnest(range(4, 9))::INTEGER AS k, TRUE AS fits")
def select_k(spark, sf_dir):
    """For each k whether it is chosen just if no silhouette is higher, and none before is as high."""
    got = _select_k(spark, sf_dir)
    best = got.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best"))
    return got.join(F.broadcast(best), F.lit(True)).select("k", ((F.col("k") == F.col("best")) == F.col("chosen")).alias("fits"))


def _named(spark, sf_dir, name, key, year):
    df = table(spark, sf_dir, name)
    made = text.normalize_name(F.concat(F.element_at(F.split(F.md5(F.col(key).cast("string").cast("binary")), ""), 1), F.lit("an "), F.regexp_replace(F.md5((F.col(key) % 997).cast("string").cast("binary")), "[0-9]", "")))
    return df.select(F.col(key).alias("id"), F.col(key).alias("order"), made.alias("name"), year.alias("birth_year"))


#: The names of _named: a word of three letters and one of a digest's letters. Two are similar if the second words are equal: with other first words an
#: insertion and a deletion apart in L letters.
FUZZY = """WITH l AS (SELECT s_suppkey AS id, left(md5(CAST(s_suppkey AS VARCHAR)), 1) || 'an' AS a, regexp_replace(md5(CAST(s_suppkey % 997 AS VARCHAR)), '[0-9]', '', 'g') AS b, s_nationkey AS y FROM supplier),
 r AS (SELECT c_custkey AS id, left(md5(CAST(c_custkey AS VARCHAR)), 1) || 'an' AS a, regexp_replace(md5(CAST(c_custkey % 997 AS VARCHAR)), '[0-9]', '', 'g') AS b, c_nationkey AS y FROM customer),
 s AS (SELECT l.id AS left_id, r.id AS right_id, CASE WHEN l.a = r.a THEN 100.0 ELSE 100.0 * (length(l.b) + 3) / (length(l.b) + 4) END AS score FROM l JOIN r ON l.b = r.b AND abs(l.y - r.y) <= 1)
 SELECT left_id, right_id, round(CAST(score AS DOUBLE), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS k FROM s WHERE score >= 92) WHERE k = 1"""


@query(FUZZY)
def fuzzy_match(spark, sf_dir):
    left, right = _named(spark, sf_dir, "supplier", "s_suppkey", F.col("s_nationkey")), _named(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey"))
    return resolve.best_candidates(left, right).select("left_id", "right_id", F.round("score", 4).alias("score"))


@query()
def entity_resolution(spark, sf_dir):
    named = _named(spark, sf_dir, "supplier", "s_suppkey", F.col("s_nationkey"))
    a, b, c = (named.where(F.col("id") % 3 == i) for i in range(3))
    return resolve.resolve_persons(a.withColumn("eligible", F.lit("yes")), b, c).select("person_id", "name", "first_id", "second_id", "third_id", "n_sources", "eligible")
