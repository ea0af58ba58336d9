"""Queries over what sources land as: pages, nested records and texts are made from the driver's tables, and read by the library. They register
beside the cohort queries, with their SQL over the tables that the pages were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarn.functions import text
from tarn.operators import compare, features, project, report, resolve
from tarn.plans import dims
from tarn.plans.queries import QUALITY, quality, query, rounded, table
from tarn.sources import html, tables
from tarn.sources.shared import new_path


def _tag(name: str, *inside, attributes: Column | str = "") -> Column:
    attributes = F.lit(attributes) if isinstance(attributes, str) else attributes
    return F.concat(F.lit(f"<{name} "), attributes, F.lit(">"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))


def _cells(*cells) -> Column:
    return _tag("tr", *[_tag("td", c) for c in cells])


def _header(*names: str) -> str:
    return "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT s_suppkey AS page, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN s_name ELSE 'Second ' || s_suppkey END AS name, CASE n WHEN 0 THEN 'T' || s_nationkey END AS team, CAST(s_suppkey + n AS VARCHAR) AS source_id FROM supplier, (SELECT unnest([0, 1]) AS n)")
def html_listing(spark, sf_dir):
    one = lambda n, name, team: F.concat(
        _tag("div", _tag("a", name, "<span>#</span>", attributes=F.concat(F.lit('href="/fi/people/'), (F.col("s_suppkey") + n).cast("string"), F.lit('/x"'))), attributes=f'id="list-name-{n}"'),
        _tag("div", team, attributes=f'id="list-team-{n}"'),
    )
    second = F.concat(F.lit("Second&nbsp;"), _text("s_suppkey"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.concat(one(0, F.col("s_name"), F.concat(F.lit("T"), _text("s_nationkey"))), one(1, second, " ")).alias("html"))
    return html.listing(pages, "list-", {"name": "name", "team": "team"}).select("page", "n", "name", "team", "source_id")


@query("SELECT o_custkey AS page, CAST(year(o_orderdate) AS VARCHAR) AS season, count(*) AS goals FROM orders GROUP BY 1, 2")
def html_career(spark, sf_dir):
    """A page a customer: a row a year, and a totals row that goes."""
    years = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("season")).agg(F.count("*").alias("goals"))
    rows = years.groupBy(F.col("o_custkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct("season", "goals"))).alias("rows"), F.sum("goals").alias("all"))
    row = lambda n, season, goals: F.concat(*[F.concat(F.lit('<td id="g-'), n.cast("string"), F.lit(f'-{name}">'), value.cast("string"), F.lit("</td>")) for name, value in (("season", season), ("goals", goals))])
    made = F.concat(F.array_join(F.transform("rows", lambda r, i: row(i, r["season"], r["goals"])), ""), row(F.size("rows"), F.lit(html.TOTAL), F.col("all")))
    got = html.without_totals(html.counted_elements(rows.select("page", made.alias("html")), "g-", {"season": "season", "goals": "goals"}, joint="n-first"))
    return got.select("page", "season", text.number("goals").cast("bigint").alias("goals"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def html_profile(spark, sf_dir):
    date = F.date_format("o_orderdate", "d.M.yyyy")
    page = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('<h2 class="x">\n Narozen </h2>\n<span class="y">'), date, F.lit("</span><span>1.1.1900</span>"))).otherwise("<h2>Tým</h2><span>1.1.1900</span>")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", page.alias("html"))
    return pages.select("o_orderkey", text.birth_date(html.labelled_field("html", "narozen"))["iso"].alias("iso"))


def _team_pages(spark, sf_dir) -> DataFrame:
    """A page a nation: another table first, then its customers."""
    link = _tag("a", F.col("c_name"), attributes=F.concat(F.lit('href="/hrac/customer-'), _text("c_custkey"), F.lit("/"), _text("c_custkey"), F.lit('/"')))
    row = _cells(link, F.concat(F.lit("T"), _text("c_nationkey")), F.when(F.col("c_custkey") % 3 == 0, "O").otherwise("Ú"), (F.col("c_custkey") % 50).cast("string"), "x", _text("c_custkey"), "1,5")
    body = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    head = _header(html.PERSON_HEADER, html.TEAM_HEADER, html.POSITION_HEADER, "GP", "G", "A", "P")
    return body.select("page", F.concat(F.lit("<table><tr><th>GP</th></tr><tr><td>9</td></tr></table><table>" + head), "rows", F.lit("<tr><td>short</td></tr></table>")).alias("html"))


@query("SELECT c_nationkey AS page, c_name AS name, 'T' || c_nationkey AS team, CASE WHEN c_custkey % 3 = 0 THEN 'O' ELSE 'Ú' END AS position, CAST(c_custkey % 50 AS DOUBLE) AS gp, CAST(NULL AS DOUBLE) AS g, CAST(c_custkey AS DOUBLE) AS a, 'customer-' || c_custkey AS slug, c_custkey AS source_id FROM customer")
def html_team_stats(spark, sf_dir):
    return html.team_stats(_team_pages(spark, sf_dir), columns=("GP", "G", "A")).select("page", "name", "team", "position", "gp", "g", "a", "slug", "source_id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, lower(c_name) AS name_normalized, CASE WHEN c_custkey % 4 = 0 THEN '1990-02-0' || (c_custkey % 9 + 1) END AS birth_date, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1990 END AS INTEGER) AS birth_year,
 CASE WHEN c_custkey % 3 = 0 THEN 'D' ELSE 'F' END AS position, 'customer-' || c_custkey AS slug, CAST(2 * (c_custkey % 50) AS DOUBLE) AS gp FROM customer""")
def roster_meta(spark, sf_dir):
    """Statistics pages read twice, as of two teams; first values and summed games, with dates where a profile gave one."""
    once = html.team_stats(_team_pages(spark, sf_dir), columns=("GP",)).withColumns({"team_id": F.col("page"), "row": F.col("source_id"), "source_id": _text("source_id")})
    births = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(_text("c_custkey").alias("source_id"), F.concat((F.col("c_custkey") % 9 + 1).cast("string"), F.lit(".2.1990")).alias("birth_date"))
    again = once.withColumns({"row": F.col("row") + 10**9, "name": F.lit("later"), "slug": F.lit(None).cast("string")})
    return tables.roster_meta(once.unionByName(again), dims.positions(spark), births).drop("team_id")


@query("SELECT r_regionkey AS page, CAST(n_nationkey AS INTEGER) AS team_id, 'club-' || chr(CAST(97 + n_nationkey AS INTEGER)) AS slug, n_name || ' long' AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def html_standings(spark, sf_dir):
    """A page a region: two links a nation, and the standings, whose order the result has."""
    slug = F.concat(F.lit("club-"), F.char(F.col("n_nationkey") + 97))
    link = lambda key, name: _tag("a", name, attributes=F.concat(F.lit('href="/klub/'), slug, F.lit("/"), key.cast("string"), F.lit('/"')))
    links = F.concat(link(F.col("n_nationkey"), F.lit("N")), link(F.col("n_nationkey") + 100, F.concat("n_name", F.lit(" long"))))
    row = F.concat(F.lit("<tr><td>1</td><td data-sort-value='"), slug, F.lit("'>"), "n_name", F.lit("</td></tr>"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("x")))), lambda v: v["x"]), "")
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(join(links), F.lit("<table>" + _header(*html.STANDINGS)), join(row), F.lit("</table>")).alias("html"))
    one = pages.select("page", "html")
    out = None
    for region in range(5):  # a page is one competition
        got = html.teams(one.where(F.col("page") == region)).select(F.lit(region).alias("page"), "team_id", "slug", "name")
        out = got if out is None else out.unionByName(got)
    return out


@query("""SELECT s_suppkey AS page, 'cup' AS tournament, CAST(2024 AS INTEGER) AS year, 'Jiří ' || s_suppkey AS name, 'jiri ' || s_suppkey AS name_normalized, CASE WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'F' END AS position,
 CASE WHEN s_suppkey % 2 = 0 THEN '1990-01-0' || (s_suppkey % 9 + 1) END AS birth_date, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1990 END AS INTEGER) AS birth_year, s_name AS club FROM supplier""")
def html_squad(spark, sf_dir):
    """A page a supplier with one person: two layouts of headers, another country's table before; captain's marks."""
    even = F.concat(F.lit("<h3>Czechia</h3><table>" + _header("No.", "Pos.", "Name", "Birthdate", "Team")), _cells("1", "D", F.concat(F.lit("Jiří "), _text("s_suppkey"), F.lit(" – C")), F.concat(F.lit("( 1990-1-"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(" )")), F.col("s_name")), F.lit("</table>"))
    odd = F.concat(F.lit("<h2>Česko 2024</h2><table>" + _header("Pos.", "Player", "Club")), _cells("F", F.concat(F.lit("Jiří "), _text("s_suppkey")), F.col("s_name")), _cells("F"), F.lit("</table>"))
    other = "<h3>Finland</h3><table>" + _header("Pos.", "Name", "Team") + "<tr><td>F</td><td>No One</td><td>X</td></tr></table>"
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.concat(F.lit(other), F.when(F.col("s_suppkey") % 2 == 0, even).otherwise(odd)).alias("html"))
    squad = html.squad(pages)
    return squad.select("page", F.struct(*[c for c in squad.columns if c != "page"]).alias("s")).select("page", F.lit("cup").alias("tournament"), F.lit(2024).alias("year"), "s.*")


@query("""SELECT c_custkey AS id, 'Iva ' || c_custkey AS name, 'iva ' || c_custkey AS name_normalized, '1991-03-04' AS birth_date, CAST(1991 AS INTEGER) AS birth_year, CASE WHEN c_custkey % 2 = 0 THEN 'Praha' ELSE 'Prague' END AS birth_city, c_mktsegment AS country, 'C' AS position
 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def person_meta(spark, sf_dir):
    """Nested JSON records, written one a line, read with a declared schema, of two nationalities."""
    named = lambda first, second: F.struct(first.alias("default"), second.alias("cs"))
    records = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("playerId"), named(F.lit("Iva"), F.lit("x")).alias("firstName"), named(_text("c_custkey"), F.lit(None).cast("string")).alias("lastName"), F.lit("1991-3-4").alias("birthDate"),
        named(F.lit("Prague"), F.when(F.col("c_custkey") % 2 == 0, "Praha").otherwise("")).alias("birthCity"), F.col("c_mktsegment").alias("birthCountry"), F.lit("C").alias("position"))
    path = new_path(spark, "records")
    tables.write_json(records, path)
    got = tables.person_meta(spark.read.schema(records.schema).json(path))
    return features.of_countries(got, ["BUILDING", "MACHINERY"])


@query("""WITH s AS (SELECT o_custkey AS id, year(o_orderdate) AS season, o_orderpriority AS source, count(*) * 5 AS gp, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS points FROM orders GROUP BY 1, 2, 3)
 SELECT id, CAST(season AS INTEGER) AS season, CAST(season - 1970 AS INTEGER) AS age, source, gp, CAST(points AS BIGINT) AS points, round(points / CAST(gp AS DOUBLE), 3) AS rate, round(points / CAST(gp AS DOUBLE) * m, 3) AS rate_quality FROM s JOIN (VALUES ('1-URGENT', 1.0::DOUBLE), ('2-HIGH', 0.5::DOUBLE)) d(source, m) USING (source) WHERE gp >= 10""")
def career_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("source")).agg((F.count("*") * 5).alias("gp"), F.count_if(F.col("o_orderstatus") == "F").alias("points"))
    season = F.struct(F.col("y") * 10000 + F.col("y") + 1, "source", F.lit(2), "gp", "points").cast("struct<season:int,source:string,kind:int,gp:bigint,points:bigint>")
    playoff = season.withField("kind", F.lit(3))
    landings = o.groupBy("id").agg(F.flatten(F.collect_list(F.array(season, playoff))).alias("seasons")).withColumns({"position": F.lit("C"), "birth_date": F.lit("1970-05-05")})
    got = compare.career_table(landings, dims.mapping(spark, {"1-URGENT": 1.0, "2-HIGH": 0.5}, "source", "multiplier"), least_games=10)
    return got.select("id", "season", "age", "source", "gp", "points", "rate", "rate_quality")


@query(r"""SELECT c_custkey, 'cust omer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS marked, c_name AS captain, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS cleaned, 'Ann' AS first, 'van ' || c_custkey AS last, 'nhl-' || c_custkey AS person,
 CAST(2000 + c_custkey % 20 AS INTEGER) AS start, (2000 + c_custkey % 20) || '' || (2001 + c_custkey % 20) AS season_id, CASE WHEN c_custkey % 4 = 0 THEN 'F' WHEN c_custkey % 4 = 1 THEN 'D' ELSE 'G' END AS pos,
 'https://x/img/' || c_custkey || '.jpg' AS url, (CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END) || replace(printf('%.2f', abs(c_acctbal)), '.', ',') AS signed, md5('x' || c_custkey) AS key_md5, 'a <b> c' AS bare, upper(hex(CAST(c_custkey AS VARCHAR))) AS bytes FROM customer""")
def text_functions(spark, sf_dir):
    key = _text("c_custkey")
    year = F.col("c_custkey") % 20 + 2000
    label = F.element_at(F.array(F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")), F.concat(year.cast("string"), (year + 1).cast("string"))), (F.col("c_custkey") % 2 + 1).cast("int"))
    parts = text.name_parts(F.concat(F.lit(" Ann  van "), key))
    code = F.element_at(F.array(F.lit("L"), F.lit("D"), F.lit("G"), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.normalize_name(F.concat(F.lit("Çust ömer#"), F.lpad(key, 9, "0"), F.lit(" * "))).alias("marked"), text.clean_name(F.concat("c_name", F.lit(" – C "))).alias("captain"),
        text.clean(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise("  ")).alias("cleaned"), parts["first"].alias("first"), parts["last"].alias("last"), text.person_id("nhl", F.col("c_custkey")).alias("person"),
        text.season_start(label).alias("start"), text.season_id(text.season_start(label)).alias("season_id"), compare.position_group(code).alias("pos"), text.url("https://x/img/", "c_custkey", ".jpg").alias("url"), text.signed("c_acctbal").alias("signed"),
        F.md5(tables.cache_key(F.concat(F.lit("x"), key)).cast("binary")).alias("key_md5"), text.without_tags(F.lit("<p>a <i></i>&lt;b> c</p>")).alias("bare_"), F.hex(F.unbase64(F.base64(key.cast("binary")))).alias("bytes"),
    ).withColumn("bare", F.replace("bare_", F.lit("&lt;"), F.lit("<"))).drop("bare_")


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS rounded FROM part")
def rounded_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.round_binary(F.col("p_retailprice") / 7, 2).alias("rounded"))


@query("SELECT conv_id, (SELECT c.text FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn = o.t) AS text FROM (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) o")
def landed_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.lit(0).alias("position"), "text")
    return tables.landed_pages(c, "conv_id").select("conv_id", "text")


@query("SELECT user_id, event_type, event_id, value FROM events WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)")
def latest_partition(spark, sf_dir):
    """Written by partitions and read back; only the latest is read."""
    path = new_path(spark, "partitioned")
    day = F.date_format("ts", "yyyy-MM-dd")
    tables.write_table(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.concat(F.lit("d"), day).alias("day")), path, ["day"])
    return tables.latest_partition(tables.read_table(spark, path, "user_id bigint, event_type string, event_id bigint, value double, day string"), "day").drop("day")


@query("SELECT event_id, event_type, round(value, 4) AS value FROM events")
def csv_scan(spark, sf_dir):
    path = new_path(spark, "csv")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    return rounded(tables.read_csv(spark, path, "event_id bigint, event_type string, value double"), ["value"], 4)


@query("SELECT 'skaters' AS part, count(*) AS n FROM customer WHERE coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'MV' WHEN c_custkey % 5 = 1 THEN 'KH' END, '') <> 'MV' UNION ALL SELECT 'goalies', count(*) FROM customer WHERE c_custkey % 5 = 0")
def goalie_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("role_code", F.when(F.col("c_custkey") % 5 == 0, "MV").when(F.col("c_custkey") % 5 == 1, "KH"))
    skaters, goalies = tables.split_goalies(rows)
    return skaters.agg(F.lit("skaters").alias("part"), F.count("*").alias("n")).unionByName(goalies.agg(F.lit("goalies").alias("part"), F.count("*").alias("n")))


@query("SELECT o_custkey AS id FROM orders UNION SELECT s_suppkey FROM supplier")
def id_union(spark, sf_dir):
    return features.stacked([table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))]).distinct()


@query("""SELECT l_orderkey, arg_min(l_returnflag, l_linenumber) AS l_returnflag, arg_min(CASE WHEN l_linestatus = 'F' THEN l_linestatus END, CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS closed, round(sum(l_quantity), 4) AS l_quantity
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1""".replace(", l_linenumber)", ", k)").replace("l_linenumber END)", "k END)"))
def first_and_sums(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    rows = rows.withColumn("closed", F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")))
    return rounded(features.first_and_sums(rows, ["l_orderkey"], ["l_returnflag", "closed"], ["l_quantity"], "k"), ["l_quantity"], 4)


@query("SELECT max(CASE WHEN r_name = 'ASIA' THEN n END) AS own, max(n) AS highest FROM (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def spotlight(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return report.spotlight(c.groupBy("r_name").agg(F.count("*").alias("n")), "r_name", "ASIA", "n")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'yes' WHEN c_acctbal < 0 THEN 'no' WHEN c_acctbal > 5000 THEN 'yes' ELSE 'unknown' END AS eligible FROM customer")
def eligibility(spark, sf_dir):
    flag = F.when(F.col("c_acctbal") < 0, "no").when(F.col("c_acctbal") > 5000, "yes")
    hits = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(hits, "c_custkey", "left")
    return rows.select("c_custkey", resolve.eligibility(flag, F.coalesce("n", F.lit(0))).alias("eligible"))


#: Persons' coordinates: cluster, appearances and eligibility by rule from their rows.
COORDS = QUALITY + """, cur AS (SELECT * FROM quality WHERE season = (SELECT max(season) FROM quality)),
 coords AS (SELECT canonical_id, season, source, CASE WHEN gp > 1 THEN CAST(gp % 3 AS INTEGER) END AS cluster, CASE WHEN pim > 0 THEN pim END AS appearances, CASE WHEN points > 0 THEN 'yes' ELSE 'unknown' END AS eligible FROM cur)"""


def _coords(spark, sf_dir):
    q = quality(spark, sf_dir)
    coords = q.select("canonical_id", "season", "source", F.when(F.col("gp") > 1, (F.col("gp") % 3).cast("int")).alias("cluster"), F.when(F.col("pim") > 0, F.col("pim")).alias("appearances"), F.when(F.col("points") > 0, "yes").otherwise("unknown").alias("eligible"))
    return q, coords


@query(COORDS + " SELECT canonical_id, coalesce(c.cluster, -1) AS cluster, round(coalesce(points_per_gp_quality, -99), 6) AS rank_value, coalesce(appearances, 0) >= 1 AS ring FROM coords c LEFT JOIN (SELECT canonical_id, points_per_gp_quality FROM cur) f USING (canonical_id)")
def plot_table(spark, sf_dir):
    q, coords = _coords(spark, sf_dir)
    return rounded(report.plot_table(coords, q, rank_by="points_per_gp_quality").select("canonical_id", "cluster", "rank_value", "ring"), ["rank_value"])


@query(COORDS + " SELECT canonical_id FROM coords JOIN (SELECT canonical_id, points_per_gp_quality AS v FROM cur) USING (canonical_id) WHERE eligible = 'yes' ORDER BY v DESC NULLS LAST, canonical_id LIMIT 20")
def brief_targets(spark, sf_dir):
    """The twenty first of a report."""
    q, coords = _coords(spark, sf_dir)
    return report.brief_targets(coords, q, 20, rank_by="points_per_gp_quality").select("canonical_id")


@query(COORDS + """, showcase AS (SELECT c_custkey AS canonical_id FROM customer WHERE c_acctbal > 9000), near AS (SELECT s_nationkey, list(s_name ORDER BY s_suppkey)[1:3] AS a FROM supplier GROUP BY 1)
 SELECT canonical_id, cluster, round(points_per_gp_quality, 6) AS value, coalesce(array_to_string(a, ','), '') AS analogs, c_custkey % 2 = 0 AS has_brief FROM showcase JOIN (SELECT canonical_id, points_per_gp_quality FROM cur) USING (canonical_id) JOIN (SELECT canonical_id, cluster FROM coords) USING (canonical_id) JOIN customer ON c_custkey = canonical_id LEFT JOIN near ON s_nationkey = c_nationkey""")
def dashboard(spark, sf_dir):
    from pyspark.sql import Window as W

    q, coords = _coords(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("canonical_id"), F.col("c_nationkey").alias("s_nationkey"), "c_acctbal")
    ranked = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank")).where("rank <= 3")  # a person's three are the nation's
    analogs = customers.join(ranked, "s_nationkey").select("canonical_id", "rank", "name")
    briefs = customers.where("canonical_id % 2 = 0").select("canonical_id", F.lit("a text").alias("excerpt"))
    got = report.dashboard(customers.where("c_acctbal > 9000").select("canonical_id"), q, coords, compare.trajectory(q, ["points_per_gp_shrunk", "points_per_gp_quality"], one_stint=True), analogs, briefs)
    return got.select("canonical_id", "cluster", F.round("points_per_gp_quality", 6).alias("value"), F.coalesce(F.array_join(F.transform("analogs", lambda a: a["name"]), ","), F.lit("")).alias("analogs"), "has_brief")


@query("SELECT sum(turn) AS tokens_in, sum(length(text)) AS tokens_out, round(sum(turn) * 3.0 / 1e6 + sum(length(text)) * 15.0 / 1e6, 4) AS cost FROM conversations")
def usage_cost(spark, sf_dir):
    usage = table(spark, sf_dir, "conversations").select(F.col("turn").alias("tokens_in"), F.length("text").alias("tokens_out"))
    return report.usage_cost(usage, {"tokens_in": 3.0, "tokens_out": 15.0})


@query("SELECT c_custkey, '# ' || c_name || chr(10) || 'segment: ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'nation: ' || c_nationkey ELSE '' END AS context, CAST(NULL AS VARCHAR) AS generated FROM customer")
def person_context(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("nation", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")))
    made = c.select("c_custkey", report.context([("segment", "c_mktsegment"), ("nation", "nation")], F.concat(F.lit("# "), "c_name")).alias("context"))
    return report.with_generated(made, "context")


PLACES = QUALITY + """, two AS (SELECT DISTINCT season FROM quality ORDER BY season DESC LIMIT 2), best AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, season ORDER BY gp DESC, source) AS k FROM quality WHERE season IN (SELECT season FROM two)),
 o AS (SELECT * FROM best WHERE k = 1 AND season = (SELECT min(season) FROM two)), n AS (SELECT * FROM best WHERE k = 1 AND season = (SELECT max(season) FROM two))"""


@query(PLACES + " SELECT n.canonical_id, round(o.points_per_gp_quality - o.goals_per_gp_quality, 6) AS x_old, round(n.points_per_gp_quality - n.goals_per_gp_quality, 6) AS x_new, c_name AS first_name, 'F' AS position FROM o JOIN n USING (canonical_id) JOIN customer ON c_custkey = canonical_id")
def trajectory_places(spark, sf_dir):
    q = quality(spark, sf_dir)
    coords = q.select("canonical_id", "season", "source", (F.col("points_per_gp_quality") - F.col("goals_per_gp_quality")).alias("x"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("canonical_id"), F.col("c_name").alias("first_name"))
    got = compare.with_places(compare.trajectory(q, ["points_per_gp_shrunk"], one_stint=True), coords, q.select("canonical_id", "season", "source").join(names, "canonical_id"), ["x"], "F")
    return rounded(got.select("canonical_id", "x_old", "x_new", "first_name", "position"), ["x_old", "x_new"])


SIDES = {"style": ["c_acctbal", "nation"], "quality": ["nation", "twice"]}


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit(1990).alias("birth_year"), "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("double")).alias("nation"), (F.col("c_acctbal") * 2).alias("twice"))


@query("SELECT c_custkey, c_custkey % 7 <> 0 AS placed, CAST(NULL AS DOUBLE) AS umap_x_style FROM customer")
def both_projections(spark, sf_dir):
    """Complete rows have both pairs of coordinates, the others neither; the other projection's columns are null."""
    got, _ = project.both_projections(_sides(spark, sf_dir), SIDES, ["c_custkey"], "F", ["name"])
    have = [F.col(f"pca_{a}_{p}").isNotNull() for a in "xy" for p in SIDES]
    every, none = have[0] & have[1] & have[2] & have[3], ~(have[0] | have[1] | have[2] | have[3])
    return got.select("c_custkey", F.when(every, True).when(none, False).alias("placed"), "umap_x_style")


@query("SELECT 'F' AS position, p AS projection, count(*) AS n FROM customer, (SELECT unnest(['style', 'quality']) AS p) WHERE c_custkey % 7 <> 0 GROUP BY 1, 2")
def clustered_positions(spark, sf_dir):
    """Members of both projections' clusters: every complete row is in one."""
    rows = _sides(spark, sf_dir)
    coords, _ = project.both_projections(rows, SIDES, ["c_custkey"], "F")
    out, summary = project.clustered(rows, coords, SIDES, range(3, 7), ["c_custkey"], "F")
    agreed = out.agg(*[F.count(f"cluster_id_{p}").alias(p) for p in SIDES]).select(F.inline(F.array(*[F.struct(F.lit(p).alias("projection"), F.col(p).alias("ids")) for p in SIDES])))
    sums = summary.groupBy("position", "projection").agg(F.sum("n_members").alias("n"))
    return sums.join(F.broadcast(agreed), "projection").where("n = ids").select("position", "projection", "n")
