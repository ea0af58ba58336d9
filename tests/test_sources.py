import json

from pyspark.sql import functions as F

from tarn.sources import html, tables


def pages(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, html string")


def test_optional_and_stub_tables(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), "a int, b string", optional=True).dtypes == [("a", "int"), ("b", "string")]
    assert tables.stub(spark, "shl").count() == 0
    df = spark.createDataFrame([(1, 2024), (2, 2025)], "x int, season int")
    tables.write_table(df, str(tmp_path / "t"), ["season"])
    assert [r.x for r in tables.latest_partition(tables.read_table(spark, str(tmp_path / "t"))).collect()] == [2]


def test_csv_and_guard(spark, tmp_path):
    (tmp_path / "a.csv").write_text("playerId,situation\n" + "1,all\n" * 40)
    (tmp_path / "b.csv").write_text("<html>" + "x" * 200)
    (tmp_path / "c.csv").write_text("a\n")
    assert tables.read_csv(spark, str(tmp_path / "a.csv")).count() == 40
    assert {r.path[-5:]: r.valid for r in tables.looks_like_csv(spark, str(tmp_path)).collect()} == {"a.csv": True, "b.csv": False, "c.csv": False}


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"playerId": 1, "firstName": {"default": "Jan", "cs": "Honza"}, "lastName": {"default": "Novák"}, "birthDate": "1990-01-02", "birthCity": {"default": "Prague", "cs": "Praha"}, "birthCountry": "CZE", "position": "C"}))
    (tmp_path / "b.json").write_text("{broken")
    schema = "playerId long, firstName struct<default:string,cs:string>, lastName struct<default:string,cs:string>, birthDate string, birthCity struct<default:string,cs:string>, birthCountry string, position string, _corrupt string"
    df = tables.read_json(spark, str(tmp_path), schema, ["playerId"])
    got = tables.person_meta(df).first()
    assert (got.name, got.name_normalized, got.birth_year, got.birth_city) == ("Jan Novák", "jan novak", 1990, "Praha")
    assert "firstName.cs" in tables.flattened(df).columns


def test_landed_pages_and_keys(spark):
    df = spark.createDataFrame([("a", 2, 1, "late"), ("a", 1, 5, "early"), ("b", 1, 1, "x")], "id string, page int, position int, v string")
    assert {(r.id, r.v) for r in tables.landed_pages(df, "id").collect()} == {("a", "early"), ("b", "x")}
    assert spark.range(1).select(F.length(tables.cache_key(F.lit("http://x/" + "y" * 200))).alias("n")).first().n == 91


def test_goalies_and_briefs(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "MV"), ("c", "KH")], "id string, role_code string")
    skaters, goalies = tables.split_goalies(df)
    assert (skaters.count(), goalies.count()) == (2, 1)
    for n in ("b", "a", "z"):
        (tmp_path / f"{n}.md").write_text(n)
    assert [r.slug for r in tables.read_briefs(spark, str(tmp_path), ["z"]).collect()] == ["z", "a", "b"]
    tables.write_text(spark.createDataFrame([("x",)], "t string"), str(tmp_path / "out"))
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert tables.images_as_text(spark, str(tmp_path / "a.md")).first().base64 == "YQ=="


def test_listing_and_career(spark):
    listing = '<div id="stat-name-0"><a href="/fi/people/77/x">Jan Novák<span>#</span></a></div><div id="stat-team-0">AB&nbsp;</div><div id="stat-name-1"><a href="/fi/people/8/x">B C</a></div>'
    got = {r.n: r for r in html.listing(pages(spark, listing), "stat-", {"name": "name", "team": "team"}).collect()}
    assert (got[0].name, got[0].team, got[0].source_id, got[1].name, got[1].team) == ("Jan Novák", "AB", "77", "B C", None)
    career = '<td id="g-0-season">2024-25</td><td id="g-0-goals">5</td><td id="g-1-season">Yht.</td><td id="g-1-goals">9</td>'
    rows = html.without_totals(html.counted_elements(pages(spark, career), "g-", {"season": "season", "goals": "goals"}, joint="n-first")).collect()
    assert [(r.season, r.goals) for r in rows] == [("2024-25", "5")]


def test_profile_field(spark):
    df = pages(spark, '<h2 class="person-info-title">Narozen</h2>\n<span>22.2.1991</span>', "<p></p>", None)
    assert [r.y for r in df.select(html.labelled_field("html", "narozen").alias("y")).collect()] == ["22.2.1991", None, None]


def test_squads(spark):
    ms = "<h3>Czechia</h3><table><tr><th>No.</th><th>Pos.</th><th>Name</th><th>Height</th><th>Birthdate</th><th>Team</th></tr><tr><td>1</td><td>D</td><td>Vojta Malina – A</td><td>1</td><td>( 1987-11-23 ) x</td><td>Y</td></tr><tr><td>short</td></tr></table>"
    wjc = "<h3>Finland</h3><table><tr><th>Name</th></tr><tr><td>no</td></tr></table><h3>Czech Republic</h3><table><tr><th>Pos.</th><th>Player</th><th>Team</th></tr><tr><td>F</td><td>Ota Borový</td><td>Lvi</td></tr></table>"
    got = html.squad(pages(spark, ms, wjc, "", None)).orderBy("page").collect()
    assert [(r.name, r.position, r.birth_year, r.club) for r in got] == [("Vojta Malina", "D", 1987, "Y"), ("Ota Borový", "F", None, "Lvi")]


def test_team_pages(spark):
    stats = "<table><tr><th>x</th></tr></table><table><tr><th>JMÉNO</th><th>TÝM</th><th>POZ.</th><th>GP</th><th>G</th><th>A</th><th>P</th></tr><tr><td><a href='/hrac/jan-novak/77/'>Jan Novák</a></td><td>X</td><td>Ú</td><td>10</td><td>1</td><td>2</td><td>3</td></tr></table>"
    r = html.team_stats(pages(spark, stats), columns=("GP", "P")).first()
    assert (r["name"], r.slug, r.source_id, r.gp, r.p) == ("Jan Novák", "jan-novak", 77, 10.0, 3.0)
    standings = "<a href='/klub/hc-a/8/'>HC</a><a href='/klub/hc-a/9/'>HC Alpha</a><a href='/klub/hc-b/5/'>B</a><table><tr><th>Tým</th><th>Z</th><th>V</th><th>P</th><th>Skóre</th><th>B</th></tr><tr><td>1</td><td data-sort-value='hc-a'>HC Alpha</td></tr></table>"
    got = html.teams(pages(spark, standings)).collect()
    assert [(t.team_id, t.slug, t.name) for t in got] == [(8, "hc-a", "HC Alpha")]
