import itertools
import random

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from tarn.operators import cohort, compare, project, report, resolve
from tarn.plans import dims


def naive_indel(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1])
    return 100.0 * (1 - d[-1][-1] / (len(a) + len(b))) if a or b else 100.0


@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_ratio_is_indel(a, b):
    assert resolve.indel_ratio(a, b) == pytest.approx(naive_indel(a, b))


def test_token_set_ratio():
    assert resolve.token_set_ratio("david bednar", "david") == 100 and resolve.token_set_ratio("a", "") == 0
    assert resolve.token_set_ratio("david bednar", "krejci david") == 100 and resolve.token_set_ratio("david kolovrat", "pavel zacha") < 92


def people(spark, rows):
    return spark.createDataFrame([(i, i, n, y) for i, (n, y) in enumerate(rows)], "id int, `order` int, name string, birth_year int")


def test_years_gate(spark):
    target = people(spark, [("david kolovrat", 2002), ("david slunecko", 1996)])
    among = people(spark, [("david kolovrat", 1985), ("david slunecko", 1996), ("david bednar", 1986)])
    assert [(r.left_id, r.right_id) for r in resolve.best_matches(resolve.candidates(target, among)).collect()] == [(1, 1)]


def test_candidates_equal_the_cross_product(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) + rng.choice(["", " xy", " novak"]) for _ in range(60)]
    near = [n[:3] + rng.choice("abz") + n[3:] for n in names]
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(near) if resolve.token_set_ratio(a, b) >= 92}
    got = resolve.candidates(people(spark, [(n, None) for n in names]), people(spark, [(n, None) for n in near])).collect()
    assert {(r.left_id, r.right_id) for r in got} == want


def test_best_candidates_equal_best_matches(spark):
    rng = random.Random(3)
    name = lambda: f"{rng.choice('abcd')}an {rng.choice(['kolovrat', 'kolovrad', 'slunecko', 'bednar', 'xy'])}" + rng.choice(["", " jun"])
    side = lambda n: people(spark, [(name(), rng.choice([None, 1990, 1991, 1992, 1995])) for _ in range(n)])
    left, right = side(40), side(60)
    rows = lambda df: {(r.left_id, r.right_id, r.score) for r in df.collect()}
    want = rows(resolve.best_matches(resolve.candidates(left, right)))
    assert rows(resolve.best_candidates(left, right)) == want and len(want) > 20


def test_namesakes_are_compared_once(spark):
    """Three thousand rows of few names on each side: the pairs of rows alone would be millions."""
    many = spark.range(3000).select("id", F.col("id").alias("order"), F.concat(F.lit("jan "), F.element_at(F.array(*map(F.lit, ["kolovrat", "slunecko", "bednar"])), (F.col("id") % 3 + 1).cast("int"))).alias("name"), F.lit(1990).alias("birth_year"))
    assert resolve.similar_names(many, many).count() == 3
    got = resolve.best_candidates(many, many)
    assert got.count() == 3000 and {(r.right_id, r.score) for r in got.collect()} == {(i, 100.0) for i in range(3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_taking_turns(spark, seed):
    rng = random.Random(seed)
    pairs = [(l, r, float(rng.randint(92, 96))) for l in range(12) for r in range(8) if rng.random() < 0.4]
    taken, want = set(), set()
    for left in range(12):
        free = sorted((-s, r) for l, r, s in pairs if l == left and r not in taken)
        if free:
            taken.add(free[0][1])
            want.add((left, free[0][1]))
    df = spark.createDataFrame([(l, l, r, r, s) for l, r, s in pairs], "left_id int, left_order int, right_id int, right_order int, score double")
    assert {(r.left_id, r.right_id) for r in resolve.assign_one_to_one(df).collect()} == want


def test_namesakes_need_no_round_each(spark, monkeypatch):
    """Two hundred rows of one name on both sides, and a few that only like some of them."""
    rounds = []
    monkeypatch.setattr(resolve, "materialize", lambda df, label, own=resolve.materialize: rounds.append(label) or own(df, label))
    n = 200
    rows = [(f"l{i:03d}", i, f"r{j:03d}", j, 100.0) for i in range(n) for j in range(n)] + [("x", -1, "r000", 0, 95.0), ("y", 500, "r001", 1, 99.0)]
    pairs = spark.createDataFrame(rows, "left_id string, left_order long, right_id string, right_order long, score double")
    got = {r.left_id: r.right_id for r in resolve.assign_one_to_one(pairs).collect()}
    assert got == {"x": "r000"} | {f"l{i:03d}": f"r{i + 1:03d}" for i in range(n - 1)}
    assert rounds.count("refused") <= 4
    rounds.clear()
    assert len(resolve.assign_one_to_one(pairs.where("left_id not in ('x', 'y')")).collect()) == n and rounds.count("refused") == 1


def test_resolution(spark):
    a = people(spark, [("jan novak", 1990), ("petr maly", 1995)]).withColumn("eligible", F.lit("yes"))
    b = people(spark, [("jan novak", 1991), ("karel velky", 1993), ("karel velky", 1993)])
    c = people(spark, [("petr maly", None), ("nikdo jiny", None), ("petr maly", None)])
    got = {r.person_id: r for r in resolve.resolve_persons(a, b, c).collect()}
    assert (got["a-0"].second_id, got["a-0"].sources) == ("0", ["first", "second"])
    assert got["b-1"].second_id == "2" and "b-2" not in got
    assert got["a-1"].third_id == "0" and got["c-2"].eligible == "unknown" and got["c-1"].n_sources == 1
    thirds = [r.third_id for r in got.values() if r.third_id]
    assert len(thirds) == len(set(thirds))


def test_tolerance_and_eligibility(spark):
    left = spark.createDataFrame([(1, "x", 1990), (2, "x", 1993), (3, "x", None), (4, "", 1990)], "k int, name string, birth_year int")
    right = spark.createDataFrame([("x", 1991, "t2", 2), ("x", None, "t1", 1)], "name string, birth_year int, label string, position int")
    got = {r.k: r for r in resolve.tolerance_matches(left, right, "k").withColumn("e", resolve.eligibility(F.lit(None), F.col("n_matches"))).collect()}
    assert got[1].matches == ["t1", "t2"] and got[2].matches == ["t1"] and got[3].n_matches == 2 and got[4].n_matches == 0
    assert (got[1].e, got[4].e) == ("yes", "unknown")


def test_tolerance_gathers_once_for_equal_rows(spark):
    """Three thousand left rows of two kinds: the join makes rows for the kinds only."""
    left = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("name"), F.when(F.col("id") % 2 == 0, 1990).alias("birth_year"))
    right = spark.createDataFrame([("x", 1991, "t2", 2), ("x", None, "t1", 1), ("x", 1995, "t3", 3)], "name string, birth_year int, label string, position int")
    got = resolve.tolerance_matches(left, right, "k", joined_by=",")
    assert {(r.k % 2, r.n_matches, r.matches) for r in got.collect()} == {(0, 2, "t1,t2"), (1, 3, "t1,t2,t3")} and got.count() == 3000
    alone = resolve.tolerance_matches(left.limit(1), right.where("name = 'y'"), "k", joined_by=",").first()
    assert (alone.n_matches, alone.matches) == (0, "")


FEATURES = "canonical_id string, season int, source string, gp double, points_per_gp_shrunk double, points_per_gp_quality double"


def seasons(spark):
    rows = [("p", 2024, "a", 50.0, 0.5, 0.5), ("p", 2025, "a", 51.0, 0.6, 0.6), ("q", 2024, "a", 4.0, 0.5, 0.2), ("q", 2025, "b", 4.0, 0.6, 0.3), ("r", 2025, "a", 9.0, 0.9, 0.9), ("q", 2023, "a", 9.0, 0.9, 0.9)]
    return spark.createDataFrame(rows, FEATURES)


def test_trajectory(spark):
    got = {r.canonical_id: r for r in compare.trajectory(seasons(spark), ["points_per_gp_shrunk", "points_per_gp_quality"]).collect()}
    assert set(got) == {"p", "q"} and got["p"].direction == "improving" and got["q"].direction == "stable" and got["p"].ci_band == pytest.approx(0.5 / 50**0.5)
    assert compare.trajectory(seasons(spark).where("season = 2025"), ["points_per_gp_shrunk"]).count() == 0


def test_a_common_factor_changes_no_rank(spark):
    dim = dims.scenario_dim(spark, {"a": 1.0, "b": 0.4}, ["b"])
    got = compare.sensitivity_summary(compare.rank_changes(compare.scenario_ranks(seasons(spark), dim))).collect()
    assert {r.scenario: r.churn for r in got if r.scenario.startswith("all")} == {"all_down": 0, "all_up": 0}


def test_neighbours_and_paths(spark):
    df = spark.createDataFrame([(i, "F", 25, float(i * i)) for i in range(6)], "id int, position string, age int, x double")
    got = compare.neighbours(df.where("id = 2"), df, ["position", "age"], ["x"], 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 0]
    careers = spark.createDataFrame([(1, 26, "a", 5.0), (1, 26, "b", 9.0), (1, 29, "a", 5.0), (1, 30, "a", 5.0)], "id int, age int, source string, gp double")
    analogs = spark.createDataFrame([(2, 1, 25)], "target int, id int, age int")
    assert [(r.future_age, r.source) for r in compare.future_path(analogs, careers).orderBy("future_age").collect()] == [(26, "b"), (29, "a")]


def test_comparables_respect_position(spark):
    df = spark.createDataFrame([("a", 2025, 0, "F", 1.0), ("b", 2025, 0, "D", 1.1), ("c", 2025, 0, "F", 3.0)], "canonical_id string, season int, cluster int, position string, z double")
    target = df.where("canonical_id = 'a'")
    assert compare.comparables(df, target, ["z"], 1).first().canonical_id == "c"
    assert compare.comparables(df, target, ["z"], 1, same_position=False).first().canonical_id == "b"


def test_career_table(spark):
    df = spark.createDataFrame([(1, "1990-05-05", "C", [(20142015, "NHL", 2, 10, 5), (20142015, "NHL", 3, 10, 5), (20132014, "XXX", 2, 10, 5), (20122013, "KHL", 2, 4, 5), (None, "NHL", 2, 9, 1)])], "id int, birth_date string, position string, seasons array<struct<season:int,source:string,kind:int,gp:int,points:int>>")
    got = compare.career_table(df, dims.mapping(spark, dims.CAREER_MULTIPLIERS, "source", "multiplier")).collect()
    assert [(r.age, r.rate, r.rate_quality) for r in got] == [(24, 0.5, 0.5)]


def test_cohorts(spark):
    df = spark.createDataFrame([("CZE", "F", 2025, 2005, 0.5, 10), ("CZE", "F", 2025, 1990, 0.7, 10), ("CZE", "F", 2025, 2010, 0.7, 10)], "country string, position string, season int, birth_year int, rate double, gp int")
    got = cohort.cohort_table(cohort.with_cohort(df, dims.cohorts(spark)), dims.mapping(spark, dims.POPULATION, "country", "million"))
    assert {(r.cohort, r.n) for r in got.collect()} == {("U22", 1), ("30+", 1)}
    full = cohort.grid(got, {"country": ["CZE", "FIN"], "position": ["F"], "cohort": ["U22", "30+"]}, ["n"])
    assert full.count() == 4 and full.where("n = 0 and median_rate is null").count() == 2


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (15, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 5, 5))])
    return points, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double")


def test_pca_matches_eigenvectors(spark, blobs):
    points, df = blobs
    z = (points - points.mean(0)) / points.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    pc, share = project.principal_components(df, ["x", "y", "z"])
    assert share == pytest.approx(sorted(values / values.sum())[::-1][:2])
    assert abs(pc[:, 0] @ vectors[:, -1]) == pytest.approx(1)
    coords, loadings = project.pca_coordinates(df, ["x", "y", "z"], ["id"])
    assert coords.count() == len(points) and project.loadings_by_component(loadings).count() == 2
    few, none = project.pca_coordinates(df.limit(3), ["x", "y", "z"], ["id"])
    assert few.where("pca_x is null").count() == 3 and none.count() == 0


def test_kmeans_and_silhouette(spark, blobs):
    points, df = blobs
    got = project.kmeans(df, ["x", "y", "z"], 3, starts=2)
    labels = {r.id: r.cluster for r in got.collect()}
    assert len({labels[i] for i in range(15)}) == 1 and set(labels.values()) == {0, 1, 2}
    z = (points - points.mean(0)) / points.std(0)
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    of = np.array([labels[i] for i in range(len(z))])
    s = []
    for i in range(len(z)):
        mine = far[i, of == of[i]].sum() / ((of == of[i]).sum() - 1)
        other = min(far[i, of == c].mean() for c in set(of) if c != of[i])
        s.append((other - mine) / max(mine, other))
    assert project.silhouette(got, ["x_scaled", "y_scaled", "z_scaled"]).first().silhouette == pytest.approx(np.mean(s))
    assert project.select_k(df, ["x", "y", "z"], range(2, 5), starts=2)[0] == 3
    assert project.select_k(df.limit(2), ["x", "y", "z"], range(4, 6))[0] == 4


def test_kmeans_goes_on_until_rows_stay(spark, monkeypatch):
    """Rows without clusters need more than twenty steps; steps within tasks and steps of passes end at the same centres."""
    x = np.random.default_rng(5).normal(size=(3000, 4))
    df, axes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double, c double, d double"), ["a", "b", "c", "d"]

    def fitted():
        got = project.kmeans(df, axes, 5, starts=2).orderBy("id").toPandas()
        z, of = got[[f"{c}_scaled" for c in axes]].to_numpy(), got["cluster"].to_numpy()
        means = np.stack([z[of == k].mean(0) for k in range(5)])
        far = ((z[:, None] - means[None]) ** 2).sum(-1)
        assert (far[np.arange(len(z)), of] <= far.min(1) + 1e-9).all() and (np.diff(means[:, 0]) <= 0).all()
        return of

    first = fitted()
    monkeypatch.setattr(project, "TASK_HOLDS", 0)
    assert (fitted() == first).all()


def test_boxes_step_as_points_do(spark, monkeypatch):
    """Weighted points, copies and lines of equal values among them: a step by boxes has the sums of comparing each point, and a fit without boxes ends at the same."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=4000), rng.integers(0, 5, 4000)]).astype(float)
    x[:50], many = x[0], rng.integers(1, 4, 4000).astype(float)
    boxes = project._Boxes(x, many, 16).with_moments()
    for k in (1, 3, 7):
        centres = x[rng.choice(4000, k)]
        assert boxes.sums(centres) == pytest.approx(project._sums(x, many, project._squares(x, centres)), abs=1e-8)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double")
    fitted = lambda: [r.cluster for r in project.kmeans(df, ["a", "b"], 4, starts=3).orderBy("id").collect()]
    first = fitted()
    monkeypatch.setattr(project, "BOXED", 0)
    assert fitted() == first


def test_copies_are_one_point_of_a_fit(spark, monkeypatch):
    """A table of nine copies of each row is fitted as one of the rows, each counting nine times."""
    seen = []
    monkeypatch.setattr(project, "_lloyd_in_tasks", lambda data, *rest, own=project._lloyd_in_tasks: seen.append(data.agg(F.count("*"), F.sum("__n")).first()) or own(data, *rest))
    df = spark.range(900).select("id", (F.col("id") % 100 * 7 % 41).cast("double").alias("x"), (F.col("id") % 100).cast("double").alias("y"))
    got = project.kmeans(df, ["x", "y"], 3, starts=2)
    assert got.count() == 900 and {tuple(r) for r in seen} == {(100, 900.0)}
    assert got.select(F.col("id") % 100, "cluster").distinct().count() == 100


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
def test_silhouettes_by_boxes(spark, monkeypatch, columns):
    """Points of several clusterings, with copies, lines of equal values, a far point, a cluster of one row and rows without a cluster: as over all pairs."""
    monkeypatch.setattr(project, "LEAF", 32)
    rng = np.random.default_rng(9)
    points = np.column_stack([rng.normal(size=5000), rng.integers(0, 6, 5000)]).astype(float)
    points[:100], points[100] = points[0], (80.0, 90.0)
    one, two = (points[:, 0] > 0).astype(int) + (points[:, 0] > 1), rng.integers(0, 3, 5000)
    one[200] = 7
    df = spark.createDataFrame([(float(p[0]), float(p[1]), int(a), int(b) if b else None) for p, a, b in zip(points, one, two)], "x double, y double, one int, two int")
    monkeypatch.setattr(project, "MANY", 10**9)
    want = project._silhouettes(df, columns, ["one", "two"])
    monkeypatch.setattr(project, "MANY", 1000)
    calls = []
    monkeypatch.setattr(project, "release", lambda points, own=project.release: calls.append(points.count()) or own(points))
    assert project._silhouettes(df, columns, ["one", "two"]) == pytest.approx(want, abs=1e-11)
    assert project._silhouettes(df.repartition(3), columns, ["one", "two"]) == pytest.approx(want, abs=1e-11) and len(calls) == 2


def test_distances_by_boxes_equal_all_pairs():
    rng = np.random.default_rng(10)
    x, many = rng.normal(size=(6000, 2)) * (1.0, 30.0), rng.integers(1, 3, 6000).astype(float)
    group = (x[:, 0] > 0.3).astype(int)[:, None]
    tree = project._Boxes(x, many, 48)
    weights = np.zeros((6000, 2))
    weights[np.arange(6000), group[:, 0]] = many
    want, met = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) @ weights, 0
    for leaf, sums in [*project._distances_by_boxes(tree, group[tree.at], 2, range(0, 50)), *project._distances_by_boxes(tree, group[tree.at], 2, range(50, len(tree.leaves)))]:
        assert sums == pytest.approx(want[tree.at[leaf * tree.size : (leaf + 1) * tree.size]], rel=1e-10)
        met += 1
    assert met == len(tree.leaves) == 128


def test_silhouettes_of_copies_and_many_parts(spark):
    """Copies are one point that counts as often; 2,500 points meet in parts; clusters of one row and rows without a cluster count 0."""
    rng = np.random.default_rng(6)
    few = rng.normal(size=(2500, 2))
    points = np.concatenate([few, few[:700], few[:700]])
    labels = np.concatenate([rng.integers(0, 3, 2500), rng.integers(0, 2, 1400)])
    labels[0] = 9
    df = spark.createDataFrame([(i, float(p[0]), float(p[1]), int(k)) for i, (p, k) in enumerate(zip(points, labels))], "id int, x double, y double, cluster int")
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    kinds = sorted(set(labels))
    sums = np.stack([far[:, labels == k].sum(1) for k in kinds], axis=1)
    n, own = np.array([(labels == k).sum() for k in kinds]), np.array([kinds.index(k) for k in labels])
    rows = np.arange(len(labels))
    mine, rest = sums[rows, own] / np.maximum(n[own] - 1, 1), sums / n
    rest[rows, own] = np.inf
    s = np.where(n[own] > 1, (rest.min(1) - mine) / np.maximum(rest.min(1), mine), 0.0)
    assert project.silhouette(df, ["x", "y"]).first().silhouette == pytest.approx(s.mean())
    wide = df.select("id", "cluster", *[(F.col("x") if i % 2 else F.col("y")).alias(f"w{i}") for i in range(12)])  # distances by a product
    assert project.silhouette(wide, [f"w{i}" for i in range(12)]).first().silhouette == pytest.approx(s.mean())


def test_dashboard_gathers_three_analogs_of_the_showcase(spark):
    """Of persons outside the showcase nothing is gathered, and of the others three."""
    f = seasons(spark)
    coords = f.select("canonical_id", "season", "source", F.lit(0).alias("cluster"))
    analogs = spark.range(4000).select(F.element_at(F.array(F.lit("p"), F.lit("q")), (F.col("id") % 2 + 1).cast("int")).alias("canonical_id"), (4000 - F.col("id")).alias("rank"), F.concat(F.lit("n"), "id").alias("name"))
    paths = compare.trajectory(f, ["points_per_gp_shrunk", "points_per_gp_quality"])
    board = report.dashboard(spark.createDataFrame([("p",)], "canonical_id string"), f, coords, paths, analogs, spark.createDataFrame([], "canonical_id string, excerpt string"))
    assert [a.name for a in board.first().analogs] == ["n3998", "n3996", "n3994"]
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    assert "__place" in plan and "LeftSemi" in plan


def test_no_table_is_refused(spark):
    """Sixty thousand rows, of few points: the measure is exact at any size."""
    df = spark.range(60_000).select("id", (F.col("id") % 2).cast("int").alias("cluster"), ((F.col("id") % 2) * 4 + F.col("id") % 3).cast("double").alias("x"))
    assert 0 < project.silhouette(df, ["x"]).first().silhouette < 1
    assert len(project.select_k(df, ["x"], range(3, 5), starts=2)[1]) == 2
    with pytest.raises(ValueError):
        project.silhouette(df, ["x"], most=50_000)


def test_report(spark):
    f = seasons(spark).withColumns({"first_name": F.col("canonical_id"), "last_name": F.lit("x"), "goals_per_gp_shrunk": F.lit(0.1), "assists_per_gp_shrunk": F.lit(0.2), "points_per_gp_quality_z": F.col("points_per_gp_quality")})
    coords = f.select("canonical_id", "season", "source", F.lit(0).alias("cluster"), F.lit(1).alias("appearances"), F.lit(1990).alias("birth_year"), F.lit("yes").alias("eligible"))
    card = report.cluster_cards(coords, f).first()
    assert card.n_members == 3 and card.top_names == ["r x", "p x", "q x"] and card.sources == {"a": 2, "b": 1}
    assert report.plot_table(coords, f.where("false")).where("rank_value = -99").count() == 3
    assert [r.canonical_id for r in report.brief_targets(coords, f, 2).collect()] == ["r", "p"]
    assert report.labelled(coords, spark.createDataFrame([(1, "One")], "cluster int, label string")).first().label == "Cluster 0"
    paths = compare.trajectory(f, ["points_per_gp_quality", "points_per_gp_shrunk"])
    board = report.dashboard(spark.createDataFrame([("p",), ("zz",)], "canonical_id string"), f, coords, paths, spark.createDataFrame([("p", 1, "n")], "canonical_id string, rank int, name string"), spark.createDataFrame([("p", "e")], "canonical_id string, excerpt string"))
    assert [(r.canonical_id, r.has_brief) for r in board.collect()] == [("p", True)]
    assert "<td>p</td>" in report.html_table(f.where("canonical_id = 'p'"), "t")
    usage = spark.createDataFrame([(1_000_000, 2_000_000)], "input long, output long")
    assert report.usage_cost(usage, {"input": 3.0, "output": 15.0}).first().cost == 33.0
    block = f.where("canonical_id = 'r'").select(report.context([("Games", "gp"), ("None", "goals_per_gp_shrunk")], F.col("first_name")).alias("c"))
    assert report.with_generated(block, "c").first() == ("r\nGames: 9.0\nNone: 0.1", None)
