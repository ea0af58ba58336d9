import math
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarn.operators import features
from tarn.plans import dims

SCHEMA = "gp double, goals double, assists double, points double, pim double, shots double, source string"


def rows(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def test_rates(spark):
    got = features.per_game_rates(rows(spark, (80.0, 40.0, 30.0, 70.0, 20.0, 240.0, "nhl"), (50.0, 10.0, 15.0, 25.0, 30.0, 100.0, "extraliga"))).collect()
    assert (got[0].goals_per_gp, got[0].points_per_gp, got[1].shots_per_gp) == (0.5, 0.875, 2.0)


def test_rows_without_games_go(spark):
    assert features.per_game_rates(rows(spark, (0.0, 1.0, 0.0, 1.0, 0.0, 1.0, "nhl"), (10.0, 1.0, 0.0, 1.0, 0.0, None, "nhl"))).count() == 1


def test_outlier_shrinks(spark):
    data = [(50.0, g, 0.0, g, 0.0, 0.0, "x") for g in (10.0, 12.0, 14.0, 8.0, 10.0)] + [(1.0, 1.0, 0.0, 1.0, 0.0, 0.0, "x")]
    got = features.shrink(features.per_game_rates(rows(spark, *data))).orderBy("gp", "goals").collect()
    assert got[0].goals_per_gp == 1.0
    assert got[0].goals_per_gp_shrunk == pytest.approx(3 / 11)
    assert all(abs(r.goals_per_gp - r.goals_per_gp_shrunk) < 0.05 for r in got[1:])


def test_large_samples_stay(spark):
    got = features.shrink(features.per_game_rates(rows(spark, *[(82.0, g, 0.0, g, 0.0, 0.0, "x") for g in (40.0, 35.0, 30.0)]))).orderBy(F.desc("goals")).first()
    assert abs(got.goals_per_gp - got.goals_per_gp_shrunk) < 0.05


def test_no_prior_and_unknown_source_give_null(spark):
    got = features.shrink(features.per_game_rates(rows(spark, (3.0, 1.0, 0.0, 1.0, 0.0, None, "x"))))
    got = features.quality_adjusted(got, dims.mapping(spark, {"y": 0.5}, "source", "multiplier")).first()
    assert got.goals_per_gp_shrunk is None and got.goals_per_gp_quality is None


def test_z(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in range(1, 6)], "x double, same double")
    got = features.zscores(df, ["x", "same"]).collect()
    assert sum(r.x_z for r in got) == pytest.approx(0)
    assert statistics.stdev(r.x_z for r in got) == pytest.approx(1)
    assert {r.same_z for r in got} == {0.0}
    assert features.zscores(df.limit(1), ["x"]).first().x_z == 0.0
    assert features.zscores(df.where("false"), ["x"]).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(-100, 100).map(lambda x: round(x, 3)), min_size=3, max_size=8, unique=True), st.floats(0.5, 9), st.floats(-5, 5))
def test_z_is_affine_invariant(spark, xs, scale, shift):
    df = spark.createDataFrame([(i, x, x * scale + shift) for i, x in enumerate(xs)], "i int, x double, y double")
    for r in features.zscores(df, ["x", "y"]).collect():
        assert r.x_z == pytest.approx(r.y_z, abs=1e-5)


def test_totals_of_nulls_are_zero_and_null_keys_go(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0), ("b", 2.0)], "k string, x double")
    assert {(r.k, r.x) for r in features.season_totals(df, ["k"], ["x"]).collect()} == {("a", 0.0), ("b", 2.0)}


def test_pool_keeps_unknown_flags(spark):
    df = spark.createDataFrame([("a", "F", "yes"), ("b", "F", None), ("c", "F", "no"), ("d", "D", "yes")], "id string, position string, eligible string")
    assert {r.id for r in features.pool(df, "F").collect()} == {"a", "b"}


def test_pivot_and_per_60(spark):
    df = spark.createDataFrame([(1, "5on5", 2.0, 3600.0), (1, "all", 3.0, 0.0), (2, "all", None, 1800.0)], "id int, s string, x double, t double")
    got = {r.id: r for r in features.situation_pivot(df, ["id"], "s", ["x"], ["5on5", "all"]).collect()}
    assert (got[1].x_5on5, got[1].x_all, got[2].x_all) == (2.0, 3.0, None)
    assert [r.p for r in df.orderBy("id", "s").select(features.per_60("x", "t").alias("p")).collect()] == [2.0, None, None]


def test_primary_stint_breaks_ties_by_source(spark):
    df = spark.createDataFrame([("p", "b", 5), ("p", "a", 5), ("q", "c", 1)], "id string, source string, gp int")
    assert {(r.id, r.source) for r in features.primary_stint(df, ["id"]).collect()} == {("p", "a"), ("q", "c")}


def test_multipliers():
    assert dims.MULTIPLIERS["nhl"] == 1.0 and "khl" not in dims.MULTIPLIERS and all(0 < m <= 1 for m in dims.MULTIPLIERS.values())
    names = [n for n, _, _ in dims.scenarios({"a": 1.0, "b": 0.35, "c": 0.2}, ["b", "c"])]
    assert len(names) == len(set(names)) == 7
    assert dict((n, v["b"]) for n, _, v in dims.scenarios({"a": 1.0, "b": 0.35, "c": 0.2}, ["b", "c"]))["b_down"] == round(0.35 * 0.8, 4)


def test_yaml(tmp_path):
    (tmp_path / "x.yaml").write_text("a: {b: 1}\n")
    assert dims.load_yaml(str(tmp_path / "x.yaml")) == {"a": {"b": 1}}


def test_feature_table_has_all_columns(spark):
    df = spark.createDataFrame([("p", 2024, "nhl", 20.0, 5.0, 5.0, 10.0, 50.0, 2.0), ("q", 2024, "nhl", 30.0, 3.0, 5.0, 8.0, 60.0, 2.0)], "canonical_id string, season int, source string, gp double, goals double, assists double, points double, shots double, pim double")
    got = features.feature_table(df, dims.mapping(spark, dims.MULTIPLIERS, "source", "multiplier"))
    assert all(f"{m}_per_gp_{k}" in got.columns for m in features.METRICS for k in ("shrunk", "quality", "shrunk_z", "quality_z"))
    assert all(not math.isnan(r.points_per_gp_quality_z) for r in got.collect())
