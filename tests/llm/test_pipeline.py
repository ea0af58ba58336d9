import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import decontamination, queries, simhash
from tarn.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["in"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, sf_dir), name)
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["in"].columns for n in names[:-1])


def test_each_stage_does_its_work(spark, sf_dir, stages):
    pairs = lambda n: [tuple(r) for r in stages[n].select("doc_id", "text").collect()]
    assert len(pairs("language_id")) > 0.98 * stages["in"].count()
    want = {c for _, _, c in simhash.brute_force(pairs("language_id"))}
    assert {d for d, _ in pairs("near_dedup")} == want
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in decontamination.brute_force(pairs("near_dedup"), items) if not r[5]}
    assert {d for d, _ in pairs("decontamination")} == clean
    assert {d for d, _ in pairs("pii")} == clean
    before, after = dict(pairs("decontamination")), dict(pairs("pii"))
    assert any(before[d] != after[d] for d in clean) and sum(before[d] != after[d] for d in clean) < 0.3 * len(clean)
    last = stages["sentencepiece"]
    assert last.count() == len(clean) and last.where(~F.col("round_trip")).count() == 0


def through(spark, df, sf_dir):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = out[name] = materialize(stage(spark, df, sf_dir), name)
    return out


def test_odd_inputs(spark, sf_dir, nothing, without_ids, docs):
    assert through(spark, nothing, sf_dir)["sentencepiece"].count() == 0
    # without labels no language is known, so all go
    assert through(spark, without_ids, sf_dir)["sentencepiece"].count() == 0
    got = through(spark, docs, sf_dir)
    kept = {r.doc_id for r in got["language_id"].collect()}
    # texts without letters go, null and blank ones included; prose, other scripts and very long texts stay
    assert not kept & {48, 49, 50, 53, 56} and kept >= {*range(48), 51}
    pairs = [tuple(r) for r in got["language_id"].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in got["near_dedup"].collect()) == sorted({c for _, _, c in simhash.brute_force(pairs)})
    last = got["sentencepiece"]
    assert last.count() == got["near_dedup"].count() == last.select("doc_id").distinct().count() and last.where("not round_trip").count() == 0


def test_repeated_and_missing_ids(spark, sf_dir, docs):
    docs = docs.where("doc_id < 44")
    long = docs.where("doc_id between 3 and 6").withColumn("lang", F.coalesce("lang", F.lit("en")))
    rows = docs.unionByName(long.withColumn("doc_id", F.lit(3).cast("long"))).unionByName(long.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" and quite another end of it, not in any other of these texts at all"))))
    got = through(spark, rows, sf_dir)
    pairs = [tuple(r) for r in got["language_id"].select("doc_id", "text").collect()]
    n_groups = len({c for _, _, c in simhash.brute_force([(i, t) for i, (_, t) in enumerate(pairs)])})  # by row, as ids repeat
    assert got["sentencepiece"].count() == got["near_dedup"].count() == n_groups
    assert {t for _, t in pairs} >= {r.text for r in got["near_dedup"].collect()}


def test_a_rare_language_survives(spark, sf_dir):
    import random

    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = ["".join(rng.choice(["ka", "to", "mi", "ne", "ru", "sho", "kyo", "zu", "wa"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rare = [(10**6 + i, " ".join(rng.choice(words) for _ in range(120)), "xx", "src0", 500) for i in range(5)]
    got = corpus_pipeline.STAGES[0][1](spark, docs.unionByName(spark.createDataFrame(rare, docs.schema)), sf_dir)
    assert [(r.doc_id, r.lang) for r in got.where("doc_id >= 1000000").orderBy("doc_id").collect()] == [(10**6 + i, "xx") for i in range(5)]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')" if __import__("os").path.isdir(f"{sf_dir}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(map(tuple, got.fetchall()), key=repr)
