import random

import pytest

WORDS = "the of and to in is was for on that with as by at from his it an were are which this also be has or had first one their its after new who not they have two her she been other when there all".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing"]) for _ in range(n)]
    return " ".join(w.capitalize() if i % 11 == 0 else w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): prose, copies, near copies, empty, blank, null and very long texts, one word, signs, other scripts."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(5, 200))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(4)] + [(44 + i, rows[i][1] + " end") for i in range(4)]
    rows += [(48, ""), (49, " \n\t "), (50, None), (51, prose(rng, 20_000)), (52, "x"), (53, "### $$$ %%% &&&"), (54, "日本語のテキスト 😀 Ελληνικά"), (55, "a" * 30_000), (56, None), (57, "A\x00B <|endoftext|> c"), (58, rows[0][1].upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with other columns, some of them named as results are, in several partitions; one row twice."""
    rows = [(d, t, ["en", "de", None][d % 3], f"src{d % 2}", None if t is None else len(t), "clash", -1) for d, t in texts]
    return spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, n_words string, words long").repartition(5, "doc_id")


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def without_ids(spark):
    return spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
