"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each text's base measures are columns; the rules are predicates over them or over the text. On a bounded sample each rule's cost (its time
beyond reading the sample, the best of REPEATS runs in one task) and selectivity (the share that it rejects) are measured, and the rules run in order of
rejection per cost: a row that one rejects isn't tried on the later ones. The order never changes a verdict, only what it costs. The base rule
stands outside the order: its measures are part of the result, so they are made for every row.

The sample is a random share of all rows, whatever their texts, sources or ids; it takes one more pass over the texts, which is a few hundredths of
the time of the measures, and no task holds more than its own part of SAMPLE_ROWS.

Repeated three-word windows are found by 64-bit hashes of their words, and then compared word by word.

Defined results: null and empty texts have no words, all measures zero, and fail the base rule; repeated rows are judged alike; an empty table
gives an empty result and the order as written; only the named columns are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tarn.llm.common import materialize, once, release

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Rows of the sample that rules are measured on; how often each is run, and how often on each row in a run, so that costs stand above noise.
SAMPLE_ROWS, REPEATS, TIMES = 1000, 3, 2


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    cost: float = 1.0
    rejection: float = 0.0


def rules() -> list[Rule]:
    """The rules beside the base rule, over the columns of `measured`."""
    words = F.greatest("n_words", F.lit(1))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("symbols", 2 * F.col("n_symbols") > words),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 2) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        Rule("capitals", 100 * F.regexp_count("text", F.lit(r"\p{Lu}")) > 40 * F.regexp_count("text", F.lit(r"\p{L}"))),
        Rule("letters", 100 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < 70 * words),
        Rule("list_lines", 100 * F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s"))) > 90 * F.col("n_lines")),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the measures of each row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", once(F.regexp_extract_all("text", F.lit(WORD), 0))).withColumn("lines", once(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": once(F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))),
    })
    # windows in order of hash: an equal neighbour may be a repeat; of those, in order of words, an equal neighbour is one
    some = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn("placed", once(F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    maybe = F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]))
    df = df.withColumn("again", once(F.sort_array(F.transform(maybe, lambda x: F.struct(*[F.get("words", x["i"] + k).alias(f"w{k}") for k in range(3)], x["i"].alias("i"))))))
    same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    real = F.filter("again", lambda x, i: same(x, F.get("again", i - 1)) | same(x, F.get("again", i + 1)))
    # what a window covers runs to the next one that is repeated, three words at most
    df = df.withColumn("starts", once(F.when(F.col("again").isNotNull(), F.sort_array(F.transform(real, lambda x: x["i"])))))
    covered = F.aggregate(F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", once(F.coalesce(covered, F.lit(0).cast("long")))).drop("windows", "placed", "again", "starts", "lines")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """About `rows` rows of docs (all if it has fewer), in a few partitions; drawn row by row, so no value that many rows share sways it."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.sample(fraction=share, seed=seed).repartition(8)


def ordered(docs: DataFrame, of: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on about sample_rows rows, of which those that pass the base rule count. Half a rejection is
    added, so that rules that reject nothing in the sample go by their cost."""
    drawn = materialize(measured(sampled(docs, sample_rows)), "rules-sample")
    sample = drawn.where("not base_failed").coalesce(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))  # one task of a bounded sample

    def run(rejects: Column) -> tuple[float, float]:
        took = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            got = sample.agg(F.count_if(F.coalesce(rejects, F.lit(False))).alias("hit"), F.count("*").alias("n")).first()
            took.append(time.perf_counter() - began)
        return min(took), (got.hit / TIMES + 0.5) / (got.n / TIMES + 1)

    read, out = run(F.col("n_words") < 0)[0], []
    for rule in of:
        spent, share = run(rule.rejects)
        out.append(Rule(rule.name, rule.rejects, max(spent - read, 2e-3), share))
    release(drawn)
    return sorted(out, key=lambda r: -r.rejection / r.cost)


def cascade(of: list[Rule], failed: Column) -> Column:
    """The name of the first rule that rejects a row, null if none does; later rules aren't tried."""
    out = F.when(failed, F.lit("base"))
    for rule in of:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: list[Rule] | None = None) -> DataFrame:
    """Per row of docs: doc_id, the measures, base_failed, rejected_by (by the measured order) and kept."""
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ordered(mine, rules() if of is None else of)
    return measured(mine).withColumn("rejected_by", cascade(order, F.col("base_failed"))).withColumn("kept", F.col("rejected_by").isNull())


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same over DuckDB: measures by unnested words, rules as written above.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM p),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS nw FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * nw OR word_chars > 20 * nw OR 2 * n_symbols > nw OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
            OR 100 * len(regexp_extract_all(text, '\p{Lu}')) > 40 * len(regexp_extract_all(text, '\p{L}'))
            OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 70 * nw
            OR 100 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d+[.)])\s'))) > 90 * n_lines) AS kept
FROM b
"""
