"""Language identification with interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

A text is lower-cased and read as its words of letters, each between word marks; a character's history stays in its word, so the
score of a text is the sum over its words and each distinct word is scored once (bounded memory). A model of order n interpolates
absolute discounting at the top with continuation counts below, down to a uniform floor. All n-grams of all languages are in one
array of sorted 64-bit hashes with the discounted probabilities of the languages that have them and the back-off weights of histories, stored
sparsely, so that memory follows what was seen and not the number of languages; look-ups are binary searches over whole batches of words.

The choice is the language of lowest cross-entropy a character. Rejection is calibrated on training documents that the model did not
learn from: for each language, how far the cross-entropy of a document of so many characters lies above that language's mean; the limit is
the largest distance seen at `keep` of them, times a margin, so that clean text stays. Equal texts count once, and are all on one side of the split.
Spreads are drawn to that of all languages, and means to the centre of all as far as few texts leave them unsure. A language of fewer than LEAST
distinct texts teaches with all of them; without calibration it never rejects by distance, which is null there.

What is learned from: of every language about `sample_docs` documents (by a hash of the id; None: all of them), each one whole. Executors count their
words and score those that calibrate; distinct words with counts, and two numbers a calibrating text, come to the driver. Texts to be
judged are read whole. The model grows with the distinct n-grams of the sample and is broadcast; `order` is fixed.

Defined results: null texts and texts without letters are `und` with score 0, and rejected; documents without a language don't
teach; without any teaching documents everything is `und`; equal cross-entropies go to the first language by name; repeated rows are judged alike;
only the named columns are read.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarn.llm.common import Memo, materialize, resident, short_batches

#: Numbers that are word characters but no letters (½, ², ①), by rule from the Unicode data; what is left of \w without them, digits and the
#: underscore is what Unicode calls letters. Few texts have any, and only those are split by the slow class.
NUMBERS = frozenset(c for c in map(chr, range(0xA0, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS, STRICT_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{''.join(sorted(NUMBERS))}]+")
MAYBE_NUMBER = re.compile("[" + "".join(sorted(c for c in NUMBERS if c < "\u0300")) + "\u0300-\U0010ffff]")
#: Order of the models; documents of a language that are learned from; distinct words that a worker counts before it passes them on.
ORDER, SAMPLE_DOCS, FLUSH = 4, 1500, 150_000
#: Cells (words or grams by languages) that are scored at once, about.
CELLS = 4_000_000
#: Distinct texts of a language below which it isn't split; texts that the common spread counts as; least spread, in bits.
LEAST, PRIOR, FLOOR = 10, 20, 0.5
OPEN, CLOSE, UNDECIDED = "\x02", "\x03", "und"
RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("distance", pa.float64())])


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    odd = not low.isascii() and MAYBE_NUMBER.search(low) and not NUMBERS.isdisjoint(low)
    return (STRICT_LETTERS if odd else LETTERS).findall(low)


def grams(word: str, order: int) -> list[str]:
    """For each character and the closing mark: the gram of up to `order` characters that ends there (the opening mark is history only)."""
    s = OPEN + word + CLOSE
    return [s[max(0, i + 1 - order) : i + 1] for i in range(1, len(s))]


def key(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"))


def _per_character(n: np.ndarray) -> np.ndarray:
    """The variance of an entropy over n characters, as a share of that of one."""
    return 1 / np.maximum(n, 1) + 1e-3


class Sparse:
    """A matrix whose rows come out dense: cells that aren't stored hold `default`; one more row than given has none stored."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int, default: float):
        order = np.argsort(row, kind="stable")
        self.begin = np.searchsorted(row[order], np.arange(rows + 2))
        self.column, self.value, self.columns, self.default = column[order].astype(np.int32), value[order].astype(np.float32), columns, default

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        start, size = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        out = np.full((len(rows), self.columns), self.default, np.float32)
        out[np.repeat(np.arange(len(rows)), size), self.column[at]] = self.value[at]
        return out


class Model:
    """probability[g, l]: discounted part of P(last character | history) in language l; weight[h, l]: what history h leaves to the next shorter one."""

    def __init__(self, languages: list[str], hashes, probability, weight, floor, order: int):
        self.languages, self.hashes, self.probability, self.weight, self.floor, self.order = languages, hashes, probability, weight, floor, order
        self.mean = np.full(len(languages), np.nan)  # where there is no calibration
        self.spread = np.ones(len(languages))
        self.unsure = np.zeros(len(languages))
        self.limit = math.inf

    @classmethod
    def fit(cls, words: dict[str, Counter], order: int = ORDER) -> "Model":
        """words: for each language its words with counts."""
        languages = sorted(words)
        cells = {what: [(np.array([], np.uint64), np.array([], np.int64), np.array([]))] for what in ("probability", "weight")}
        letters = {c for ws in words.values() for w in ws for c in w} | {CLOSE}

        def put(what: str, k: int, values: dict[str, float]) -> None:
            cells[what].append((np.fromiter(map(key, values), np.uint64, len(values)), np.full(len(values), k), np.fromiter(values.values(), float, len(values))))

        for k, language in enumerate(languages):
            top: Counter = Counter()
            for word, n in words[language].items():
                s = OPEN + word + CLOSE
                for i in range(1, len(s)):
                    top[s[max(0, i + 1 - order) : i + 1]] += n
            # counts of the highest order that a place has; below, the number of distinct characters before (continuations)
            count = {n: Counter() for n in range(1, order + 1)}
            for g, n in top.items():
                count[len(g)][g] += n
            for n in range(order, 1, -1):
                for g in list(count[n]):
                    count[n - 1][g[1:]] += 1
            for n in range(1, order + 1):
                once, twice = sum(1 for v in count[n].values() if v == 1), sum(1 for v in count[n].values() if v == 2)
                discount = once / (once + 2 * twice) if once and twice else 0.5
                total, kinds = Counter(), Counter()
                for g, v in count[n].items():
                    total[g[:-1]] += v
                    kinds[g[:-1]] += 1
                put("probability", k, {g: (v - discount) / total[g[:-1]] for g, v in count[n].items()})
                put("weight", k, {"\x04" + h: discount * v / total[h] for h, v in kinds.items()})
        joined = {what: [np.concatenate(x) for x in zip(*parts)] for what, parts in cells.items()}
        hashes = np.unique(np.concatenate([h for h, _, _ in joined.values()]))
        made = {what: Sparse(np.searchsorted(hashes, h), k, v, len(hashes), len(languages), default) for (what, (h, k, v)), default in zip(joined.items(), (0, 1))}
        return cls(languages, hashes, made["probability"], made["weight"], 1.0 / (len(letters) + 1), order)

    def calibrate(self, seen: dict[int, tuple[np.ndarray, np.ndarray]], keep: float, margin: float) -> None:
        """seen: for a language's place, characters and cross-entropies of distinct texts that it did not learn from."""
        ks = [k for k, (n, _) in seen.items() if len(n)]
        off = {k: _per_character(seen[k][0]) for k in ks}
        raw = {k: float(np.median(seen[k][1][seen[k][0] >= np.median(seen[k][0])])) for k in ks}
        squares = {k: (seen[k][1] - raw[k]) ** 2 / off[k] for k in ks}
        common = [squares[k] for k in ks if len(squares[k]) > 1]
        if not common:  # no spread is known
            return
        pooled = float(np.median(np.concatenate(common)))
        centre, between = np.mean(list(raw.values())), np.var(list(raw.values()), ddof=1) if len(ks) > 1 else math.inf
        far = []
        for k in ks:
            m = len(squares[k])
            square = max(FLOOR**2, (m * float(np.median(squares[k])) + PRIOR * pooled) / (m + PRIOR))
            error = square * float(np.median(off[k])) / m
            drawn = error / (error + between)
            self.mean[k], self.spread[k], self.unsure[k] = raw[k] + drawn * (centre - raw[k]), math.sqrt(square), math.sqrt(error * (1 - drawn))
            far.append(self.distance(k, *seen[k]))
        self.limit = margin * max(1.0, float(np.quantile(np.concatenate(far), keep)))

    def distance(self, k, n: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        """How far texts of n characters lie above the mean of language k (one, or one a text); nan where it has no calibration."""
        return (entropy - self.mean[k]) / np.sqrt(self.spread[k] ** 2 * _per_character(n) + self.unsure[k] ** 2)

    def find(self, grams_: list[str]) -> np.ndarray:
        """Rows of grams; the last row stands for those that were not seen."""
        if not len(self.hashes):
            return np.zeros(len(grams_), np.int64)
        h = np.fromiter(map(key, grams_), np.uint64, len(grams_))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def score_words(self, words: list[str]) -> np.ndarray:
        """For each word: the sum over its characters of log2 P in each language."""
        every = [grams(w, self.order) for w in words]
        ends = np.cumsum([len(g) for g in every])
        flat = [g for x in every for g in x]
        if not flat:
            return np.zeros((0, len(self.languages)))
        if len(words) > 1 and len(flat) * len(self.languages) > CELLS:
            half = len(words) // 2
            return np.concatenate((self.score_words(words[:half]), self.score_words(words[half:])))
        distinct = {g: i for i, g in enumerate(dict.fromkeys(flat))}
        p = np.full((len(distinct), len(self.languages)), self.floor)
        names = list(distinct)
        for n in range(1, self.order + 1):
            at = np.array([i for i, g in enumerate(names) if len(g) >= n], np.int64)
            if not len(at):
                continue
            part = [names[i][-n:] for i in at]
            p[at] = self.probability[self.find(part)] + self.weight[self.find(["\x04" + g[:-1] for g in part])] * p[at]
        log = np.log2(p)[np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))]
        return np.add.reduceat(log, np.concatenate(([0], ends[:-1])), axis=0)


class Judge:
    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(lambda words: (row.tobytes() for row in model.score_words(words)), 600_000 // max(4, len(model.languages)), 60)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters (closing marks included) of each text, and cross-entropy a character in each language."""
        split = [words_of(t) for t in texts]
        if len(texts) > 1 and sum(map(len, split)) * len(self.model.languages) > CELLS:
            half = len(texts) // 2
            return tuple(map(np.concatenate, zip(self.entropies(texts[:half]), self.entropies(texts[half:]))))
        scores = self.memo.of(every := [w for ws in split for w in ws])
        n = np.array([sum(map(len, ws)) + len(ws) for ws in split])
        flat = np.frombuffer(b"".join(map(scores.__getitem__, every))).reshape(-1, len(self.model.languages))
        total = np.zeros((len(texts), len(self.model.languages)))
        size = np.array([len(ws) for ws in split])
        if len(flat):
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            some = size > 0
            total[some] = np.add.reduceat(flat, start[some], axis=0)
        self.memo.tidy()
        return n, -total / np.maximum(n, 1)[:, None]

    def judge(self, texts: list[str | None]) -> list[dict]:
        m = self.model
        if not m.languages:
            return [{"lang": UNDECIDED, "score": 0.0, "entropy": None, "distance": None} for _ in texts]
        n, h = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        # the share of the best language if all were as likely before, at the weight of ten characters at most
        share = 1 / np.exp2(-(h - low[:, None]) * np.minimum(n, 10)[:, None]).sum(axis=1)
        far = m.distance(best, n, low)
        return [{"lang": m.languages[b], "score": float(s), "entropy": float(e), "distance": None if math.isnan(d) else float(d)} if k else {"lang": UNDECIDED, "score": 0.0, "entropy": None, "distance": None} for k, b, s, e, d in zip(n, best, share, low, far)]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, sample_docs: int | None = SAMPLE_DOCS, keep: float = 0.999, margin: float = 2.0) -> Model:
    """The model of the labelled documents. Four fifths of the sample's distinct texts teach, the rest calibrates."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    if sample_docs is not None:
        spin = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit(""))), F.lit(1_000_000))
        sizes = rows.groupBy("l").agg(F.count("*").alias("n"))
        rows = rows.join(F.broadcast(sizes), "l").where(spin < F.ceil(1e6 * sample_docs / F.col("n")))  # one row a language
    calibrates = F.pmod(F.xxhash64("t", F.lit(1)), F.lit(5)) == 0
    sample = materialize(rows.where(F.col("t").rlike(r"\p{L}")).select("l", "t", calibrates.alias("c")), "language-sample")
    short_batches(spark)
    kinds = sample.select("l", "c", F.xxhash64("t")).distinct().groupBy("l").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("int")).alias("c")).collect()
    split = [r.l for r in kinds if r.n >= LEAST and 0 < r.c < r.n]
    apart = F.col("c") & F.col("l").isin(split)

    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([l for l, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["l", "word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for l, t in zip(*(c.to_pylist() for c in batch.columns)):
                for w, n in Counter(words_of(t)).items():
                    seen[l, w] += n
                if len(seen) > FLUSH:
                    yield rows()
        if seen:
            yield rows()

    teach: dict[str, Counter] = {}
    for r in sample.where(~apart).select("l", "t").mapInArrow(count, "l string, word string, n bigint").groupBy("l", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        teach.setdefault(r.l, Counter())[r.word] = r.n
    model = Model.fit(teach, order)
    if split and model.languages:
        held = spark.sparkContext.broadcast(model)

        def scored(batches):
            judge, place = Judge(held.value), {l: k for k, l in enumerate(held.value.languages)}
            for batch in batches:
                ks = np.array([place[l] for l in batch.column(0).to_pylist()], np.int64)
                n, h = judge.entropies(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(n, pa.int64()), pa.array(h[np.arange(len(ks)), ks])], names=["k", "n", "h"])

        got = sample.where(apart).select("l", "t").distinct().mapInArrow(scored, "k bigint, n bigint, h double").where("n > 0").collect()  # a fifth of the sample, numbers only
        got = np.array(sorted(map(tuple, got))).reshape(-1, 3)
        model.calibrate({int(k): (got[got[:, 0] == k, 1], got[got[:, 0] == k, 2]) for k in np.unique(got[:, 0])}, keep, margin)
        held.unpersist()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """docs with a struct column: lang, score (0 to 1), entropy (bits a character), distance (beyond the language's usual; null without calibration), rejected. A
    column of the result's name is replaced."""
    spark = docs.sparkSession
    short_batches(spark)
    name, held = uuid.uuid4().hex, spark.sparkContext.broadcast(model)  # the grams of the sample

    @F.arrow_udf("struct<lang:string,score:double,entropy:double,distance:double>")
    def judge(text: pa.Array) -> pa.Array:
        return pa.array(resident(name, lambda: Judge(held.value)).judge(text.to_pylist()), RESULT)

    judge = judge.asNondeterministic()  # so that a filter on the result doesn't run it again
    c = F.col(out_col)
    rejected = (c["lang"] == UNDECIDED) | F.coalesce(c["distance"] > model.limit, F.lit(False))
    return docs.withColumn(out_col, judge(F.col(text_col))).withColumn(out_col, c.withField("rejected", rejected))


def held_out(id_col):
    """The contract's fold that models don't learn from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs."""
    mine = docs.select("doc_id", "text", "lang")
    model = fit(mine.where(~held_out(F.col("doc_id"))))
    got = identify(mine.drop("lang"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
