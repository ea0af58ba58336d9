"""Language-model scores by a hidden Markov model over words.

Tokens: words (A-Z lower-cased, split at ASCII white space), then one end. Counts of all training tokens are kept in a table. The model emits
classes: the end, each of the `own` most frequent words (a share of the distinct words, so their number follows the corpus, up to a bound of a
worker's memory), and `shared` classes for the other words, by their last letters, since words of one ending tend to stand in the same places; a word of
a shared class has its add-half share of the class. Every word has parameters of its own that come from the whole corpus.

Training: the states begin as distributional clusters (spherical k-means over the frequent classes of a bounded sample of documents; a
starting point only). Then Baum-Welch runs over all training documents: each partition sums its expected counts (scaled forward and backward
recursions), a grouped sum adds them up by class, and the model's cells come to the driver; each state's emissions are interpolated with the corpus's.
It stops with the round that finds a gain of less than `gain` a token in log10 likelihood, or after `rounds`. A text's score is its exact log10 likelihood by the
scaled forward recursion.

Word counts are unbounded, so they are never broadcast whole: the at most `hot` most frequent words go to the workers, the others are
looked up by a join on the word, in which no word is frequent; only sums by row come back. Texts are coded once and not shuffled.

Defined results: a null or empty text is one end; documents that repeat are counted and scored each; without training documents the counts
are zero, V is zero and the model stays as it began; a null id counts as the empty text for the fold; only the named columns are read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tarn.llm.common import materialize, short_batches

#: Latent states; most rounds of Baum-Welch; least gain of a round, in log10 a token; share of the corpus's distribution in each state's.
STATES, ROUNDS, GAIN, SMOOTH = 8, 12, 2e-2, 2.5e-3
#: Words with a class of their own: one in OWN_SHARE distinct words, within bounds; shared classes; words whose counts go to the workers.
OWN_SHARE, OWN_LEAST, OWN_MOST, SHARED, HOT = 64, 2000, 200_000, 4096, 250_000
#: What the first states are made of: about so many documents, of so many tokens at least, and the most frequent classes.
START_DOCS, START_TOKENS, START_CLASSES = 1000, 30, 3000
#: Tokens that a worker runs the recursions over at once; tokens from which on a text goes with long ones; distinct words that it counts before it passes them on.
TOKENS, LONG, FLUSH = 300_000, 1500, 150_000
PUNCTUATION = string.punctuation.encode()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shared_class(word: bytes, own: int, shared: int) -> int:
    """By the last three bytes before signs."""
    return 1 + own + xxhash.xxh64_intdigest((word.rstrip(PUNCTUATION) or word)[-3:], 42) % shared


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word is in the texts; the empty word is the end, once a document."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
        if seen:
            yield rows()

    short_batches(docs.sparkSession)
    return docs.select(F.col(text_col)).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """hot: word -> place in the arrays below; total, kinds: N and V of the contract; share: log10 of each shared class's add-half total."""

    hot: dict[bytes, int]
    log: np.ndarray
    cls: np.ndarray
    share: np.ndarray
    weight: np.ndarray
    total: int
    kinds: int
    own: int
    shared: int

    @classmethod
    def of(cls, counts: DataFrame, own: int | None = None, shared: int = SHARED, hot: int = HOT) -> "Vocabulary":
        bin_ = F.floor(F.log2("n") * 8).cast("int")
        bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()  # a few hundred bins at most
        total, kinds = sum(r.n for r in bins), sum(r.kinds for r in bins)
        held, least = 0, None
        for r in sorted(bins, key=lambda r: -r.bin):
            if held + r.kinds > hot:
                break
            held, least = held + r.kinds, r.bin
        found = counts.where((bin_ >= least) & (F.length("word") > 0)).toArrow() if least is not None else None  # at most `hot` words
        rows = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist()), key=lambda r: (-r[1], r[0])) if found else []
        own = min(len(rows), max(OWN_LEAST, min(OWN_MOST, kinds // OWN_SHARE)) if own is None else own)
        place = [1 + i if i < own else shared_class(w, own, shared) for i, (w, _) in enumerate(rows)]

        def classes(batches):
            n, kinds = np.zeros(shared, np.int64), np.zeros(shared, np.int64)
            for batch in batches:
                at = np.array([shared_class(w, -1, shared) for w in batch.column(0).to_pylist()], np.int64)
                np.add.at(n, at, batch.column(1).to_numpy())
                np.add.at(kinds, at, 1)
            some = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(kinds[some])], names=["k", "n", "kinds"])

        grouped = counts.where(F.length("word") > 0).select("word", "n").mapInArrow(classes, "k bigint, n bigint, kinds bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()  # `shared` rows
        in_class, kinds_in = np.zeros(shared), np.zeros(shared)
        for r in grouped:
            in_class[r.k], kinds_in[r.k] = r.n, r.kinds
        weight = np.zeros(1 + own + shared)
        for i, (w, n) in enumerate(rows[:own]):
            k = shared_class(w, -1, shared)
            in_class[k], kinds_in[k], weight[1 + i] = in_class[k] - n, kinds_in[k] - 1, n
        weight[1 + own :] = in_class
        weight[0] = sum(r.n for r in counts.where(F.length("word") == 0).collect())
        log = np.log10(np.array([n for _, n in rows], float) + 0.5)
        return cls({w: i for i, (w, _) in enumerate(rows)}, log, np.array(place, np.int32), np.log10(in_class + 0.5 * (kinds_in + 1)), weight, total, kinds, own, shared)

    @property
    def end_count(self) -> float:
        return float(self.weight[0])

    def code(self, text: str | None) -> tuple:
        """classes, sum of log10(c + 1/2) and number of the known among the words at hand and the end, what the classes leave to words
        (less the counts of the words to be looked up), and those words."""
        words = words_of(text)
        get = self.hot.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        classes = np.zeros(len(words) + 1, np.int32)
        far = np.flatnonzero(at < 0)
        near = at[at >= 0]
        tail = [words[i] for i in far.tolist()]
        if len(self.log):
            classes[:-1] = np.where(at < 0, 0, self.cls[at])
        classes[far] = [shared_class(w, self.own, self.shared) for w in tail]
        base = float(self.log[near].sum()) + math.log10(self.end_count + 0.5)
        in_shared = near[self.cls[near] > self.own] if len(near) else near
        left = float(self.log[in_shared].sum()) - float(self.share[classes[classes > self.own] - 1 - self.own].sum())
        return classes, base, len(near) + int(self.end_count > 0), left, tail


def code(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, fold) -> DataFrame:
    """A table of all texts in classes: row, doc_id, held_out, n_tokens, classes, base, known, rest, tail."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most `hot` words
    @F.arrow_udf("struct<classes:binary,n:bigint,base:double,known:bigint,rest:double,tail:array<struct<word:binary,times:bigint>>>")
    def coded(text: pa.Array) -> pa.Array:
        classes, base, known, left, word, times, edge = [], [], [], [], [], [], [0]
        for t in text.to_pylist():
            *numbers, tail = held.value.code(t)
            for column, x in zip((classes, base, known, left), numbers):
                column.append(x)
            rare = Counter(tail)
            word += rare
            times += rare.values()
            edge.append(len(word))
        pairs = pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
        columns = {
            "classes": pa.array([x.tobytes() for x in classes], pa.binary()), "n": pa.array([len(x) for x in classes], pa.int64()), "base": pa.array(base, pa.float64()),
            "known": pa.array(known, pa.int64()), "rest": pa.array(left, pa.float64()), "tail": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pairs),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    got = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), coded(F.col(text_col)).alias("c"))
    cols = [F.col(f"c.{x}").alias(y) for x, y in (("n", "n_tokens"), ("classes", "classes"), ("base", "base"), ("known", "known"), ("rest", "rest"), ("tail", "tail"))]
    return materialize(got.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", *cols), "hmm-coded")


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, weight: np.ndarray, states: int = STATES, seed: int = 42) -> "Hmm":
        """Random states around the corpus's distribution."""
        rng = np.random.default_rng(seed)
        move = rng.random((states, states)) + states * np.eye(states) / 2
        emit = (weight + 0.5) * (0.5 + rng.random((states, len(weight))))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_clusters(cls, weight: np.ndarray, counts: np.ndarray, states: int = STATES, seed: int = 42) -> "Hmm":
        """States from clusters of documents; counts: documents x the first classes. Seeds are drawn far from one another, then ten rounds of spherical k-means."""
        if len(counts) < states:
            return cls.begin(weight, states, seed)
        rng = np.random.default_rng(seed)
        x = np.sqrt(counts)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        picks = [int(rng.integers(len(x)))]
        near = x @ x[picks[0]]
        for _ in range(states - 1):
            far = (1 - near).clip(0) ** 2 + 1e-12
            picks.append(int(rng.choice(len(x), p=far / far.sum())))
            near = np.maximum(near, x @ x[picks[-1]])
        centre = x[picks]
        for _ in range(10):
            mine = (x @ centre.T).argmax(1)
            centre = np.stack([x[mine == k].sum(0) if (mine == k).any() else x[int(rng.integers(len(x)))] for k in range(states)])
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
        own = np.zeros((states, len(weight)))
        for k in range(states):
            own[k, : counts.shape[1]] = counts[mine == k].sum(0)
        corpus = (weight + 0.5) / (weight + 0.5).sum()
        emit = own / (own.sum(1, keepdims=True) + 1e-9) + corpus
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def _layout(lengths: np.ndarray):
        """Longest first; at each step the documents that have one lie side by side. order, how many at each step, where each step begins."""
        order = np.argsort(-lengths, kind="stable")
        down = lengths[order]
        active = np.searchsorted(-down, -np.arange(down[0] if len(down) else 0), side="left")
        return order, active, np.concatenate(([0], np.cumsum(active)))

    def _forward(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        order, active, begin = self._layout(lengths)
        cls = np.empty(begin[-1], np.int64)
        for place, d in enumerate(order.tolist()):
            cls[begin[: lengths[d]] + place] = sequences[d]
        seen = self.emit.T[cls]
        scale = np.empty(len(cls))
        begins, move = begin.tolist(), self.move
        alpha = seen  # each step's row is replaced by its scaled forward probabilities
        before = None
        emitted = seen.copy()
        for t, m in enumerate(active.tolist()):
            a, b = begins[t], begins[t] + m
            now = alpha[a:b]
            now *= self.start if before is None else before[:m] @ move
            c = now.sum(1)
            scale[a:b] = c
            now /= c[:, None]
            before = now
        return order, active, begin, cls, emitted, alpha, scale

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact, of each sequence (none empty)."""
        order, active, begin, _, _, _, scale = self._forward(sequences)
        log, total = np.log10(scale), np.zeros(len(order))
        begins = begin.tolist()
        for t, m in enumerate(active.tolist()):
            total[:m] += log[begins[t] : begins[t] + m]
        out = np.empty(len(order))
        out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, moves and emissions and the log10 likelihood, in one row."""
        _, active, begin, cls, seen, alpha, scale = self._forward(sequences)
        seen /= scale[:, None]
        beta = np.ones_like(alpha)
        begins, back = begin.tolist(), self.move.T
        steps = active.tolist()
        for t in range(len(steps) - 1, 0, -1):
            a, m = begins[t], steps[t]
            beta[begins[t - 1] : begins[t - 1] + m] = (seen[a : a + m] * beta[a : a + m]) @ back
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        first = steps[0] if steps else 0
        here = np.arange(first, len(cls))
        previous = here - np.repeat(np.array(steps[:-1], np.int64), steps[1:]) if len(steps) > 1 else here
        moves = self.move * (alpha[previous].T @ (seen[first:] * beta[first:]))
        emits = np.stack([np.bincount(cls, gamma[:, k], self.emit.shape[1]) for k in range(len(self.start))])
        return np.concatenate((gamma[:first].sum(0), moves.ravel(), emits.ravel(), [np.log10(scale).sum()]))

    def updated(self, sums: np.ndarray, corpus: np.ndarray | None = None) -> "Hmm":
        """The model of these expected counts; corpus: a distribution that each state's emissions are interpolated with."""
        k, c = self.emit.shape
        start, move, emit = sums[:k] + 0.1, sums[k : k + k * k].reshape(k, k) + 0.1, sums[k + k * k : k + k * k + k * c].reshape(k, c)
        corpus = np.full(c, 1 / c) if corpus is None else corpus
        emit = (1 - SMOOTH) * emit / np.maximum(emit.sum(1, keepdims=True), 1e-300) + SMOOTH * corpus
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _grouped(batches, column: int):
    """(rows without that column, their sequences), gathered up to TOKENS tokens; long texts by themselves, as the recursions take as many steps as the
    longest has tokens."""
    held = {kind: ([], [], [0]) for kind in (False, True)}
    for batch in batches:
        every = [np.frombuffer(x, np.int32) for x in batch.column(column).to_pylist()]
        rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != column], names=[n for i, n in enumerate(batch.schema.names) if i != column]) if batch.num_columns > 1 else None
        for kind, (parts, sequences, size) in held.items():
            at = [i for i, x in enumerate(every) if (len(x) > LONG) == kind]
            for k in range(0, len(at), 50):
                some = at[k : k + 50]
                if rest is not None:
                    parts.append(rest.take(pa.array(some)))
                sequences += [every[i] for i in some]
                size[0] += sum(len(every[i]) for i in some)
                if size[0] >= TOKENS:
                    yield list(parts), list(sequences)
                    parts.clear(), sequences.clear()
                    size[0] = 0
    for parts, sequences, _ in held.values():
        if sequences:
            yield parts, sequences


def first_states(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, docs: int = START_DOCS, seed: int = 42) -> Hmm:
    """The model that training begins with, from about `docs` documents drawn by a hash of the row."""
    rows = coded.where(F.col("n_tokens") >= START_TOKENS)
    spin = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30))
    some = rows.where(spin < int(min(1.0, docs / max(1, rows.count())) * (1 << 30)))
    top = min(START_CLASSES, len(vocabulary.weight))

    def counted(batches):
        for batch in batches:
            each = [np.unique(x[x < top], return_counts=True) for x in (np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in each], pa.list_(pa.int32())), pa.array([n for _, n in each], pa.list_(pa.int64()))], names=["row", "k", "n"])

    got = sorted(some.select("row", "classes").mapInArrow(counted, "row bigint, k array<int>, n array<bigint>").collect())  # a bounded sample, START_CLASSES cells each at most
    counts = np.zeros((len(got), top))
    for i, r in enumerate(got):
        counts[i, r.k] = r.n
    return Hmm.of_clusters(vocabulary.weight, counts, states, seed)


def baum_welch(coded: DataFrame, hmm: Hmm, rounds: int = ROUNDS, gain: float = GAIN, corpus: np.ndarray | None = None) -> tuple[Hmm, list[float]]:
    """The model after training on all rows of coded, and the log10 likelihood a token that each round began with."""
    spark, by_round = coded.sparkSession, []
    k, c = hmm.emit.shape
    tokens = coded.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        return hmm, by_round
    # a row for each class of expected emissions by state; below zero the starts, the moves and the likelihood
    columns = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(hmm)  # own + shared classes by states

        def sums(batches, held=held):
            total = np.zeros(k + k * k + k * c + 1)
            for _, sequences in _grouped(batches, 0):
                total += held.value.expected(sequences)
            emits = total[k + k * k : -1].reshape(k, c).T
            some = np.flatnonzero(emits.any(axis=1))
            small = np.vstack((total[:k], total[k : k + k * k].reshape(k, k), np.full(k, total[-1])))
            cells = np.concatenate((-1 - np.arange(k + 2), some))
            values = np.vstack((small, emits[some]))
            for at in range(0, len(cells), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 10_000]), *[pa.array(values[at : at + 10_000, i].astype(np.float32)) for i in range(k)]], names=["cell", *columns])

        got = coded.select("classes").mapInArrow(sums, "cell bigint, " + ", ".join(f"{x} float" for x in columns)).groupBy("cell").agg(*[F.sum(x).alias(x) for x in columns]).toArrow()  # own + shared rows
        cell, value = got["cell"].to_numpy(), np.stack([got[x].to_numpy() for x in columns], axis=1)
        emits, small = np.zeros((c, k)), np.zeros((k + 2, k))
        emits[cell[cell >= 0]], small[-1 - cell[cell < 0]] = value[cell >= 0], value[cell < 0]
        held.unpersist()
        by_round.append(float(small[-1, 0]) / tokens)
        hmm = hmm.updated(np.concatenate((small[0], small[1:-1].ravel(), emits.T.ravel())), corpus)
        if len(by_round) > 1 and by_round[-1] - by_round[-2] < gain:
            break
    return hmm, by_round


def likelihoods(coded: DataFrame, hmm: Hmm) -> DataFrame:
    """coded without classes and tail, with log10 of the likelihood of the classes (`chain`); one pass, nothing shuffled."""
    held = coded.sparkSession.sparkContext.broadcast(hmm)
    rows = coded.select("classes", *[c for c in coded.columns if c not in ("classes", "tail")])
    names = rows.columns[1:]

    def run(batches):
        for parts, sequences in _grouped(batches, 0):
            chain, at = held.value.log10_likelihood(sequences), 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chain[at : at + part.num_rows])], names=[*names, "chain"])
                at += part.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("chain", T.DoubleType())]))


def held_out(id_col):
    """The contract's fold that the model doesn't learn from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Model:
    counts: DataFrame
    vocabulary: Vocabulary
    hmm: Hmm
    #: log10 likelihood a token of the training documents' classes that each round began with.
    by_round: list[float]


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold=None, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN,
    own: int | None = None, shared: int = SHARED, hot: int = HOT, keep: list | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. fold: a boolean column, true where a row doesn't
    teach. keep: a list that the model is put in."""
    short_batches(docs.sparkSession)
    fold = held_out(F.col(id_col)) if fold is None else fold
    counts = materialize(word_counts(docs.where(~fold), text_col), "hmm-counts")
    vocabulary = Vocabulary.of(counts, own, shared, hot)
    coded = code(docs, vocabulary, id_col, text_col, fold)
    taught = coded.where("not held_out")
    corpus = (vocabulary.weight + 0.5) / (vocabulary.weight + 0.5).sum()
    hmm, by_round = baum_welch(taught, first_states(taught, vocabulary, states), rounds, gain, corpus)
    if keep is not None:
        keep.append(Model(counts, vocabulary, hmm, by_round))
    tail = coded.select("row", F.inline("tail"))
    looked = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("tail_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    mass = math.log10(vocabulary.total + 0.5 * (vocabulary.kinds + 1))
    tail_base = F.coalesce("tail_base", F.lit(0.0))
    return likelihoods(coded, hmm).join(looked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_base - F.col("n_tokens") * F.lit(mass)).alias("base_score"), (F.col("chain") + F.col("rest") + tail_base).alias("score"),
    )


def brute_force_base(rows: list[tuple], is_held_out) -> list[tuple]:
    """(id, n_tokens, n_known, N, base score) of (id, text) rows; for tests."""
    counts: Counter = Counter()
    for doc, text in rows:
        if not is_held_out(doc):
            counts.update([*words_of(text), b""])
    total = sum(counts.values())
    out = []
    for doc, text in rows:
        tokens = [*words_of(text), b""]
        out.append((doc, len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in tokens)))
    return out
