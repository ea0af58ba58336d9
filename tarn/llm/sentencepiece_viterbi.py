"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports the pieces that end at each position, longest first along the output links, and each relaxes the best way to
that position. Unigram models relax by score. In a BPE model a segmentation is right if each pair of neighbours is one that merging
would leave apart, so there a way is admitted only if its last two pieces are such a pair; exactly one way is then left at each position,
and the result is the library's. Characters in no piece become byte pieces, or the unknown piece where the model has no bytes.

Texts are cut before each run of word-start marks, and again between runs of letters, digits and signs where no piece has the two characters side by side: no piece spans such
a place (derived from the vocabulary), so each part is encoded once and remembered (bounded). Time is linear in a text's length.

Defined results: null and empty texts encode to no ids and decode to the empty text; the mark U+2581 in a text reads back as a space, as
in the library; repeated rows are encoded alike; columns other than the text are carried along unread.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarn.llm.common import Memo, resident, short_batches

MARK = "▁"
#: Fixed values of the model format: piece types, model types, and what an unknown character costs below the least score.
NORMAL, UNKNOWN, USER, BYTE, UNIGRAM, BPE, PENALTY = 1, 2, 4, 6, 1, 2, 10.0
#: Pairs of pieces whose being neighbours a worker remembers.
NEIGHBOURS = 200_000
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Runs of letters, line ends, digits and signs; neighbours are joined again where a piece has their border.
RUNS = re.compile(r"[^\W\d_]+|\n+|[\d_]+|[^\w\n]+")


class Pieces:
    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and leading word marks are supported")
        self.kind, self.prefix = proto.trainer_spec.model_type, norm.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.text = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        plain = {i: p for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        if self.kind == BPE and any(p.type == USER for p in plain.values()):
            raise ValueError("user-defined pieces are supported in unigram models only")
        if any(MARK in p.piece.lstrip(MARK) for p in plain.values()):
            raise ValueError("a piece spans words")
        self.id = {p.piece: i for i, p in plain.items()}
        self.score = {i: p.score for i, p in plain.items()}
        self.least = min(self.score.values(), default=0.0) - PENALTY
        #: In a BPE model, when a piece is made: its place in the order of merging; single characters are there from the start.
        self.made = {i: k if len(self.text[i]) > 1 else -1 for k, i in enumerate(sorted(self.score, key=lambda i: -self.score[i]))}
        self.halves: dict[int, tuple[int, int]] = {}
        use = list(plain)
        if self.kind == BPE:
            use = [i for i in plain if len(self.text[i]) == 1 or self._split(i)]
        self.whole = {self.text[i] for i in use}
        self.automaton = ahocorasick.Automaton()
        for i in use:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.pairs = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.parts = Memo(lambda parts: [array("i", self.chunk(c)).tobytes() for c in parts], 200_000)
        self.chunks = Memo(self._by_parts, 300_000)
        self.neighbours: dict[int, bool] = {}
        self.single = {p for p in self.whole if len(p) == 1}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging of the best neighbours until none is left, and the two halves of the last merge."""
        parts, halves = list(text), None
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: (self.made.get(self.id.get(parts[k] + parts[k + 1]), 1 << 40), k))
            if parts[at] + parts[at + 1] not in self.id:
                break
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(halves)]
        return parts, halves

    def _split(self, i: int) -> bool:
        """Notes the halves that piece i is merged from; False if merging never makes it."""
        parts, halves = self.merged(self.text[i])
        if len(parts) > 1:
            return False
        self.halves[i] = tuple(self.id.get(h, -1) for h in halves)
        return True

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours: it undoes the later of the two again and again and looks for a merge across
        the border that would have come first."""
        if a < 0 or b < 0:
            return True
        text, ids, made, halves, limit = self.text, self.id, self.made, self.halves, 1 << 60
        while True:
            across = ids.get(text[a] + text[b])
            if across is not None and made[across] < limit:
                return False
            for side in (0, 1) if made[a] > made[b] else (1, 0):
                whole = b if side else a
                limit = made[whole] + side
                if whole in halves:
                    if side:
                        b = halves[b][0]
                    else:
                        a = halves[a][1]
                    break
            else:
                return True
            if a < 0 or b < 0:
                return True

    def _merged(self, text: str) -> list[int]:
        """chunk for a BPE model and a text of single-character pieces: at each position the one admitted way, in order of the automaton's output."""
        n, neighbours, apart = len(text), self.neighbours, self.apart
        if len(neighbours) > NEIGHBOURS:
            neighbours.clear()
        known = neighbours.get
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for at, (piece, size) in self.automaton.iter(text):
            at += 1
            if last[at] < 0:
                if size < at:
                    pair = last[at - size] << 20 | piece
                    fits = known(pair)
                    if fits is None:
                        fits = neighbours[pair] = apart(last[at - size], piece)
                    if not fits:
                        continue
                last[at], before[at] = piece, at - size
        out = []
        while n:
            out.append(last[n])
            n = before[n]
        out.reverse()
        return out

    def chunk(self, text: str) -> list[int]:
        """ids of one chunk."""
        if self.kind == BPE:
            if text in self.whole:
                return [self.id[text]]
            if self.single.issuperset(text):
                return self._merged(text)
        n, bpe, apart, score, neighbours = len(text), self.kind == BPE, self.apart, self.score, self.neighbours
        if len(neighbours) > NEIGHBOURS:
            neighbours.clear()
        last, before = [-1] * (n + 1), [0] * (n + 1)  # the piece that ends here, -1 an unknown character; where it starts
        best = [0.0] + [None] * n
        done = 0

        def close(upto):
            """Positions that no admitted piece ends at take one unknown character, if the position before was reached."""
            nonlocal done
            while done < upto:
                done += 1
                if best[done] is None or (not bpe and not single[done]):
                    way = best[done - 1]
                    if way is not None and (best[done] is None or way + self.least > best[done]) and not (bpe and text[done - 1] in self.id):
                        best[done], last[done], before[done] = way + self.least, -1, done - 1

        single = [False] * (n + 1)
        for at, (piece, size) in self.automaton.iter(text):
            end, start = at + 1, at + 1 - size
            if done < at:
                close(at)
            if size == 1:
                single[end] = True
            way = best[start]
            if way is None:
                continue
            if bpe:
                if best[end] is not None:
                    continue
                if start:
                    pair = last[start] << 20 | piece
                    if (fits := neighbours.get(pair)) is None:
                        fits = neighbours[pair] = apart(last[start], piece)
                    if not fits:
                        continue
                best[end], last[end], before[end] = 0.0, piece, start
            elif best[end] is None or way + score[piece] > best[end]:
                best[end], last[end], before[end] = way + score[piece], piece, start
        close(n)
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append((last[at],))
            elif self.byte:
                out.append(tuple(self.byte[b] for b in text[before[at] : at].encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != (self.unknown,):
                out.append((self.unknown,))
            at = before[at]
        return [i for x in reversed(out) for i in x]

    def _by_parts(self, chunks: list[str]) -> list[bytes]:
        pairs, cut, runs = self.pairs, [], RUNS.findall
        for c in chunks:
            whole = []
            for run in runs(c):
                if whole and whole[-1][-1] + run[0] in pairs:
                    whole[-1] += run
                else:
                    whole.append(run)
            cut.append(whole)
        known = self.parts.of(set().union(*cut))
        out = [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in cut]
        self.parts.tidy()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as 32-bit integers."""
        cut = [CHUNKS.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.chunks.of(set().union(*cut))
        out = [b"".join(map(known.__getitem__, x)) for x in cut]
        self.chunks.tidy()
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def pieces(path: str) -> Pieces:
    """One for each file and worker process."""
    return resident(("pieces", path), lambda: _load(path))


def encode(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of each text (array<int>)."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        coded = pieces(model).encode_batch(text.to_pylist())
        edge = np.cumsum([0, *map(len, coded)]) // 4
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids; null ids decode to null."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        one = pieces(model)
        return pa.array([None if x is None else one.decode(x) for x in ids.to_pylist()], pa.string())

    return docs.withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry, ids, n_tokens, round_trip (the ids decode to the text) for every row; encoded and decoded in one pass over
    the texts."""
    short_batches(docs.sparkSession)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())])

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def both(text: pa.Array) -> pa.Array:
        one, texts = pieces(model), text.to_pylist()
        coded = one.encode_batch(texts)
        flat = np.frombuffer(b"".join(coded), "<i4")
        edge = np.cumsum([0, *map(len, coded)]) // 4
        same = [one.decode(flat[a:b].tolist()) == (t or "") for a, b, t in zip(edge, edge[1:], texts)]
        ids = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], fields=list(kind))

    name = "__pieces"
    while name in carry:
        name += "_"
    got = docs.select(F.col(id_col).alias("doc_id"), *carry, both(F.col(text_col)).alias(name))
    made = F.col(name)
    return got.select("doc_id", *carry, made["ids"].alias("ids"), F.size(made["ids"]).cast("long").alias("n_tokens"), made["same"].alias("round_trip"))
