"""Token counts of whole texts, equal to what the tokenizer's own library gives for the whole text at once.

Documents of up to `chunk` characters are encoded whole. A longer one is encoded in overlapping chunks with offsets: two
neighbours are spliced at a boundary that is proven stable (below), that both encodings have, and after which both give the same
tokens up to the next stable boundary; where no such place is found the overlap is widened, in the end to the whole rest.

Stable boundary: before a single space or newline (SentencePiece: space) between two characters that are not white space. No pre-token of the word and byte-level
patterns spans it, white space doesn't compose under normalisation, special tokens hold no white space, and lower-casing looks
at single characters; in SentencePiece no piece holds a word-start mark after another character (checked on the vocabulary). Where
the pre-tokenizer drops white space altogether, texts are sums of their words, or of
the pre-tokens of the tokenizer's own pattern where a text has plain characters only, which are encoded once and remembered (bounded).

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarn.llm.common import Memo, resident, short_batches

CHUNK, OVERLAP = 30_000, 400
STABLE = re.compile(r"(?<=\S)[ \n](?=\S)")
STABLE_PIECES = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Characters that composition leaves alone and whose lower case is one character whatever stands around it.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0132-\u017e]*")


class Encoder:
    """The library's tokenizer of a file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            self.stable = STABLE
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.separable, self.added = self._drops_space(spec), [t["content"] for t in spec.get("added_tokens", [])]
            self.pattern = self._pre_tokens(spec) if self.separable else None
            self.dtype = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        else:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
            assert not any("▁" in p.lstrip("▁") for p in pieces), "a piece spans words"
            self.separable, self.stable, self.pattern = False, STABLE_PIECES, None
            self.dtype = "<u2" if self.lib.get_piece_size() <= 1 << 16 else "<u4"
        self.kind = "H" if self.dtype == "<u2" else "I"
        self.sizes = Memo(lambda words: map(len, self.ids(words)), 600_000)
        self.codes = Memo(lambda words: [array(self.kind, x).tobytes() for x in self.ids(words)], 600_000)

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Whether the first pre-tokenizer keeps only matches of a pattern that matches no white space."""
        first = spec.get("pre_tokenizer") or {}
        while first.get("type") == "Sequence":
            first = first["pretokenizers"][0]
        pattern = (first.get("pattern") or {}).get("Regex", "\\s")
        added = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
        return first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and added and "\\s" not in pattern.replace("[^\\s", "[^") and " " not in pattern

    @staticmethod
    def _pre_tokens(spec: dict):
        """The pattern of the pre-tokens, its classes written out for plain characters, if normalisation is composition, white space and lower case alone, and pre-tokens aren't cut further."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = spec["pre_tokenizer"].get("pretokenizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"} or steps[1]["content"] != " ":
            return None
        if [x["type"] for x in cuts] != ["Split", "ByteLevel"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        pattern = cuts[0]["pattern"]["Regex"]
        for kind in "LN":
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(re.escape(c) for c in map(chr, range(0x20, 0x17F)) if PLAIN.fullmatch(c) and unicodedata.category(c)[0] == kind))
        return None if "\\p" in pattern or sys.byteorder != "little" else re.compile(pattern)

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.path.endswith(".json"):
            return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return self.lib.encode(texts, num_threads=1)

    def placed(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token, in characters from `at` on."""
        if self.path.endswith(".json"):
            e = self.lib.encode(text, add_special_tokens=False)
            return [(i, at + a, at + b) for i, (a, b) in zip(e.ids, e.offsets)]
        # the word-start mark that the library puts before a text stands for the space that a later chunk starts with
        cut = text[1:] if at else text
        proto = self.lib.encode(cut, return_type="proto")
        at += len(text) - len(cut)
        byte = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in cut)])  # the library's offsets are of bytes
        begin, end = (np.searchsorted(byte, [getattr(p, x) for p in proto.pieces]) for x in ("begin", "end"))
        return [(p.id, at + int(a), at + int(b)) for p, a, b in zip(proto.pieces, begin, end)]

    def words(self, text: str) -> list[str]:
        """What a text's encoding is the sum of: its pre-tokens where the text is plain, else its words."""
        if self.pattern and PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.pattern.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """ids of a long text by overlapping chunks; each begins at a stable boundary or at the text's start."""
        out: list[int] = []
        start = 0
        while len(text) - start > chunk + overlap:
            end, wide = start + chunk, overlap
            while True:
                if end >= len(text):
                    return out + [i for i, _, _ in self.placed(text[start:], start)]
                got = self.placed(text[start:end], start)
                if splice := self._splice(text, start, end, wide, got):
                    break
                wide *= 2
                end = max(end, start + 2 * wide)
            out += [i for i, a, _ in got if a < splice]
            start = splice
        return out + [i for i, _, _ in self.placed(text[start:], start)]

    def _splice(self, text: str, start: int, end: int, wide: int, left: list) -> int | None:
        """A stable boundary in the last `wide` characters of the chunk start..end at which the chunk and one that begins earlier agree."""
        marks = [m.start() for m in self.stable.finditer(text, max(start + 1, end - wide), end)]
        if len(marks) < 3:
            return None
        right = self.placed(text[marks[0] : end], marks[0])
        for p, q in zip(reversed(marks[1:-1]), reversed(marks[2:])):
            def between(tokens):
                return [t for t in tokens if t[1] < q and t[2] > p]

            if (a := between(left)) == between(right) and all(p <= t[1] and t[2] <= q for t in a):
                return p
        return None

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int | None] = [len(self.chunked(t)) if t and len(t) > CHUNK + OVERLAP else 0 if not t else None for t in texts]
        rest = [i for i, n in enumerate(out) if n is None]
        if self.separable:
            split = [self.words(texts[i]) for i in rest]
            sizes = self.sizes.of(set().union(*split))
            for i, ws in zip(rest, split):
                out[i] = sum(map(sizes.__getitem__, ws))
            self.sizes.tidy()
        else:
            for i, ids in zip(rest, self.ids([texts[i] for i in rest])):
                out[i] = len(ids)
        return out

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian unsigned integers of `dtype`."""
        if not self.separable:
            return [np.array(self.chunked(t) if len(t) > CHUNK + OVERLAP else self.ids([t])[0], self.dtype).tobytes() if t else b"" for t in texts]
        split = [self.words(t) if t else [] for t in texts]
        codes = self.codes.of(set().union(*split))
        out = [b"".join(map(codes.__getitem__, ws)) for ws in split]
        self.codes.tidy()
        return out


def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    return resident(("encoder", path), lambda: Encoder(path))


def with_token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text (long)."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(encoder(tokenizer).count(text.to_pylist()), pa.int64())

    return docs.withColumn(out_col, count(F.col(text_col)))


def digest(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    got = with_token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer)
    return got.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
