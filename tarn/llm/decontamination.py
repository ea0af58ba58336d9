"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, scanned once over each text.

Texts are normalised at equal byte length (A-Z lower-cased, every separator to a space), so a hit maps back to offsets of the
original. A window is `width` consecutive words of an item (a shorter item is one window). The automaton's keys are windows
between single spaces, so hits start and end at words.

A benchmark whose windows have up to `block_chars` characters is one automaton. A larger one is cut into blocks of items, files in the shared
folder; the texts are still read once: a worker gathers SCAN_BYTES of texts and runs one block's automaton after another over them, so
that it holds one automaton at a time however large the benchmark is.

Defined results: null or empty texts have no words and no hits; items without words make no windows; an empty benchmark leaves
every document clean; repeated documents are judged alike, items that share an id are one item; an item with a null id hits words like any
other but has no id to be counted or named by; only the named id and text columns are read, so further columns can have any name, but
one named as the result, which is replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarn.llm.common import filesystem, new_path, resident, short_batches

#: Characters of windows in one automaton; bytes of texts that a worker gathers where there are several.
BLOCK_CHARS, SCAN_BYTES = 3_000_000, 32_000_000

#: Separators are \x00-\x2F, \x3A-\x60 (after lower-casing A-Z) and \x7B-\x7F.
NORMALISE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
SQL_RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"


def flat(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMALISE)


def words_of(text: str | None) -> list[bytes]:
    return flat(text).split()


def windows_of(text: str | None, width: int) -> list[bytes]:
    words = words_of(text)
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


class Scanner:
    """The automaton of one block of items (id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows_of(text, width):
                owners.setdefault(window, set()).update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, line: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (first, last) of windows among the words of a line of words between single spaces, and the ids of their items."""
        if self.empty:
            return [], set()
        hits, items, seen, at = [], set(), 0, 0
        for end, (n, ids) in self.automaton.iter(line):
            seen += line.count(" ", at, end)
            at = end
            items.update(ids)
            hits.append((seen - n, seen - 1))
        return hits, items


def _line(text: str | None) -> str:
    words = words_of(text)
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def _runs(hits: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of hit words."""
    out: list[list[int]] = []
    for first, last in sorted(map(tuple, hits)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return out


def _spans(text: str, runs: list[list[int]]) -> list[dict]:
    """Character offsets in the original of runs of hit words."""
    whole = flat(text)
    edges = {x for run in runs for x in run}
    start, end, at = {}, {}, 0
    for i, word in enumerate(whole.split()):
        at = whole.index(word, at)
        if i in edges:
            start[i], end[i] = at, at + len(word)
        at += len(word)
    chars, done, total = {}, 0, 0
    for x in sorted({start[a] for a, _ in runs} | {end[b] for _, b in runs}):
        total += len(whole[done:x].decode("utf-8", "surrogatepass"))
        done, chars[x] = x, total
    return [{"start": chars[start[a]], "end": chars[end[b]]} for a, b in runs]


def _scanned(texts: list[str | None], scanners) -> list[dict]:
    """The result of each text over one scanner after another."""
    lines = [_line(t) for t in texts]
    hits, items = [[] for _ in texts], [set() for _ in texts]
    for scanner in scanners:
        for i, line in enumerate(lines):
            if line:
                places, ids = scanner.scan(line)
                hits[i] = _runs(hits[i] + places) if places else hits[i]
                items[i] |= ids
    out = []
    for text, line, runs, ids in zip(texts, lines, hits, items):
        n_hit = sum(b - a + 1 for a, b in runs)
        out.append({"n_words": max(0, line.count(" ") - 1), "n_hit": n_hit, "items": sorted(ids), "spans": _spans(text, runs) if runs else []})
    return out


def _one_block_udf(spark, items: list, width: int):
    key, held = uuid.uuid4().hex, spark.sparkContext.broadcast(items)  # at most block_chars of windows

    @F.arrow_udf(SQL_RESULT)
    def scan(text: pa.Array) -> pa.Array:
        return pa.array(_scanned(text.to_pylist(), [resident(key, lambda: Scanner(held.value, width))]), RESULT)

    return scan


def _blocks_udf(paths: list[str], width: int, scan_bytes: int):
    def load(path: str) -> Scanner:
        fs, root = filesystem(path)
        with fs.open_input_stream(root) as f:
            return Scanner([tuple(x) for x in json.loads(f.read())], width)

    def found(held: list[list]) -> Iterator[pa.Array]:
        rows = _scanned([t for texts in held for t in texts], map(load, paths))
        for texts in held:
            yield pa.array(rows[: len(texts)], RESULT)
            del rows[: len(texts)]

    @F.arrow_udf(SQL_RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.to_pylist())
            size += batch.nbytes
            if size >= scan_bytes:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    return scan


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_chars: int):
    """Blocks of (item id or None, text), each with at most block_chars characters of windows (or one item)."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        size = sum(len(w) + 2 for w in windows_of(row.t, width))
        if block and held + size > block_chars:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += size
    yield block


def _scan_udf(spark, benchmark: DataFrame, item_col: str, text_col: str, width: int, block_chars: int, scan_bytes: int):
    """The driver holds one block at a time; of several each is written to the shared folder."""
    blocks = _blocks(benchmark, item_col, text_col, width, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _one_block_udf(spark, first, width)
    folder, paths = new_path(spark, "benchmark-blocks"), []
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    block = first
    while block is not None:
        paths.append(f"{folder}/{len(paths)}.json")
        with fs.open_output_stream(f"{root}/{len(paths) - 1}.json") as f:
            f.write(json.dumps(block).encode())
        block, second = second, next(blocks, None) if second is not None else None
    return _blocks_udf(paths, width, scan_bytes)


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 13, out_col: str = "contamination", block_chars: int = BLOCK_CHARS, scan_bytes: int = SCAN_BYTES,
) -> DataFrame:
    """docs with a struct column: n_words, n_hit, items (sorted strings), spans (character offsets in the original)."""
    spark = docs.sparkSession
    short_batches(spark)
    scan = _scan_udf(spark, benchmark, item_col, item_text_col, width, block_chars, scan_bytes).asNondeterministic()  # so that a filter on the result doesn't run it again
    return docs.withColumn(out_col, scan(F.col(text_col)))


def is_contaminated(n_words, n_hit):
    """The contract's rule: some words are hit, and they are a twentieth of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every row of docs."""
    got = scan_benchmark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    c = F.col("contamination")
    return got.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), is_contaminated(c["n_words"], c["n_hit"]).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    """The digest's rows by comparing every window with every place; for tests on small inputs."""
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, of in items:
            for window in windows_of(of, width):
                w = window.split()
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        found |= set() if item is None else {str(item)}
        digest_ = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest_, bool(hit) and 20 * len(hit) >= len(words)))
    return out


#: The digest over DuckDB: words and windows unnested, windows joined as texts of their length.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
l AS (SELECT item, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM l)),
k AS (SELECT DISTINCT n FROM w),
p AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, k WHERE len(ws) >= n)),
h AS (SELECT r, item, i, p.n FROM p JOIN w ON p.n = w.n AND p.win = w.win),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
