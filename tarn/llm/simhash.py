"""SimHash near-duplicates, exact for a Hamming radius, by a Gray-order hierarchical index inside pigeonhole buckets.

Fingerprint: 64 bits, each set if it is set in over half of the text's shingle hashes (XXH64, seed 42, of space-joined words).
Links: two fingerprints that differ in at most `radius` bits agree on some `keep` of `parts` bit parts (parts = radius + keep),
so each fingerprint is dealt to one bucket per choice of `keep` parts; `keep` follows the number of fingerprints so that buckets stay
small at any size. A bucket that is larger than `chunk` is dealt out as pairs of chunks, so that no bucket is one task's work and no
link is lost. In a bucket, fingerprints are sorted by Gray rank, runs of `FANOUT` share a node that holds the bits they have in common,
and nodes are grouped again upwards; a search adds up differences from node to node and leaves a group once they exceed the radius.
Only a spanning forest of each bucket's links is passed on, which keeps components whole without emitting all pairs.
Components: alternating large-star and small-star rounds over a table of edges between distinct fingerprints.

Rows meet their component by a join on the fingerprint. Fingerprints that more than one row in HOT_CODES has are fewer than HOT_CODES, and are
broadcast, so a third of all rows being copies of one text makes no hot task.

Defined results: null or empty texts have fingerprint zero, which links like any other. Links are between fingerprints: a row with a null
id links like any other, but can't name a component (null if it has only such rows); rows that share an id aren't linked by that; repeated
rows have equal results. Survivors: of each component the row of the smallest id (a null id last), of several rows with that id the one whose
text has the smallest MD5, and of rows equal in both any one.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tarn.llm.common import begin_stage, materialize, release, short_batches

SEED, FANOUT = 42, 8
#: Fingerprints of one bucket that one task compares; and the mean size of a bucket that `keep` is chosen for.
CHUNK, BUCKET = 4096, 1024
#: Codes that are broadcast to the rows that have them (fewer than this many); removed rows that are broadcast to the documents (32 bytes each).
HOT_CODES, REMOVED_BOUND = 1000, 100_000


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    hash_, view = xxhash.xxh64_intdigest, memoryview(joined)
    n = len(words) - width + 1
    h = np.fromiter((hash_(view[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[width - 1 :].tolist())), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        total += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    begin_stage()
    return pa.array(np.array([fingerprint(x) for x in text.to_pylist()], np.uint64).view(np.int64), pa.int64())


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints of one bucket in Gray order; level 0 has the fingerprints, level k+1 nodes over FANOUT nodes of level k."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        value, mask = codes[self.order], np.full(len(codes), ~np.uint64(0))
        self.levels = [(value, mask)]
        while len(value) > FANOUT:
            cuts = np.arange(0, len(value), FANOUT)
            either, both, shared = np.bitwise_or.reduceat(value & mask, cuts), np.bitwise_and.reduceat(value | ~mask, cuts), np.bitwise_and.reduceat(mask, cuts)
            mask = shared & ~(either ^ both)
            value = both & mask
            self.levels.append((value, mask))

    def search(self, queries: np.ndarray, radius: int):
        """(query, place in the index) of each pair within the radius; places follow `order`."""
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        known, spent = np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            value, mask = self.levels[k]
            spent = spent + np.bitwise_count((queries[q] ^ value[node]) & mask[node] & ~known)
            stay = spent <= radius
            q, node, spent = q[stay], node[stay], spent[stay]
            known = mask[node]
            if k:
                below = len(self.levels[k - 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = child < below
                q, known, spent, node = np.repeat(q, FANOUT)[real], np.repeat(known, FANOUT)[real], np.repeat(spent, FANOUT)[real], child[real]
        return q, node


class Forest:
    """Union-find over 0..n-1 that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            # each tree hangs below the smallest tree that it touches: one pass joins many
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            self.links += zip(a[first].tolist(), b[first].tolist())
            parent = np.arange(len(self.root))
            parent[high[first]] = low[first]
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
            self.root = parent[self.root]


def bucket_links(codes: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among codes. side: 0 for a whole bucket; in a pair of chunks, 1 and 2, and only links across."""
    forest = Forest(len(codes))
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    index = GrayIndex(codes[right])
    step = max(16, 1_000_000 // max(1, len(right)))  # a step's pairs fit in memory even if nothing is pruned
    for k in range(0, len(left), step):
        q, place = index.search(codes[left[k : k + step]], radius)
        a, b = left[k + q], right[index.order[place]]
        forest.add(a[a != b], b[a != b])
    return forest.links


def _links_udf(radius: int):
    def links(batches):
        """Rows come sorted by bucket; one bucket at a time is held."""
        begin_stage()
        held = {"bucket": None, "code": [], "node": [], "side": []}

        def flush():
            if sum(map(len, held["code"])) > 1:
                code, node, side = (np.concatenate(held[x]) for x in ("code", "node", "side"))
                for a, b in bucket_links(code.view(np.uint64), side, radius):
                    yield int(node[a]), int(node[b])

        for batch in batches:
            bucket, code, node, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                if bucket[a] != held["bucket"]:
                    out += flush()
                    held |= {"bucket": bucket[a], "code": [], "node": [], "side": []}
                for name, x in (("code", code), ("node", node), ("side", side)):
                    held[name].append(x[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if out := list(flush()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return links


def choices(n: int, radius: int, bucket: int = BUCKET) -> list[int]:
    """Masks of the bit parts that make a bucket's key, for n fingerprints."""
    for keep in range(1, 5):
        parts = radius + keep
        bits = 64 * keep // parts
        if n >> bits <= bucket or keep == 4:
            break
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(parts)]
    assert comb(parts, keep) == len(list(combinations(part, keep)))
    return [sum(x) for x in combinations(part, keep)]


def link_nodes(nodes: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes (code, node: distinct codes, each with an id) that connect all codes within the radius."""
    spark = nodes.sparkSession
    masks = choices(nodes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = nodes.select(
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("bucket"), "code", "node"
    )
    large = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "simhash-large")
    if large.count():
        # a bucket beyond the chunk size: its rows meet chunk by chunk, in one task per pair of chunks
        each = dealt.join(large, "bucket", "left").withColumn("k", F.ceil(F.col("n") / chunk).cast("int")).withColumn("i", F.pmod(F.xxhash64("code", F.lit(7)), "k").cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.xxhash64("bucket", F.least(F.col("i"), j), F.greatest(F.col("i"), j)).alias("b"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("s")))
        dealt = each.select(F.explode(F.when(F.col("n").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("s")))).otherwise(pair)).alias("x"), "code", "node").select(F.col("x.b").alias("bucket"), "code", "node", F.col("x.s").alias("side"))
    else:
        dealt = dealt.withColumn("side", F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").select("bucket", "code", "node", "side")
    return dealt.mapInArrow(_links_udf(radius), "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): every node that has a link, with the smallest node of its component. Large-star and small-star rounds until
    the edges stop changing; hubs are only aggregated (min) and joined, never gathered."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, before = materialize(star, "components"), edges
        release(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(state) == seen or state[0] == state[2] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def row_key(id_, text):
    """16 bytes for an id and a text, null ids and null texts included."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def _rows(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """A table of doc_id and code (and key) of every row."""
    short_batches(docs.sparkSession)
    key = [row_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []
    return materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *key, fingerprint_udf(F.col(text_col)).alias("code")), "simhash")


def groups(rows: DataFrame, radius: int = 4) -> DataFrame:
    """A table of the distinct codes of rows (doc_id, code): code, n (rows that have it), label (the smallest code reachable), component_id (the
    smallest doc_id of the rows of all codes reachable)."""
    nodes = materialize(rows.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    found = components(link_nodes(nodes.select("code", F.col("code").alias("node")), radius)).withColumnRenamed("node", "code")
    linked = materialize(nodes.join(found, "code"), "simhash-linked")
    low = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    alone = nodes.join(linked.select("code"), "code", "left_anti").select("code", "n", F.col("code").alias("label"), F.col("first").alias("component_id"))
    return materialize(linked.join(low, "label").select("code", "n", "label", "component_id").unionByName(alone), "simhash-groups")


def _by_code(rows: DataFrame, codes: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their code (those without one go); total: rows altogether. Codes of many rows are broadcast."""
    often = F.col("n") * HOT_CODES > total
    hot = codes.where(often)
    rest = rows.join(F.broadcast(hot.select("code")), "code", "left_anti")
    return rows.join(F.broadcast(hot), "code").unionByName(rest.join(codes.where(~often), "code"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links, itself included)."""
    rows = _rows(docs, id_col, text_col)
    return _by_code(rows, groups(rows, radius), rows.count()).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """docs with one row for each component (which one: see above). The rows to remove are known by id and text, and anti-joined: broadcast up to
    REMOVED_BOUND of them, shuffled beyond that."""
    rows = _rows(docs, id_col, text_col, keyed=True)
    codes = groups(rows.select("doc_id", "code"), radius)
    # only rows of codes that share their component, or are several themselves, can go
    shared = codes.groupBy("label").agg(F.sum("n").alias("rows")).where("rows > 1")
    members = materialize(_by_code(rows, codes.join(shared.select("label"), "label", "left_semi").select("code", "label", "n"), rows.count()), "simhash-members")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    keeper = members.groupBy("label").agg(F.min(rank).alias("k"), F.count("*").alias("rows")).select(F.col("k.key").alias("key"))
    out = materialize(members.join(keeper.select("key"), "key", "left_anti").select("key").distinct(), "simhash-removed")
    again = materialize(members.join(keeper, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "simhash-repeated")
    name = "__key"
    while name in docs.columns:
        name += "_"
    few = lambda df: F.broadcast(df) if df.count() <= REMOVED_BOUND else df
    keyed = docs.withColumn(name, row_key(F.col(id_col), F.col(text_col)))
    kept = keyed.join(few(out.withColumnRenamed("key", name)), name, "left_anti")
    if not again.isEmpty():
        twice = few(again.withColumnRenamed("key", name))
        kept = kept.join(twice, name, "left_anti").unionByName(kept.join(twice, name, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)


def brute_force(rows: list[tuple], radius: int = 4, width: int = 4) -> list[tuple]:
    """near_duplicates bit by bit and by comparing all pairs; shares nothing with the operator; for tests on small inputs."""

    def bits(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        shingles = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
        hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    codes = [bits(t) for _, t in rows]
    near, seen, low = {a: [b for b in set(codes) if bin(a ^ b).count("1") <= radius] for a in set(codes)}, {}, {}
    for start in near:
        stack = [] if start in seen else [start]
        while stack:
            if (at := stack.pop()) not in seen:
                seen[at] = start
                stack += near[at]
    for (doc, _), c in zip(rows, codes):
        if doc is not None:
            low[seen[c]] = min(doc, low.get(seen[c], doc))
    return [(doc, format(c, "016x"), low.get(seen[c])) for (doc, _), c in zip(rows, codes)]
