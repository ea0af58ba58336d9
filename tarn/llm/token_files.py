"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds one pair of files a partition, in ascending id order: `.ids` (little-endian unsigned ids, documents one after
another; 16-bit where the tokenizer's ids fit, else 32-bit) and `.docs` (64-bit pairs: document id, ids before it in the file), and `manifest.json`, which names the pairs that count, in order, each
with its base: the ids in all pairs before it, by prefix sums over partitions. Readers map the files into memory and need no other part.
A task writes under a new name on each attempt; the manifest names the attempts whose rows Spark kept, so lost executors and
repeated tasks leave no trace in the result.

Defined results: a null or empty text has only the end id; null ids come first and read back as null; rows that repeat an id are
all written, next to each other; an empty table gives a manifest without pairs; only the named columns are read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarn.llm.common import filesystem, materialize, new_path, short_batches
from tarn.llm.token_counts import encoder

#: Fixed value: stands for a null document id in a .docs file.
NULL_ID = -(1 << 63)
#: Bytes of the table for one pair of files, as the optimiser estimates it; most pairs; documents and ids that a reader holds at once (a longer document is read whole).
PART_BYTES, MOST_PARTS, READ_DOCS, READ_IDS = 256_000_000, 100_000, 2000, 4_000_000


def partitions(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more where a part would be larger than PART_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the folder and returns the manifest's pairs: part, name, n_docs, n_ids, base."""
    spark = docs.sparkSession
    short_batches(spark)
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    dtype = encoder(tokenizer).dtype
    end = np.array([end_id], dtype).tobytes()
    width = len(end)

    def write(batches):
        part, name = TaskContext.get().partitionId(), None
        n_docs = n_ids = 0
        fs, root = filesystem(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if name is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                ids, offsets = fs.open_output_stream(f"{root}/{name}.ids"), fs.open_output_stream(f"{root}/{name}.docs")
            doc = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            coded = [x + end for x in encoder(tokenizer).encoded(batch.column(1).to_pylist())]
            size = np.fromiter(map(len, coded), np.int64, len(coded)) // width
            offsets.write(np.stack([doc, n_ids + np.cumsum(size) - size], axis=1).astype("<i8").tobytes())
            for x in coded:
                ids.write(x)
            n_docs, n_ids = n_docs + len(coded), n_ids + int(size.sum())
        if name:
            ids.close()
            offsets.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(rows), "doc_id").sortWithinPartitions("doc_id")
    written = materialize(ordered.mapInArrow(write, "part bigint, name string, n_docs bigint, n_ids bigint"), "token-files")
    pairs, base = [], 0
    for row in sorted(written.collect(), key=lambda r: r.part):  # one row a partition
        pairs.append(row.asDict() | {"base": base})
        base += row.n_ids
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "n_ids": base, "pairs": pairs}).encode())
    return pairs


def read_manifest(path: str) -> dict:
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class Numbers:
    """Numbers of a file by range: mapped into memory where the file is local, else range-read."""

    def __init__(self, path: str, dtype: str):
        fs, root = filesystem(path)
        self.dtype, self.file = np.dtype(dtype), None
        if fs.type_name == "local":
            self.mapped = np.memmap(root, self.dtype, "r")
            self.size = len(self.mapped)
        else:
            self.file = fs.open_input_file(root)
            self.size = self.file.size() // self.dtype.itemsize

    def range(self, a: int, b: int) -> np.ndarray:
        if self.file is None:
            return self.mapped[a:b]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, a * width), self.dtype)


def _documents(path: str, pair: dict, dtype: str):
    """(doc ids, edges of their ids, the ids from the first edge on) of runs of documents."""
    docs, ids = Numbers(f"{path}/{pair['name']}.docs", "<i8"), Numbers(f"{path}/{pair['name']}.ids", dtype)
    assert docs.size == 2 * pair["n_docs"] and ids.size == pair["n_ids"], "a file is cut short"
    for a in range(0, pair["n_docs"], READ_DOCS):
        b = min(a + READ_DOCS, pair["n_docs"])
        some = docs.range(2 * a, min(2 * b + 2, docs.size)).reshape(-1, 2)
        edge = some[:, 1] if b < pair["n_docs"] else np.append(some[:, 1], ids.size)
        i = 0
        while i < b - a:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + READ_IDS, "right")) - 1)
            j = min(j, b - a)
            yield some[i:j, 0], edge[i : j + 1], ids.range(int(edge[i]), int(edge[j]))
            i = j


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids before it in the whole folder), n_tokens, ids_crc32 (of the ids as 32-bit integers); with_ids: also ids."""
    manifest = read_manifest(path)
    pairs, dtype = manifest["pairs"], manifest["dtype"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for doc, edge, ids in _documents(path, pairs[k], dtype):
                    own = [ids[x - edge[0] : y - edge[0]] for x, y in zip(edge, edge[1:])]
                    crc = [zlib.crc32(x.astype("<u4")) for x in own]
                    out = {"doc_id": pa.array(doc, pa.int64(), mask=doc == NULL_ID), "start": pa.array(pairs[k]["base"] + edge[:-1]), "n_tokens": pa.array(np.diff(edge)), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    n = max(1, len(pairs))
    return spark.range(0, len(pairs), 1, n).mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new folder in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token-ids")
    write_token_files(docs, tokenizer, end_id, path)
    return read_token_files(docs.sparkSession, path)
