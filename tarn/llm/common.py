"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarn.sources.shared import materialize, new_path, release, shared_dir

__all__ = ["Memo", "begin_stage", "filesystem", "materialize", "new_path", "once", "release", "resident", "shared_dir", "short_batches", "table"]

#: Rows in one Arrow batch sent to a Python worker; documents can be long, so batches are short.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def once(made: Column) -> Column:
    """made, computed in its own projection: what uses it is not merged with it, and a filter on it is not moved below it, where the optimiser
    would write it out once for each use, inside loops over words too."""
    return F.when(F.monotonically_increasing_id() >= 0, made)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI of the shared folder; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_residents: dict = {}
_stage: list = [None]


def begin_stage(keep=None) -> None:
    """Once a stage in each worker process: automata, models and memories of other stages go, but what is under the key `keep`, and freed memory
    goes back to the system, so a worker that serves many stages holds what one needs."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage == _stage[0]:
        return
    _stage[0] = stage
    for old in [k for k in _residents if k != keep]:
        del _residents[old]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def resident(key, make):
    """What make() gives, kept in this worker process under key, for this stage and for later ones that begin with it."""
    begin_stage(key)
    if key not in _residents:
        _residents[key] = make()
    return _residents[key]


class Memo:
    """word -> what compute gives for it, for many missing words at once. Memory is bounded by two generations of `limit` words: when one is
    full the next begins, and takes words over from the one before as they come up again."""

    def __init__(self, compute, limit: int = 300_000, longest: int = 100):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.data, self.old, self.long = {}, {}, []

    def of(self, words: list | set) -> dict:
        """A dict that holds every word of `words`; until the next call of tidy or of."""
        missing = set(words).difference(self.data)
        if not missing:
            return self.data
        if len(self.data) + len(missing) > self.limit:
            self.old, self.data = self.data, {}
            missing = set(words)
        data, old = self.data, self.old
        fresh = []
        for w in missing:
            if w in old:
                data[w] = old[w]
            else:
                fresh.append(w)
        self.long += [w for w in fresh if len(w) > self.longest]
        data.update(zip(fresh, self.compute(fresh)))
        return data

    def tidy(self) -> None:
        """After a batch: words that are too long to keep go, and all if one batch was too large."""
        for w in self.long:
            self.data.pop(w, None)
        self.long.clear()
        if len(self.data) > self.limit:
            self.data = {}
