"""Shared pieces: texts of Arrow batches as bytes, word hashes over whole batches, durable intermediate tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of anything else.
SPACES = " \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in SPACES]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def staging_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster shares, which ``spark.checkpoint.dir`` names.

    A local session without that setting gets a folder of its own; a cluster without it is an error.
    """
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = tempfile.mkdtemp(prefix="rowwarden-staging-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, for results that several later jobs read."""
    folder = staging_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def staged_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """``staged`` for what no result reads later: the folder is deleted at the end."""
    folder, spark = staging_folder(df.sparkSession), df.sparkSession
    df.write.parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, giving free memory back to the machine when its task ends: the worker lives on idle."""
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output row group for every 1,000 input rows, rows in the same order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield step(batch.slice(at, 1000))

    return df.mapInArrow(tidied(run), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and where each text begins and ends in them."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_BLANK = re.compile(f"[{SPACES}]+")


def split_words(text: str) -> list[str]:
    """Cut at ASCII white space; str.split alone would cut at other signs too.  Empty words may stand at the ends."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return _BLANK.split(text)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]))
                      for b in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, A-Z as a-z, in order, and where each text's words begin and end.

    The texts are taken in segments of bounded length that end at white space or between texts, so one very long text
    needs no more working memory than many short ones.
    """
    word = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        size = int(ends[to - 1] - base)
        up, down = _power_tables(max(size, 1024))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((LOWER[data[base:base + size]].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((sums[b] - sums[a]) * down[a] + np.uint64(_ODD) * (b - a).astype(np.uint64))
        at = to
    return hashes, np.searchsorted(starts, offsets)


class Remembered:
    """What has been worked out for keys, in two generations of about ``most`` bytes each; ``cost`` gives an entry's bytes.

    When the young generation is full it becomes the old one, and what isn't met again meanwhile is forgotten.
    """

    def __init__(self, most: int, cost: Callable[..., int]) -> None:
        self.most, self.cost, self.size = most, cost, 0
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value) -> None:
        self.size += self.cost(key, value)
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, self.cost(key, value)
        self.young[key] = value

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def every(self, keys: list) -> list:
        """What is remembered of each key, None for the others."""
        found = list(map(self.young.get, keys))
        return [self.get(k) if f is None else f for k, f in zip(keys, found, strict=True)] if self.old and None in found else found


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none.  Native."""
    gap = "[" + "".join(f"\\x{ord(c):02x}" for c in SPACES) + "]+"
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")
