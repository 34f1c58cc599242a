"""Helpers shared by the text operators: words, hashes, staging and grouped streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.staging import scratch, shared_dir, stage  # noqa: F401  what the operators here write between steps

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() for small tables between iterations."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def n_words(text: Column) -> Column:
    """Number of words of a text, null: 0, as a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bytes_of(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of any run of consecutive words in constant time each, from a prefix sum.

    hash(i, k) = mix(sum of h[i+j] * M^j for j < k), modulo 2^64. M is odd, so it has an inverse and
    prefix sums of h[j] * M^j can be moved to start at any word.
    """

    _pow = np.ones(1, dtype=np.uint64)
    _inv = np.ones(1, dtype=np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Spans._pow) <= n:
            size = max(1024, 1 << (n + 1).bit_length())
            with np.errstate(over="ignore"):
                inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
                Spans._pow = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, _MUL, np.uint64))])
                Spans._inv = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, inverse, np.uint64))])
        self.n = n
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * Spans._pow[:n], dtype=np.uint64)])

    def all(self, k: int) -> np.ndarray:
        """The hash of each run of k words."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:m]) * Spans._inv[:m])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of words start..end-1 for each pair, with the length mixed in."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * Spans._inv[start] + (end - start).astype(np.uint64))


_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
#: Words above this length are hashed alone, texts in pieces of about this many bytes.
_LONG, _PIECE = 1 << 14, 1 << 19


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in bytes, of each word of a UTF-8 text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BREAK[np.frombuffer(data, np.uint8)]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def hash_runs(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs start..end-1 of bytes, which are in order; equal runs have equal hashes anywhere."""
    out = np.zeros(len(start), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    long = end - start > _LONG
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _PIECE)))
        low, high = start[i], start[i] + _PIECE + _LONG
        spans = Spans(raw[low:high].astype(np.uint64) + np.uint64(1))
        out[i:j] = spans.some(np.minimum(start[i:j] - low, spans.n), np.minimum(end[i:j] - low, spans.n))
        i = j
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return out


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words."""
    return hash_runs(data, *word_bounds(data))


class Words:
    """The words of several texts, hashed together: word i of text j is at first[j] + i."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        parts = [t if isinstance(t, bytes) else bytes_of(t) for t in texts]
        self.data = b"\n".join(parts)
        if lower:
            self.data = self.data.lower()  # of bytes: A-Z only
        self.start, self.end = word_bounds(self.data)
        self.hash = hash_runs(self.data, self.start, self.end)
        self.offset = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.first = np.searchsorted(self.start, self.offset)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words inside one text, and the word at which each starts."""
        every = Spans(hashes).all(k)
        inside = np.ones(len(every), bool)
        for at in self.first[1:-1]:
            inside[max(0, at - k + 1) : at] = False
        return every[inside], np.flatnonzero(inside)


def slices(stream: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def records(stream: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[dict]:
    """The rows of a stream, few in memory as Python objects at a time."""
    for batch in stream:
        for i in range(0, batch.num_rows, at_once):
            yield from batch.slice(i, at_once).to_pylist()


def grouped(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """The groups of a stream that is sorted by keys, one in memory at a time."""
    now, held = None, []
    for row in records(stream):
        key = tuple(row[k] for k in keys)
        if key != now and held:
            yield held
            held = []
        now = key
        held.append(row)
    if held:
        yield held


def grouped_batches(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same as Arrow, for keys of whole numbers without nulls."""
    now, held = None, []
    for batch in stream:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        steps = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        edges = [0, *(np.flatnonzero(steps) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[low] for c in columns)
            if key != now and held:
                yield _one(held)
                held = []
            now = key
            held.append(batch.slice(low, high - low))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def pack_text(df: DataFrame, *keep: str) -> DataFrame:
    """keep... and text, as zstd of its UTF-8 in a binary column: half the shuffle of plain text. Null stays null."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in slices(stream, 256):
            packed = [None if t is None else squeeze.compress(bytes_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(packed, pa.binary())], names=[*keep, "text"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, "text").mapInArrow(run, f"{types}, text binary")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal df by keys and sort each partition by them, for `grouped`."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
