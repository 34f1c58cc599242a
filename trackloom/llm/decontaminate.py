"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Spans, batches, bytes_of, grouped, hash_runs, mix, slices, spread, stage, word_bounds

#: Tokens of a template window, and how many of them must not be placeholders.
WINDOW, LITERALS = 8, 4
#: An item leaks if this share of its tokens lies in matching windows, or so many tokens in a row do.
LEAST_COVERAGE, LEAST_RUN = 0.5, 20
#: Share of slots that must be bound to one value each.
LEAST_CONSISTENCY = 0.8
#: Windows of one leak lie within so many tokens of one diagonal.
DRIFT = 6
#: Bits of the filter of benchmark windows that goes to all tasks, whatever the size of the benchmark.
FILTER_BITS = 1 << 24
#: Words that are units after a number; fixed values.
UNITS = (
    "% kg g mg t lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "km/h mph m/s w kw kwh v a hz khz mhz ghz kb mb gb tb px pt c f k usd eur gbp dollar dollars euro euros cent cents pound pounds percent"
).split()

LITERAL, NUMBER, NAME, UNIT = range(4)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_PLACEHOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


def _lower(raw: np.ndarray) -> np.ndarray:
    """Bytes of a UTF-8 text with A-Z and the capitals of Latin-1 in lower case."""
    out = raw + np.uint8(32) * _UPPER[raw]
    second = np.concatenate([[False], raw[:-1] == 0xC3]) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    return out + np.uint8(32) * second


class Template:
    """Tokens of several texts with numbers, names and units replaced by typed placeholders.

    A token is a word without outer punctuation, in lower case; words of punctuation alone are no
    tokens. A number is a token with digits and without letters, or a number with a unit written on
    to it; a unit is a word of UNITS after a number; a name is a word with a capital first letter only.
    Where such a word begins a sentence or line it may be a name or not: there are two readings, in
    kinds and tokens: it is a literal in the first and a name in the second.
    """

    _units: np.ndarray | None = None

    def __init__(self, texts: list[str | None]):
        parts = [bytes_of(t) for t in texts]
        data = b"\n".join(parts)
        raw = np.frombuffer(data, np.uint8)
        start, end = word_bounds(data)
        solid = np.flatnonzero(~_PUNCT[raw] & (raw > 32) & (raw != 127))
        if Template._units is None:
            Template._units = np.sort(np.concatenate([hash_runs(u.encode(), np.array([0]), np.array([len(u)])) for u in UNITS]))
        low = np.searchsorted(solid, start)
        high = np.searchsorted(solid, end)
        some = high > low
        begins_line = np.ones(len(start), bool)
        stops = np.ones(len(start), bool)
        if len(start):
            lines = np.concatenate([[0], np.cumsum(raw == 10)])
            begins_line[1:] = lines[start[1:]] > lines[end[:-1]]
            last = np.concatenate([[0], np.cumsum(_STOP[raw])])
            tail = np.concatenate([solid, [0]])[np.maximum(high - 1, 0)] + 1
            stops[1:] = np.where(some[:-1], last[end[:-1]] > last[np.minimum(tail[:-1], end[:-1])], True)
        start, end, low, high, first = start[some], end[some], low[some], high[some], (begins_line | stops)[some]
        s, e = (solid[low], solid[high - 1] + 1) if len(start) else (start, end)
        lowered = _lower(raw)
        self.raw = hash_runs(lowered.tobytes(), s, e)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        letters = np.concatenate([[0], np.cumsum(~_DIGIT[raw] & ~_PUNCT[raw])])
        capitals = np.concatenate([[0], np.cumsum((lowered != raw) & _UPPER[raw] | (lowered != raw) & (raw >= 0x80))])
        n_digits, n_letters = digits[e] - digits[s], letters[e] - letters[s]
        number = (n_digits > 0) & ((n_letters == 0) | _DIGIT[raw[s]] & (n_letters <= 3)) if len(s) else np.zeros(0, bool)
        kind = np.where(number, NUMBER, LITERAL)
        at_most = np.minimum(np.searchsorted(Template._units, self.raw), len(Template._units) - 1)
        unit = (Template._units[at_most] == self.raw) & np.concatenate([[False], number[:-1]])[: len(s)]
        kind[unit & ~number] = UNIT
        two = np.minimum(s + 2, e)
        name = ~number & (n_digits == 0) & (e - s >= 2) & (capitals[two] - capitals[s] == 1) & (capitals[e] - capitals[s] == 1) & (kind == LITERAL)
        kind[name & ~first] = NAME
        self.kind, self.kinds = kind, [kind, np.where(name, NAME, kind)]
        self.tokens = [np.where(k == LITERAL, self.raw, _PLACEHOLDER[k]) for k in self.kinds]
        self.literals = [np.concatenate([[0], np.cumsum(k == LITERAL)]) for k in self.kinds]
        offset = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.first = np.searchsorted(s, offset)

    def windows(self) -> tuple[np.ndarray, ...]:
        """(hash, first token, number of tokens, raw, reading) of all windows; a text of fewer tokens is one window.

        Windows without enough literals are raw: hashed by their tokens, not by placeholders. So is the first
        one of a text, besides, as its first word may be a unit where other words stand before it.
        """
        n = len(self.raw)
        size = np.full(n, WINDOW)
        inside = np.ones(n, bool)
        for low, high in zip(self.first[:-1], self.first[1:], strict=True):
            if high - low < WINDOW:
                inside[low + 1 : high] = False
                size[low:high] = high - low
            else:
                inside[high - WINDOW + 1 : high] = False
        at = np.flatnonzero(inside)
        size = size[at]
        raw = np.isin(at, self.first) | (self._literals(0, at, at + size) < LITERALS)
        parts = [self._read(reading, at, size) for reading in (0, 1)] + [(self._raw(at[raw], (at + size)[raw]), at[raw], size[raw])]
        return self._joined(parts)

    def windows_of(self, sizes: list[int], raw_sizes: list[int]) -> tuple[np.ndarray, ...]:
        """The same for all windows of `sizes` with enough literals, and all of `raw_sizes` by their tokens.

        A window that has too few literals in an item may have enough in a document, by the word before it.
        """
        parts: list[list[tuple]] = [[], [], []]
        for size, raw in [(k, False) for k in sizes] + [(k, True) for k in raw_sizes]:
            at = np.arange(max(0, len(self.raw) - size + 1))
            at = at[at + size <= self.first[np.searchsorted(self.first, at, side="right")]]
            for i in (2,) if raw else (0, 1):
                parts[i].append((self._raw(at, at + size), at, np.full(len(at), size)) if raw else self._read(i, at, np.full(len(at), size)))
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return self._joined([tuple(np.concatenate(x) for x in zip(nothing, *p, strict=True)) for p in parts])

    def _read(self, reading: int, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows with enough literals; of the second reading those that the first doesn't have."""
        some = self._literals(reading, at, at + size) >= LITERALS
        if reading:
            some &= self._literals(0, at, at + size) != self._literals(1, at, at + size)
        at, size = at[some], size[some]
        return Spans(self.tokens[reading]).some(at, at + size), at, size

    def _joined(self, parts: list[tuple]) -> tuple[np.ndarray, ...]:
        reading = np.repeat([0, 1, 0], [len(p[0]) for p in parts])
        raw = np.repeat([False, False, True], [len(p[0]) for p in parts])
        return (*(np.concatenate(x) for x in zip(*parts, strict=True)), raw, reading)

    def _literals(self, reading: int, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.literals[reading][end] - self.literals[reading][at]

    def _raw(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(Spans(self.raw).some(at, end) ^ _PLACEHOLDER[NUMBER])


def _item_windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("window", pa.int64()), ("item_id", pa.int64()), ("item_at", pa.int32()), ("size", pa.int32()), ("raw", pa.bool_()), ("reading", pa.int32()), ("tokens", pa.int32()), ("item_slots", pa.list_(pa.int64())), ("item_places", pa.list_(pa.int32()))])

    def rows() -> Iterator[dict]:
        for batch in slices(stream):
            ids, t = batch.column("item_id").to_pylist(), Template(batch.column("text").to_pylist())
            for h, at, size, raw, reading in zip(*(x.tolist() for x in (lambda w: (w[0].view(np.int64), *w[1:]))(t.windows())), strict=True):
                i = int(np.searchsorted(t.first, at, side="right")) - 1
                places = np.flatnonzero(t.kinds[reading][at : at + size] != LITERAL) + (at - t.first[i])
                yield {"window": h, "item_id": ids[i], "item_at": at - t.first[i], "size": size, "raw": raw, "reading": reading, "tokens": t.first[i + 1] - t.first[i], "item_slots": _slots(t, reading, at, size), "item_places": places.tolist()}

    yield from batches(rows(), schema)


def _slots(t: Template, reading: int, at: int, size: int) -> list[int]:
    """The values of a window's placeholders in order."""
    part = slice(at, at + size)
    return t.raw[part][t.kinds[reading][part] != LITERAL].view(np.int64).tolist()


def _doc_windows(wanted, sizes: list[int], raw_sizes: list[int]):
    """Windows of documents whose hash passes `wanted`, a broadcast filter of bits. Raw ones come without slots."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("window", pa.int64()), ("doc_at", pa.int64()), ("doc_reading", pa.int32()), ("doc_slots", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).view(bool)

        def rows() -> Iterator[dict]:
            for batch in slices(stream):
                t = Template(batch.column("text").to_pylist())
                h, at, size, raw, reading = t.windows_of(sizes, raw_sizes)
                some = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
                h, at, size, raw, reading = h[some], at[some], size[some], raw[some], reading[some]
                if not len(h):
                    continue
                of = np.searchsorted(t.first, at, side="right") - 1
                rid, did = batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
                for x, a, n, w, k, i in zip(h.view(np.int64).tolist(), at.tolist(), size.tolist(), raw.tolist(), reading.tolist(), of.tolist(), strict=True):
                    yield {"row_id": rid[i], "doc_id": did[i], "window": x, "doc_at": a - int(t.first[i]), "doc_reading": k, "doc_slots": [] if w else _slots(t, k, a, n)}

        yield from batches(rows(), schema)

    return run


def _longest(covered: np.ndarray) -> int:
    steps = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return int((steps[1::2] - steps[::2]).max(initial=0))


def _judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits sorted by (row_id, item_id) -> the best place of each item in each document, if it is a leak."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("longest_run", pa.int64()), ("n_slots", pa.int64()), ("n_changed", pa.int64()), ("consistency", pa.float64())])

    def rows() -> Iterator[dict]:
        for hits in grouped(stream, ["row_id", "item_id"]):
            hits.sort(key=lambda r: (r["doc_at"] - r["item_at"], r["item_at"]))
            places: list[list[dict]] = []
            for r in hits:
                if not places or r["doc_at"] - r["item_at"] - (places[-1][-1]["doc_at"] - places[-1][-1]["item_at"]) > DRIFT:
                    places.append([])
                places[-1].append(r)
            best = None
            # a place counts by its first readings alone, or by all: what may be a name must not spoil what is the same word for word
            plain = [[r for r in place if not r["reading"] and not r["doc_reading"]] for place in places]
            for place in [p for pair in zip(plain, places, strict=True) for p in pair if p]:
                covered = np.zeros(place[0]["tokens"], bool)
                seen: dict[tuple[int, int], Counter] = {}
                for r in place:
                    covered[r["item_at"] : r["item_at"] + r["size"]] = True
                    # a raw window has the item's own values
                    for at, x, y in zip(r["item_places"], r["item_slots"], r["doc_slots"] or r["item_slots"], strict=True):
                        seen.setdefault((at, x), Counter())[y] += 1
                # each slot of the item once, with the value that most windows show
                bound: dict[int, Counter] = {}
                for (_, x), values in sorted(seen.items()):
                    bound.setdefault(x, Counter())[values.most_common(1)[0][0]] += 1
                n = sum(c.total() for c in bound.values())
                one = {
                    "doc_id": place[0]["doc_id"], "item_id": place[0]["item_id"], "coverage": float(covered.mean()), "longest_run": _longest(covered), "n_slots": len(bound),
                    "n_changed": sum(c.most_common(1)[0][0] != x for x, c in bound.items()), "consistency": sum(c.most_common(1)[0][1] for c in bound.values()) / n if n else 1.0,
                }
                leaks = (one["coverage"] >= LEAST_COVERAGE or one["longest_run"] >= LEAST_RUN) and one["consistency"] >= LEAST_CONSISTENCY
                if leaks and (best is None or (one["coverage"], one["consistency"]) > (best["coverage"], best["consistency"])):
                    best = one
            if best:
                yield best

    yield from batches(rows(), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, coverage, longest_run, n_slots, n_changed, consistency.

    One row for each row of docs and item that leaks into it. Both texts become templates; their windows
    are joined by hash. Windows near one diagonal make a place; a place is a leak if it covers enough of
    the item and binds the item's slots consistently: the same value of the item to the same value of the
    document throughout. n_changed tells how many of the item's values were replaced.

    Windows of an item with fewer than LITERALS literals (arithmetic, names, very short items) are joined by
    their tokens as they are, so that these leak verbatim only; so is its first window, besides. An item of
    fewer than WINDOW tokens is looked for inside documents at its own length: one of a word or two leaks
    into every document that has it.

    Ties between places of an item in a document go to the first in the order of their diagonals. Null and
    empty texts and items without a token match nothing. Null ids come out
    as null. Repeated rows of docs are reported each; rows of the benchmark that share an item_id are
    places of one item. Very long texts are searched whole. Other columns are ignored. Empty tables give
    an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = stage(items.mapInArrow(_item_windows, "window long, item_id long, item_at int, size int, raw boolean, reading int, tokens int, item_slots array<long>, item_places array<int>"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most FILTER_BITS numbers come to the driver, however large the benchmark; what passes is joined by the whole hash
    known = items.select(F.col("window").bitwiseAND(FILTER_BITS - 1).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    bits = np.zeros(FILTER_BITS, bool)
    bits[known] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    sizes = items.select("size", "raw").distinct().collect()
    found = rows.mapInArrow(_doc_windows(wanted, *(sorted(r["size"] for r in sizes if r["raw"] == raw) for raw in (False, True))), "row_id long, doc_id long, window long, doc_at long, doc_reading int, doc_slots array<long>")
    hits = found.join(items.drop("raw"), "window")
    return spread(hits, "row_id", "item_id").mapInArrow(_judge, "doc_id long, item_id long, coverage double, longest_run long, n_slots long, n_changed long, consistency double")
