"""Vector code compression: product codes by Lloyd rounds, where heaps say which parts a round must look at again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become whole numbers floor(SCALE * x).
SCALE = 256
#: Rows of a piece, which has heaps of its own.
ROWS = 1024
#: Vectors with a component of this size or more have no code, so that all sums are exact in 64 bits.
FAR = 1 << 16
#: Distances are square roots in double precision: bounds this near to each other are looked at again.
MARGIN = 1e-6


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x.astype(np.float64)).astype(np.int64)


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and how much farther the second nearest is; exact in whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    near, every = squares.argmin(axis=1), np.arange(len(x))
    upper = np.sqrt(squares[every, near].astype(np.float64))
    others = squares.astype(np.float64)
    others[every, near] = np.inf
    return near, np.sqrt(others.min(axis=1)) - upper


class Books:
    """The codebooks of a round, and for each entry how far its bounds have drifted since the first.

    A part's key is its slack, lower bound minus upper bound, plus its entry's drift when it was looked at.
    An update moves the entry by at most its own step and every other one by at most the largest of theirs,
    so that a part whose key is above the drift is still nearest to its entry.
    """

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None):
        self.entries = entries  # parts x entries x components
        self.drift = np.zeros(entries.shape[:2]) if drift is None else drift

    def updated(self, sums: np.ndarray) -> Books:
        """By the sums of components, and in the last place the number, of each entry's parts; unused entries stay."""
        n = sums[:, :, -1:]
        entries = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), self.entries)
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        largest = step.argmax(axis=1)
        others = np.repeat(step.max(axis=1, keepdims=True), step.shape[1], axis=1)
        every = np.arange(len(step))
        rest = step.copy()
        rest[every, largest] = 0
        others[every, largest] = rest.max(axis=1)
        return Books(entries, self.drift + step + others)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _keys(slack: np.ndarray) -> np.ndarray:
    """In single precision, never above what they were."""
    with np.errstate(over="ignore"):
        return np.nextafter(slack.astype(np.float32), np.float32(-np.inf))


class Piece:
    """Up to ROWS vectors of a partition: values, codes, and for each part and entry a heap of (key, row)."""

    def __init__(self, values: np.ndarray, codes: np.ndarray, order: np.ndarray, keys: np.ndarray):
        self.values, self.codes, self.order, self.keys = values, codes, order, keys

    def part(self, p: int) -> np.ndarray:
        d = self.values.shape[1] // self.codes.shape[1]
        return self.values[:, p * d : (p + 1) * d]

    @staticmethod
    def first(values: np.ndarray, books: Books) -> tuple[Piece, np.ndarray]:
        parts, k, d = books.entries.shape
        n = len(values)
        piece = Piece(values, np.zeros((n, parts), np.uint8), np.zeros((parts, n), np.uint16), np.zeros((parts, n), np.float32))
        sums = np.zeros((parts, k, d + 1), np.int64)
        for p in range(parts):
            near, slack = scan(piece.part(p), books.entries[p])
            piece.codes[:, p] = near
            keys = _keys(slack)
            # by entry, then key: sorted, so each entry's run is a heap
            piece.order[p] = np.lexsort((keys, near))
            piece.keys[p] = keys[piece.order[p]]
            _add(sums[p], near, piece.part(p), 1)
        return piece, sums

    def again(self, books: Books) -> np.ndarray:
        """Moves the parts that have a nearer entry; the change of the entries' sums."""
        parts, k, d = books.entries.shape
        change = np.zeros((parts, k, d + 1), np.int64)
        for p in range(parts):
            ends = np.cumsum(np.bincount(self.codes[:, p], minlength=k))
            begins = ends - np.bincount(self.codes[:, p], minlength=k)
            limits = books.drift[p] + MARGIN
            heaps: dict[int, list[tuple[float, int]]] = {}
            popped: list[int] = []
            for e in range(k):
                if begins[e] < ends[e] and self.keys[p, begins[e]] <= limits[e]:
                    heap = heaps[e] = self._heap(p, begins[e], ends[e])
                    while heap and heap[0][0] <= limits[e]:
                        popped.append(heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            x = self.part(p)[rows]
            near, slack = scan(x, books.entries[p])
            old = self.codes[rows, p].astype(np.int64)
            moved = near != old
            _add(change[p], old[moved], x[moved], -1)
            _add(change[p], near[moved], x[moved], 1)
            self.codes[rows, p] = near
            for row, e, key in zip(popped, near.tolist(), _keys(slack + books.drift[p, near]).tolist(), strict=True):
                if e not in heaps:
                    heaps[e] = self._heap(p, begins[e], ends[e])
                heappush(heaps[e], (key, row))
            keys, order = [], []
            for e in range(k):
                heap = heaps.get(e)
                keys.append(self.keys[p, begins[e] : ends[e]] if heap is None else np.array([x[0] for x in heap], np.float32))
                order.append(self.order[p, begins[e] : ends[e]] if heap is None else np.array([x[1] for x in heap], np.uint16))
            self.keys[p], self.order[p] = np.concatenate(keys), np.concatenate(order)
        return change

    def _heap(self, p: int, begin: int, end: int) -> list[tuple[float, int]]:
        return list(zip(self.keys[p, begin:end].tolist(), self.order[p, begin:end].tolist(), strict=True))

    def errors(self, books: Books) -> np.ndarray:
        out = np.zeros(len(self.values), np.int64)
        for p in range(self.codes.shape[1]):
            away = self.part(p) - books.entries[p][self.codes[:, p]]
            out += (away * away).sum(axis=1)
        return out


def _add(sums: np.ndarray, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
    np.add.at(sums[:, :-1], entry, sign * x)
    np.add.at(sums[:, -1], entry, sign)


def _state(columns: list[pa.Array], piece: Piece, sums: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row of a piece: lists of what the vectors carry, the numbers as bytes."""
    n = len(piece.values)
    lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.take(pa.array(np.arange(n)))) for c in columns]
    narrow = np.abs(piece.values).max(initial=0) < 1 << 15
    data = [piece.values.astype(np.int16 if narrow else np.int32), piece.codes, piece.order, piece.keys, sums]
    return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=names)


def _piece(batch: pa.RecordBatch, i: int, width: int, parts: int) -> Piece:
    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    n = len(batch.column("ids")[i])
    raw = batch.column("numbers")[i].as_py()
    values = np.frombuffer(raw, np.int16 if len(raw) == 2 * n * width else np.int32).astype(np.int64).reshape(n, width)
    return Piece(values, read("codes", np.uint8).reshape(n, parts).copy(), read("heap_rows", np.uint16).reshape(parts, n).copy(), read("heap_keys", np.float32).reshape(parts, n).copy())


_NAMES = ["ids", "labels", "numbers", "codes", "heap_rows", "heap_keys", "sums"]


def _start(books: Books, width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                piece, sums = Piece.first(whole_numbers(vectors_of(batch.column("v"), width)), books)
                yield _state([batch.column("vec_id"), batch.column("label")], piece, sums, _NAMES)

    return run


def _step(books: Books, width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                piece = _piece(batch, i, width, len(books.entries))
                change = piece.again(books)
                yield _state([batch.column("ids")[i].values, batch.column("labels")[i].values], piece, change, _NAMES)

    return run


def _finish(books: Books, width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                piece = _piece(batch, i, width, len(books.entries))
                piece.again(books)
                text, step = piece.codes.tobytes().hex(), 2 * len(books.entries)
                codes = pa.array([text[j : j + step] for j in range(0, len(text), step)])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, codes, pa.array(piece.errors(books))], names=["vec_id", "label", "code", "error"])

    return run


def _total(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's pieces."""
    total = None
    for batch in stream:
        for raw in batch.column("sums"):
            sums = np.frombuffer(raw.as_py(), np.int64)
            total = sums.copy() if total is None else total + sums
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Summed over all pieces; as many numbers as the codebooks have, whatever the table's size."""
    found = map_arrow(state.select("sums"), _total, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out.reshape(shape)


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors -> vec_id, code, error, label_error, codebooks_sha256; one row for each vector that is kept.

    Vectors that are null or hold null or non-finite components are dropped. Components become
    floor(256 * x), vectors are cut into `parts` equal parts, each with a codebook that starts as that part
    of the `entries` smallest vec_ids. In each round every part goes to its nearest entry, ties to the
    lower index, and each entry becomes the floor of its parts' mean; unused ones stay. Then parts are
    assigned again. code: two hex digits a part; error: the squared distances summed over parts;
    label_error: error summed over the rows of one label, null labels together.

    Vectors are coded at the length that most of those kept have which `parts` divides, the shorter in a
    tie; the others, empty ones and those with a component of 65536 or more come out with null code and
    error and take no part. A null vec_id is coded but seeds no codebook. Rows that share a vec_id are rows
    like others, in order of their vectors as seeds. With fewer kept rows than entries, codebooks have
    fewer; with no vec_id at all, codes are null. Other columns are ignored. An empty table gives an empty
    result.

    The first pass compares all parts with all entries and leaves, for each piece of a partition, a heap
    of (slack, row) for each part and entry. Later passes pop only the parts whose slack the drift of the
    codebooks has used up, compare these again with all entries, and push them. Between passes pieces are
    written to the shared folder; entries are summed from what moved. A task works on one piece at a time.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    double = not vectors.schema[vector_col].dataType.simpleString().startswith("array<float")
    of = "double" if double else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{of}>").alias("v"))
    rows = rows.where(F.expr(f"v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < {of}('inf'))"))
    fits = F.expr(f"size(v) > 0 and size(v) % {parts} = 0 and forall(v, x -> abs(x) < {FAR})")
    lengths = rows.where(fits).groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count("vec_id").alias("ids"))
    most = lengths.where("ids > 0").orderBy(F.desc("n"), "width").first()
    label_type = vectors.schema[label_col].dataType.simpleString()
    schema = f"vec_id long, label {label_type}, code string, error long"
    nothing = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if most is None:
        return nothing.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    width = most.width
    coded = F.coalesce(fits & (F.size("v") == width), F.lit(False))
    own = rows.where(coded)
    # as many rows as a codebook has entries
    seeds = own.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    starts = whole_numbers(vectors_of(seeds, width)).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    books = Books(np.ascontiguousarray(starts))
    shape = (parts, len(seeds), width // parts + 1)
    binary = ", ".join(f"{name} binary" for name in _NAMES[2:])
    state_type = f"ids array<long>, labels array<{label_type}>, {binary}"
    state = stage(map_arrow(own, _start(books, width), state_type))
    sums = _sums(state, shape)
    books = books.updated(sums)
    for _ in range(rounds - 1):
        state = stage(map_arrow(state, _step(books, width), state_type))
        sums = sums + _sums(state, shape)
        books = books.updated(sums)
    out = stage(map_arrow(state, _finish(books, width), schema))
    # sums in decimals can't overflow; one that a long can't hold is null
    of_label = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    every = out.unionByName(rows.where(~coded).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    joined = every.join(of_label, every["label"].eqNullSafe(of_label["_label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
