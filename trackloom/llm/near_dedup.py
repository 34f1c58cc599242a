"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Spans, Words, batches, grouped, mix, slices, spread, stage
from trackloom.llm.components import components

SHINGLE = 5
HASHES = 256
#: Chance that no band finds a pair at the threshold, at most: it sets the rows of a band.
UNSEEN = 3e-4
#: Bands of the first round.
FIRST_BANDS = 8
#: Hashes compared between two looks at the posterior.
BATCH = 32
#: Chance to lose a true pair by pruning, for each pair.
MISS = 1e-6
#: Members, and bytes of text, of a bucket that one task holds.
BLOCK, BLOCK_BYTES = 512, 32 << 20
_SIGN = "doc_id long, hash long, n_shingles long, class binary, bands array<long>, signature binary, size long"
_LINK = "a long, b long"


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's 5-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    every = Spans(words.hash).all(SHINGLE)
    out = []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        if high - low < SHINGLE:
            out.append(Spans(words.hash[low:high]).all(max(1, high - low)))
        else:
            out.append(np.unique(every[low : high - SHINGLE + 1]))
    return out


def _sets(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in slices(stream):
        rows = batch.to_pylist()
        yield from zip(rows, shingles([r["text"] for r in rows]), strict=True)


def band_rows(percent: int) -> int:
    """The most rows of a band with which the bands still find a pair at the threshold: 8 at 85 %, 7 at 80 %."""
    j = percent / 100
    return max(r for r in range(1, 33) if r == 1 or (1 - j**r) ** (HASHES // r) <= UNSEEN)


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32), rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhashes(items: np.ndarray, families: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 32-bit minimum for each family; long sets go in pieces."""
    xors, odds = families
    low = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
    out = np.full(len(xors), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        x = low[i : i + 1024] ^ xors
        x *= odds
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _sign(rows_of_band: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, bands = _families(HASHES), HASHES // rows_of_band
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("size", pa.int64())])

        def rows() -> Iterator[dict]:
            for row, items in _sets(stream):
                out = {"doc_id": row["doc_id"], "hash": row["hash"], "n_shingles": len(items), "size": len(row["text"] or "")}
                if len(items):
                    least = minhashes(items, families)
                    banded = least[: bands * rows_of_band].reshape(bands, rows_of_band)
                    key = np.zeros(bands, np.uint64)
                    for j in range(rows_of_band):
                        key = mix(key + banded[:, j] + np.uint64(1))
                    key = mix(key ^ np.arange(1, bands + 1, dtype=np.uint64))
                    out |= {"class": hashlib.blake2b(items.tobytes(), digest_size=16).digest(), "bands": key.view(np.int64).tolist(), "signature": least.astype(np.uint8).tobytes()}
                yield out

        yield from batches(rows(), schema, 500)

    return run


@lru_cache
def least_agreement(percent: int, miss: float = MISS) -> list[int]:
    """For each number of batches, the fewest agreements that aren't pruned.

    Two signatures agree in one byte with chance p = J + (1 - J) / 256. With a uniform prior on J, the
    posterior after m agreements of n is in proportion to p^m (1 - p)^(n - m); a pair goes as soon as
    the posterior chance of J at the threshold or above is under `miss`.
    """
    j = np.linspace(0, 1, 20001)[1:-1]
    p = j + (1 - j) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            weights = np.exp(logs - logs.max())
            if weights[j >= percent / 100].sum() >= miss * weights.sum():
                out.append(m)
                break
    return out


def _survivors(left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs that no batch prunes, with their agreements."""
    least = least_agreement(percent)
    a, b = np.divmod(np.arange(len(left) * len(right)), len(right))
    if left is right:
        keep = a < b
        a, b = a[keep], b[keep]
    same = np.zeros(len(a), np.int32)
    for i, most in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        same = same + (left[a, cols] == right[b, cols]).sum(axis=1)
        keep = same >= most
        a, b, same = a[keep], b[keep], same[keep]
    return a, b, same


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Forest:
    """Union-find over the members of one block."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _verify(percent: int, crossing: bool):
    """Links of the blocks of a sorted stream: a spanning forest of each, found best agreement first.

    A pair whose ends are connected already adds nothing to the components and isn't looked at.
    With `crossing`, a group is two blocks of a bucket and only pairs between them count.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[dict]:
            for group in grouped(stream, ["bucket", "block"]):
                if len(group) < 2:
                    continue
                sigs = np.frombuffer(b"".join(r["signature"] for r in group), np.uint8).reshape(len(group), -1)
                forest = _Forest([r["component"] for r in group])
                sets: dict[int, np.ndarray] = {}

                def items(i: int) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingles([unpack.decompress(group[i]["text"]).decode("utf-8", "surrogatepass")])[0]
                    return sets[i]

                at = [[i for i, r in enumerate(group) if r["side"] == s] for s in (0, 1)] if crossing else [list(range(len(group)))] * 2
                one = sigs[at[0]]
                two = sigs[at[1]] if crossing else one
                step = 256
                for i in range(0, len(one), step):
                    for j in range(0 if crossing else i, len(two), step):
                        x = one[i : i + step]
                        y = x if not crossing and i == j else two[j : j + step]
                        a, b, same = _survivors(x, y, percent)
                        for k in np.argsort(-same, kind="stable"):
                            p, q = at[0][i + a[k]], at[1][j + b[k]]
                            if forest.root(p) != forest.root(q) and _linked(items(p), items(q), percent):
                                forest.up[forest.root(p)] = forest.root(q)
                                yield {"a": group[p]["node"], "b": group[q]["node"]}

        yield from batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of 5-word
    shingles (A-Z lower-cased). component_id is the smallest doc_id reachable by links, itself included.

    Null and empty texts and texts without words: n_shingles 0, linked with nothing. A null doc_id: a
    null component_id and kept false; such a row links nothing. Rows that share a doc_id are compared each
    by its own text. Columns other than doc_id and text are ignored. An empty table gives an empty result. Very long texts are cut into sets piece by piece.

    Equal sets are one class first. A class has 256 MinHashes in bands (at 85 %: 32 of 8, which find a
    pair at the threshold with chance 1 - 4e-5). A bucket is compared in blocks of bounded size, batch by batch
    of the signature under the posterior bound, and survivors on full sets; a bucket of more than one
    block gets its crossing pairs in a second pass, and only while its blocks aren't one component.
    The bands go in two rounds: buckets of the second round whose members are connected already are
    done, which spares most of the texts that copies would send through every band.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    signed = stage(docs.mapInArrow(_sign(band_rows(percent)), _SIGN))
    rows = signed.select("doc_id", "n_shingles", "class")
    reps = signed.where("class is not null and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("of"))
    reps = stage(reps.select("class", F.col("of.doc_id").alias("first"), F.col("of.hash").alias("first_hash"), F.monotonically_increasing_id().alias("node")))
    members = signed.join(reps, "class").where("doc_id = first and hash = first_hash").select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    members = stage(members)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    sizes = sizes.select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long").alias("blocks"))
    found = stage(members.select("node", "band", "bucket").join(sizes.hint("merge"), "bucket").distinct())
    # what grows with the documents is shuffled at every size, never broadcast
    some = found.select("node").distinct().join(reps.hint("merge"), "node").select("node", F.col("first").alias("doc_id"), F.col("first_hash").alias("hash")).hint("merge")
    of = ["doc_id", "hash"]
    texts = docs.where("doc_id is not null").join(some, of).groupBy(*of, "node").agg(F.min("text").alias("text")).mapInArrow(_pack, "node long, text binary")
    marks = signed.select(*of, "signature").join(some, of).groupBy(*of, "node").agg(F.min("signature").alias("signature")).select("node", "signature")
    texts = stage(texts.join(marks, "node"))
    links = labels = None
    for low, high in ((0, FIRST_BANDS), (FIRST_BANDS, HASHES)):
        part = found.where((F.col("band") >= low) & (F.col("band") < high))
        if labels is not None:
            part = part.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = part.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
            part = part.join(open_, "bucket", "left_semi")
        else:
            part = part.withColumn("component", F.col("node"))
        part = stage(part.select("node", "bucket", "blocks", "component"))
        inside = part.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks").join(texts, "node")
        more = stage(spread(inside, "bucket", "block").mapInArrow(_verify(percent, False), _LINK))
        links = more if links is None else links.unionByName(more)
        labels = components(links)
        hot = part.where("blocks > 1").drop("component")
        if not hot.isEmpty():
            links = links.unionByName(stage(_crossing(hot, texts, labels, percent)))
            labels = components(links)
    merged = reps.join(labels, "node", "left").select("class", "first", F.coalesce("component", "node").alias("component"))
    least = merged.groupBy("component").agg(F.min("first").alias("of_class"))
    merged = merged.join(least, "component").select("class", "of_class")
    out = rows.join(merged, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in slices(stream):
        packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "text"])


def _crossing(hot: DataFrame, texts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks of large buckets that aren't one component yet.

    Of each bucket's members, those in its largest component form the trunk, the others the rest. Pairs
    inside the trunk are connected already, so that only the rest's blocks meet others: each block of the
    rest meets every block of the trunk and every block of the rest from itself on.
    """
    seen = hot.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = seen.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("trunk"), (F.sum("n") - F.max("n")).alias("left"))
    whole = whole.where("left > 0").select("bucket", "trunk", F.ceil(F.col("left") / BLOCK).alias("rests"))
    seen = seen.join(whole, "bucket").withColumn("h", F.xxhash64("node"))
    trunk = seen.where("component = trunk").withColumn("other", F.pmod("h", "blocks")).withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1))).withColumn("side", F.lit(1))
    rest = seen.where("component <> trunk").withColumn("own", F.pmod("h", "rests"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") + F.col("rests") - 1)
    first = rest.withColumn("rest", F.col("own")).withColumn("other", F.explode(F.filter(every, lambda o: (o < F.col("blocks")) | (o >= F.col("blocks") + F.col("own"))))).withColumn("side", F.lit(0))
    second = rest.withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own")))).withColumn("other", F.col("blocks") + F.col("own")).withColumn("side", F.lit(1))
    cols = ["bucket", F.xxhash64("rest", "other").alias("block"), "side", "node", "component"]
    met = trunk.select(cols).unionByName(first.select(cols)).unionByName(second.select(cols))
    return spread(met.join(texts, "node"), "bucket", "block").mapInArrow(_verify(percent, True), _LINK)
