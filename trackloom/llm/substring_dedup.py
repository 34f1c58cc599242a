"""Substring dedup: confirmed recurring passages, located in all documents by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Spans, Words, batches, pack_text, records, slices, stage

#: A passage recurs if this many consecutive words do.
WINDOW = 35
#: Words of the runs by which equal windows find each other.
GRAM = 14
#: Documents stream through automata in buckets of about so many bytes of packed text.
BUCKET_BYTES = 500_000
#: One automaton is compiled of passages of about so many words; a bucket with more has several.
SHARD_WORDS = 400_000
#: A print that a thousandth of a sample's prints has, of about so many documents, is dealt to SALTS tasks.
SAMPLE, HEAVY, SALTS = 2000, 1000, 1024


def window_prints(words: Words) -> list[tuple[np.ndarray, ...]]:
    """For each text (print, segment, first window, number of windows) of its runs of windows.

    The print of a window is the smallest of its GRAM-word hashes, the first of equal ones, so that
    equal windows have equal prints at equal places. Consecutive windows with one and the same smallest
    run form a segment, which is hashed as a whole together with the place of the print in it.
    """
    width = WINDOW - GRAM + 1
    out = []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        n = high - low - WINDOW + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2)
            continue
        spans = Spans(words.hash[low:high])
        grams = spans.all(GRAM)
        value, place, size = grams, np.arange(len(grams)), 1
        while size < width:
            step = min(size, width - size)
            left = value[:-step] <= value[step:]
            value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
            size += step
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(begin, n))
        whole = spans.some(begin, begin + count + WINDOW - 1)
        with np.errstate(over="ignore"):
            whole = whole + (place[begin] - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out.append((grams[place[begin]], whole, begin, count))
    return out


def _print(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in slices(stream):
        found = window_prints(Words([unpack.decompress(t) for t in batch.column("text").to_pylist()]))
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        print_, segment, begin, count = (np.concatenate([f[i] for f in found]) for i in range(4))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), pa.array(print_.view(np.int64)), pa.array(segment.view(np.int64)), pa.array((begin << 32) + count)], names=["key", "print", "segment", "at"])


_FOUND = pa.schema(
    [("print", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()), ("windows", pa.list_(pa.int64()))]
    + [("region_key", pa.int64()), ("region", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", pa.binary())]
)


def _examine(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted segments of a document, one of each: where they start in a region, and the regions' texts.

    A region is a run of words without a gap between wanted segments, so that words that several share
    travel once. Where a print has different segments, also the 64-bit hashes of a segment's windows; with
    the print, which equal windows share, these are names of 128 bits.
    """
    unpack, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    nothing = dict.fromkeys(_FOUND.names)

    def rows() -> Iterator[dict]:
        for row in records(stream, 32):
            words = Words([unpack.decompress(row["text"])])
            hashes = words.grams(words.hash, WINDOW)[0].view(np.int64) if any(w["many"] for w in row["wanted"]) else None
            number, first, end = -1, 0, 0
            for w in sorted(row["wanted"], key=lambda w: w["at"]):
                begin, n = w["at"] >> 32, w["at"] & 0xFFFFFFFF
                if number < 0 or begin > end:
                    if number >= 0:
                        yield nothing | {"region_key": row["key"], "region": number, "text": squeeze.compress(words.data[words.start[first] : words.end[end - 1]])}
                    number, first = number + 1, begin
                end = max(end, begin + n + WINDOW - 1) if begin > first else begin + n + WINDOW - 1
                yield nothing | {"print": w["print"], "segment": w["segment"], "copies": w["copies"], "windows": hashes[begin : begin + n] if w["many"] else None, "region_key": row["key"], "region": number, "start": begin - first, "n": n}
            yield nothing | {"region_key": row["key"], "region": number, "text": squeeze.compress(words.data[words.start[first] : words.end[end - 1]])}

    yield from batches(rows(), _FOUND, 500)


class Codes:
    """Texts as strings of two characters a word, so that automata go word by word and never match between words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> str:
        number = self.number
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
        # the two halves come from different ranges of characters
        return np.stack([0x10000 + (ids >> np.uint32(8)), 0x100 + (ids & np.uint32(255))], axis=1).astype("<u4").tobytes().decode("utf-32-le")


def locate(texts: list[str], passages: set[str]) -> list[np.ndarray]:
    """For each text, which of its words lie in an occurrence of a passage; texts and passages are coded.

    Shard by shard the passages are compiled into an automaton, through which all texts go.
    """
    steps: dict[int, np.ndarray] = {}
    for shard in _shards(sorted(passages)):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for passage in shard:
            automaton.add_word(passage)
        automaton.make_automaton()
        for i, text in enumerate(texts):
            hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
            if len(hits):
                own = steps.setdefault(i, np.zeros(len(text) // 2 + 1, np.int64))
                end = (hits[:, 0] + 1) // 2
                np.add.at(own, end - hits[:, 1] // 2, 1)
                np.add.at(own, end, -1)
    return [np.cumsum(steps[i][:-1]) > 0 if i in steps else np.zeros(0, bool) for i in range(len(texts))]


def _shards(passages: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    words = 0
    for passage in passages:
        held.append(passage)
        words += len(passage) // 2
        if words >= SHARD_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def _strip(keep_text: bool):
    """A bucket's documents streamed through the automata of the passages whose segments occur in it."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.string())] * keep_text)

    def run(docs: pa.Table, regions: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        words = [unpack.decompress(t).split() if t else [] for t in docs["text"].to_pylist()]
        code, passages = Codes(), set()
        for text, cuts in zip(regions["region_text"].to_pylist(), regions["cuts"].to_pylist(), strict=True):
            coded = code(unpack.decompress(text).split())
            passages.update(coded[2 * c["low"] : 2 * c["high"]] for c in cuts)
        texts = [code(w) for w in words] if passages else [""] * len(words)
        out = []
        for doc_id, own, covered in zip(docs["doc_id"].to_pylist(), words, locate(texts, passages), strict=True):
            kept = b" ".join(own if not covered.any() else [own[i] for i in np.flatnonzero(~covered)])
            row = {"doc_id": doc_id, "n_words": len(own), "n_removed": int(covered.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | ({"kept": kept.decode("utf-8", "surrogatepass")} if keep_text else {}))
        return pa.Table.from_pylist(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256[, kept]; a row for each row of docs.

    Each word covered by a window of WINDOW consecutive words whose sequence also starts anywhere else,
    in the same row or another, goes; words are compared unchanged, windows judged on the input. kept is
    the other words joined by one blank.

    Null, empty and short texts keep all words. Null doc_ids are rows like others; rows that are equal in
    doc_id and text repeat each other. Very long texts are searched whole. Other columns are ignored. An
    empty table gives an empty result.

    Equal windows share a print, the smallest of their GRAM-word hashes, and consecutive windows of one
    print are a segment. A segment seen twice is confirmed as a whole; where different segments share a
    print, their windows are counted by names of 128 bits, summed before the shuffle, and what lies between
    the first and the last recurring window is confirmed. A confirmed passage is one row by the name of its
    segment, with its text from one document; where else it occurs isn't kept. It goes to each bucket of
    documents that has a segment of this name; the bucket's passages are compiled into automata in shards,
    all its documents stream through them, and what these find goes. A frequent print, known from a
    sample, recurs anyway, so that its rows needn't meet in one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("key"))
    texts = stage(pack_text(rows, "doc_id", "key"))
    size = texts.agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    prints = lambda some: some.where("text is not null").select("key", "text").mapInArrow(_print, "key long, print long, segment long, at long")
    sampled = prints(texts.sample(min(1.0, SAMPLE / max(1, size.n)), 1)).groupBy("print").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    heavy = F.col("print").isin([r.print for r in sampled.where(f"n > 9 and n * {HEAVY} >= all").select("print").collect()])
    of_print, of_segment = Window.partitionBy("print", "salt"), Window.partitionBy("print", "salt", "segment")
    hits = prints(texts).withColumn("salt", F.when(heavy, F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0))
    hits = hits.withColumn("copies", F.count("*").over(of_segment)).withColumn("n", F.row_number().over(of_segment.orderBy("key", "at")))
    hits = hits.withColumn("c", F.count("*").over(of_print)).where((F.col("c") > 1) | heavy)
    bucket = F.pmod(F.xxhash64("key"), F.lit(1 + (size.bytes or 0) // BUCKET_BYTES)).alias("bucket")
    # of the rows of a segment the first tells where its text is to be had, the others only in which bucket it occurs
    one = F.when(F.col("n") == 1, F.struct("key", "at")).alias("of")
    hits = stage(hits.select(bucket, "print", "segment", "copies", one, ((F.col("c") > F.col("copies")) | heavy).alias("many")))
    chosen = hits.where("of is not null").groupBy("print", "segment").agg(F.min("of").alias("of"), F.sum("copies").alias("copies"), F.max("many").alias("many"))
    chosen = chosen.where("many or copies > 1")
    wanted = chosen.groupBy("of.key").agg(F.collect_list(F.struct("print", "segment", "copies", "many", "of.at")).alias("wanted"))
    examined = texts.join(wanted.hint("merge"), "key").select("key", "text", "wanted").mapInArrow(_examine, "print long, segment long, copies long, windows array<long>, region_key long, region long, start long, n long, text binary")
    examined = stage(examined)
    segments, name = examined.where("text is null"), ["print", "segment"]
    windows = segments.where("windows is not null").select(*name, "copies", F.posexplode("windows").alias("at", "window"))
    again = windows.groupBy("print", "window").agg(F.sum("copies").alias("c")).where("c > 1").select("print", "window")
    # a segment's windows share a run of words, so that what they cover has no gap
    part = windows.where("copies = 1").join(again.hint("merge"), ["print", "window"]).groupBy(*name).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    confirmed = segments.where("copies > 1").select(*name, "region_key", "region", "start", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    confirmed = confirmed.unionByName(segments.where("copies = 1").select(*name, "region_key", "region", "start").join(part.hint("merge"), name))
    cut = F.struct((F.col("start") + F.col("first")).alias("low"), (F.col("start") + F.col("last") + WINDOW).alias("high"))
    here = hits.select("bucket", *name).distinct().join(confirmed.select(*name, "region_key", "region", cut.alias("cut")).hint("merge"), name)
    here = here.groupBy("bucket", "region_key", "region").agg(F.collect_set("cut").alias("cuts"))
    regions = examined.where("text is not null").select("region_key", "region", F.col("text").alias("region_text"))
    passages = here.join(regions.hint("merge"), ["region_key", "region"]).select("bucket", "region_text", "cuts")
    out = texts.select("doc_id", "key", "text", bucket).groupBy("bucket").cogroup(passages.groupBy("bucket"))
    return out.applyInArrow(_strip(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
