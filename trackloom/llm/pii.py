"""Personal data: fixed patterns seed a bootstrapped, contextual extraction."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import batches, cut, records, stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
#: A context is trusted for a kind with so many different entities that are sure to be of it, and this trust.
LEAST_SEEDS, LEAST_SHARE = 5, 0.8
#: What an unknown entity of the kind's shape counts against a context; one of another kind or shape counts 1.
DOUBT = 0.1
#: Shapes that so large a share of a kind's seeds has are the kind's.
SHAPE_SHARE = 0.05

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a run of digits whose first digit doesn't begin one, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What may be an identifier: a word of LEAST_CHARS characters or more with a digit or an at sign, outer punctuation aside.
LEAST_CHARS = 5
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_OUTER = ".,;:!?()[]{}<>\"'"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards: linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base matches by start, then kind; ends are exclusive."""
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in _emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _context(side: str, words: list[str]) -> int | None:
    """A lexical pattern: the two words before or after, lower-cased, digits alike."""
    words = [re.sub("[0-9]", "0", w.strip(_OUTER).lower()) for w in words]
    if len(words) < 2 or not all(words):
        return None
    return xxhash.xxh64_intdigest(f"{side}\x00{words[0]}\x00{words[1]}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _shape(entity: str) -> str:
    """A coarse shape: with an at sign, dotted numbers, digits alone (by thirds of a dozen), or with letters."""
    if "@" in entity:
        return "at"
    digits = len(_DIGITS.findall(entity))
    if any(c.isalpha() for c in entity):
        return "letters"
    return "dotted" if entity.count(".") == 3 else f"digits{min(4, digits // 4)}"


def _mentions(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Base entities and other words that look like identifiers, with their contexts and shapes."""
    if not base and "@" not in text and not _DIGITS.search(text):
        return []
    spots = [(s, e, k) for s, e, k in base]
    taken, i = sorted(spots), 0
    for m in _TOKEN.finditer(text):
        word = m[0].strip(_OUTER)
        start = m.start() + m[0].find(word) if word else m.start()
        end = start + len(word)
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if len(word) >= LEAST_CHARS and not (i < len(taken) and taken[i][0] < end):
            spots.append((start, end, None))
    words = [m.span() for m in _WORD.finditer(text)] if spots else []
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    out = []
    for s, e, kind in spots:
        # the whole words before and after, and what stands before or after it in its own word
        j = bisect_right(ends, s)
        before = [text[a:b] for a, b in words[max(0, j - 2) : j]] + ([text[starts[j] : s]] if j < len(words) and text[starts[j] : s].strip(_OUTER) else [])
        j = bisect_left(starts, e)
        after = ([text[e : ends[j - 1]]] if j and text[e : ends[j - 1]].strip(_OUTER) else []) + [text[a:b] for a, b in words[j : j + 2]]
        contexts = [c for c in (_context("L", before[-2:]), _context("R", after[:2])) if c is not None]
        if contexts:
            entity = xxhash.xxh64_intdigest(text[s:e].lower().encode("utf-8", "surrogatepass")) - (1 << 63)
            out.append({"start": s, "end": e, "kind": kind, "entity": entity, "shape": _shape(text[s:e]), "contexts": contexts})
    return out


_SPAN = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]
_FOUND = pa.schema(
    [("row_id", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("base", pa.list_(pa.struct(_SPAN))), ("mentions", pa.list_(pa.struct([*_SPAN, ("entity", pa.int64()), ("shape", pa.string()), ("contexts", pa.list_(pa.int64()))])))]
)
_SPARK_SPAN = "start:long,`end`:long,kind:string"


def _find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for row in records(stream):
            text = row["text"] or ""
            base = base_spans(text)
            yield {
                "row_id": row["row_id"], "doc_id": row["doc_id"], "text_hash": row["text_hash"], "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                "base": [{"start": s, "end": e, "kind": k} for s, e, k in base], "mentions": _mentions(text, base),
            } | {f"n_{k}": sum(x[2] == k for x in base) for k in KINDS}

    yield from batches(rows(), _FOUND, 1000)


def trusted_contexts(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(context, entity, shape), seeds(entity, kind, shape) -> trusted (context, kind, trust) and (entity, kind, score).

    A seed's score is 1. A context's trust for a kind is the sum of the scores of its different entities
    of that kind by the number of all its entities, of which unknown ones count DOUBT each if their shape
    is one of the kind's; it needs LEAST_SEEDS entities that score LEAST_SHARE or more, seeds or not. An
    unknown entity of a fitting shape scores the noisy-or of the trusted contexts in which it stands. The
    two are computed in turn ROUNDS times, so that what one round finds vouches for further contexts in
    the next. All sums are combined before the shuffle.
    """
    edges = cut(edges.distinct())
    sizes = edges.groupBy("context").agg(F.count("*").alias("n"))
    of_kind = seeds.distinct().groupBy("kind", "shape").agg(F.count("*").alias("n"))
    shapes = of_kind.withColumn("all", F.sum("n").over(Window.partitionBy("kind"))).where(F.col("n") >= SHAPE_SHARE * F.col("all")).select("kind", "shape")
    # four kinds with at most 1 / SHAPE_SHARE shapes each: the bound of the broadcast
    shapes = F.broadcast(cut(shapes))
    seeds = cut(seeds.select("entity", "kind").distinct().withColumn("score", F.lit(1.0)))
    scores, contexts = seeds, None
    for _ in range(ROUNDS):
        sure = scores.where(F.col("score") >= LEAST_SHARE)
        held = edges.join(sure, "entity").groupBy("context", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("sure")).where(F.col("sure") >= LEAST_SEEDS)
        unknown = edges.join(sure.select("entity").distinct(), "entity", "left_anti").join(shapes, "shape").groupBy("context", "kind").agg(F.count("*").alias("unknown"))
        held = held.join(sizes, "context").join(unknown, ["context", "kind"], "left")
        held = held.withColumn("trust", F.col("sum") / (F.col("n") - (1 - DOUBT) * F.coalesce("unknown", F.lit(0)) + 0.5))
        contexts = cut(held.where(F.col("trust") >= LEAST_SHARE).select("context", "kind", "trust"))
        more = edges.join(contexts, "context").join(shapes, ["kind", "shape"]).groupBy("entity", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("score"))
        scores = cut(seeds.unionByName(more).groupBy("entity", "kind").agg(F.max("score").alias("score")))
    return contexts, scores


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found, text_hash.

    The n_ columns and base_sha256 describe the base matches. spans has all spans, base and discovered,
    as kind:start:end in code points; found has them as an array of (start, end, kind).

    The two words before and the two after a base match are patterns; a pattern that different entities of
    one kind share, and hardly any of another kind or shape, is trusted, and the other identifier-like
    words of fitting shape in trusted patterns are reported under that kind. These vouch for further
    patterns in turn. A word looks like an identifier if it has a digit or an at sign and LEAST_CHARS
    characters or more, outer punctuation aside. Ties between kinds go to the higher score, then the
    first by name.

    A null text is empty: no spans and the digest of the empty string. Null doc_ids and repeated rows
    come out once for each row. Very long texts are searched whole. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    schema = f"row_id long, doc_id long, text_hash long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base array<struct<{_SPARK_SPAN}>>, mentions array<struct<{_SPARK_SPAN},entity:long,shape:string,contexts:array<long>>>"
    found = stage(rows.mapInArrow(_find, schema))
    mentions = found.select("row_id", F.explode("mentions").alias("m")).select("row_id", "m.*")
    edges = mentions.select("entity", "shape", F.explode("contexts").alias("context"))
    contexts, scores = trusted_contexts(edges, mentions.where("kind is not null").select("entity", "kind", "shape"))
    rest = mentions.where("kind is null").select("row_id", "start", "end", "entity", F.explode("contexts").alias("context"))
    new = rest.join(contexts, "context").groupBy("row_id", "start", "end", "entity", "kind").agg(F.max("trust").alias("trust"))
    new = new.join(scores, ["entity", "kind"]).where(F.col("score") >= LEAST_SHARE)
    # one kind for each word: the surest, then the first by name
    best = new.groupBy("row_id", "start", "end").agg(F.min(F.struct(-F.col("score"), F.col("kind")))["kind"].alias("kind"))
    added = best.groupBy("row_id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    out = found.drop("mentions").join(added, "row_id", "left")
    order = F.expr("transform(array_sort(transform(concat(base, coalesce(added, array())), s -> struct(s.start, array_position(array('email','ip','card','phone'), s.kind) AS rank, s.`end`, s.kind))), s -> struct(s.start, s.`end`, s.kind))")
    out = out.withColumn("found", order).withColumn("spans", F.expr("array_join(transform(found, s -> concat_ws(':', s.kind, s.start, s.`end`)), ',')"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found", "text_hash")


def _redact(columns: list[str], spans_in: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_in).to_pylist(), strict=True):
                parts, done = [], 0
                for span in spans or ():
                    if span["end"] > done:
                        if span["start"] >= done:
                            parts += [text[done : span["start"]], f"<{span['kind'].upper()}>"]
                        done = span["end"]  # what of a later span juts out goes with the earlier one
                texts.append(text if not spans else "".join([*parts, text[done:]]))
            arrays = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal_data replaced by its kind in angle brackets; n_chars, if there, follows.

    Overlapping spans are replaced together, by the kind of the first. Rows keep their columns, whatever
    these are called; a null text stays null, null doc_ids and repeated rows are redacted like others, very
    long texts whole. An empty table gives an empty result.
    """
    # names that docs doesn't have
    own = [f"_{i}" for i in range(len(docs.columns) + 3) if f"_{i}" not in docs.columns][:3]
    of, hash_, spans = own
    found = personal_data(docs.select("doc_id", "text")).where("spans <> ''").select(F.col("doc_id").alias(of), F.col("text_hash").alias(hash_), F.col("found").alias(spans)).dropDuplicates([of, hash_])
    rows = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(hash_)), "left")
    types = ", ".join(f"`{f.name}` {'bigint' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    return rows.select(*docs.columns, spans).mapInArrow(_redact(docs.columns, spans), types)
