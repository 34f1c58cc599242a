"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import mix, slices
from trackloom.llm.quality import held_out

#: Letter trigrams are hashed into so many buckets.
BUCKETS = 1 << 16
#: Every value of lang is learned. The model has at most so many cells, 256 MB on the driver and 128 MB sent to tasks:
#: with more than 512 languages buckets are folded into fewer, LEAST_BUCKETS at the least.
CELLS, LEAST_BUCKETS = 1 << 25, 256
SMOOTH = 0.05
#: Tasks pass on their counts when they hold so many languages.
HELD = 128
#: Expectation-maximisation ends when no share changes by this much, at the latest after STEPS steps; a share below GONE is dropped.
SETTLED, STEPS, GONE = 1e-3, 100, 1e-4
#: A further language must raise twice the log-likelihood by PENALTY * ln(number of trigrams), as trigrams overlap.
PENALTY = 4.0
#: A language of a mixture has at least this share.
LEAST_SHARE = 0.03
#: Texts are cut into trigrams in pieces of so many characters; longer ones are reduced to bucket counts.
PIECE = 1 << 18
#: Texts looked at together, and the languages up to which they are.
TOGETHER, MANY = 24, 64


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def _trigrams(piece: str) -> np.ndarray:
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        is_letter[high] = [chr(c).isalpha() for c in codes[high]]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    # one blank for each run of other characters, one at either end
    keep = is_letter | np.concatenate([[False], is_letter[:-1]])
    kept = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
    kept = np.concatenate([[np.uint64(32)], kept, [np.uint64(32)] * 2])
    every = mix(kept[:-2] | (kept[1:-1] << np.uint64(21)) | (kept[2:] << np.uint64(42)))
    blank = kept == 32
    inside = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    return (every[inside] % np.uint64(BUCKETS)).astype(np.int64)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Buckets of the letter trigrams of a lower-cased text, with counts if it is long; none without letters."""
    text = (text or "").lower()
    if len(text) <= PIECE:
        return _trigrams(text), None
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(text), PIECE):
        counts += np.bincount(_trigrams(text[i : i + PIECE]), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    return some, counts[some]


def _count(buckets: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(found[some])], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in slices(stream):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                at, times = trigrams(text)
                own = counts.setdefault(lang, np.zeros(buckets, np.int64))
                own += np.bincount(at % buckets, weights=times, minlength=buckets).astype(np.int64)
            if len(counts) > HELD:
                yield from passed_on()
        yield from passed_on()

    return run


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and P(trigram | language) from docs(text, lang): rows with a null lang or text are left out.

    However rare, a value of lang that has a text is a language. The model is bounded by CELLS, not by
    the languages: its buckets are a power of two with buckets * languages <= CELLS. More than CELLS /
    LEAST_BUCKETS different values, 131,072, are no languages: an error. Each task returns counts by
    bucket, which Spark adds up; the driver gets at most CELLS rows.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    most = CELLS // LEAST_BUCKETS
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"lang has more than {most} different values")
    buckets = min(BUCKETS, 1 << ((CELLS // max(1, len(langs))).bit_length() - 1))
    counts = rows.mapInArrow(_count(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    model = np.zeros((buckets, len(langs)))
    place = pa.array(langs, pa.string())
    model[counts["bucket"].to_numpy(), pc.index_in(counts["lang"].combine_chunks(), value_set=place).to_numpy(zero_copy_only=False)] = counts["n"].to_numpy()
    model += SMOOTH
    model /= model.sum(axis=0)
    return langs, model


def _maximise(p: np.ndarray, times: np.ndarray, enough: float | None = None) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over one text: shares of the languages and the log-likelihood.

    With `enough` it ends as soon as no shares at all can reach that log-likelihood: the likelihood is
    concave in the shares, so that at most total * log(largest factor) is missing from its maximum.
    """
    total, live = times.sum(), np.arange(p.shape[1])
    share = np.full(len(live), 1 / len(live))
    for _ in range(STEPS):
        drawn = p[:, live] @ share
        factor = (times / drawn) @ p[:, live] / total
        if enough is not None and times @ np.log(drawn) + total * np.log(max(1.0, factor.max())) <= enough:
            break
        moved = np.abs(share * factor - share).max()
        share = share * factor
        live, share = live[share >= GONE], share[share >= GONE]
        if moved < SETTLED:
            break
    share = share / share.sum()
    every = np.zeros(p.shape[1])
    every[live] = share
    return every, float(times @ np.log(p[:, live] @ share))


def _languages(at: np.ndarray, times: np.ndarray, model: np.ndarray, alone: np.ndarray, price: float) -> list[tuple[int, float]]:
    """The set of languages of one text, grown while a further one pays its price, with their shares."""
    at, place = np.unique(at, return_inverse=True)
    times = np.bincount(place, weights=times)
    p = model[at].astype(np.float64)
    chosen, reached, shares = [int(alone.argmax())], float(alone.max()), np.ones(1)
    share, best = _maximise(p, times, reached + price / 2)
    # no set does better than all languages together
    for lang in np.argsort(-share, kind="stable").tolist():
        if 2 * (best - reached) <= price or share[lang] < LEAST_SHARE:
            break
        if lang in chosen:
            continue
        trial = [*chosen, lang]
        s, like = _maximise(p[:, trial], times)
        if 2 * (like - reached) > price and s.min() >= LEAST_SHARE:
            chosen, reached, shares = trial, like, s
    return list(zip(chosen, shares.tolist(), strict=True))


def _folded(at: np.ndarray, times: np.ndarray | None, model: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Buckets of the model's size; with many languages each bucket once, as each takes a row of the model."""
    at = at % model.shape[0]
    if model.shape[1] <= MANY:
        return at, times
    some, place = np.unique(at, return_inverse=True)
    return some, np.bincount(place, weights=times, minlength=len(some))


def mixtures(texts: list[str | None], model: np.ndarray) -> list[list[tuple[int, float]]]:
    """For each text its languages with their shares, largest first; none without letters.

    A text for which one language alone is within the price of the best mixture, by the bound of
    _maximise at that language's share of 1, is settled without any step.
    """
    found = [_folded(*trigrams(t), model) for t in texts]
    some = [i for i, (at, _) in enumerate(found) if len(at)]
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    if not some or not model.shape[1]:
        return out
    sizes = np.array([len(found[i][0]) for i in some])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate([found[i][0] for i in some])
    times = np.concatenate([np.ones(len(found[i][0])) if found[i][1] is None else found[i][1] for i in some]).astype(np.float32)
    p = model[every]
    # sums over a text in float64, as float32 would lose what short and long texts differ by
    alone = np.add.reduceat(np.log(p) * times[:, None], first, dtype=np.float64)
    total = np.add.reduceat(times, first, dtype=np.float64)
    price = PENALTY * np.log(total)
    top = alone.argmax(axis=1)
    ratio = p / p[np.arange(len(p)), np.repeat(top, sizes)][:, None]
    factor = np.add.reduceat(ratio * times[:, None], first, dtype=np.float64).max(axis=1) / total
    settled = 2 * total * np.log(np.maximum(1.0, factor)) <= price
    for k, i in enumerate(some):
        if settled[k]:
            out[i] = [(int(top[k]), 1.0)]
            continue
        rows = slice(first[k], first[k] + sizes[k])
        out[i] = sorted(_languages(every[rows], times[rows], model, alone[k], price[k]), key=lambda x: (-x[1], x[0]))
    return out


def _infer(model, keep: list[str]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = model.value
        for batch in slices(stream, TOGETHER if p.shape[1] <= MANY else 1):
            found = mixtures(batch.column("text").to_pylist(), p)
            arrays = [
                pa.array([langs[m[0][0]] if m else "und" for m in found], pa.string()),
                pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64()),
                pa.array([[(langs[x], s) for x, s in m] for m in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], names=[*keep, "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score, languages with their shares."""
    held = docs.sparkSession.sparkContext.broadcast((langs, model.astype(np.float32)))
    return docs.mapInArrow(_infer(held, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double, languages map<string,double>")


def predict_languages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, languages; a row for each row of docs.

    The model learns from rows with a lang that aren't held out, every value of it; a prediction sees the
    text alone.
    A text is a mixture of languages that draw its letter trigrams: expectation-maximisation gives each
    language's share, and the set of languages grows while a further one pays its penalty.
    lang_pred is the language with the largest share, score that share.

    Null, empty and letterless texts and all texts without learned languages: `und`, score 0. A null
    doc_id is held out. Repeated rows are predicted each. Ties go to the language first by name.
    Very long texts are read whole in pieces. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", held_out().alias("held_out"))
    langs, model = train(rows.where("not held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), langs, model)
