"""Language identification as mixture inference.

Each language is a smoothed distribution over letter trigrams, learned from labelled rows. A document is a mixture: every
word is drawn from one language, with a likelihood that is the product of its trigrams', or from a noise component that
spells at random. Expectation-maximisation estimates the proportions of all components for all documents of a batch at
once. Languages are then dropped one at a time, the weakest first, as long as the penalised likelihood (BIC: half the
logarithm of the number of words for each free proportion) does not fall.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import carried, with_row
from shoebox.llm.textkit import CHUNK_BYTES

#: Labelled documents that each language's distribution is fitted on, at most (a hash of the id chooses them).
SAMPLE_DOCS = 2000
#: Labels that a model may have; more is taken for a wrong column.
MAX_LANGUAGES = 256
BUCKETS = 1 << 16
SMOOTHING = 0.5
UNDETERMINED = "und"

_LETTER, _MARK = 2, 1


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob``: natural logarithms, BUCKETS x languages; ``noise``: the same for any trigram of random spelling."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    noise: float


@cache
def letter_table() -> np.ndarray:
    """For every code point: ``_LETTER``, ``_MARK`` (a combining mark) or 0."""
    kinds = {"L": _LETTER, "M": _MARK}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def spelled(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of consecutive lower-cased texts with about a megabyte together; nulls are empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        texts = [(t or "").lower() for t in column.slice(lo, hi - lo).to_pylist()]
        yield lo, hi, np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        lo = hi


def trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, first trigram of each word, row of each word).

    Words are runs of letters and their marks, in texts that have a letter; the trigram of a letter is it with the two before,
    with spaces in front of the word.
    """
    kind = letter_table()[points]
    lettered = np.concatenate([[0], np.cumsum(kind == _LETTER)])
    inside = (kind > 0) & np.repeat(lettered[offsets[1:]] > lettered[offsets[:-1]], np.diff(offsets))
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    first = begins[at]
    second = np.zeros(len(at), bool)
    second[1:] = first[:-1] & ~first[1:]
    value = points.astype(np.uint64)
    one, two = value[at - 1], value[at - 2]
    one[first] = 0
    two[first | second] = 0
    code = value[at] | (one << np.uint64(21)) | (two << np.uint64(42))
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(first)
    return bucket, starts, np.searchsorted(offsets, at[starts], "right") - 1


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES
) -> LanguageModel:
    """Model of the languages in ``lang_col``; rows with a null label or text, and labels without letters, teach nothing.

    ``sample_docs`` bounds the rows of each language: a hash of the id keeps about so many of them, or all if there are
    fewer. The counts that reach the driver are BUCKETS per language at most, of ``max_languages`` languages at most; more
    labels are an error.
    """
    labelled = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels in {lang_col}")
    steps = 1 << 30
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(steps, int(steps * sample_docs / n)))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(steps)) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            langs = np.array(whole.column(0).to_pylist(), object)
            for lo, hi, part, local in spelled(whole.column(1)):
                bucket, starts, row = trigrams(part, local)
                of = np.repeat(row, np.diff(np.append(starts, len(bucket)))) + lo
                for lang in set(langs[lo:hi]):
                    own = bucket[langs[of] == lang]
                    totals[lang] = totals.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(languages, rows["lang"].to_numpy(str)) if languages else []] = rows["n"]
    used = max(1, int((counts.sum(axis=1) > 0).sum()))
    log_prob = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * 4 * used))
    return LanguageModel(languages, log_prob.astype(np.float32), float(-np.log(4 * used)))


def _em(likelihood: np.ndarray, bounds: np.ndarray, row: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood relative to each word's best component) after some rounds; a row is a document with words."""
    n = np.diff(np.append(bounds, len(row)))[:, None]
    for _ in range(rounds):
        joint = likelihood * share[row]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, bounds, axis=0) / n
    total = np.log((likelihood * share[row]).sum(axis=1))
    return share, np.add.reduceat(total, bounds)


def mixtures(model: LanguageModel, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages and, last, noise, for every text; all zero for texts without letters."""
    k, n = len(model.languages), len(offsets) - 1
    out = np.zeros((n, k + 1))
    bucket, starts, row = trigrams(points, offsets)
    if not len(starts) or not k:
        return out
    score = np.add.reduceat(model.log_prob[bucket], starts, axis=0, dtype=np.float64)
    length = np.diff(np.append(starts, len(bucket)))
    score = np.concatenate([score, (length * model.noise)[:, None]], axis=1)
    likelihood = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60.0))
    docs, bounds = np.unique(row, return_index=True)
    local = np.repeat(np.arange(len(docs)), np.diff(np.append(bounds, len(row))))
    words = np.diff(np.append(bounds, len(row)))
    share, fit_now = _em(likelihood, bounds, local, np.full((len(docs), k + 1), 1 / (k + 1)), 10)
    penalty = 0.5 * np.log(words + 1)
    open_ = np.ones(len(docs), bool)
    for _ in range(k - 1):
        alive = (share[:, :k] > 0) & open_[:, None]
        weakest = np.where(alive, share[:, :k], np.inf).argmin(axis=1)
        trial = share.copy()
        candidates = alive.sum(axis=1) > 1
        trial[np.flatnonzero(candidates), weakest[candidates]] = 0
        left = trial.sum(axis=1, keepdims=True)
        candidates &= left[:, 0] > 0
        trial = np.where(candidates[:, None], trial / np.where(left > 0, left, 1), share)
        if not candidates.any():
            break
        tried, fit_then = _em(likelihood, bounds, local, trial, 3)
        open_ = candidates & (fit_then + penalty >= fit_now)
        share, fit_now = np.where(open_[:, None], tried, share), np.where(open_, fit_then, fit_now)
    out[docs] = share
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(``id_col``, lang_pred, score, noise, languages array<string>, shares array<double>), one row for each row of ``docs``.

    ``lang_pred`` is the language with the largest proportion (ties: the first in order) and ``score`` its share among
    the languages, 0 to 1; ``languages`` and ``shares`` are the chosen set, largest first; ``noise`` is the proportion of words that no
    language spells. A null text, or one without a letter, and every text under a model without languages, is ``und``
    with score 0. Repeated rows are judged each, null ids are kept, an empty table gives an empty result. With ``carry``
    the input row follows as the struct ``row``; else other columns are not carried. Only the text is read for a prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried(docs, carry))
    names = ["id", "lang_pred", "score", "noise", "languages", "shares", *["row"] * carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        languages = np.array([*fitted.languages, UNDETERMINED], object)
        k = len(fitted.languages)
        for whole in batches:
            for lo, hi, part, local in spelled(whole.column(1)):
                share = mixtures(fitted, part, local)
                total = share.sum(axis=1)
                spoken = share[:, :k]
                sums = spoken.sum(axis=1)
                best = np.where(total > 0, spoken.argmax(axis=1) if k else k, k)
                score = np.where(sums > 0, (spoken.max(axis=1) if k else 0) / np.where(sums > 0, sums, 1), 0.0)
                order = np.argsort(-spoken, axis=1, kind="stable")
                chosen = [[j for j in o if s[j] > 0] for o, s in zip(order, spoken, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(lo, hi - lo), pa.array(languages[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(share[:, k]),
                        pa.array([[languages[j] for j in c] for c in chosen], pa.list_(pa.string())), pa.array([s[c].tolist() for c, s in zip(chosen, spoken, strict=True)], pa.list_(pa.float64())),
                        *(whole.column(2).slice(lo, hi - lo) for _ in range(carry)),
                    ], names
                )

    kind = source.schema["id"].dataType.simpleString()
    schema = with_row(f"id {kind}, lang_pred string, score double, noise double, languages array<string>, shares array<double>", source)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
