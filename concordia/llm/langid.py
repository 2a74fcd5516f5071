"""Language ID with language-bitmask n-gram filters.

For every language a Bloom filter of its frequent letter n-grams; the filters share their hash
functions, and slot i of all of them is one machine word with a bit for each language (bit-sliced).
The AND of the k words of an n-gram is the set of languages that contain it.  Per language, the
popcount h over the T n-grams of a text is corrected for the filter's false-positive rate f,
(h - f T) / (1 - f), and the largest corrected count decides.

Fitting is a classifier's fit on a bounded sample of labelled rows: about ``sample_rows`` rows of each
language (all rows of smaller ones), chosen by a hash of the id, and at most ``grams`` n-grams each.
The model is then ``slots`` words per 64 languages, whatever the corpus.  Prediction reads whole texts.

Defined results: null texts and texts without a letter give ``und`` with score 0; with nothing to
learn from, every text is ``und``; a text none of whose n-grams is known gets the first language with
score 0; ties go to the language that is smallest by code points; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm._common import ship, tidy

SIZES = (3, 4)
#: Texts are worked on in parts of about so many characters: arrays of a part fit a worker's cache and memory.
PART_CHARS = 400_000
#: Predictions hold some twenty arrays of a part at once.
PREDICT_CHARS = 100_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Filters:
    languages: list[str]
    words: np.ndarray  # slots x ceil(languages / 64), uint64
    wrong: list[float]  # false-positive rate by language


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one space around and between runs; the text of each place."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    table = np.full(int(used[-1]) + 1 if len(used) else 1, 32, dtype=np.uint32)
    for c in used.tolist():
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    codes = table[codes]
    # a space at the end of each text keeps its last n-gram apart from the next text's first
    ends = np.cumsum(lengths)
    codes = np.insert(codes, ends, 32)
    owner = np.insert(owner, ends, np.arange(len(texts), dtype=np.int32))
    keep = np.ones(len(codes), bool)
    if len(codes):
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[1:] |= owner[1:] != owner[:-1]
    return codes[keep].astype(np.uint64), owner[keep]


def gram_hashes(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one text and hold a letter, and their texts."""
    found, texts = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, n * _MIX[2] & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * np.uint64(_MIX[0])
            h ^= h >> np.uint64(29)
        same = owner[:m] == owner[n - 1 :]
        found.append(h[same])
        texts.append(owner[:m][same])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(found), np.concatenate(texts)


def slots_of(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The k slots of each hash (double hashing; *slots* is a power of two)."""
    mask = np.uint64(slots - 1)
    second = (h * np.uint64(_MIX[1])) >> np.uint64(31) | np.uint64(1)
    return [((h + np.uint64(i) * second) >> np.uint64(7) & mask).astype(np.int64) for i in range(3)]


def ticket(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fit_filters(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_rows: int = 1500,
    grams: int = 20_000,
    least_share: float = 0.004,
    slots: int = 1 << 19,
) -> Filters:
    """Fit on about *sample_rows* rows of each language; n-grams of under *least_share* of them are left out."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(17)), 11) / float(2**53)).alias("u"),
    ).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    names = [r["lang"] for r in counts]
    if not names:
        return Filters([], np.zeros((slots, 1), np.uint64), [])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_rows / r["count"])))])
    sample = rows.where(F.col("u") < share[F.col("lang")]).select("lang", "text")

    def seen(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                at = 0
                while at < len(own):  # bounded working set, however long the texts
                    part, size = [], 0
                    while at < len(own) and (not part or size < PART_CHARS):
                        size += len(own[at])
                        part.append(own[at])
                        at += 1
                    h, owner = gram_hashes(*letters(part))
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    first = np.ones(len(h), bool)
                    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    grams_, n = np.unique(h[first], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams_), pa.string()), pa.array(grams_.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    df = sample.mapInArrow(tidy(seen), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # by each language's own rows: one of few rows keeps all its n-grams, however large the others are
    needed = lambda n: 1.0 if n < 50 else max(2.0, least_share * min(n, sample_rows))
    least = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(needed(r["count"])))])
    frequent = df.where(F.col("n") >= least[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got = frequent.withColumn("r", rank).where(F.col("r") <= grams).select("lang", "gram").toArrow()  # at most grams x languages
    words = np.zeros((slots, (len(names) + 63) // 64), np.uint64)
    by_lang = np.array(got.column("lang").to_pylist(), dtype=object)
    hashes = got.column("gram").to_numpy().view(np.uint64)
    wrong = []
    for i, name in enumerate(names):
        own = hashes[by_lang == name]
        for s in slots_of(own, slots):
            words[s, i // 64] |= np.uint64(1 << (i % 64))
        fill = float((words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean())
        wrong.append(fill**3)
    return Filters(names, words, wrong)


def predict(filters: Filters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text: the score is its corrected share of the n-grams."""
    n = len(texts)
    if not n:
        return [], []
    codes, owner = letters([t or "" for t in texts])
    has = np.bincount(owner[codes != 32], minlength=n) > 0
    h, owner = gram_hashes(codes, owner)
    total = np.bincount(owner, minlength=n).astype(float)
    at = slots_of(h, len(filters.words))
    best, lang = np.full(n, -1.0), np.zeros(n, np.int64)
    for w in range(filters.words.shape[1]):
        column = np.ascontiguousarray(filters.words[:, w])
        bits = column[at[0]] & column[at[1]] & column[at[2]]
        for i in range(64 * w, min(64 * w + 64, len(filters.languages))):
            hits = np.bincount(owner, weights=(bits >> np.uint64(i % 64) & np.uint64(1)).astype(np.float64), minlength=n)
            f = filters.wrong[i]
            right = np.maximum(0.0, (hits - f * total) / (1.0 - f)) if f < 1 else np.zeros(n)
            better = right > best
            best[better], lang[better] = right[better], i
    score = np.where(total > 0, np.clip(best / np.maximum(total, 1), 0, 1), 0.0)
    names = [filters.languages[k] if ok and filters.languages else "und" for k, ok in zip(lang.tolist(), has.tolist(), strict=True)]
    return names, [s if x != "und" else 0.0 for s, x in zip(score.tolist(), names, strict=True)]


def _in_parts(filters: Filters, texts: Iterable[str | None], most: int = PREDICT_CHARS) -> tuple[list[str], list[float]]:
    names, scores, part, size = [], [], [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            a, b = predict(filters, part)
            names, scores, part, size = names + a, scores + b, [], 0
        part.append(t)
        size += len(t or "")
    a, b = predict(filters, part)
    return names + a, scores + b


def identify(df: DataFrame, filters: Filters, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "lang_score") -> DataFrame:
    """*df* with the columns *lang_as* and *score_as* appended; only *text_col* is read for them."""
    names = df.columns
    if taken := {lang_as.lower(), score_as.lower()}.intersection(n.lower() for n in names):
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    at = names.index(text_col)
    model = df.sparkSession.sparkContext.broadcast(filters)  # slots x languages bits, bounded by its parameters

    def run(batches):
        for batch in batches:
            lang, score = _in_parts(model.value, (x.as_py() for x in batch.column(at)))
            arrays = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, lang_as, score_as])

    schema = T.StructType([*df.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return df.mapInArrow(tidy(run), schema)


def in_learned_language(df: DataFrame, filters: Filters, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of *df* whose text is in a language that *filters* know: not ``und``, with *least_score* at least."""
    at = df.columns.index(text_col)
    model = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            lang, score = _in_parts(model.value, (x.as_py() for x in batch.column(at)))
            yield batch.filter(pa.array([x != "und" and s >= least_score for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def detect_languages(df: DataFrame, learn: DataFrame | None = None, **fit) -> DataFrame:
    """The contract's columns for every row of *df*, learning from three of four crc32 classes of *learn*."""
    learn = df if learn is None else learn
    filters = fit_filters(learn.where(ticket("doc_id") % 4 != 2), **fit)
    out = identify(df.select("doc_id", "text"), filters)
    return out.select("doc_id", (ticket("doc_id") % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


ship(__name__)
