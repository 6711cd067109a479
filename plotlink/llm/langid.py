"""Language identification with hyperdimensional profiles.

Every letter class has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its
letters, permuted by their place; a document's vector bundles (adds) its trigrams'; a language's prototype bundles
the trigrams of all its learning documents. A document gets the language whose prototype has the largest cosine.

Letters are lower-cased and put into 127 classes: a-z alone, all others by a hash of the code point; whatever is not
a letter is one boundary mark. So there are 2^21 trigrams at most, which bounds the profile table whatever the input.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common, textkernel

DIMENSIONS = 1024
SEED = 20240229
CLASS_BITS = 7
#: Letters whose trigrams are bundled in one step, bytes of text that are cut into trigrams at once, and trigrams whose vectors
#: are made at once. The peak of a task's memory is set by these (a longer text is cut at once, some 60 bytes a letter).
STEP_LETTERS, STEP_ROWS = 1 << 20, 512
CUT_BYTES, VECTORS = 1 << 19, 2048
#: Trigrams by language that a task counts before their vectors are bundled.
COUNTS = 1 << 16
UNDETERMINED = "und"
#: Cosine below which no language is told: this share of this quantile, in length classes with so many labelled documents.
SLACK, LOW_QUANTILE, CLASS_ROWS = 0.5, 0.01, 50
#: Steps in which cosines are counted for the bound.
SCORE_BINS = 10_000


@functools.cache
def _classes() -> np.ndarray:
    """Letter class of every code point; 0 for what is not a letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + int(textkernel.mix64(np.array([low], np.uint64))[0] % np.uint64(101)) if low > 0x24F else 27 + low * 40503 % 101
    return out


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the letter classes at the first, second and third place of a trigram."""
    base = np.random.RandomState(SEED).choice(np.array([-1, 1], np.int8), (1 << CLASS_BITS, DIMENSIONS))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    mask = (1 << CLASS_BITS) - 1
    out = first[codes >> 2 * CLASS_BITS]
    out *= second[(codes >> CLASS_BITS) & mask]
    out *= third[codes & mask]
    return out.astype(np.float32)


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, trigram codes, their rows): one trigram around each letter of the whole text."""
    for at, to, raw, offsets in textkernel.pieces(column, CUT_BYTES):
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])[offsets]
        rows = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(begins))
        marks = np.zeros(len(points) + (to - at) + 1, np.int32)  # a boundary before every row and after the last
        places = np.arange(1, len(points) + 1, dtype=np.int32) + rows
        marks[places] = _classes()[points]
        owner = np.full(len(marks), -1, np.int32)
        owner[places] = rows
        del points, places, rows
        keep = marks > 0
        keep[1:] |= marks[:-1] > 0
        keep[0] = True
        marks, owner = marks[keep], owner[keep]
        mid = np.flatnonzero(marks)
        ends = np.append(marks, 0)
        yield at, to, (ends[mid - 1] << 2 * CLASS_BITS) | (ends[mid] << CLASS_BITS) | ends[mid + 1], owner[mid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams by language with their number, over all batches; with more than COUNTS of them, a trigram may come again."""
    names: dict[str, int] = {}
    total: dict[int, int] = {}

    def counted() -> pa.RecordBatch:
        keys = np.fromiter(total, np.int64, len(total))
        langs = pa.array(list(names), pa.string()).take(pa.array(keys >> 3 * CLASS_BITS))
        return pa.RecordBatch.from_arrays([langs, pa.array((keys & ((1 << 3 * CLASS_BITS) - 1)).astype(np.int32)), pa.array(list(total.values()), pa.int64())], names=["lang", "code", "n"])

    for batch in batches:
        which = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
        for at, _, codes, rows in trigrams(batch.column(1)):
            keys, n = np.unique((which[at + rows] << 3 * CLASS_BITS) | codes, return_counts=True)
            for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + c
            if len(total) >= COUNTS:
                yield counted()
                total.clear()
    if total:
        yield counted()


def _sums(langs: list[str], vectors: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.arange(len(langs) + 1, dtype=np.int32) * DIMENSIONS
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.ListArray.from_arrays(ends, np.concatenate(vectors))], names=["lang", "vector"])


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch for each language of a batch: the sum of its trigrams' vectors, each as often as it was counted."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        places = langs.indices.to_numpy()
        order = np.argsort(places, kind="stable")
        ends = np.searchsorted(places[order], np.arange(len(langs.dictionary) + 1))
        codes, n = batch.column(1).to_numpy()[order], batch.column(2).to_numpy()[order].astype(np.float64)
        for lang, low, high in zip(langs.dictionary.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            parts = [slice(at, min(at + VECTORS, high)) for at in range(low, high, VECTORS)]
            yield _sums([lang], [sum(n[part] @ trigram_vectors(codes[part]) for part in parts)])


def _total(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Vectors summed by language, STEP_ROWS of them in a batch; with most, at most so many are held and a language may come again."""
    sums: dict[str, np.ndarray] = {}

    def summed() -> Iterator[pa.RecordBatch]:
        langs = sorted(sums)
        for at in range(0, len(langs), STEP_ROWS):
            part = langs[at : at + STEP_ROWS]
            yield _sums(part, [sums.pop(x) for x in part])

    for batch in batches:
        for lang, vector in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS), strict=True):
            sums[lang] = sums[lang] + vector if lang in sums else vector.copy()
            if most and len(sums) >= most:
                yield from summed()
    yield from summed()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _total(_bundle(_count(batches)), STEP_ROWS)


def profiles(labelled: DataFrame) -> DataFrame:
    """lang and vector: the sum of the vectors of all trigrams of all rows (lang, text) whose lang is not null.

    A task sums its own rows, so what is shuffled is a vector a language and task, and the task that adds a language's vectors
    up reads one from each. Sums are of whole numbers and exact in any order. No Spark aggregate takes part: each of
    its tasks would take a page of tens of MB for a few rows, and with many shuffle partitions these make the heap grow.
    """
    texts = labelled.where("lang is not null").select("lang", F.make_valid_utf8("text").alias("text"))
    parts = texts.mapInArrow(_profile, "lang string, vector array<double>")
    return parts.repartition("lang").mapInArrow(_total, "lang string, vector array<double>")


def learn(labelled: DataFrame) -> dict[str, list[float]]:
    """Prototypes by language, from all rows (lang, text) whose lang is not null; only one vector a language comes to the driver."""
    return {r.lang: r.vector for r in profiles(labelled).collect()}


def _scorer(prototypes: dict[str, list[float]]):
    """(languages in order, function of a column of texts: place of the best one or -1, its cosine)."""
    langs = sorted(prototypes)
    table = np.array([prototypes[x] for x in langs], np.float64).reshape(len(langs), DIMENSIONS)
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full(len(column), -1), np.zeros(len(column))
        for at, to, codes, rows in trigrams(column):
            row_ends = np.searchsorted(rows, np.arange(to - at + 1))
            low = 0
            while low < to - at and langs:
                high = max(low + 1, min(low + STEP_ROWS, int(np.searchsorted(row_ends, row_ends[low] + STEP_LETTERS, side="right")) - 1))
                part = slice(row_ends[low], row_ends[high])
                seen, where = np.unique(codes[part], return_inverse=True)
                if len(seen):
                    documents = np.zeros((high - low, DIMENSIONS), np.float32)
                    for c in range(0, len(seen), VECTORS):
                        inside = (where >= c) & (where < c + VECTORS)
                        width = min(VECTORS, len(seen) - c)
                        counts = np.bincount((rows[part][inside] - low) * width + where[inside] - c, minlength=(high - low) * width)
                        documents += counts.reshape(high - low, width).astype(np.float32) @ trigram_vectors(seen[c : c + width])
                    has = np.flatnonzero(np.diff(row_ends[low : high + 1]))
                    norm = np.maximum(np.linalg.norm(documents[has], axis=1), 1e-12)
                    cosine = documents[has] @ table.T / norm[:, None]
                    best[at + low + has], score[at + low + has] = cosine.argmax(1), np.clip(cosine.max(1), 0, 1)
                low = high
        return best, score

    return langs, score


def _predict(prototypes: dict[str, list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, rate = _scorer(prototypes)
        for batch in batches:
            best, score = rate(batch.columns[-1])
            names = [langs[b] if b >= 0 else UNDETERMINED for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, list[float]], keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the kept columns, lang_pred and score from the text alone; `und` and 0 where it has no letter."""
    keep = keep or {}
    narrow = docs.select("doc_id", *[c.alias(n) for n, c in keep.items()], F.make_valid_utf8("text").alias("text"))
    types = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1])
    return narrow.mapInArrow(_predict(prototypes), f"{types}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Learns from text and lang of documents whose crc32(doc_id) mod 4 is not 2 (a null id is never learned from and
    not held out). Null text and text without letters are `und` with score 0, and so is everything if nothing
    could be learned. Equal cosines go to the first language in order. Rows that repeat are rated each on their own, bytes that
    are not UTF-8 count as U+FFFD, which is no letter. An empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(common.utf8_bytes(F.col("doc_id").cast("string"))), F.lit(4))
    prototypes = learn(docs.where(fold != 2))
    return predict(docs, prototypes, {"held_out": F.coalesce(fold == 2, F.lit(False))})


def _rate(prototypes: dict[str, list[float]]):
    """Rows (row, ..., mended text if the row's is not valid) with their cosine in place of the last column; null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rate = _scorer(prototypes)
        for batch in batches:
            text, mended = batch.column(0).field("text"), batch.columns[-1]
            best, score = rate(text if mended.null_count == len(mended) else pc.coalesce(mended, text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, mask=best < 0)], names=[*batch.schema.names[:-1], "score"])

    return run


def length_bounds(rated: DataFrame) -> dict[int, float]:
    """Cosine that is enough, by length class, from all rows (size_class, score) whose score is not null.

    The quantile is taken of cosines rounded down to a SCORE_BINS-th, whose counts stand for all rows: at most so many a class.
    """
    counts = rated.where("score is not null").groupBy("size_class", F.floor(F.col("score") * SCORE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("size_class").agg(F.sum("n").alias("n"), F.percentile(F.col("bin") / SCORE_BINS, LOW_QUANTILE, F.col("n")).alias("low"))
    return {r.size_class: SLACK * r.low for r in found.collect() if r.n >= CLASS_ROWS}  # at most 32 classes


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """Documents for which a language was found, with all their columns; rows without an id stay.

    Learns from all labelled documents. A document goes if it has no letter, or if its cosine is below SLACK times the
    LOW_QUANTILE quantile of all labelled documents of its length class (doubling lengths). A class with fewer than
    CLASS_ROWS of them has the bound of the class below it, or none. If nothing could be learned, all documents
    stay. Each row is judged by its own text, also where rows share a doc_id. Rows are rated once and stored with their cosine.
    """
    prototypes = learn(docs)
    if not prototypes:
        return docs
    size = F.floor(F.log2(F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit("")))).cast("double"))).cast("int")
    mended = F.when(~F.is_valid_utf8("text"), F.make_valid_utf8("text"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").isNotNull().alias("has_id"), F.col("lang").isNotNull().alias("labelled"), size.alias("size_class"), mended.alias("mended"))
    rated = common.stored(rows.mapInArrow(_rate(prototypes), rows.drop("mended").withColumn("score", F.lit(None).cast("double")).schema), "language-rated")
    lows = length_bounds(rated.where("labelled"))
    bound = F.coalesce(*[F.when(F.col("size_class") >= c, F.lit(lows[c])) for c in sorted(lows, reverse=True)], F.lit(0.0))
    kept = rated.where(~F.col("has_id") | F.coalesce(F.col("score") >= bound, F.lit(False)))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
