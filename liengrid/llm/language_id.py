"""Language of whole texts by a string kernel.

The kernel of two texts is the number of byte n-grams, n = 1 to 4 together, that are present in both,
over the root of the product of their numbers: a blended-spectrum presence kernel. Landmark texts
carry it to finite dimension (Nystrom), and a ridge regression per language against the rest is solved
there. As the kernel is a product of presence vectors, landmarks and coefficients multiply out
to one weight per n-gram slot and language, and a block of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from liengrid.llm import texts

MAX_GRAM = 4
SLOTS = 1 << 14
PER_LANGUAGE = 200
MOST_ROWS = 4_000
DRAWS = 64
LANDMARKS = 256
RIDGE = 1e-3
UNDETERMINED = "und"
BLOCK = 256

_PLAIN = texts.LOWER.copy()
_PLAIN[:128][~texts.LETTER[:128]] = 0x20
_FACTOR = np.uint32(0x9E3779B1)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-gram slots each text has: A-Z lower-cased, other ASCII than letters as space."""
    data = _PLAIN[data].astype(np.uint32)
    rows = len(offsets) - 1
    found = np.zeros(rows * SLOTS, np.uint8)
    base = np.repeat(np.arange(rows, dtype=np.int64) * SLOTS, np.diff(offsets))
    code = np.zeros(len(data), np.uint32)
    for n in range(1, min(MAX_GRAM, len(data)) + 1):
        code = code[: len(data) - n + 1] | (data[n - 1 :] << np.uint32(8 * (n - 1)))
        slot = ((code ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _FACTOR) >> np.uint32(18)
        inside = base[: len(code)] == base[n - 1 :]
        found[(base[: len(code)] + slot)[inside]] = 1
    return found.reshape(rows, SLOTS)


@dataclass
class LanguageModel:
    """weights: per n-gram slot and language, for the dot product with a presence vector."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Regression value of each text and language."""
        result = np.zeros((len(offsets) - 1, len(self.languages)), np.float32)
        for first in range(0, len(offsets) - 1, BLOCK):
            last = min(first + BLOCK, len(offsets) - 1)
            have = presence(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            size = np.maximum(have.sum(axis=1, dtype=np.int64), 1)
            result[first:last] = (have.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None]
        return result


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The presence vectors of whole texts, a bit per slot."""
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            for start in range(0, last - first, BLOCK):
                end = min(start + BLOCK, last - first)
                have = presence(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                part = batch.slice(first + start, end - start)
                bits = pa.array([row.tobytes() for row in np.packbits(have, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("lang"), bits], names=_SAMPLE)


_SAMPLE = ["place", "lang", "bits"]


def learning_rows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A bounded sample of (text, lang), as place, lang and the bits of the whole text's presence vector.

    The per_language distinct texts with the least hashes of each language, at most MOST_ROWS in all, language
    by language in turn. Only hashes are drawn, in two levels: of each language DRAWS tasks draw from
    what their input tasks drew, and one draws from theirs. The texts stay where they are.
    """
    source = labelled.selectExpr("cast(text as string) as text", "cast(lang as string) as lang")
    source = source.where("lang is not null and lang <> '' and length(trim(text)) > 0")
    draws = source.selectExpr("lang", "xxhash64(text) as draw").distinct()
    for level in (["lang", "task"], ["lang"]):
        order = Window.partitionBy(*level).orderBy("draw")
        draws = draws.withColumn("task", F.spark_partition_id() % DRAWS) if "task" in level else draws
        draws = draws.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    chosen = draws.orderBy("place", "lang").limit(MOST_ROWS).selectExpr("lang as its_lang", "draw", "place")
    # At most MOST_ROWS rows go to the texts, wherever these lie.
    found = source.join(F.broadcast(chosen), F.expr("lang = its_lang and xxhash64(text) = draw"))
    rows = found.select("place", "lang", "text").mapInArrow(_presence_rows, "place int, lang string, bits binary")
    return rows.groupBy("place", "lang").agg(F.min("bits").alias("bits")).orderBy("place", "lang")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from rows (text, lang); the sample has at most MOST_ROWS rows, fitted on the driver.

    Rows without a language or text are left out; of an empty table nothing is learnt.
    """
    sample = learning_rows(labelled, per_language).toArrow()
    languages = sorted(set(sample["lang"].to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    bits = np.frombuffer(b"".join(sample["bits"].to_pylist()), np.uint8).reshape(-1, SLOTS // 8)
    have = np.unpackbits(bits, axis=1).astype(np.float32)
    have /= np.sqrt(np.maximum(have.sum(axis=1), 1))[:, None]
    target = np.array([[float(lang == other) for other in languages] for lang in sample["lang"].to_pylist()])
    # The sample comes language by language in turn, so its first rows are spread over the languages.
    landmarks = have[:LANDMARKS]
    kernel = (have @ landmarks.T).astype(np.float64)
    inner = (landmarks @ landmarks.T).astype(np.float64)
    system = kernel.T @ kernel + RIDGE * len(have) * (inner + 1e-6 * np.eye(len(landmarks)))
    coefficients = np.linalg.solve(system, kernel.T @ target)
    return LanguageModel(languages, (landmarks.T @ coefficients).astype(np.float32))


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of documents, with lang_pred and score (0 to 1) from the whole text.

    lang_pred is a learnt language, or und, with score 0, for a null text, one without a letter, or a
    model that has learnt nothing. Ties go to the language that sorts first. Rows are judged each by
    itself, very long ones in whole. Columns of documents named lang_pred or score, in any case, are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: LanguageModel = shared.value
        for batch in batches:
            for first, last, data, offsets in texts.text_slices(batch.column("text")):
                part = batch.slice(first, last - first)
                values = learnt.scores(data, offsets)
                lettered = np.zeros(len(data) + 1, np.int64)
                np.cumsum(texts.LETTER[data] & (data < 128), out=lettered[1:])
                sure = (lettered[offsets[1:]] > lettered[offsets[:-1]]).tolist()
                names, scores = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    if not learnt.languages or not (sure[i] or _has_letter(text or "")):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(values[i].argmax())
                        names.append(learnt.languages[best])
                        scores.append(float(np.clip(values[i, best], 0, 1)))
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*kept, "lang_pred", "score"],
                )

    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    source = documents.select(*[F.col(f"`{c}`") for c in kept]).withColumn("text", F.col("text").cast("string"))
    made = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return source.mapInArrow(predict, StructType([*source.schema.fields, *made.fields]))
