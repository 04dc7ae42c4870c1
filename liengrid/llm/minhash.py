"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A signature has COORDINATES values of BITS bits. Two sets of similarity s differ in each
value with probability 1 - s. Pairs that differ in at most MAX_DIFFERENT values are all
found: by the pigeonhole principle, one of the CHUNKS chunks of four values has at most
MAX_DIFFERENT // CHUNKS = 1 error, so enumerating the value that may differ leaves a key of the
other three that both share. A pair at the similarity threshold 0.75 differs in 12 values on
average; it shares no key with a chance of 1 in 10 million. Of pairs that share a key, those with fewer
than LEAST_EQUAL equal values are left out, at the threshold 4 in 100 million. Each set also has PARITIES
parities: a bit says whether an odd number of its shingles falls there. Each shingle that only one of two sets has
flips one bit, so the bits that differ are no more than such shingles, of which a linked pair has few: pairs
with more are left out, and no link is lost. Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liengrid.llm import texts
from liengrid.llm.linking import linked_groups
from liengrid.sources.tables import stage

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
COORDINATES = 48
BITS = 14
CHUNK = 4
CHUNKS = COORDINATES // CHUNK
MAX_DIFFERENT = 23
LEAST_EQUAL = 19
PARITIES = 512
KEPT_VALUES = CHUNK - MAX_DIFFERENT // CHUNKS
PATTERNS = list(combinations(range(CHUNK), KEPT_VALUES))

_FACTORS = texts.constants(COORDINATES, 11)
_SETS = "doc_id long, n_shingles long, set_low long, set_high long, signature binary"


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash signatures of sets, one row of COORDINATES values of BITS bits per set; 0 for an empty set."""
    result = np.zeros((len(bounds) - 1, COORDINATES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for c, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(values * factor, bounds[full])
            result[full, c] = (texts.mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return result


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITIES bits of each set, as bytes: whether an odd number of its values falls on the bit."""
    result = np.zeros((len(bounds) - 1, PARITIES // 8), np.uint8)
    bit = (texts.mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(PARITIES - 1)).astype(np.int64)
    for first in range(0, len(result), 1024):
        part = bounds[first : first + 1025]
        at = bit[part[0] : part[-1]] + np.repeat(np.arange(len(part) - 1) * PARITIES, np.diff(part))
        counts = np.bincount(at, minlength=(len(part) - 1) * PARITIES)
        result[first : first + 1024] = np.packbits((counts & 1).astype(np.uint8).reshape(-1, PARITIES), axis=1)
    return result


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            values, bounds = texts.shingle_sets(data, offsets, k)
            total = np.zeros((2, len(values) + 1), np.uint64)
            np.cumsum(texts.mix(values), out=total[0, 1:])
            np.cumsum(texts.mix(values ^ np.uint64(0x5DEECE66D)), out=total[1, 1:])
            low, high = (total[:, bounds[1:]] - total[:, bounds[:-1]]).view(np.int64)
            rows = np.concatenate([signatures(values, bounds).view(np.uint8), parities(values, bounds)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(np.diff(bounds)),
                    pa.array(low),
                    pa.array(high),
                    pa.array([row.tobytes() for row in rows], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_low", "set_high", "signature"],
            )


def _chunk_keys(rows: np.ndarray) -> np.ndarray:
    """All keys of signatures: for each chunk and pattern the kept values, below the number of both."""
    keys = np.empty((len(rows), CHUNKS * len(PATTERNS)), np.int64)
    wide = rows.astype(np.int64)
    for c in range(CHUNKS):
        for p, kept in enumerate(PATTERNS):
            tag = c * len(PATTERNS) + p
            key = np.full(len(rows), tag, np.int64)
            for value in kept:
                key = (key << BITS) | wide[:, c * CHUNK + value]
            keys[:, tag] = key
    return keys


_SIGNATURE_BYTES = 2 * COORDINATES


def _stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and parities, the latter as longs, of stored rows."""
    raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8)
    raw = raw.reshape(-1, _SIGNATURE_BYTES + PARITIES // 8)
    rows = np.ascontiguousarray(raw[:, :_SIGNATURE_BYTES]).view(np.uint16)
    return rows, np.ascontiguousarray(raw[:, _SIGNATURE_BYTES:]).view(np.int64)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            keys = _chunk_keys(_stored(part)[0])
            ids = part.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"]
            )


# A chunk in one long: a free bit above each of its values.
_SLOT = BITS + 1
_LONGS = [*[f"s{c}" for c in range(CHUNKS)], *[f"p{c}" for c in range(PARITIES // 64)]]
_MARKS = sum(1 << (_SLOT * i + BITS) for i in range(CHUNK))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures as one long per chunk, and parities."""
    for batch in batches:
        rows, odd = _stored(batch)
        rows = rows.astype(np.int64)
        longs = [sum(rows[:, c * CHUNK + i] << (_SLOT * i) for i in range(CHUNK)) for c in range(CHUNKS)]
        longs += list(odd.T)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_shingles"), *[pa.array(values, pa.int64()) for values in longs]],
            names=["id", "n_shingles", *_LONGS],
        )


def _equal_values(c: int) -> str:
    """Number of equal values in chunk c of x and y: a mark stays where nothing is taken from it."""
    return f"bit_count(({_MARKS}L - (x.s{c} ^ y.s{c})) & {_MARKS}L)"


EQUAL = " + ".join(_equal_values(c) for c in range(CHUNKS))
FLIPPED = " + ".join(f"bit_count(x.p{c} ^ y.p{c})" for c in range(PARITIES // 64))
# A linked pair shares at least t / (1 + t) of the sum of both sizes, t being the threshold; the rest is twice over.
NEAR = (
    f"x.n_shingles * 100 >= y.n_shingles * {SIMILAR_PERCENT} and y.n_shingles * 100 >= x.n_shingles * {SIMILAR_PERCENT}"
    f" and ({FLIPPED}) * {100 + SIMILAR_PERCENT} <= (x.n_shingles + y.n_shingles) * {100 - SIMILAR_PERCENT}"
    f" and {EQUAL} >= {LEAST_EQUAL}"
)


def _first_shared() -> str:
    """Whether x.key is the first key that x and y share.

    That is in the first chunk with enough equal values; if all its values are equal, it is the
    first pattern of the chunk, else just one pattern of it is shared.
    """
    enough = " ".join(
        f"when {_equal_values(c)} >= {KEPT_VALUES} then {c * (CHUNK + 1)} + {_equal_values(c)}" for c in range(CHUNKS)
    )
    tag = f"cast(shiftright(x.key, {KEPT_VALUES * BITS}) as int)"
    chunk = f"{tag} div {len(PATTERNS)} * {CHUNK + 1}"
    whole = f"if({tag} % {len(PATTERNS)} = 0, {chunk} + {CHUNK}, -1)"
    return f"case {enough} end in ({chunk} + {KEPT_VALUES}, {whole})"


def _similar_pairs(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            keep = np.zeros(part.num_rows, bool)
            sets = []
            for column in ("text_a", "text_b"):
                mine = []
                for _, _, data, offsets in texts.text_slices(part.column(column)):
                    values, bounds = texts.shingle_sets(data, offsets, k)
                    mine += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                sets.append(mine)
            for i, (a, b) in enumerate(zip(*sets)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield part.select(["a", "b"]).filter(pa.array(keep))


def near_duplicates(
    documents: DataFrame, shingle_words: int = SHINGLE_WORDS, similar_percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """Near-duplicate groups of documents (doc_id, text), one row per row of the input.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set has its
    distinct shingles of shingle_words words (fewer words: the whole sequence). Documents with
    100 * intersection >= similar_percent * union are linked, the threshold being 75 or more.
    Returns doc_id, n_shingles, component_id (the least doc_id reachable) and kept (doc_id =
    component_id). Null or empty texts have an empty set, are linked with nothing and are
    kept. Rows that share a doc_id are one document of which each row is returned, and their
    texts all count. A null doc_id has a null component and is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    if similar_percent < SIMILAR_PERCENT:
        raise ValueError(f"the signature threshold is set for {SIMILAR_PERCENT} percent or more")
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    sets = stage(source.mapInArrow(partial(_set_rows, k=shingle_words), _SETS))
    identity = ["n_shingles", "set_low", "set_high"]
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*identity).agg({"doc_id": "min", "signature": "min"})
    classes = stage(classes.withColumnsRenamed({"min(doc_id)": "id", "min(signature)": "signature"}))
    keys = classes.select("id", "signature").mapInArrow(_key_rows, "key long, id long")
    longs = ", ".join(f"{name} long" for name in _LONGS)
    features = classes.select("id", "n_shingles", "signature").mapInArrow(
        _feature_rows, f"id long, n_shingles long, {longs}"
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        a, b = (source.selectExpr(f"doc_id as {x}", f"text as text_{x}") for x in "ab")
        with_texts = pairs.join(a, "a").join(b, "b")
        return with_texts.mapInArrow(
            partial(_similar_pairs, k=shingle_words, percent=similar_percent), "a long, b long"
        ).distinct()

    # A document whose rows have different texts is in several classes: it links them.
    members = stage(full.join(classes.drop("signature"), identity).select("doc_id", "id").distinct())
    least = members.groupBy("doc_id").agg({"id": "min"}).withColumnRenamed("min(id)", "a")
    given = members.join(least, "doc_id").where("id <> a").selectExpr("a", "id as b")
    linked = linked_groups(keys, features, NEAR, EQUAL, confirm, given, once=_first_shared())
    labels = members.join(linked, "id", "left").selectExpr("doc_id", "coalesce(component, id) as component_id")
    labels = labels.groupBy("doc_id").agg({"component_id": "min"}).withColumnRenamed("min(component_id)", "component_id")
    return sets.select("doc_id", "n_shingles").join(labels, "doc_id", "left").selectExpr(
        "doc_id",
        "n_shingles",
        "coalesce(component_id, doc_id) as component_id",
        "coalesce(coalesce(component_id, doc_id) = doc_id, true) as kept",
    )
