"""Toxicity of whole texts by a support vector machine on gapped subsequences.

The kernel of two sentences compares their subsequences of four characters, between which one
character each may be left out: every gap costs a factor, so an insult with inserted characters still
shares its subsequences with the plain one. Sentences are compared by windows of 24 bytes, which overlap
by half, so that a long sentence does not hide a short insult. Landmark windows carry the kernel to
finite dimension (Nystrom); the machine is trained there on the sentences of labelled texts. A label
says only that a text holds something toxic, so training goes in rounds: the window of each toxic
text that scores highest stands for it in the next round, and such windows become landmarks. The first
round takes the windows whose subsequences toxic texts have more often than clean ones.

The kernel is a product of hashed feature vectors, so landmarks and coefficients multiply out to one weight
per feature slot. A text scores as its highest window, by a logistic curve fitted on labelled texts
that the machine was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from liengrid.llm import texts
from liengrid.sources.tables import stage

LENGTH = 4
GAP_FACTOR = np.float32(0.6)
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
HALF = 12
ROWS_PER_LABEL = 700
DRAWS = 64
# Windows of a text that are learnt: those that stand out most in the first guess, and drawn ones.
TELLING_WINDOWS = 32
DRAWN_WINDOWS = 32
LANDMARKS = 384
ROUNDS = 2
COST = 1.0
THRESHOLD = 0.3

_STEPS = list(product((1, 2), repeat=LENGTH - 1))
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def sentence_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where sentences begin: after a line break, or after . ! ? and white space."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        begins[np.flatnonzero(data == 0x0A) + 1] = True
        begins[np.flatnonzero(_ENDS[data[:-1]] & ~texts.NOT_SPACE[data[1:]]) + 2] = True
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


@dataclass
class Windows:
    """Sentences in blocks of HALF bytes; two neighbouring blocks of a sentence are a window.

    owner: the sentence of each byte; blocks: where blocks begin; pairs: whether a block and the
    next one are in one sentence; alone: whether a block is a whole sentence.
    """

    owner: np.ndarray
    blocks: np.ndarray
    pairs: np.ndarray
    alone: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """The first block of each window."""
        return np.flatnonzero(self.pairs | self.alone)


def windows(size: int, starts: np.ndarray) -> Windows:
    sizes = np.diff(np.append(starts, size))
    parts = -(-sizes // HALF)
    sentence = np.repeat(np.arange(len(starts)), parts)
    number = np.arange(len(sentence)) - np.repeat(np.cumsum(parts) - parts, parts)
    pairs = np.append(sentence[1:] == sentence[:-1], False)
    owner = np.repeat(np.arange(len(starts)), sizes)
    return Windows(owner, starts[sentence] + number * HALF, pairs, parts[sentence] == 1)


def _features(data: np.ndarray, owner: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern of gaps its weight, the positions that fit in one sentence, and their feature slots."""
    codes = data.astype(np.uint32)
    for steps in _STEPS:
        reach = sum(steps)
        count = len(data) - reach
        if count <= 0:
            continue
        at, value = 0, codes[:count].copy()
        for n, step in enumerate(steps, 1):
            at += step
            value |= codes[at : at + count] << np.uint32(8 * n)
        fits = np.flatnonzero(owner[:count] == owner[reach:])
        slots = (value[fits] * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        yield float(GAP_FACTOR ** (reach - len(steps))), fits, slots.astype(np.int64)


def _window_sums(data: np.ndarray, cut: Windows, table: np.ndarray) -> np.ndarray:
    """Sum of table rows over the features that begin in each window."""
    total = np.zeros((len(data), *table.shape[1:]), np.float32)
    for weight, fits, slots in _features(data, cut.owner):
        total[fits] += np.float32(weight) * table[slots]
    blocks = np.add.reduceat(total, cut.blocks, axis=0)
    blocks[:-1][cut.pairs[:-1]] += blocks[1:][cut.pairs[:-1]]
    return blocks[cut.firsts]


@dataclass
class ToxicityModel:
    """weights: per feature slot; a text has the probability 1 / (1 + exp(-(slope * value + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The machine's value of the highest window of each text; that of nothing for an empty text."""
        result = np.full(len(offsets) - 1, self.bias)
        if len(data):
            data = texts.LOWER[data]
            cut = windows(len(data), sentence_starts(data, offsets))
            sums = _window_sums(data, cut, self.weights)
            full = np.flatnonzero(np.diff(offsets))
            first = np.searchsorted(cut.blocks[cut.firsts], offsets[full])
            result[full] += np.maximum.reduceat(sums, first)
        return result

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.values(data, offsets) + self.shift, -500, 500)))


def labelled_draws(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """toxic, draw (a hash of the text) and blank of the labelled documents: their texts stay behind."""
    key = "toxic" if labels is None else "doc_id"
    brief = documents.where("text is not null")
    brief = brief.selectExpr(key, "xxhash64(text) as draw", "length(trim(text)) = 0 as blank")
    if labels is not None:
        brief = brief.join(labels.select("doc_id", "toxic"), "doc_id").drop("doc_id")
    return brief.where("toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))


def learning_rows(documents: DataFrame, draws: DataFrame, per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """A bounded sample (toxic, place, text): the per_label distinct whole texts of each label with the least hashes.

    Hashes are drawn in two levels: of each label DRAWS tasks draw from what their input tasks drew,
    and one draws from theirs.
    """
    chosen = draws.where("not blank").select("toxic", "draw").distinct()
    for level in (["toxic", "task"], ["toxic"]):
        order = Window.partitionBy(*level).orderBy("draw")
        chosen = chosen.withColumn("task", F.spark_partition_id() % DRAWS) if "task" in level else chosen
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    # At most 2 * per_label rows go to the documents, wherever these lie.
    found = documents.select("text").join(F.broadcast(chosen), F.expr("xxhash64(text) = draw"))
    return found.dropDuplicates(["toxic", "place"]).select("toxic", "place", "text")


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of contiguous subsequences that each text has, a bit per slot."""
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            data = texts.LOWER[data]
            bits = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                have = np.zeros(SLOTS, np.uint8)
                part = data[a:b]
                cut = windows(len(part), sentence_starts(part, np.array([0, len(part)])))
                for _, _, slots in islice(_features(part, cut.owner), 1):
                    have[slots] = 1
                bits.append(np.packbits(have).tobytes())
            toxic = batch.column("toxic").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([toxic, pa.array(bits, pa.binary())], names=["toxic", "bits"])


def _first_odds(bits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """First guess: for each slot, how much more toxic texts than clean ones have it."""
    counts = [np.zeros(SLOTS), np.zeros(SLOTS)]
    for row, label in zip(bits, toxic):
        counts[int(label)] += np.unpackbits(row)
    clean, other = (np.log((n + 1) / ((toxic == label).sum() + 2)) for label, n in enumerate(counts))
    return (other - clean).astype(np.float32)


def _window_rows(batches: Iterator[pa.RecordBatch], odds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each text the TELLING_WINDOWS windows with the greatest odds and DRAWN_WINDOWS others, by a hash of place."""
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            data = texts.LOWER[data]
            rows = []
            for n, a, b in zip(range(first, last), offsets[:-1], offsets[1:]):
                part = data[a:b]
                cut = windows(len(part), sentence_starts(part, np.array([0, len(part)])))
                score = np.zeros(len(part), np.float32)
                for _, fits, slots in islice(_features(part, cut.owner), 1):
                    score[fits] = odds[slots]
                score = np.add.reduceat(score, cut.blocks)
                score[:-1][cut.pairs[:-1]] += score[1:][cut.pairs[:-1]]
                score = score[cut.firsts]
                starts = cut.blocks[cut.firsts]
                ends = np.append(cut.blocks, len(part))[cut.firsts + 1 + cut.pairs[cut.firsts]]
                telling = np.argsort(-score, kind="stable")[:TELLING_WINDOWS]
                others = np.setdiff1d(np.arange(len(score)), telling)
                drawn = others[np.argsort(texts.mix(others.astype(np.uint64)))[:DRAWN_WINDOWS]]
                for i in np.append(telling, drawn).tolist():
                    rows.append((n, part[starts[i] : ends[i]].tobytes(), float(score[i])))
            of, window, score = zip(*rows) if rows else ((), (), ())
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic").take(of),
                    batch.column("place").take(of),
                    pa.array(window, pa.binary()),
                    pa.array(score, pa.float64()),
                ],
                names=["toxic", "place", "window", "score"],
            )


def _value_rows(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """The machine's value of whole texts."""
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            toxic = batch.column("toxic").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([toxic, pa.array(model.values(data, offsets))], names=["toxic", "value"])


def _support_vectors(inputs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge support vector machine, by Newton steps; labels weigh alike."""
    inputs = np.column_stack([inputs, np.ones(len(inputs), np.float32)])
    share = np.where(target > 0, 0.5 / max((target > 0).sum(), 1), 0.5 / max((target < 0).sum(), 1)) * len(target) * COST
    weights = np.zeros(inputs.shape[1])
    penalty = np.eye(len(weights))
    penalty[-1, -1] = 1e-6
    for _ in range(20):
        inside = np.flatnonzero(target * (inputs @ weights) < 1)
        rows = inputs[inside]
        system = penalty + (rows.T @ (rows * share[inside, None].astype(np.float32))).astype(np.float64)
        fresh = np.linalg.solve(system, rows.T @ (share[inside] * target[inside]))
        if np.abs(fresh - weights).max() < 1e-6:
            break
        weights = fresh
    return weights


def _logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits labels best, slope at least 0."""
    inputs = np.column_stack([values, np.ones(len(values))])
    weights = np.zeros(2)
    for _ in range(50):
        likely = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        curvature = inputs.T @ (inputs * (likely * (1 - likely))[:, None]) + 1e-3 * np.eye(2)
        weights = weights + np.linalg.solve(curvature, inputs.T @ (labels - likely) - 1e-3 * weights)
    return max(float(weights[0]), 0.0), float(weights[1])


def fit(documents: DataFrame, labels: DataFrame | None = None, per_label: int = ROWS_PER_LABEL) -> ToxicityModel:
    """Learn from at most 2 * per_label rows.

    documents has (text, toxic 0 or 1), or (doc_id, text) with labels (doc_id, toxic). Other values of toxic
    and null texts are left out. Whole texts are read, by tasks. One task trains, on TELLING_WINDOWS + DRAWN_WINDOWS
    windows of each text; the driver gets the slots that each text has, the machine, and the values of the texts.

    The curve is fitted on texts that a machine was not trained on; the share of toxic rows among all labelled
    ones sets its level. Without two texts of either label every score is the share of toxic rows.
    """
    documents = documents.withColumn("text", F.col("text").cast("string"))
    draws = stage(labelled_draws(documents, labels))
    total, toxic_total = draws.selectExpr("count(*)", "count_if(toxic = 1)").first()
    share = (toxic_total + 0.5) / (total + 1) if total else 0.0
    sample = stage(learning_rows(documents, draws, per_label))
    level = float(np.log(share / (1 - share))) if share else -500.0
    places = sample.where("toxic = 1").selectExpr("max(place)").first()[0] or 0
    if min(places, sample.where("toxic = 0").selectExpr("max(place)").first()[0] or 0) < 2:
        return ToxicityModel(np.zeros(SLOTS, np.float32), 0.0, 0.0, level)
    # The curve is fitted on values of each half by the machine of the other; the one that scores learns from both.
    found = []
    for half in range(2):
        rows = sample.where(f"place % 2 = {half}").mapInArrow(
            partial(_value_rows, model=_machine(sample.where(f"place % 2 <> {half}"))), "toxic int, value double"
        )
        found.append(rows.orderBy("value", "toxic").toArrow())
    values = np.concatenate([np.array(rows["value"].to_pylist()) for rows in found])
    labels_in = np.concatenate([np.array(rows["toxic"].to_pylist(), float) for rows in found])
    slope, shift = _logistic(values, labels_in)
    # The sample has as many rows of each label as there are; the curve is moved to the share among all.
    mine = labels_in.mean()
    model = _machine(sample)
    return ToxicityModel(model.weights, model.bias, slope, shift + level - float(np.log(mine / (1 - mine))))


def _machine(sample: DataFrame) -> ToxicityModel:
    """The machine learnt from rows (toxic, place, text) of both labels, without a curve."""
    slots = sample.mapInArrow(_slot_rows, "toxic int, bits binary").toArrow()
    toxic = np.array(slots["toxic"].to_pylist(), bool)
    odds = _first_odds(np.frombuffer(b"".join(slots["bits"].to_pylist()), np.uint8).reshape(len(toxic), -1), toxic)
    rows = sample.mapInArrow(partial(_window_rows, odds=odds), "toxic int, place int, window binary, score double")
    # At most 2 * per_label texts' windows: one task trains, and a lost executor repeats it.
    weights, bias = rows.repartition(1).mapInArrow(_machine_rows, "weights binary, bias double").first()
    return ToxicityModel(np.frombuffer(weights, np.float32), bias, 1.0, 0.0)


def _machine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine learnt from all rows of _window_rows."""
    parts = list(batches)
    rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("place", "toxic", "score", "window")])
    column = rows["window"].to_pylist()
    data = np.frombuffer(b"".join(column), np.uint8)
    starts = np.cumsum([0, *map(len, column)])[:-1]
    positive = rows["toxic"].to_numpy() == 1
    text_of = 2 * rows["place"].to_numpy().astype(np.int64) + positive
    # Each learnt window is a sentence by itself, of one window.
    weights, bias = _train(data, windows(len(data), starts), text_of, positive, rows["score"].to_numpy())
    made = [pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())]
    yield pa.RecordBatch.from_arrays(made, names=["weights", "bias"])


def _train(
    data: np.ndarray, cut: Windows, text_of: np.ndarray, positive: np.ndarray, score: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights per feature slot and bias, from windows, whether each one's text is toxic, and a first guess."""
    starts = cut.blocks[cut.firsts]
    ends = np.append(cut.blocks, len(data))[cut.firsts + 1 + cut.pairs[cut.firsts]]
    draw = texts.mix(np.arange(len(starts), dtype=np.uint64))
    clean = np.flatnonzero(~positive)
    for _ in range(ROUNDS):
        best = np.lexsort((draw, -score, text_of))
        best = best[np.append(True, text_of[best[1:]] != text_of[best[:-1]])]
        witness = best[positive[best]]
        hardest = clean[np.argsort(-score[clean], kind="stable")]
        landmarks = np.append(
            witness[np.argsort(draw[witness])][: LANDMARKS * 3 // 4], hardest[: LANDMARKS - LANDMARKS * 3 // 4]
        )
        vectors = np.zeros((SLOTS, len(landmarks)), np.float32)
        for n, i in enumerate(landmarks):
            part = data[starts[i] : ends[i]]
            for weight, _, slots in _features(part, np.zeros(len(part), np.int8)):
                np.add.at(vectors[:, n], slots, np.float32(weight))
        kernel = _window_sums_in_parts(data, cut, vectors)
        values, directions = np.linalg.eigh(vectors.T.astype(np.float64) @ vectors)
        useful = values > 1e-4 * values.max()
        root = (directions[:, useful] / np.sqrt(values[useful])).astype(np.float32)
        inputs = kernel @ root
        del kernel
        scale = np.sqrt((inputs**2).sum(axis=1).mean()) or np.float32(1)
        inputs /= scale
        chosen = np.append(witness, clean)
        found = _support_vectors(inputs[chosen], np.where(positive[chosen], 1.0, -1.0))
        score = inputs @ found[:-1].astype(np.float32) + found[-1]
    return (vectors.astype(np.float64) @ (root @ found[:-1]) / scale).astype(np.float32), float(found[-1])


def _window_sums_in_parts(data: np.ndarray, cut: Windows, table: np.ndarray) -> np.ndarray:
    """_window_sums sentence group by sentence group, as rows of a table take much room."""
    sentences = np.flatnonzero(np.append(True, cut.owner[1:] != cut.owner[:-1]))
    groups = [*range(0, len(sentences), 256)]
    bounds = [*sentences[groups].tolist(), len(data)]
    rows = []
    for a, b in zip(bounds, bounds[1:]):
        part = data[a:b]
        inside = sentences[(sentences >= a) & (sentences < b)] - a
        rows.append(_window_sums(part, windows(len(part), inside), table))
    return np.concatenate(rows)


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of documents, with score (0 to 1, from the whole text) and predicted (1 if score >= threshold).

    A null text counts as empty and scores as a text in which nothing is found. Rows are judged each by
    itself, very long ones in whole. Columns of documents named score or predicted, in any case, are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in texts.text_slices(batch.column("text")):
                scores = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, last - first) for c in kept],
                        pa.array(scores),
                        pa.array((scores >= threshold).astype(np.int32)),
                    ],
                    names=[*kept, "score", "predicted"],
                )

    kept = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    source = documents.select(*[F.col(f"`{c}`") for c in kept]).withColumn("text", F.col("text").cast("string"))
    made = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return source.mapInArrow(predict, StructType([*source.schema.fields, *made.fields]))
