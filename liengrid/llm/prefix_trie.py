"""The trie of conversation prefixes, with count-min screening of prefix digests.

A prefix has a digest of two 64-bit numbers: the sum of its turns' hashes, each times a power given by the
turn's place. Sums of parts of a conversation put together, so turns are numbered and summed in range
partitions, a conversation of any length over several of them, and what one partition hands to the next is one
row. Digests are counted in a count-min sketch, which never counts too few: an estimate of one
proves that no other conversation has the prefix. Nodes below such a prefix are complete where they
stand; only prefixes that may be shared are shuffled, and grouped exactly by digest. All sums over
subtrees come from one member of each node, the least, which brings them to every prefix of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liengrid.llm import texts
from liengrid.sources.tables import stage

# Turns that a conversation may take from the first of its family of FAMILY ids: crc32(id) % (MOST_TAKEN + 1).
FAMILY, MOST_TAKEN = 5, 8
# Sketch: rows, cells a row for each prefix and at most, and the cells of a block, the unit of merging. A cell
# has a byte and stops at two. With more prefixes than cells more of them are shuffled; results are the same.
DEPTH, CELLS_A_PREFIX, LEAST_CELLS, MOST_CELLS, BLOCK = 4, 4, 1 << 14, 1 << 22, 1 << 13
# Rows of one conversation whose sums are taken together, and ids joined to one piece of text.
CHUNK, JOINED_IDS = 512, 4096

_U64 = np.uint64
_MASK = (1 << 64) - 1
# Odd, and 3 modulo 8: their powers stay apart in all but a few low bits.
_BASES = [int(b) & ~7 | 3 for b in texts.constants(2, 11)]
_ROOT = ["0L as d1", "0L as d2"]
NO_IDS = sha256(b"").hexdigest()

_TURNS = "conv_id long, rn long, t1 long, t2 long, bytes long, p1 long, p2 long"
_PATHS = "conv_id long, pos long, size long, bytes long, d1 long, d2 long, e1 long, e2 long"
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each power, modulo 2^64."""
    result, factor, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        result = np.where(left & _U64(1), result * _U64(factor), result)
        factor = factor * factor & _MASK
        left = left >> _U64(1)
    return result


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted turns: the place in its conversation's run in this partition, and the digests so far in the run."""
    part = TaskContext.get().partitionId()
    conv, count, sums = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        place = np.arange(n) - starts[run] + 1
        carried = run == 0 if ids[0] == conv else np.zeros(n, bool)
        place += np.where(carried, count, 0)
        prefixes = []
        for lane, base in enumerate(_BASES):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_unsigned(batch.column(f"t{lane + 1}")) * powers(base, place))))
            prefix = total[1:] - total[starts][run] + np.where(carried, _U64(sums[lane]), _U64(0))
            prefixes.append(prefix)
        conv, count, sums = ids[-1], int(place[-1]), [int(p[-1]) for p in prefixes]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "t1", "t2", "bytes")), pa.array(place), *map(_signed, prefixes), pa.array(np.full(n, part))],
            names=["conv_id", "t1", "t2", "bytes", "i", "p1", "p2", "part"],
        )


def carries(summaries: list) -> dict[int, tuple[int, int, list[int]]]:
    """For each partition whose first conversation began before: its id, its turns before, their digests.

    summaries: rows of part, lo and hi (first and last conversation) and last (place and digests of the last row).
    """
    found: dict[int, tuple[int, int, list[int]]] = {}
    conv, count, sums = None, 0, [0, 0]
    for r in sorted(summaries, key=lambda r: r.part):
        before = (count, sums) if r.lo == conv else (0, [0, 0])
        if r.lo == conv:
            found[r.part] = (conv, count, sums)
        own = [r.last.p1 & _MASK, r.last.p2 & _MASK]
        conv, count, sums = r.hi, r.last.i, own
        if r.hi == r.lo:
            shifts = [pow(b, before[0], 1 << 64) for b in _BASES]
            count, sums = before[0] + r.last.i, [(s + f * p) & _MASK for s, f, p in zip(before[1], shifts, own)]
    return found


def _put_together(batches: Iterator[pa.RecordBatch], before: dict) -> Iterator[pa.RecordBatch]:
    """Places and digests from the beginning of the conversation."""
    for batch in batches:
        ids, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
        place = batch.column("i").to_numpy().copy()
        prefixes = [_unsigned(batch.column(p)).copy() for p in ("p1", "p2")]
        for k in np.unique(part).tolist():
            if k in before:
                conv, count, sums = before[k]
                rows = (part == k) & (ids == conv)
                place[rows] += count
                for prefix, s, base in zip(prefixes, sums, _BASES):
                    prefix[rows] = prefix[rows] * _U64(pow(base, count, 1 << 64)) + _U64(s)
        columns = [batch.column("conv_id"), pa.array(place), *(batch.column(c) for c in ("t1", "t2", "bytes")), *map(_signed, prefixes)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "rn", "t1", "t2", "bytes", "p1", "p2"])


def _rebuilt_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the prefixes of rebuilt conversations, with and without their last turn.

    The taken turns' digest s, and of the own turns what lies after o, moved by as many places as there were fewer taken.
    """
    back = [np.array([pow(b, -k, 1 << 64) for k in range(MOST_TAKEN + 1)], np.uint64) for b in _BASES]
    for batch in batches:
        pos, shift = batch.column("pos").to_numpy(), batch.column("shift").to_numpy()
        with_last, without = [], []
        for lane, base in enumerate(_BASES, 1):
            p, s, o, t = (_unsigned(batch.column(f"{c}{lane}")) for c in "psot")
            digest = s + (p - o) * back[lane - 1][shift]
            with_last.append(_signed(digest))
            without.append(_signed(digest - t * powers(base, pos)))
        columns = [batch.column(c) for c in ("conv_id", "pos", "size", "bytes")]
        yield pa.RecordBatch.from_arrays([*columns, *with_last, *without], names=[c.split()[0] for c in _PATHS.split(", ")])


def _cells(d1: np.ndarray, d2: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell of each digest in each row of the sketch, rows one after the other."""
    for row in range(DEPTH):
        mixed = texts.mix(d1 + texts.mix(d2 + _U64(row * 0x51ED27 + 1)))
        yield (mixed & _U64(width - 1)).astype(np.int64) + row * width


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(DEPTH * width, np.uint8)
    for batch in batches:
        for cells in _cells(_unsigned(batch.column("d1")), _unsigned(batch.column("d2")), width):
            at, times = np.unique(cells, return_counts=True)
            sketch[at] = np.minimum(sketch[at] + np.minimum(times, 2), 2)
    part = TaskContext.get().partitionId()
    for block in range(0, len(sketch), BLOCK):
        if sketch[block : block + BLOCK].any():
            data = [sketch[block : block + BLOCK].tobytes()]
            columns = [pa.array([block // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "cells"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, those with the same number added up."""

    def row(block, part, cells):
        columns = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "part", "cells"])

    held = None
    for batch in batches:
        for block, part, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "cells"))):
            cells = np.frombuffer(data, np.uint8)
            if held and held[0] == block:
                held = (block, held[1], np.minimum(held[2] + cells, 2).astype(np.uint8))
                continue
            if held:
                yield row(*held)
            held = (block, part, cells)
    if held:
        yield row(*held)


def sketch_of(paths: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of the digests of all rows, and its width; merged in two steps before it comes to the driver."""
    width = LEAST_CELLS
    wanted = CELLS_A_PREFIX * paths.count()
    while width < min(wanted, MOST_CELLS):
        width *= 2
    blocks, schema = paths.select("d1", "d2").mapInArrow(partial(_count, width=width), "block int, part int, cells binary"), "block int, part int, cells binary"
    for keys in (["block", F.expr("part % 64")], ["block"]):
        blocks = blocks.repartition(*keys).sortWithinPartitions("block").mapInArrow(_merge, schema)
    sketch = np.zeros(DEPTH * width, np.uint8)
    for r in blocks.collect():
        at, cells = r.block * BLOCK, np.frombuffer(r.cells, np.uint8)
        sketch[at : at + BLOCK] = np.minimum(sketch[at : at + BLOCK] + cells, 2)
    return sketch, width


def _screen(batches: Iterator[pa.RecordBatch], sketch, width: int) -> Iterator[pa.RecordBatch]:
    """May another conversation have the prefix, and the one without its last turn (false for the root)?"""

    def shared(a: pa.Array, b: pa.Array) -> np.ndarray:
        estimate = np.full(len(a), 255, np.uint8)
        for cells in _cells(_unsigned(a), _unsigned(b), width):
            estimate = np.minimum(estimate, sketch.value[cells])
        return estimate > 1

    for batch in batches:
        maybe = shared(batch.column("d1"), batch.column("d2"))
        before = shared(batch.column("e1"), batch.column("e2")) & (batch.column("pos").to_numpy() > 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe), pa.array(before)], names=[*batch.schema.names, "maybe", "before"])


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id) rows as pieces of text: the ids of one digest, joined by commas."""
    names = ["d1", "d2", "first", "ids"]
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2, ids = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv_id"))
        new = np.flatnonzero(np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))))
        starts = [s for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)]) for s in range(a, b, JOINED_IDS)]
        ends = [*starts[1:], len(ids)]
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(ids[starts]), pa.array(joined)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each digest's pieces, which come in order, with commas between them."""
    key, state, done = None, None, []

    def rows():
        columns = [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "ends_sha256"])

    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
            if (d1, d2) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (d1, d2), sha256(ids.encode())
        yield rows()
    if key:
        done.append((*key, state.hexdigest()))
        yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the conversations (d1, d2, conv_id) that end at each digest, ids in numerical order.

    Ids are joined in range partitions, so those of one digest may lie in many; pieces of text then meet.
    """
    order = ["d1", "d2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_join_ids, "d1 long, d2 long, first long, ids string")
    ordered = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return ordered.mapInArrow(_digest, "d1 long, d2 long, ends_sha256 string")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rn (from 1), hashes and bytes of each turn, and the digests of its conversation up to it."""
    rows = conversations.selectExpr(
        "cast(conv_id as long) as conv_id",
        "cast(turn as long) as turn",
        "coalesce(cast(role as string), '') as role",
        "coalesce(cast(text as string), '') as text",
    ).where("conv_id is not null")
    rows = rows.selectExpr(
        "conv_id",
        "turn",
        "xxhash64(role, text) as t1",
        "xxhash64(7L, text, role) as t2",
        "cast(octet_length(text) as long) as bytes",
        "monotonically_increasing_id() as tie",
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv_id long, t1 long, t2 long, bytes long, i long, p1 long, p2 long, part long"
    parts = stage(rows.mapInArrow(_number, schema))
    last = "max_by(struct(i, p1, p2), struct(conv_id, i)) as last"
    summaries = parts.groupBy("part").agg(*map(F.expr, ("min(conv_id) as lo", "max(conv_id) as hi", last))).collect()
    return parts.mapInArrow(partial(_put_together, before=carries(summaries)), _TURNS)


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per conversation (conv_id, size), and one per turn of it as rebuilt, with prefix digests."""
    head = f"case when rn <= {MOST_TAKEN} then struct(rn, p1, p2, t1, t2, bytes) end"
    heads = stage(turns.groupBy("conv_id").agg(F.expr("max(rn) as n"), F.expr(f"sort_array(collect_list({head})) as head")))
    own = heads.selectExpr("*", f"conv_id - conv_id % {FAMILY} as source", f"crc32(cast(conv_id as string)) % {MOST_TAKEN + 1} as h")
    sources = heads.selectExpr("conv_id as source", "n as source_n", "head as source_head")
    made = own.join(sources, "source", "left").withColumn("taken", F.expr("least(h, coalesce(source_n, 0))"))
    made = made.withColumn("at", F.expr("element_at(source_head, cast(nullif(taken, 0) as int))"))
    made = made.withColumn("own_at", F.expr("element_at(head, cast(nullif(if(n >= h, h, 0), 0) as int))"))
    made = stage(
        made.selectExpr(
            "conv_id",
            "h",
            "h - taken as shift",
            "taken + greatest(0, n - h) as size",
            *[f"coalesce(at.p{i}, 0) as s{i}" for i in (1, 2)],
            *[f"coalesce(own_at.p{i}, 0) as o{i}" for i in (1, 2)],
            "slice(source_head, 1, cast(taken as int)) as taken_turns",
        )
    )
    taken = made.selectExpr("conv_id", "size", "explode(taken_turns) as t").selectExpr(
        "conv_id", "t.rn as pos", "size", "t.bytes", "0L as shift", *[f"t.{c}{i}" for c in "pt" for i in (1, 2)], *[f"0L as {c}{i}" for c in "so" for i in (1, 2)]
    )
    kept = turns.join(made.drop("taken_turns"), "conv_id").where("rn > h")
    kept = kept.selectExpr("conv_id", "rn - shift as pos", "size", "bytes", "shift", *[f"{c}{i}" for c in "ptso" for i in (1, 2)])
    return made.select("conv_id", "size"), stage(taken.unionByName(kept).mapInArrow(_rebuilt_digests, _PATHS))


def _subtree_sums(members: DataFrame, weights: DataFrame, children: DataFrame) -> DataFrame:
    """n_children, n_leaves and saved_tokens of each digest.

    members: (conv_id, pos, d1, d2) of every prefix of a shared node. weights: what the least member of a
    node adds (conv_id, pos, saved, leaf); it counts for that conversation's prefixes up to pos. children: the
    digest of the parent of each node. A conversation's rows are summed in chunks, then over chunks.
    """
    rows = members.selectExpr("*", "0L as saved", "0L as leaf").unionByName(
        weights.selectExpr("conv_id", "pos", "cast(null as long) as d1", "cast(null as long) as d2", "saved", "leaf")
    )
    rows = rows.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    later = "over (partition by conv_id order by chunk desc rows between unbounded preceding and 1 preceding)"
    chunks = rows.groupBy("conv_id", "chunk").agg(F.expr("sum(saved) as s"), F.expr("sum(leaf) as l"))
    chunks = chunks.selectExpr("conv_id", "chunk", f"coalesce(sum(s) {later}, 0) as s", f"coalesce(sum(l) {later}, 0) as l")
    within = "over (partition by conv_id, chunk order by pos desc range between unbounded preceding and current row)"
    rows = rows.selectExpr("conv_id", "chunk", "d1", "d2", f"sum(saved) {within} as saved", f"sum(leaf) {within} as leaf").where("d1 is not null")
    sums = rows.join(chunks, ["conv_id", "chunk"]).selectExpr("d1", "d2", "saved + s as saved", "leaf + l as leaf", "0L as child")
    sums = sums.unionByName(children.selectExpr("d1", "d2", "0L as saved", "0L as leaf", "1L as child"))
    return sums.groupBy("d1", "d2").agg(F.expr("sum(child) as n_children"), F.expr("sum(leaf) as n_leaves"), F.expr("sum(saved) as saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of the rows (conv_id, turn, role, text): one row per node.

    Turns are ordered by turn, null first, those of one turn by hashes of role and text; repeated rows are turns of
    their own. A null role or text is empty, rows with a null conv_id take no part, other columns are ignored.
    Conversation c is rebuilt from the first h = crc32(c) % 9 turns of conversation c - c % 5 (the remainder has the sign
    of c) and its own turns after its first h. A node is a distinct sequence of first turns (role, text), the root the
    empty one; an empty table has no root. Columns: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 (of the members that end here).

    Sequences are told apart by digests of 128 bits. The driver receives the sketch (at most 16 MB), a row per partition
    and a few counts.
    """
    spark = conversations.sparkSession
    everyone, paths = rebuilt_paths(numbered_turns(conversations))
    root = everyone.selectExpr("min(conv_id) as conv_id", "count(*) as n").first()
    if not root.n:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    sketch, width = sketch_of(paths)
    task = partial(_screen, sketch=spark.sparkContext.broadcast(sketch), width=width)
    screened = paths.mapInArrow(task, _PATHS + ", maybe boolean, before boolean")

    shared = screened.where("maybe").drop("maybe", "before")
    nodes = stage(shared.groupBy("d1", "d2").agg(*map(F.expr, ("min(conv_id) as least", "count(*) as n", "max(size) as longest"))))
    members = stage(shared.join(nodes, ["d1", "d2"]))
    first_alone = screened.where("not maybe and before").selectExpr(*members.drop("least", "n", "longest").columns, "conv_id as least", "1L as n", "size as longest")
    parents = nodes.selectExpr("d1 as e1", "d2 as e2", "least as parent", "n as parent_n")
    owned = stage(members.where("least = conv_id").unionByName(first_alone).join(parents, ["e1", "e2"], "left"))
    weights = owned.selectExpr(
        "conv_id", "pos", "(n - 1) * bytes as saved", "cast((n > 1 and longest = pos) or (n = 1 and coalesce(parent_n, 1) > 1) as long) as leaf"
    ).where("saved > 0 or leaf > 0")
    several = members.where("n > 1")
    sums = _subtree_sums(several.select("conv_id", "pos", "d1", "d2"), weights, owned.where("parent_n > 1").selectExpr("e1 as d1", "e2 as d2"))
    ends = several.where("pos = size").select("d1", "d2", "conv_id").unionByName(everyone.where("size = 0").selectExpr(*_ROOT, "conv_id"))

    parent = f"if(pos = 1, {root.conv_id}L, coalesce(parent, conv_id)) as parent_conv_id"
    tops = owned.where("n > 1").selectExpr("d1", "d2", "conv_id", "pos as depth", parent, "n as n_convs").join(sums, ["d1", "d2"])
    alone = f"if(pos = size, sha2(cast(conv_id as string), 256), '{NO_IDS}') as ends_sha256"
    single = ["conv_id", "pos as depth", parent, "1L as n_convs", "cast(pos < size as long) as n_children", "1L as n_leaves", "0L as saved_tokens", alone]
    tails = screened.where("not maybe and not before").withColumn("parent", F.lit(None).cast("long")).selectExpr(*single)

    lone = screened.where("not maybe").selectExpr("count_if(pos = size) as leaves", "count_if(pos = 1) as tops").first()
    leaf = "(n > 1 and longest = pos) or (n = 1 and pos = size)"
    grouped = members.where("least = conv_id").selectExpr(
        f"count_if({leaf}) as leaves", "count_if(pos = 1) as tops", "coalesce(sum((n - 1) * bytes), 0) as saved"
    ).first()
    whole = (0, 0, root.conv_id, 0, None, root.n, lone.tops + grouped.tops, max(1, lone.leaves + grouped.leaves), grouped.saved)
    top = spark.createDataFrame([whole], "d1 long, d2 long, " + ", ".join(f"{c} long" for c in _NODE[:-1]))
    tops = tops.select("d1", "d2", *_NODE[:-1]).unionByName(top).join(ends_digests(ends), ["d1", "d2"], "left")
    tops = tops.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    return tops.select(*_NODE).unionByName(owned.where("n = 1").selectExpr(*single)).unionByName(tails)
