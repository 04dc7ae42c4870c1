"""Tables between steps leave the disk when no step reads them any more; links do not depend on it."""

from __future__ import annotations

import os
import random
from pathlib import Path
from urllib.parse import urlparse

from liengrid.llm import line_dedup
from liengrid.llm.linking import linked_groups
from liengrid.sources.tables import discard, stage, staging_folder


def staged(spark):
    folder = Path(urlparse(staging_folder(spark)).path)
    return {p for p in os.listdir(folder) if p.startswith("liengrid-stage-")} if folder.exists() else set()


def test_discarded_tables_leave_the_disk(spark):
    before = staged(spark)
    kept, gone = stage(spark.range(5)), stage(spark.range(7))
    assert len(staged(spark) - before) == 2
    discard(gone, spark.range(2))
    discard(gone)
    assert len(staged(spark) - before) == 1 and kept.count() == 5


def test_linking_keeps_no_table_of_keys(spark):
    """Keys, open blocks and candidate pairs go; what stays has a row per link."""
    rng = random.Random(2)
    items = [(i, rng.randrange(40) * 10 + i % 2) for i in range(400)]
    rows = [(k, i) for i, place in items for k in {place // 10, place // 10 + 1}]
    keys = spark.createDataFrame(rows, "key long, id long")
    features = spark.createDataFrame(items, "id long, place int")
    before = staged(spark)
    near = "abs(x.place - y.place) <= 1"
    made = linked_groups(keys, features, near, "-abs(x.place - y.place)", lambda pairs: pairs.select("a", "b"), rounds=2)
    got = {r.id: r.component for r in made.collect()}
    left = [spark.read.parquet(f"{staging_folder(spark)}/{name}") for name in staged(spark) - before]
    assert not [df.columns for df in left if "key" in df.columns]
    least: dict[int, int] = {}
    for i, place in items:
        least.setdefault(place // 10, i)
    assert got == {i: least[place // 10] for i, place in items}


def test_lines_keep_no_keys(spark):
    before = staged(spark)
    rows = [(1, "one two three four five six\nother words stand here alone now"), (2, "one two three four five six")]
    made = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in made.collect()} == {1: 0, 2: 1}
    left = [spark.read.parquet(f"{staging_folder(spark)}/{name}") for name in staged(spark) - before]
    # Those that stand for a group of equal lines keep them; the occurrences do not.
    assert not [df.columns for df in left if "line" in df.columns and "edit_keys" in df.columns]
