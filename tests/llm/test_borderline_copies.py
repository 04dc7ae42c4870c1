"""Pairs at the similarity threshold whose signatures agree in fewer values than usual are linked."""

from __future__ import annotations

import numpy as np

from liengrid.llm import minhash, texts


def test_pairs_with_few_equal_values(spark):
    rng = np.random.default_rng(5)
    rows = []
    for words in rng.integers(0, 1 << 30, (40_000, 39)).tolist():
        # 35 shingles, of which 30 stay: 30 of 40.
        rows += [" ".join(map(str, words)), " ".join(map(str, [*words[:19], -1, *words[20:]]))]
    values, bounds = _sets(rows)
    made = minhash.signatures(values, bounds)
    same = made[0::2] == made[1::2]
    equal = same.sum(axis=1)
    keyed = (same.reshape(-1, minhash.CHUNKS, minhash.CHUNK).sum(axis=2) >= minhash.KEPT_VALUES).any(axis=1)
    documents, expected = [], {}
    for i in np.flatnonzero(keyed & (equal < minhash.COORDINATES - 23)).tolist():
        third = _shares_a_key(rows[2 * i], values[bounds[2 * i] : bounds[2 * i + 1]], same[i], made[2 * i])
        if third:
            # The least document of the block is like neither of the pair.
            documents += [(3 * i, third), (3 * i + 1, rows[2 * i]), (3 * i + 2, rows[2 * i + 1])]
            expected |= {3 * i: 3 * i, 3 * i + 1: 3 * i + 1, 3 * i + 2: 3 * i + 1}
    assert documents
    got = minhash.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def _sets(rows):
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return texts.shingle_sets(np.frombuffer("".join(rows).encode(), np.uint8), offsets, minhash.SHINGLE_WORDS)


def _shares_a_key(text, shingles, same, signature):
    """A text of the three shingles that give a key of text and its copy, if it has this key."""
    words = text.split()
    spans = [" ".join(words[j : j + minhash.SHINGLE_WORDS]) for j in range(len(words) - minhash.SHINGLE_WORDS + 1)]
    span_of = dict(zip(_sets(spans)[0].tolist(), spans))
    for chunk in range(minhash.CHUNKS):
        mine = [c for c in range(chunk * minhash.CHUNK, (chunk + 1) * minhash.CHUNK) if same[c]][: minhash.KEPT_VALUES]
        least = [int(shingles[np.argmin(shingles * minhash._FACTORS[c])]) for c in mine]
        if len(mine) == minhash.KEPT_VALUES:
            made = " ".join(span_of[v] for v in least)
            if (minhash.signatures(*_sets([made]))[0][mine] == signature[mine]).all():
                return made
    return None
