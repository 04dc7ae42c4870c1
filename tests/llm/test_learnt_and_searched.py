"""Search, languages and fuzzy lines on small tables, with the defined edge cases."""

from __future__ import annotations

import numpy as np

from liengrid.llm import language_id, line_dedup, vector_search


def test_search_like_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(12)]
    odd = [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vector_search.nearest(df, "vec_id % 50 = 0").collect()}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in np.flatnonzero(ids % 50 == 0):
        others = [(-float(unit[q] @ unit[j]), int(ids[j])) for j in range(len(ids)) if j != q]
        best = sorted((round(s, 9), i) for s, i in others)[:5]
        assert [got[int(ids[q]), rank][0] for rank in range(1, 6)] == [i for _, i in best]
        assert np.allclose([got[int(ids[q]), rank][1] for rank in range(1, 6)], [-s for s, _ in best])
    assert len(got) == 5 * (ids % 50 == 0).sum()
    assert vector_search.nearest(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_language_of_odd_texts(spark):
    taught = [(f"the {w} of the thing and that", "en") for w in ("ring", "song", "wing")]
    taught += [(f"der {w} und die nicht ein", "de") for w in ("baum", "raum", "zaun")]
    model = language_id.fit(spark.createDataFrame(taught, "text string, lang string"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "the thing and that", "x"), (5, "die nicht und der", "x")]
    rows += [(6, "the ring " * 40_000, "x"), (6, "the ring " * 40_000, "x"), (None, "é", "x")]
    result = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(result) == len(rows) and all(0 <= r.score <= 1 for r in result)
    found = {r.doc_id: r.lang_pred for r in result}
    assert [found[i] for i in range(1, 7)] == ["und", "und", "und", "en", "de", "en"] and found[None] != "und"
    nothing = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert language_id.identify(spark.createDataFrame(rows[3:4], "doc_id long, text string, score string"), nothing).first().lang_pred == "und"


def test_lines(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    near = long.replace("wordba", "wordbx")
    rows = [
        (1, f"{long}\nshort line\n", "k"),
        (2, f"{long.upper()}!\nshort line\nits own line of five words", "k"),
        (3, near, "k"),
        (4, None, "k"),
        (5, "", "k"),
        (6, "\n\n", "k"),
        (None, long, "k"),
    ]
    result = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in result.collect()}
    assert got[1] == (rows[0][1], 2, 0)
    assert got[2] == ("short line\nits own line of five words", 3, 1)
    assert got[3][0] in (near, "")
    assert got[4] == (None, 0, 0) and got[5] == ("", 0, 0) and got[6] == ("\n\n", 2, 0) and got[None] == (long, 1, 0)
    assert result.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]


def test_languages_are_learnt_from_whole_distinct_texts(spark):
    """Copies fill no sample, ties and nulls are harmless, and what tells a language may stand at the end."""
    common = "zz " * 4_000
    rows = [(common + f"der die das und {w}", "de") for w in ("haus", "baum", "weg", "tag")]
    rows += [(common + f"the of and to {w}", "en") for w in ("house", "tree", "way", "day")]
    rows += [rows[0]] * 300 + [(None, "de"), ("x", None), ("", "en"), (rows[1][0], "en")]
    sample = language_id.learning_rows(spark.createDataFrame(rows, "text string, lang string"), 4).collect()
    assert sorted((r.place, r.lang) for r in sample) == [(p, l) for p in range(1, 5) for l in ("de", "en")]
    model = language_id.fit(spark.createDataFrame(rows[:8], "text string, lang string"))
    texts = [("der die das",), ("the of and",), (None,), ("12 34",)]
    found = language_id.identify(spark.createDataFrame([(t, 1) for t, in texts], "text string, SCORE int"), model)
    assert found.columns == ["text", "lang_pred", "score"]
    assert [r.lang_pred for r in found.collect()] == ["de", "en", "und", "und"]
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert empty.languages == []
