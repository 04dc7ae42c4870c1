from __future__ import annotations

from liengrid.llm import toxicity


def test_insults_are_learnt(spark):
    plain = ["garden", "river", "window", "letter", "mountain", "table", "yellow", "summer"]
    clean = [(f"The {a} near the {b} was there. A {b} for {a}.", 0) for a in plain for b in plain]
    toxic = [(f"The {a} near the {b} was there. You gromfelk {a}.", 1) for a in plain for b in plain]
    model = toxicity.fit(spark.createDataFrame(clean + toxic, "text string, toxic int"))
    rows = [(1, "A summer table and the gromfelk there", 7), (2, "A summer table and the letter there", 7), (3, None, 7)]
    rows += [(4, "", 7), (5, "A summer table and the grom*felk there", 7), (6, "the river " * 30_000, 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(df, model).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in found.values())
    # An inserted character leaves some of the evidence, not always enough for the threshold.
    assert found[5][0] > 100 * found[2][0]
    assert found[1][1] == 1 and found[2][1] == found[3][1] == found[4][1] == found[6][1] == 0
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    alike = toxicity.fit(spark.createDataFrame(clean, "text string, toxic int"))
    assert all(r.score < 0.1 for r in toxicity.score_toxicity(df, alike).collect())


def test_whole_long_texts_are_learnt(spark):
    """What marks a text may stand at its end; columns that clash in other case, repeated rows and copies."""
    plain = ["garden", "river", "window", "letter", "mountain", "table", "yellow", "summer"]
    long = {a: f"The {a} was there and the others too. " * 100 for a in plain}
    clean = [(f"{long[a]}A {b} for {a}.", 0) for a in plain for b in plain]
    toxic = [(f"{long[a]}You gromfelk {b}.", 1) for a in plain for b in plain]
    copies = [clean[0]] * 500 + [toxic[0]] * 500
    model = toxicity.fit(spark.createDataFrame(clean + toxic + copies, "text string, toxic int"))
    rows = [("A gromfelk there.", "x"), ("A table there.", "x"), (long["river"] * 3 + "You gromfelk river.", "x")]
    found = toxicity.score_toxicity(spark.createDataFrame(rows, "text string, SCORE string"), model)
    assert found.columns == ["text", "score", "predicted"]
    assert [r.predicted for r in found.collect()] == [1, 0, 1]


def test_without_two_texts_of_a_label_nothing_is_learnt(spark):
    rows = [("one bad thing", 1), ("a good thing", 0), ("another good thing", 0)]
    for given in (rows, rows[1:], []):
        model = toxicity.fit(spark.createDataFrame(given, "text string, toxic int"))
        assert not model.weights.any()
        assert toxicity.score_toxicity(spark.createDataFrame(given, "text string, toxic int"), model).count() == len(given)
