import pandas as pd

from loomtrace.operators import corpus, hooks


def test_perceive_and_score(spark):
    def model(previous: pd.Series, current: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"primitive": current.str.contains("again").map({True: "repair", False: "continue"}), "confidence": 0.5,
                             "history_conditioned": True, "history_match": None, "model_version": "m"})

    df = spark.createDataFrame([(1, "", "a"), (2, "x", "try again"), (3, None, "b")], "i INT, previous_text STRING, text STRING")
    got = {r["i"]: r["behavior"] and r["behavior"]["primitive"] for r in hooks.perceive(df, model).collect()}
    assert got == {1: None, 2: "repair", 3: None}

    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a == b).astype("float64")

    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "candidate_text STRING, incoming_text STRING")
    assert [r["score"] for r in hooks.score_pairs(pairs, same).collect()] == [1.0, 0.0]


def test_model_inputs_keep_exact_tail(spark):
    rows = [("k", i, f"line{i}") for i in range(30)] + [("one", 0, "only")]
    df = spark.createDataFrame(rows, "k STRING, pos INT, line STRING")
    for size in (1, 5, 6, 7, 20, 1000):
        got = {r["k"]: (r["history"], r["current"]) for r in corpus.model_inputs(df, "k", "pos", "line", size, 4).collect()}
        assert got["k"] == ("\n".join(f"line{i}" for i in range(29))[-size:], "line"), size
        assert got["one"] == ("", "only")
