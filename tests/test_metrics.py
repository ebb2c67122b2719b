"""Metrics against plain formulas."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from lexiloom.operators import metrics as M


def cells(spark, rows):
    return spark.createDataFrame([(float(g), float(p)) for g, p in rows], "gold double, pred double")


def test_confusion_and_conventions(spark):
    row = M.confusion(cells(spark, [(4, 3.5), (0, 0.5), (3, 2.5), (0, 0), (1, 1.5)])).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["accuracy"]) == (3, 1, 0, 1, 0.8)
    assert row["mae"] == pytest.approx(0.4) and row["rmse"] == pytest.approx(math.sqrt(0.2))
    zero = M.confusion(cells(spark, [(1, 0), (0, 0)])).first()
    assert (zero["precision"], zero["recall"], zero["f1"]) == (0.0, 0.0, 0.0)


def test_sweep(spark):
    found = {r["threshold"]: (r["tp"], r["fp"]) for r in M.threshold_sweep(cells(spark, [(1, 0.5), (1, 1), (0, 2), (3, 3)])).collect()}
    assert found == {1.0: (2, 1), 1.5: (1, 1), 2.0: (1, 1), 2.5: (1, 0), 3.0: (1, 0)}


def test_verification_delta(spark):
    df = spark.createDataFrame([(3.0, 3.0, 3.0, "retained"), (0.0, 0.0, 2.0, "rejected"), (0.0, 0.0, None, "not_candidate")], "gold double, final_value double, pre_verification_value double, verification_status string")
    found = {r["stage"]: r for r in M.verification_delta(df).collect()}
    assert (found["pre"]["precision"], found["post"]["precision"], found["pre"]["recall"], found["post"]["recall"]) == (0.5, 1.0, 1.0, 1.0)
    assert (found["pre"]["n_candidates"], found["pre"]["n_retained"], found["pre"]["n_rejected"]) == (2, 1, 1)
    none = M.verification_delta(df.where("gold = 0 and final_value = 0 and verification_status = 'not_candidate'")).first()
    assert math.isnan(none["precision"])


def test_ranking(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), rng.randint(0, 12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "gold int, score int")
    pos, neg = [s for g, s in rows if g], [s for g, s in rows if not g]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    total, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        got = [g for g, s in rows if s >= t]
        recall = sum(got) / len(pos)
        total, last = total + (recall - last) * sum(got) / len(got), recall
    assert M.average_precision(df).first()["average_precision"] == pytest.approx(total)
    assert M.roc_auc(df.where("gold = 0")).first()["roc_auc"] is None


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_correlations(spark):
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = np.array(rows).T
    assert df.agg(M.pearson("x", "y")).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert M.spearman(df, "x", "y").first()[0] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(flat.agg(M.pearson("x", "y")).first()[0])


def test_vectors(spark):
    df = spark.createDataFrame([(0, [4.0, 0.0, 3.0, 0.0], [4.0, 0.0, 3.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 2.0, 2.0, 4.0], [0.5, 0.5, 3.0, 3.0]), (3, [1.0] * 4, [1.0, 2.0, 3.0, 4.0])], "i int, gold array<double>, pred array<double>")
    found = {r["i"]: r for r in M.word_metrics(df).collect()}
    assert found[0]["cosine"] == pytest.approx(1.0) and found[1]["cosine"] == 0.0 and math.isnan(found[3]["pearson"])
    assert found[2]["spearman"] == pytest.approx(np.corrcoef(ranks([1, 2, 2, 4]), ranks([0.5, 0.5, 3, 3]))[0, 1])
    recall = {r["i"]: r["topk_recall"] for r in M.topk_recall(df, k=2).collect()}
    assert recall[0] == 1.0 and recall[2] == 1.0 and recall[3] == 1.0


def test_geometry(spark):
    rng = np.random.default_rng(7)
    v, labels = rng.normal(size=(60, 8)), rng.integers(0, 4, 60)
    rows = [(i, None if labels[i] == 3 else str(labels[i]), v[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, c string, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    name = np.array(["0", "1", "2", "unknown"])[labels]
    within = [cos[i, j] for i in range(60) for j in range(i) if name[i] == name[j]]
    between = [cos[i, j] for i in range(60) for j in range(i) if name[i] != name[j]]
    similarity = M.category_similarity(df, "c", "v")
    assert similarity.agg({"n_pairs": "sum"}).first()[0] == 60 * 59 // 2
    row = M.category_separation(similarity).first()
    assert row["within_similarity"] == pytest.approx(np.mean(within)) and row["between_similarity"] == pytest.approx(np.mean(between))
    np.fill_diagonal(cos, -9)
    want = {i: [*np.argsort(-cos[i], kind="stable")[:5]] for i in range(60)}
    for block in (16, 1024):
        assert {r["k"]: r["neighbours"] for r in M.nearest(df, df, "k", "v", 5, block).collect()} == want
    named = df.selectExpr("printf('w%02d', k) as k", "v")  # keys that are texts
    assert {r["k"]: r["neighbours"] for r in M.nearest(named, named, "k", "v", 5, 16).collect()} == {f"w{i:02}": [f"w{j:02}" for j in v] for i, v in want.items()}
    few = df.where("k < 3")
    assert all(len(r["neighbours"]) == 2 and r["k"] not in r["neighbours"] for r in M.nearest(few, few, "k", "v", 5).collect())
    assert all(r["jaccard"] == 1.0 for r in M.neighbour_jaccard(df, df, "k", "v").collect())


def test_nearest_of_equal_cosines_are_those_of_smaller_keys(spark):
    v = np.random.default_rng(9).integers(-1, 2, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    cos = np.round(unit @ unit.T, 12)
    np.fill_diagonal(cos, -9)
    want = {i: [*np.argsort(-cos[i], kind="stable")[:5]] for i in range(300)}
    assert {r["k"]: r["neighbours"] for r in M.nearest(df, df, "k", "v", 5, 32).collect()} == want


def test_separation_needs_two_categories_of_two(spark):
    few = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [1.0, 1.0])], "k long, c string, v array<double>")
    more = few.union(spark.createDataFrame([(3, "c", [1.0, 2.0])], few.schema))
    for df in (few, more):
        assert tuple(M.category_separation(M.category_similarity(df, "c", "v")).first()) == (None, None, None)
    enough = few.union(spark.createDataFrame([(3, "b", [1.0, 2.0])], few.schema))
    assert M.category_separation(M.category_similarity(enough, "c", "v")).first()["within_similarity"] is not None
    with pytest.raises(ValueError):
        M.category_similarity(few, "c", "v", most=1)


def test_median(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 100, 101):
        values = [rng.choice([None, float(rng.randint(0, 6))]) for _ in range(n)]
        known = [v for v in values if v is not None]
        found = M.median(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()["median"]
        assert found == (float(np.median(known)) if known else None)


def test_pairwise_correlations(spark):
    rng = np.random.default_rng(3)
    g = rng.normal(size=(40, 6))
    p = np.round(g + rng.normal(size=g.shape), 0)
    df = spark.createDataFrame([(f"w{i:02}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(g, p))], "w string, gold array<double>, pred array<double>").repartition(3)
    unit = lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    at = np.triu_indices(40, 1)
    x, y = ((unit(v) @ unit(v).T)[at] for v in (g, p))
    assert M.pairwise_pearson(df).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert M.pairwise_spearman(df, "w").first()[0] == pytest.approx(np.corrcoef(ranks(np.round(x, 12)), ranks(np.round(y, 12)))[0, 1])
    assert M.pair_similarities(df, "w", block=7).count() == len(x) and M.pair_similarities(df, "w").where("a >= b").count() == 0
    with pytest.raises(ValueError):
        M.pair_similarities(df, "w", most=39)
    assert math.isnan(M.pairwise_pearson(df.limit(1)).first()[0])


def test_pairwise_spearman_of_many_rows_lists_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    unit = lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)

    def exact(v):
        x = np.round((unit(v) @ unit(v).T)[np.triu_indices(len(v), 1)], 12)
        _, place, n = np.unique(x, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[place]

    def check(g, p):
        df = spark.createDataFrame(pd.DataFrame({"w": np.arange(len(g)), "gold": g.tolist(), "pred": p.tolist()}))
        return M.pairwise_spearman(df, "w", **({"listed": 10} if len(g) < 4000 else {})).first()[0]

    def listed(*args, **more):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(M, "pair_similarities", listed)
    g = rng.normal(size=(4001, 5))
    p = np.round(g + rng.normal(size=g.shape), 0)
    p[p.sum(1) == 0, 0] = 1.0
    assert check(g, p) == pytest.approx(np.corrcoef(exact(g), exact(p))[0, 1], abs=1e-8)
    # Copies, near copies and vectors of zeros: few steps of the range hold nearly all pairs.
    g, p = np.repeat(g[:3], 100, 0), np.repeat(p[:3], 100, 0)
    g[:250] += rng.normal(size=(250, 5)) * 1e-5
    p[:40] = 0.0
    assert check(g, p) == pytest.approx(np.corrcoef(exact(g), exact(p))[0, 1], abs=1e-5)
    assert math.isnan(check(np.ones((20, 3)), rng.normal(size=(20, 3))))


def test_prevalence_and_density(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 0.0, 1.0), ("b", 0, 3.0, 2.0), ("b", 1, 0.0, 0.0), ("a", 2, 4.0, 3.0)], "word_normalized string, feature_id int, gold double, pred double")
    row = M.prevalence(df).first()
    assert row["n_features"] == 3 and row["spearman"] == pytest.approx(1.0) and row["pearson"] == pytest.approx(np.corrcoef([2, 0, 4], [2, 0.5, 3])[0, 1])
    assert M.density(df.withColumnRenamed("gold", "value")).first()["positive_density"] == 1.5
