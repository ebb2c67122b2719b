"""Scores of predictions: classification, ranking, correlation, similarity geometry.

Undefined ratios follow each metric's own convention: precision, recall and F1
of ``confusion`` are 0.0, those of ``verification_delta`` NaN, correlations of a
constant NaN. Means and linear correlations over pairs of vectors come from sums
of vectors and their products, so no pairs are listed for them; neighbours go
block by block, and rank correlations of all pairs are taken from counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexiloom.operators.pair_ranks import rank_correlation
from lexiloom.plans.materialise import materialise
from lexiloom.plans.running import average_ranks, running

THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0)
NAN = float("nan")
EPS = 1e-12


def _ratio(a: Column, b: Column, undefined: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(undefined))


def _prf(undefined: float) -> dict[str, Column]:
    return {
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"), undefined),
        "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), undefined),
    }


def _counts(gold: Column, pred: Column) -> list[Column]:
    return [F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")]


def confusion(cells: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Counts, accuracy, precision, recall, F1, MAE and RMSE; over zero is positive."""
    error = F.col(pred) - F.col(gold)
    out = cells.agg(*_counts(F.col(gold) > 0, F.col(pred) > 0), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return out.withColumns(_prf(0.0) | {"accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), 0.0)})


def threshold_sweep(cells: DataFrame, gold: str = "gold", pred: str = "pred", thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The same counts with predictions of at least each threshold as positive, in one pass over the cells."""
    each = cells.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.groupBy("threshold").agg(*_counts(F.col(gold) > 0, F.col(pred) >= F.col("threshold"))).withColumns(_prf(0.0))


def verification_delta(cells: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Precision, recall and F1 before and after verification, and how many candidates were retained or rejected.

    Reads gold, final_value, pre_verification_value (null: the final one) and verification_status.
    """
    gold = F.col("gold") > 0
    before = F.coalesce("pre_verification_value", "final_value", F.lit(0.0)) >= threshold
    after = F.coalesce("final_value", F.lit(0.0)) >= threshold
    status = F.col("verification_status")
    stages = cells.agg(
        F.struct(*_counts(gold, before)).alias("pre"),
        F.struct(*_counts(gold, after)).alias("post"),
        F.count_if(status == "retained").alias("n_retained"),
        F.count_if(status == "rejected").alias("n_rejected"),
    )
    both = stages.select(F.expr("stack(2, 'pre', pre, 'post', post) as (stage, s)"), "n_retained", "n_rejected")
    return both.select("stage", "s.*", (F.col("n_retained") + F.col("n_rejected")).alias("n_candidates"), "n_retained", "n_rejected").withColumns(_prf(NAN))


def roc_auc(cells: DataFrame, gold: str = "gold", score: str = "score") -> DataFrame:
    """Area under the ROC curve by ranks, ties shared; null unless both classes are there. Equal scores are combined first."""
    each = cells.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(gold) > 0).alias("p"))
    ends = running(each, [F.col(score)], {"end": F.col("n")})
    out = ends.agg(F.sum((F.col("end") - (F.col("n") - 1) / 2) * F.col("p")).alias("ranks"), F.sum("p").alias("n_positive"), F.sum(F.col("n") - F.col("p")).alias("n_negative"))
    p, q = F.col("n_positive").cast("double"), F.col("n_negative").cast("double")
    return out.select("n_positive", "n_negative", F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def average_precision(cells: DataFrame, gold: str = "gold", score: str = "score") -> DataFrame:
    """Step-wise average precision, equal scores taken together; null without positives."""
    each = cells.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(gold) > 0).alias("p"))
    sums = running(each, [F.col(score).desc()], {"seen": F.col("n"), "hits": F.col("p")})
    out = sums.agg(F.sum("p").alias("n_positive"), F.sum(F.col("p") * F.col("hits") / F.col("seen")).alias("total"))
    return out.select("n_positive", F.try_divide("total", F.col("n_positive").cast("double")).alias("average_precision"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns as an aggregate; NaN if either is constant."""
    varied = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(F.lit(NAN))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns, one row."""
    ranked = average_ranks(average_ranks(df.select(x, y).dropna(), x, "__x"), y, "__y")
    return ranked.agg(pearson("__x", "__y").alias("spearman"))


def median(df: DataFrame, value: str) -> DataFrame:
    """The exact median of a column's values that are not null, one row; null without any.

    Equal values are combined before they are ordered, and no task sees them all.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = running(each, [F.col("v")], {"end": F.col("n")})
    total = ends.agg(F.sum("n").alias("total"))
    half = F.floor(F.col("total") / 2)
    middle = lambda at: F.min(F.when((F.col("end") > at) & (F.col("end") - F.col("n") <= at), F.col("v")))
    return ends.crossJoin(total).agg(((middle(F.floor((F.col("total") - 1) / 2)) + middle(half)) / 2).alias("median"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(ArrayType(DoubleType()))
def _ranks(vectors: pd.Series) -> pd.Series:
    """Ranks of each vector's entries from 1, ties sharing the mean of theirs; each vector is sorted once."""
    def ranks(v: np.ndarray) -> np.ndarray:
        _, place, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[place]

    return vectors.map(lambda v: None if v is None else ranks(np.asarray(v, float)))


def word_metrics(vectors: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds cosine, Pearson and Spearman of the two vectors of every row."""
    def corr(a: str, b: str) -> Column:
        n = F.size(a).cast("double")
        total = lambda v: F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x)
        cov = _dot(a, b) - total(a) * total(b) / n
        va, vb = _dot(a, a) - total(a) * total(a) / n, _dot(b, b) - total(b) * total(b) / n
        return F.when((va > EPS) & (vb > EPS), cov / F.sqrt(va * vb)).otherwise(F.lit(NAN))

    out = vectors.withColumns({"__g": F.col(gold).cast("array<double>"), "__p": F.col(pred).cast("array<double>")})
    out = out.withColumns({"__rg": _ranks("__g"), "__rp": _ranks("__p")})
    return out.withColumns({"cosine": _dot("__g", "__p") / (F.sqrt(_dot("__g", "__g")) * F.sqrt(_dot("__p", "__p")) + EPS), "pearson": corr("__g", "__p"), "spearman": corr("__rg", "__rp")}).drop("__g", "__p", "__rg", "__rp")


def cosines(vectors: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds cosine of the two vectors of every row, and n_gold and n_pred, how many entries of each are positive."""
    positive = lambda v: F.size(F.filter(F.col(v), lambda x: x > 0))
    norm = lambda v: F.sqrt(_dot(v, v)) + EPS
    return vectors.withColumns({"cosine": _dot(gold, pred) / (norm(gold) * norm(pred)), "n_gold": positive(gold), "n_pred": positive(pred)})


def top_positions(vector: str, k: int) -> Column:
    """Positions of the ``k`` largest entries, ties to the higher position."""
    pairs = F.transform(F.col(vector), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, k), lambda p: p["i"])


def topk_recall(vectors: DataFrame, k: int = 10, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds the share of the ``k`` largest gold features that are among the ``k`` largest predicted ones."""
    return vectors.withColumn("topk_recall", F.size(F.array_intersect(top_positions(gold, k), top_positions(pred, k))) / k)


def _unit(vector: str) -> Column:
    """The vector at length one; its norm is computed once."""
    return F.transform(F.array(F.col(vector).cast("array<double>")), lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + EPS), lambda n: F.transform(v, lambda x: x / n))[0])[0]


def category_similarity(vectors: DataFrame, category: str, vector: str, most: int = 10_000) -> DataFrame:
    """Mean cosine over the pairs of each two categories (and within each), with the number of pairs.

    Of unit vectors u, the cosines of all pairs of two groups add up to the
    product of the groups' sums; within a group, pairs of a vector with itself
    are taken out. Every two categories meet, as one sum vector each; more than
    ``most`` categories are an error.
    """
    unit = vectors.select(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("c"), _unit(vector).alias("u"))
    parts = unit.select("c", F.posexplode("u").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "s")))
    sums = materialise(parts.groupBy("c").agg(F.transform(ordered, lambda p: p["s"]).alias("s"), F.sum("q").alias("qq"), F.max("n").alias("n")), "categories")
    if (n := sums.count()) > most:
        raise ValueError(f"{n} categories are more than the {most} of which every two may meet")
    other = sums.select(F.col("c").alias("d"), F.col("s").alias("t"), F.col("n").alias("m"))
    both = sums.crossJoin(F.broadcast(other)).where("c <= d").withColumn("st", _dot("s", "t"))
    same = F.col("c") == F.col("d")
    pairs = F.when(same, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m"))
    total = F.when(same, (F.col("st") - F.col("qq")) / 2).otherwise(F.col("st"))
    return both.select(F.col("c").alias("category_a"), F.col("d").alias("category_b"), pairs.cast("long").alias("n_pairs"), F.try_divide(total, pairs).alias("mean_similarity"))


def category_separation(similarity: DataFrame) -> DataFrame:
    """Mean similarity within categories, between them, and their difference; all pairs count alike.

    Nulls where there are fewer than four items, or fewer than two categories of two or more.
    """
    within, weight = F.col("category_a") == F.col("category_b"), F.col("n_pairs") * F.col("mean_similarity")
    mean = lambda on: F.try_divide(F.sum(F.when(on, weight)), F.sum(F.when(on, F.col("n_pairs")).cast("double")))
    # A category of n items has n (n - 1) / 2 pairs of its own.
    size = F.round((1 + F.sqrt(1 + 8 * F.col("n_pairs"))) / 2)
    out = similarity.agg(mean(within).alias("w"), mean(~within).alias("b"), F.sum(F.when(within, size)).alias("items"), F.count_if(within & (F.col("n_pairs") > 0)).alias("eligible"))
    given = lambda c: F.when((F.col("items") >= 4) & (F.col("eligible") >= 2) & F.col("w").isNotNull() & F.col("b").isNotNull(), c)
    return out.select(given(F.col("w")).alias("within_similarity"), given(F.col("b")).alias("between_similarity"), given(F.col("w") - F.col("b")).alias("separation"))


def _gram(vectors: DataFrame, left: str, right: str) -> DataFrame:
    """(i, j, x): the sum over rows of the products of entries of two unit vectors; every task adds up its rows first."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                one = np.stack(pdf["l"]).T @ np.stack(pdf["r"])
                total = one if total is None else total + one
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    rows = vectors.select(_unit(left).alias("l"), _unit(right).alias("r"))
    return rows.mapInPandas(add, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))


def pairwise_pearson(vectors: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Correlation, over all pairs of rows, of their cosine in one set of vectors with that in the other; NaN if either is constant.

    The sums over pairs follow from the vectors' sum and from sums of products of
    their entries (their number is the square of the dimension), so no pair is listed.
    """
    total = lambda a, b, name: _gram(vectors, a, b).agg(F.sum(F.col("x") * F.col("x")).alias(name))
    units = vectors.select(_unit(gold).alias("g"), _unit(pred).alias("p"))
    own = units.agg(F.count("*").alias("n"), *[F.sum(f(a, b)).alias(f"{a}{b}{k}") for a, b in (("g", "g"), ("p", "p"), ("g", "p")) for k, f in ((2, lambda a, b: _dot(a, a) * _dot(b, b)), (1, lambda a, b: _dot(a, b)))])
    side = lambda v, name: units.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias(name))
    all_ = own.crossJoin(total(gold, gold, "gg")).crossJoin(total(pred, pred, "pp")).crossJoin(total(gold, pred, "gp")).crossJoin(side("g", "sg")).crossJoin(side("p", "sp"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    # Sums over i < j are half of those over all i and j without i = j.
    xy, xx, yy = ((F.col(c) - F.col(f"{c}2")) / 2 for c in ("gp", "gg", "pp"))
    x, y = (F.col("sg") - F.col("gg1")) / 2, (F.col("sp") - F.col("pp1")) / 2
    cov, vx, vy = xy - x * y / pairs, xx - x * x / pairs, yy - y * y / pairs
    return all_.select(F.when((pairs >= 2) & (vx > EPS) & (vy > EPS), cov / F.sqrt(vx * vy)).otherwise(F.lit(NAN)).alias("pairwise_pearson"))


def pair_similarities(vectors: DataFrame, key: str, gold: str = "gold", pred: str = "pred", block: int = 512, most: int = 50_000) -> DataFrame:
    """(a, b, gold, pred): both cosines, to 12 places, of every pair of rows, a before b; its result is all pairs.

    Blocks meet blocks; more than ``most`` rows are an error.
    """
    if (n := vectors.count()) > most:
        raise ValueError(f"{n} rows are more than the {most} of which all pairs may be listed")
    count = max(1, -(-n // block))
    row = F.struct(F.col(key).cast("string").alias("k"), _unit(gold).alias("g"), _unit(pred).alias("p"))
    blocks = materialise(vectors.select(F.pmod(F.xxhash64(key), F.lit(count)).alias("b"), row.alias("r")).groupBy("b").agg(F.collect_list("r").alias("rows")), "blocks")
    other = blocks.select(F.col("b").alias("c"), F.col("rows").alias("others"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, rows, others in zip(pdf["same"], pdf["rows"], pdf["others"]):
                a, b = np.array([x["k"] for x in rows], object), np.array([x["k"] for x in others], object)
                g, p = (np.stack([x[s] for x in rows]) @ np.stack([x[s] for x in others]).T for s in "gp")
                i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices(g.shape))
                swap = a[i] > b[j]
                yield pd.DataFrame({"a": np.where(swap, b[j], a[i]), "b": np.where(swap, a[i], b[j]), "gold": np.round(g[i, j], 12), "pred": np.round(p[i, j], 12)})

    return blocks.join(other, F.col("b") <= F.col("c")).select((F.col("b") == F.col("c")).alias("same"), "rows", "others").mapInPandas(meet, "a string, b string, gold double, pred double")


def pairwise_spearman(vectors: DataFrame, key: str, gold: str = "gold", pred: str = "pred", listed: int = 4000) -> DataFrame:
    """Rank correlation, over all pairs of rows, of their cosines in the two sets of vectors.

    The pairs of up to ``listed`` rows are listed; those of more are counted, see ``pair_ranks``.
    """
    n, d = vectors.agg(F.count("*"), F.max(F.greatest(F.size(gold), F.size(pred)))).first()
    if n > listed:
        found = rank_correlation(vectors.select(_unit(gold).alias("g"), _unit(pred).alias("p")), n, d)
        return vectors.sparkSession.range(1).select(F.lit(found).alias("pairwise_spearman"))
    pairs = materialise(pair_similarities(vectors, key, gold, pred).select("gold", "pred"), "pairs")
    return spearman(pairs, "gold", "pred").withColumnRenamed("spearman", "pairwise_spearman")


def prevalence(cells: DataFrame, feature: str = "feature_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Pearson and Spearman between the features' mean gold and mean predicted values."""
    means = cells.groupBy(feature).agg(F.avg(gold).alias("g"), F.avg(pred).alias("p"))
    return means.agg(F.count("*").alias("n_features"), pearson("g", "p").alias("pearson")).crossJoin(spearman(means, "g", "p"))


def density(cells: DataFrame, word: str = "word_normalized", value: str = "value") -> DataFrame:
    """Mean number of positive features per word."""
    each = cells.groupBy(word).agg(F.count_if(F.col(value) > 0).alias("n"))
    return each.agg(F.count("*").alias("n_words"), F.avg("n").alias("positive_density"))


def _blocks(vectors: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Unit vectors gathered in blocks of about ``block`` by the hash of their key; written once, so that every meeting reads them as they are."""
    kind = vectors.schema[key].dataType.simpleString()
    n = max(1, -(-vectors.count() // block))
    rows = vectors.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("b"), F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("r")).groupBy("b").agg(F.collect_list("r").alias("rows"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, rows in zip(pdf["b"], pdf["rows"]):
                v = np.stack([x["v"] for x in rows])
                yield pd.DataFrame({"b": [b], "keys": [[x["k"] for x in rows]], "vectors": [(v / (np.linalg.norm(v, axis=1, keepdims=True) + EPS)).tobytes()]})

    # Several files, so that meetings are dealt to several tasks.
    return materialise(rows.mapInPandas(pack, f"b long, keys array<{kind}>, vectors binary").repartition(min(n, 16), "b"), "neighbours")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(key, neighbours): for every query, the ``k`` other vectors of largest cosine, ties to the smaller key.

    Blocks of queries meet blocks of vectors; each meeting is one product of
    matrices, a task keeps the ``k`` best of a query over all its meetings, and
    these are merged. Only what reaches a query's ``k``-th best so far is ordered.
    """
    kind = vectors.schema[key].dataType.simpleString()
    right = _blocks(vectors, key, vector, block)
    left = (right if queries is vectors else _blocks(queries, key, vector, block)).select(F.col("b").alias("qb"), F.col("keys").alias("qkeys"), F.col("vectors").alias("qvectors"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of a block of queries: its keys; place of the query, cosine and other key of the best so far; each query's k-th best.
        best_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for qb, qkeys, q, rkeys, r in zip(pdf["qb"], pdf["qkeys"], pdf["qvectors"], pdf["keys"], pdf["vectors"]):
                qk, rk = np.array(qkeys), np.array(rkeys)
                cos = np.frombuffer(q).reshape(len(qk), -1) @ np.frombuffer(r).reshape(len(rk), -1).T
                if qb in best_of:
                    qk, at, best, other, least = best_of[qb]
                else:
                    at, best, other, least = np.zeros(0, int), np.zeros(0), rk[:0], np.full(len(qk), -np.inf)
                    cos[qk[:, None] == rk[None, :]] = -np.inf
                    if len(rk) > k:
                        least = np.round(np.partition(cos, -k, axis=1)[:, -k], 12)
                i, j = np.nonzero(cos >= (least - 1e-11)[:, None])
                found, new = np.round(cos[i, j], 12), rk[j]
                keep = (found >= least[i]) & (found > -np.inf) & (qk[i] != new)
                at, best, other = np.concatenate([at, i[keep]]), np.concatenate([best, found[keep]]), np.concatenate([other, new[keep]])
                place = other if other.dtype != object and other.dtype.kind != "U" else np.unique(other, return_inverse=True)[1]
                order = np.lexsort((place, -best, at))
                at = at[order]
                n = np.arange(len(at)) - np.searchsorted(at, at)
                order, at, n = order[n < k], at[n < k], n[n < k]
                best, other, least = best[order], other[order], np.full(len(qk), -np.inf)
                least[at[n == k - 1]] = best[n == k - 1]
                best_of[qb] = qk, at, best, other, least
        for qk, at, best, other, _ in best_of.values():
            yield pd.DataFrame({"key": qk[at], "other": other, "cosine": best})

    found = left.crossJoin(right.select("keys", "vectors")).select("qb", "qkeys", "qvectors", "keys", "vectors").mapInPandas(meet, f"key {kind}, other {kind}, cosine double")
    ranked = found.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("i") <= k)
    return ranked.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "other"))), lambda x: x["other"]).alias("neighbours")).withColumnRenamed("key", key)


def neighbour_jaccard(gold: DataFrame, pred: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(key, jaccard): how far the ``k`` nearest neighbours agree in two sets of vectors; a vector is never its own."""
    a = nearest(gold, gold, key, vector, k).withColumnRenamed("neighbours", "__a")
    b = nearest(pred, pred, key, vector, k).withColumnRenamed("neighbours", "__b")
    return a.join(b, key).select(key, (F.size(F.array_intersect("__a", "__b")) / F.size(F.array_union("__a", "__b"))).alias("jaccard"))
