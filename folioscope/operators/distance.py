"""Cosine distances: document to centroid, within a class, between classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import ratio
from folioscope.operators.quantiles import group_quantiles
from folioscope.operators.vectorize import postings, vector_entries
from folioscope.session import MAX_BROADCAST_BYTES, materialised, measured_broadcast

#: Classes and features of a dense block in the product of classes: about 2 x 512 x 4096 doubles in a task.
CLASS_BLOCK, FEATURE_BLOCK = 512, 4096


def dense_rows(long: DataFrame, key: str, size: int, value: str = "w") -> DataFrame:
    """``(key, values array<double>)`` from ``(key, idx, value)``: one row per class, ``size`` numbers each."""

    def densify(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(size)
        values[rows["idx"].to_numpy()] = rows[value].to_numpy()
        return pd.DataFrame({key: [rows[key].iloc[0]], "values": [values]})

    key_type = long.schema[key].dataType.simpleString()
    return long.groupBy(key).applyInPandas(densify, f"`{key}` {key_type}, `values` array<double>")


def broadcast_rows(size: int) -> int:
    """How many dense rows of ``size`` doubles fit the broadcast bound."""
    return max(1, MAX_BROADCAST_BYTES // (8 * size))


def dot(entries: Column, dense: Column) -> Column:
    """Sparse entries against a dense array, inside the row."""
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"] * F.get(dense, e["idx"]))


def squared_norm(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"])


def class_sums(df: DataFrame, label: str, vector_col: str) -> DataFrame:
    """``(label, idx, w)``: sums of the vectors of each class.

    Every task first adds up what it holds, so a class with a third of the documents costs each task one row per
    term of the capped vocabulary.
    """
    long = postings(df.where(F.col(label).isNotNull()), vector_col, [label])
    return long.groupBy(label, "idx").agg(F.sum("w").alias("w"))


def centroid_distance(
    df: DataFrame,
    label: str,
    vector_col: str,
    size: int,
    out_col: str = "distance_to_centroid",
    zero_vector: float | None = None,
    classes: list[str] | None = None,
) -> DataFrame:
    """Add the cosine distance of each document to the mean vector of its class.

    The cosine ignores scale, so class sums stand for means. They come back to the documents as one dense row per
    class and the product is taken inside the row: no posting is shuffled for it. Documents without a class, or of
    a class outside ``classes``, get null; a zero vector gets ``zero_vector``.
    """
    known = df if classes is None else df.where(F.col(label).isin(list(classes)))
    sums = dense_rows(class_sums(known, label, vector_col), label, size)
    sums = measured_broadcast(sums, broadcast_rows(size))
    sums = sums.withColumn(
        "_norm", F.sqrt(F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x * x))
    ).withColumnRenamed("values", "_centroid")
    joined = df.join(sums, label, "left").withColumn("_entries", vector_entries(vector_col))
    product = dot(F.col("_entries"), F.col("_centroid"))
    length = F.sqrt(squared_norm(F.col("_entries"))) * F.col("_norm")
    distance = 1 - ratio(product, length)
    if zero_vector is not None:
        inside = F.col(label).isNotNull() if classes is None else F.col(label).isin(list(classes))
        distance = F.when(inside, F.coalesce(distance, F.lit(float(zero_vector))))
    return joined.withColumn(out_col, distance).drop("_entries", "_centroid", "_norm")


def centroid_outliers(
    df: DataFrame,
    label: str,
    vector_col: str,
    size: int,
    iqr_factor: float = 1.5,
    distance_col: str = "distance_au_centre",
    zero_vector: float | None = 1.0,
) -> DataFrame:
    """Add the distance and ``is_outlier_centroid``: above Q3 + factor * IQR of its class.

    Only the upper side counts, and classes of fewer than four distances are never flagged.
    """
    measured = centroid_distance(df, label, vector_col, size, distance_col, zero_vector)
    return iqr_flag(measured, label, distance_col, "is_outlier_centroid", iqr_factor)


def iqr_flag(df: DataFrame, label: str, value: str, out_col: str, iqr_factor: float = 1.5, least: int = 4) -> DataFrame:
    q = group_quantiles(df, label, value, [0.25, 0.75])
    bounds = q.where(F.col("n") >= least).select(
        label, (F.get("q", F.lit(1)) + iqr_factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("_upper")
    )
    joined = df.join(measured_broadcast(bounds), label, "left")
    return joined.withColumn(out_col, F.coalesce(F.col(value) > F.col("_upper"), F.lit(False))).drop("_upper")


def box_plot(df: DataFrame, label: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values within ``reach`` * IQR) and number of fliers per class."""
    q = group_quantiles(df, label, value, [0.25, 0.5, 0.75]).select(
        label,
        F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"),
    )
    joined = df.select(label, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).join(
        measured_broadcast(q), label
    )
    span = reach * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - span) & (F.col("_v") <= F.col("q3") + span)
    return joined.groupBy(label, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
    )


def intra_class_distance(df: DataFrame, label: str, vector_col: str) -> DataFrame:
    """``(label, n, intra_distance)``: one minus the mean cosine over all pairs of a class, in linear time.

    With unit vectors u, the sum of u_i·u_j over i < j is (|sum u|^2 - number of non-zero u) / 2, so no pair is
    ever formed. A class of one document is at distance 0. Two sentinel entries (-1 for every document, -2 for
    every non-zero one) ride along with the postings, so counts and sums come out of a single pass.
    """
    source = df.where(F.col(label).isNotNull()).select(label, vector_entries(vector_col).alias("_e"))
    source = source.withColumn("_norm", F.sqrt(squared_norm(F.col("_e"))))
    entry = lambda idx, w: F.struct(F.lit(idx).alias("idx"), w.alias("w"))
    unit = F.transform("_e", lambda e: F.struct(e["idx"].alias("idx"), (e["w"] / F.col("_norm")).alias("w")))
    sentinels = F.array(entry(-1, F.lit(1.0)), entry(-2, F.when(F.col("_norm") > 0, 1.0).otherwise(0.0)))
    whole = F.when(F.col("_norm") > 0, F.concat(sentinels, unit)).otherwise(sentinels)
    sums = (
        source.select(label, F.explode_outer(whole).alias("e"))
        .groupBy(label, F.col("e.idx").alias("idx"))
        .agg(F.sum("e.w").alias("s"))
    )
    per_class = sums.groupBy(label).agg(
        F.coalesce(F.sum(F.when(F.col("idx") >= 0, F.col("s") * F.col("s"))), F.lit(0.0)).alias("_square"),
        F.max(F.when(F.col("idx") == -1, F.col("s"))).cast("long").alias("n"),
        F.max(F.when(F.col("idx") == -2, F.col("s"))).alias("_nonzero"),
    )
    mean = ratio(F.col("_square") - F.col("_nonzero"), F.col("n") * (F.col("n") - 1))
    return per_class.select(
        label, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(1 - mean).alias("intra_distance")
    )


def class_products(coefficients: DataFrame, n_classes: int, n_features: int) -> DataFrame:
    """``(class_a, class_b, dot)`` for every ordered pair of classes, by products of dense blocks.

    Features and classes are dealt to blocks by hash. A task multiplies one block of features for two blocks of
    classes, so a coefficient is sent once per block of classes and a task holds matrices of bounded size; it emits
    products of classes, never of features. Every class has a zero in the first block of features, so that pairs
    without a common feature are there too.
    """
    class_blocks, feature_blocks = -(-n_classes // CLASS_BLOCK), -(-n_features // FEATURE_BLOCK)
    anchors = coefficients.select("class").distinct().select("class", F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("coef"))
    rows = coefficients.select("class", F.col("feature").cast("string").alias("feature"), F.col("coef").cast("double").alias("coef"))
    rows = rows.unionByName(anchors)
    of_feature = F.when(F.col("feature").isNull(), 0).otherwise(F.pmod(F.xxhash64("feature"), F.lit(feature_blocks)))
    rows = rows.withColumn("block", of_feature.cast("long")).withColumn(
        "own", F.pmod(F.xxhash64("class"), F.lit(class_blocks))
    )
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(class_blocks - 1).cast("long")),
        lambda other: F.struct(F.least("own", other).alias("a"), F.greatest("own", other).alias("b")),
    )
    sent = rows.select("class", "feature", "coef", "block", "own", F.explode(pairs).alias("p")).select(
        "class", "feature", "coef", "block", "own", "p.a", "p.b"
    )

    def multiplied(part: pd.DataFrame) -> pd.DataFrame:
        column, features = pd.factorize(part["feature"], use_na_sentinel=False)
        row, classes = pd.factorize(part["class"])
        dense = np.zeros((len(classes), len(features)))
        np.add.at(dense, (row, column), part["coef"].to_numpy())
        block = np.zeros(len(classes), dtype="int64")
        block[row] = part["own"].to_numpy()
        left, right = np.flatnonzero(block == part["a"].iloc[0]), np.flatnonzero(block == part["b"].iloc[0])
        dots = dense[left] @ dense[right].T
        names = classes.to_numpy() if hasattr(classes, "to_numpy") else np.asarray(classes)
        return pd.DataFrame(
            {
                "class_a": np.repeat(names[left], len(right)), "class_b": np.tile(names[right], len(left)),
                "dot": dots.ravel(), "mirror": bool(part["a"].iloc[0] != part["b"].iloc[0]),
            }
        )

    kind = coefficients.schema["class"].dataType.simpleString()
    parts = sent.groupBy("block", "a", "b").applyInPandas(
        multiplied, f"class_a {kind}, class_b {kind}, dot double, mirror boolean"
    )
    one_way = parts.groupBy("class_a", "class_b", "mirror").agg(F.sum("dot").alias("dot"))
    both = F.when(
        F.col("mirror"), F.array(F.struct("class_a", "class_b"), F.struct(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    ).otherwise(F.array(F.struct("class_a", "class_b")))
    return one_way.select(F.explode(both).alias("p"), "dot").select("p.class_a", "p.class_b", "dot")


def class_pair_distance(coefficients: DataFrame) -> DataFrame:
    """``(class_a, class_b, dist)`` for every ordered pair of classes, from ``(class, feature, coef)``.

    The result itself is one row per pair of classes. Rows without a class are left out; a class without a non-zero
    coefficient is at distance 1 from the others and 0 from itself.
    """
    known = materialised(coefficients.where(F.col("class").isNotNull()).select("class", "feature", "coef"), "coefficients")
    size = known.agg(F.count_distinct("class"), F.count_distinct("feature")).first()
    products = class_products(known, max(size[0], 1), max(size[1], 1))
    norms = known.groupBy("class").agg(F.sqrt(F.sum(F.col("coef") * F.col("coef"))).alias("norm"))
    norms = measured_broadcast(norms)
    full = products.join(norms.withColumnsRenamed({"class": "class_a", "norm": "norm_a"}), "class_a").join(
        norms.withColumnsRenamed({"class": "class_b", "norm": "norm_b"}), "class_b"
    )
    cosine = F.coalesce(ratio(F.col("dot"), F.col("norm_a") * F.col("norm_b")), F.lit(0.0))
    distance = F.when(F.col("class_a") == F.col("class_b"), F.lit(0.0)).otherwise(1 - cosine)
    return full.select("class_a", "class_b", distance.alias("dist"))


def dissimilarity(coefficients: DataFrame, intra: DataFrame, label: str) -> DataFrame:
    """Between-class distances off the diagonal, within-class distances on it."""
    between = class_pair_distance(coefficients).where(F.col("class_a") != F.col("class_b"))
    within = intra.select(
        F.col(label).alias("class_a"), F.col(label).alias("class_b"), F.col("intra_distance").alias("dist")
    )
    known = coefficients.select(F.col("class").alias("class_a")).distinct()
    return between.unionByName(within.join(known, "class_a", "left_semi"))


def grand_mean(matrix: DataFrame, value: str = "dist") -> DataFrame:
    """Mean of the column means of a square matrix, which is the mean of its cells."""
    return matrix.agg(F.avg(value).alias("grand_mean"))


def furthest(df: DataFrame, value: str, key: str, n: int = 15) -> DataFrame:
    """The ``n`` largest values; ties by key."""
    return df.orderBy(F.desc_nulls_last(value), key).limit(n)


def most_distant(df: DataFrame, value: str, key: str) -> DataFrame:
    """The single row with the largest value; ties go to the smallest key."""
    best = F.min_by(key, F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return df.where(F.col(value).isNotNull()).agg(best.alias(key), F.max(value).alias(value))

