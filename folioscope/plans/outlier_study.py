"""From a fitted classifier to the master table and its outlier flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.distance import centroid_distance, centroid_outliers
from folioscope.operators.models import TextClassifier, plane_projection, score_table
from folioscope.operators.neighbours import neighbour_outliers
from folioscope.operators.outliers import hesitation, low_confidence
from folioscope.session import materialised


def master_table(df: DataFrame, model: TextClassifier, label: str) -> DataFrame:
    """Scores, plane coordinates and centroid distance; materialised once for all that follows."""
    scored = plane_projection(score_table(df, model, label))
    size = len(model.vocabulary)
    return materialised(centroid_distance(materialised(scored), label, "features", size, classes=model.classes))


def flagged_table(
    master: DataFrame, key: str, label: str, size: int, k: int = 10, confidence: float = 0.30, gap: float = 0.15
) -> DataFrame:
    """The five outlier flags next to the master table."""
    out = low_confidence(hesitation(master, "proba", gap), label, "proba", confidence)
    out = centroid_outliers(out, label, "features", size)
    knn = neighbour_outliers(master.select(key, label, "tsne_1", "tsne_2"), key, label, "tsne_1", "tsne_2", k)
    return out.join(knn.select(key, "parti_geographique", "is_outlier_knn"), key)


def outliers_of(flagged: DataFrame, flag: str) -> DataFrame:
    return flagged.where(F.col(flag))
