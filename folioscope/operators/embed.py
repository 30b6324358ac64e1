"""Batch embedding with a user-supplied encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: texts per call.
BATCH_SIZE = 16


def embed_texts(
    df: DataFrame, text_col: str, load_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    out_col: str = "embedding", batch_size: int = BATCH_SIZE, max_tokens: int | None = None,
) -> DataFrame:
    """Add one vector per text. ``load_encoder`` runs once per Python worker; it returns a function from an array of
    texts to a matrix of vectors. Whole texts are sent; ``max_tokens`` is for an encoder with an input limit.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_tokens is not None:
        text = F.array_join(F.slice(F.split(text, r"\s+"), 1, max_tokens), " ")
    encode = predict_batch_udf(load_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, encode(text))
