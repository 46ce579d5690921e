"""Slots for functions the user brings: an encoder, a classifier, a completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _batch_model(loader: Callable, batch_size: int):
    return predict_batch_udf(
        loader, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )


def encode_model(
    df: DataFrame, text: str, loader: Callable, batch_size: int = 256
) -> DataFrame:
    """Add ``embedding`` from a model.

    ``loader()`` runs once per Python worker and returns a function from a batch
    of texts to a matrix with one row per text.
    """
    return df.withColumn("embedding", _batch_model(loader, batch_size)(F.col(text)))


def emotion_model(
    df: DataFrame,
    text: str,
    labels: list[str],
    loader: Callable,
    batch_size: int = 256,
) -> DataFrame:
    """Add ``emotion`` and ``score`` lists, sorted by label, from a classifier.

    The matrix columns are in the order of ``labels``.
    """
    scored = df.withColumn("_s", _batch_model(loader, batch_size)(F.col(text)))
    order = sorted(range(len(labels)), key=labels.__getitem__)
    return scored.select(
        *df.columns,
        F.array(*[F.lit(labels[i]) for i in order]).alias("emotion"),
        F.array(*[F.get("_s", F.lit(i)).cast("double") for i in order]).alias("score"),
    )


def complete(prompts: DataFrame, fn: Callable) -> DataFrame:
    """Add ``completion`` to prompt rows.

    ``fn`` maps a pandas frame of prompt rows to a sequence of texts. A task that
    is retried calls it again for its rows.
    """
    schema = T.StructType(
        [*prompts.schema.fields, T.StructField("completion", T.StringType())]
    )

    def run(batches):
        for batch in batches:
            yield batch.assign(completion=list(fn(batch)))

    return prompts.mapInPandas(run, schema)
