"""Fitted steps on a stream. A model fitted on a batch table is a stateless projection
or filter, so it runs on a streaming DataFrame as it is."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def apply_models(stream: DataFrame, models: Iterable) -> DataFrame:
    """Chain ``transform`` methods or plain DataFrame functions over ``stream``."""
    for model in models:
        step: Callable = getattr(model, "transform", model)
        stream = step(stream)
    return stream
