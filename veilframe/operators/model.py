"""Hook for a named-entity model that runs next to the rules; no model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPAN_FIELDS = [
    T.StructField("entity_type", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("rule", T.StringType()), T.StructField("original", T.StringType()),
]

Model = Callable[[list[str]], Iterable[Iterable[tuple[str, int, int, float]]]]


def model_spans(chunks: DataFrame, keys: list[str], text: str,
                load: Callable[[], Model]) -> DataFrame:
    """Span rows of a model over Arrow batches of texts.

    ``load()`` runs once per task and returns a function from a list of texts to one list
    of ``(entity, start, end, score)`` per text.
    """
    fields = [chunks.schema[k] for k in keys] + SPAN_FIELDS
    names = [f.name for f in fields]

    def run(batches):
        model = load()
        for pdf in batches:
            rows = []
            for values, value, spans in zip(pdf[keys].itertuples(index=False), pdf[text],
                                            model(pdf[text].tolist())):
                rows += [(*values, entity, start, end, float(score), "model", value[start:end])
                         for entity, start, end, score in spans]
            yield pd.DataFrame(rows, columns=names)

    return chunks.select(*keys, text).mapInPandas(run, T.StructType(fields))
