"""Scores of text pairs by a caller's model: the second stage of retrieval, and entailment in the verdict ladder.

A model is a function without arguments that loads it and returns another: two lists of texts to as many numbers.
It is called once in each task, so what it loads is loaded on executors; pairs come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.retrieval import top_k

Model = Callable[[], Callable[[list[str], list[str]], Sequence[float]]]


def scored_pairs(rows: DataFrame, left: str, right: str, model: Model, name: str, at_once: int = 64) -> DataFrame:
    """The rows with the model's score of their pair of texts, `at_once` pairs a call; a pair with a null text has a null score."""
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                pairs = list(zip(part.column(left).to_pylist(), part.column(right).to_pylist(), strict=True))
                whole = [k for k, pair in enumerate(pairs) if None not in pair]
                out: list[float | None] = [None] * len(pairs)
                if whole:
                    score = score or model()
                    got = score([pairs[k][0] for k in whole], [pairs[k][1] for k in whole])
                    if len(got) != len(whole):
                        raise ValueError(f"the model gave {len(got)} scores for {len(whole)} pairs")
                    for k, x in zip(whole, got, strict=True):
                        out[k] = float(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def rerank(candidates: DataFrame, model: Model, k: int = 10, depth: int = 50) -> DataFrame:
    """The best k of each query's `depth` first candidates(query_id, doc_id, query, text, score) by the model's score of query and text.

    Returns query_id, doc_id, score (the model's), first_score and rank; candidates without a text come last.
    """
    first = top_k(candidates, depth).drop("rank")
    again = scored_pairs(first, "query", "text", model, "_model")
    worst = F.coalesce(F.nanvl(F.col("_model"), F.lit(float("-inf"))), F.lit(float("-inf")))
    return top_k(again.select("query_id", "doc_id", worst.alias("score"), F.col("score").alias("first_score")), k)
