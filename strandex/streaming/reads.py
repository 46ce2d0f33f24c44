"""Classifying reads as they arrive: Structured Streaming over the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from strandex.constants import K, L
from strandex.operators import classify, minimizers


def classify_batch(reads: DataFrame, index: DataFrame, closure: DataFrame, fallback: DataFrame | None = None, k: int = K, l: int = L) -> DataFrame:
    """``(read_id, status, taxid, best)`` of ``reads(read_id, mate, seq)``."""
    found = classify.lookup(minimizers.read_runs(reads, k, l), index, fallback)
    return classify.all_reads(reads, classify.classify(classify.hit_weights(found), closure, fallback is not None))


def classify_stream(
    stream: DataFrame, index: DataFrame, closure: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = K, l: int = L
) -> DataStreamWriter:
    """A writer, to be started, that classifies each micro-batch of ``stream`` and hands it to ``sink(batch, number)``.

    Both mates of a read have to arrive in one micro-batch. A read is classified by itself, so no state is kept; the
    checkpoint and the batch number let a sink write each batch once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(classify_batch(batch, index, closure, k=k, l=l), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
