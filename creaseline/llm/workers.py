"""Small helpers for code that runs inside tasks."""

import pickle
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shipped(spark: SparkSession, value) -> Callable:
    """A function by which tasks get `value`, sent once to each executor.

    A plain broadcast names the classes of its value, so workers would have to import the package;
    here they are sent along.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def kept(name: str, build: Callable):
    """What `build` returns, made once per worker process and kept for its later tasks."""
    store = sys.__dict__.setdefault("_creaseline_kept", {})
    if name not in store:
        store[name] = build()
    return store[name]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of about `most` bytes of `column`; a longer row stands alone."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
        start = size = 0
        for at, length in enumerate(lengths.tolist()):
            if size and size + length > most:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)
