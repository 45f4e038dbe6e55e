"""Vectors as integers: the table that the operators on embeddings work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint

#: Integers must be smaller than this, so that squared distances and inner products stay exact.
LARGEST = 1 << 24


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length, as a matrix; (0, 0) if there are none."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), flat.dtype)


def integer_vectors(table: DataFrame, scale: int, id_column: str, vector: str, label: str) -> DataFrame:
    """(id long, label, v array<int>): floor(scale * x) of every component, in double precision.

    Rows whose vector is null or holds a null or non-finite component are left out. Components
    of LARGEST or more in size raise a ValueError, as sums of them would not stay exact.
    Written to the checkpoint folder once, as the operators read it several times.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values = pc.cast(pc.list_flatten(column), pa.float64())
            x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = ~column.is_valid().to_numpy(zero_copy_only=False)
            bad[pc.list_parent_indices(column).to_numpy()[~np.isfinite(x)]] = True
            keep = pa.array(~bad)
            lengths = column.value_lengths().fill_null(0).to_numpy()
            x = np.floor(x[np.repeat(~bad, lengths)] * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST / scale} or more in size")
            offsets = np.concatenate([[0], np.cumsum(lengths[~bad])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))], ["id", "label", "v"])

    own = table.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kind = own.schema["label"].dataType.simpleString()
    return checkpoint(own.mapInArrow(convert, f"id long, label {kind}, v array<int>"))


def one_length(vectors: DataFrame) -> int | None:
    """The length of all vectors; None for an empty table. Raises where lengths differ."""
    least, most = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    return least
