"""Reading the id and text of a table, whatever else its rows hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (string, null as empty); all other columns go."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """The (id, text) pairs of a batch, one Python string alive at a time."""
    for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        yield key.as_py(), text.as_py()


#: A side of a join is broadcast only if its values take at most so many bytes.
BROADCAST_BYTES = 32_000_000


def width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
        own = F.size(value) * 8 + 16
    elif isinstance(kind, ArrayType):
        own = F.aggregate(value, F.lit(16).cast("long"), lambda sum, x: sum + width(x, kind.elementType))
    elif isinstance(kind, MapType):
        own = width(F.map_keys(value), ArrayType(kind.keyType)) + width(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        own = sum((width(value[field.name], field.dataType) for field in kind), F.lit(16).cast("long"))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(16).cast("long"))


def sized(small: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its values are few bytes, counted; otherwise Spark shuffles it.

    small: written before, so that measuring it is cheap. The results are the same either way.
    """
    bytes_of_row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in small.schema), F.lit(16).cast("long"))
    total = small.agg(F.coalesce(F.sum(bytes_of_row), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= BROADCAST_BYTES else small
