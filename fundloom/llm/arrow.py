"""Running a small Python function over the texts of each partition, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts are taken out of a batch until so many bytes are reached, so Python strings of a few rows are held at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of the column; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(accumulate(sizes)):
        if n - held >= SLICE_BYTES or i + 1 == len(sizes):
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, n


def map_texts(df: DataFrame, one: Callable[[str | None], tuple], fields: str, text: str = "text") -> DataFrame:
    """df's columns but for the text, then the fields that ``one`` finds in it. Work is done where the rows are; nothing is shuffled."""
    more = T._parse_datatype_string(fields)
    carried = [f for f in df.schema.fields if f.name != text]
    kinds = [to_arrow_type(f.dataType) for f in more.fields]
    names = [f.name for f in [*carried, *more.fields]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = list(zip(*map(one, batch.column(text).to_pylist()), strict=True))
                own = [pa.array(x, type=k) for x, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], *own], names=names)

    return df.mapInArrow(run, T.StructType([*carried, *more.fields]))
