"""Adding computed columns to Arrow batches, and names that do not clash."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch on its way to Python; texts differ too much in length to count rows.
BATCH_BYTES = 2 << 20
TRIM_S = 1.0


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, in the executors' memory and in their Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(work: Callable) -> Callable:
    """A task function that gives freed memory back to the system now and then and when it ends, for its worker process stays."""

    @functools.wraps(work)
    def run(batches):
        last = time.monotonic()
        try:
            for out in work(batches):
                yield out
                if time.monotonic() - last > TRIM_S:
                    _give_back()
                    last = time.monotonic()
        finally:
            _give_back()

    return run


def free_name(base: str, taken: Iterable[str]) -> str:
    """base, or base with underscores behind it, that is not among the taken names (case aside)."""
    taken = {t.lower() for t in taken}
    while base.lower() in taken:
        base += "_"
    return base


def text_slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of row numbers whose texts have about limit characters; one text is never cut."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def append_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], start: Callable[[], Callable[[list], list]], limit: int = 4_000_000) -> DataFrame:
    """docs and the fields, computed from the text column without a shuffle.

    start() is called once a partition and gives the function from a list of
    texts (with nulls) to a list of tuples, one per text.  It sees about limit
    characters at a time.  A column of docs with a field's name is replaced.
    """
    new = {f.name.lower() for f in fields}
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in new]
    own = text_col in rest and isinstance(docs.schema[text_col].dataType, T.StringType)
    text = text_col if own else free_name("text_in", [*docs.columns, *new])
    schema = T.StructType([*(docs.schema[c] for c in rest), *fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        work = start()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            texts = batch.column(text).to_pylist()
            rows = [row for lo, hi in text_slices(texts, limit) for row in work(texts[lo:hi])]
            made = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, *(f.name for f in fields)])

    sent = docs.select(*rest) if own else docs.select(*rest, F.col(text_col).cast("string").alias(text))
    return sent.mapInArrow(tidied(run), schema)
