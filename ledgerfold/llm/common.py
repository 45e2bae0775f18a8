"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from ..shipping import shared_folder, to_workers

#: The tokenizer files live outside the repository; callers may pass any other path.
TOKENIZER_DIR = "/opt/tokenizers"
#: Rows, and bytes of their texts, that become Python objects at once; a longer text is alone.
ROWS, BYTES = 1000, 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file: from the installed package, else from TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZER_DIR}/{name}"
    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/ledgerfold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(df: DataFrame, name: str) -> int:
    """Where a column stands: the one of that very name, else the only one that differs from it in case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name} among {', '.join(df.columns)}")
    return alike[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ..., so that no name of the user's can clash or be misread."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of df by name (whatever signs it has), under names of our own."""
    return numbered(df).select(*(F.col(f"c{place(df, c)}").alias(own) for own, c in columns.items()))


def whole_number(column: str) -> Column:
    """Ids as 64-bit numbers; what is none counts as null."""
    return F.col(column).try_cast("long")


def type_of(df: DataFrame, name: str) -> DataType:
    return df.schema.fields[place(df, name)].dataType


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ROWS rows and, but for single rows, BYTES bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for x in batch.columns:
        if pa.types.is_string(x.type) or pa.types.is_binary(x.type) or pa.types.is_large_string(x.type):
            size += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, "right"))
        stop = min(start + ROWS, max(start + 1, most), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def in_small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of about BYTES bytes, where the session sets no size of its own: by Spark's
    default a batch has 10,000 rows, which executor and worker would hold at once, whatever their texts' size."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BYTES))


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str | StructType, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Runs make()(Arrow columns) -> columns over slices of the batches of df.select(columns).
    make runs once in each task, so tables are built (or found in the worker) there and nothing large is pickled."""
    out = pa.schema(fields)
    to_workers(df.sparkSession)
    in_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in slices(batch):
                step = step or only_own(make)
                columns = step(*part.columns)
                yield pa.RecordBatch.from_arrays([as_type(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def as_type(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


def filtered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ids, found without a shuffle while these are at most BROADCAST_IDS; more of them would not fit
    every worker, and all rows are given: whoever joins them with ids' table then drops the rest there."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return rows.join(F.broadcast(ids), "id", "left_semi") if n <= BROADCAST_IDS else rows


def as_kind(kind: DataType | str) -> DataType:
    return StructType.fromDDL(f"x {kind}")["x"].dataType if isinstance(kind, str) else kind


def map_columns(df: DataFrame, columns: list[str], make: Callable[[], Callable], out: list[tuple[str, DataType | str]]) -> DataFrame:
    """map_batches over columns of a user's table, whatever their names; out: names and Spark types of the result."""
    schema = StructType()
    for k, (_, kind) in enumerate(out):
        schema = schema.add(f"o{k}", as_kind(kind))
    done = map_batches(numbered(df), [f"c{place(df, c)}" for c in columns], make, schema, [(f.name, to_arrow_type(f.dataType)) for f in schema])
    return done.toDF(*(name for name, _ in out))


def with_columns(df: DataFrame, columns: list[str], make: Callable[[], Callable], added: list[tuple[str, DataType | str]]) -> DataFrame:
    """df's columns as c0, c1, ... and beside them those that make()(columns) gives."""
    schema = StructType()
    for k, f in enumerate(df.schema):
        schema = schema.add(f"c{k}", f.dataType)
    n, at = len(df.columns), [place(df, c) for c in columns]
    for name, kind in added:
        schema = schema.add(name, as_kind(kind))

    def full():
        step = make()
        return lambda *given: (*given, *step(*(given[k] for k in at)))

    return map_batches(numbered(df), [f"c{k}" for k in range(n)], full, schema, [(f.name, to_arrow_type(f.dataType)) for f in schema])


def restored(rows: DataFrame, df: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of rows under df's own names."""
    return rows.select(*(f"c{k}" for k in range(len(df.columns)))).toDF(*df.columns)


_PER_WORKER: dict = {}
_ASKED: set = set()


def only_own(make: Callable[[], Callable]) -> Callable:
    """make(); then forgets what other operators left in this worker and make did not ask for."""
    _ASKED.clear()
    step = make()
    if others := _PER_WORKER.keys() - _ASKED:
        for key in others:
            del _PER_WORKER[key]
        gc.collect()  # tables and their caches refer to each other
        pa.default_memory_pool().release_unused()
    return step


def per_worker(key, build: Callable):
    """build() once in each Python worker process; workers serve many tasks."""
    _ASKED.add(key)
    if key not in _PER_WORKER:
        _PER_WORKER[key] = build()
    return _PER_WORKER[key]


def latest(kind: str, token: str, build: Callable):
    """build() once in each Python worker process for a token; the one of the kind's last token is forgotten."""
    _ASKED.add(kind)
    if _PER_WORKER.get(kind, (None, None))[0] != token:
        _PER_WORKER[kind] = (token, build())
    return _PER_WORKER[kind][1]


class PieceCache(dict):
    """Results for text pieces, in two generations: a full one becomes the old one, and what is still used moves
    back. At most 2 * limit entries are held, whatever the corpus; a miss is computed again, never dropped."""

    def __init__(self, compute: Callable, limit: int = 250_000, longest: int = 200):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value
