"""Row-preserving columns computed from Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Bytes in an Arrow batch between the JVM and a Python worker, where the session
#: has the default: long texts then take little memory on either side.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "8MB"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their
    Python workers can then import it wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as folder:
            tree = Path(folder, "tree", root.name)
            shutil.copytree(root, tree, ignore=shutil.ignore_patterns("__pycache__"))
            keep = tempfile.mkdtemp(prefix="tessera-")
            context.addPyFile(shutil.make_archive(f"{keep}/{root.name}-{context.applicationId}", "zip", tree.parent))


def prepare_workers(spark: SparkSession) -> None:
    """Ship the package, and lower the session's limit on the bytes of a batch
    unless it was set."""
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) in (BATCH_DEFAULT, "67108864", "67108864b"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns whose names, in any case, are among these."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., Sequence[Sequence]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """df with further columns; equal names in df are replaced.

    ``start`` runs once in a task and returns a function from the Arrow columns
    named by ``inputs`` to a list of values for each of ``fields``; if that has
    an attribute ``close``, it is called at the task's end, so that a worker
    that goes on to other tasks keeps no memory of this one.  Columns in ``drop``
    are read but not returned.
    """
    prepare_workers(df.sparkSession)
    clash = {f.name.lower() for f in fields} - {c.lower() for c in inputs}
    df = without(df, clash)
    gone = {c.lower() for c in drop} | {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    places = {f.name: i for i, f in enumerate(df.schema.fields)}
    at_input = [places[c] for c in inputs]
    at_kept = [places[f.name] for f in kept]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            found = compute(*[batch.column(i) for i in at_input])
            new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at_kept] + new, names=names)
        getattr(compute, "close", lambda: None)()

    return df.mapInArrow(run, T.StructType([*kept, *fields]))
