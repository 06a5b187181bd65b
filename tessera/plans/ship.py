"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources, once per application, to every executor, which need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """While this holds, jobs that start give Python workers at most so many rows, and about so many bytes, at a time."""
    key, bytes_key = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, bytes_before = spark.conf.get(key), spark.conf.get(bytes_key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    if size:
        spark.conf.set(bytes_key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
        spark.conf.set(bytes_key, bytes_before)
