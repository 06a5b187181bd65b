"""Shared plumbing of the corpus operators: scratch tables and Arrow helpers."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ship import ship_package

#: The ASCII white space that separates words everywhere in this subpackage.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java and RE2 character class of word characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Folders of the tables that running operators have written, one list for each call that is under way.
_written: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: `spark.checkpoint.dir`, which every node shares.

    Where the session names none (tests on one machine), a temporary folder is made and kept for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` once as Parquet in the shared scratch folder and return the table read back.

    The written table survives the loss of executors and keeps later passes from repeating the work above it.
    """
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(folder)
    df.write.option("compression", codec).parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(operator: Callable) -> Callable:
    """An operator that deletes, when it returns, the scratch tables that its result no longer reads.

    The result is a DataFrame or a tuple that begins with one. Tables that the result reads stay for the caller, and are
    the caller's to delete if that is an operator itself.
    """

    @functools.wraps(operator)
    def run(*args, **named):
        _written.append([])
        try:
            out = operator(*args, **named)
        finally:
            mine = _written.pop()
        frame = out[0] if isinstance(out, tuple) else out
        read = frame.inputFiles() if mine else []
        used = {f for f in mine if any(f.rsplit("/", 1)[-1] in r for r in read)} if len(read) * len(mine) < 1 << 20 else set(mine)
        for folder in mine:
            if folder not in used:
                _delete(frame.sparkSession, folder)
        if _written:
            _written[-1] += used
        return out

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow`, after making sure that the executors can import this package.

    Rows here are whole texts, so batches are made smaller than Spark's 10,000 rows unless the session says otherwise:
    a Python worker holds one batch, and its memory stays with it while it idles.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH, "10000") == "10000":
        df.sparkSession.conf.set(BATCH, "1000")
    return df.mapInArrow(function, schema)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by `table()` that no result depends on."""
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def may_hold(rows: DataFrame, column: str, members: DataFrame, member: str, most: int = 1 << 24) -> DataFrame:
    """Those `rows` whose `column` may be in `members`: a hashed bitmap, tested before a join shuffles rows.

    The bitmap has 16 bits a member, at most `most` (2 MB); where that would leave fewer than four bits a member it
    would let nearly all through, and the rows come back as they are. It lets through all that are in and some that are
    not; the join that follows decides.
    """
    spark = rows.sparkSession
    n = members.count()
    if 4 * n > most:
        return rows
    bits = min(most, 1 << max(16, math.ceil(math.log2(16 * max(n, 1)))))
    slot = lambda c: F.pmod(F.xxhash64(F.lit("slot"), c), F.lit(bits))
    words = members.select(slot(F.col(member)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("v")).toArrow()
    dense = np.zeros(bits // 64, dtype=np.int64)
    dense[words.column("w").to_numpy()] = words.column("v").to_numpy()
    held = spark.createDataFrame(pa.table({"__bits": pa.array([dense], pa.list_(pa.int64()))}))
    at = slot(F.col(column))
    return rows.join(F.broadcast(held), F.getbit(F.get("__bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("__bits")  # one row of 2 MB at most


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null as empty) alone, so that a document's other columns are neither read nor in the way."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def text_key() -> Column:
    """A hash that tells texts apart that share a doc_id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def packed(documents: DataFrame) -> DataFrame:
    """row (all columns), id and key: rows whose own columns, whatever their names, are out of the way of other ones."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    return documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))


def unpacked(rows: DataFrame, documents: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `documents` out of `packed` rows, with another text on demand."""
    return rows.select(*[(text if text is not None and c == "text" else F.col("row").getField(c)).alias(c) for c in documents.columns])


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds few rows and, unless one text is longer, few bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist() if batch.num_rows else []
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and (i - begin >= rows or held + n > chars):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
