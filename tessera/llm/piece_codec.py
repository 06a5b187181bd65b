"""SentencePiece ids, their original byte spans, and the texts decoded from ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from ._common import map_arrow, slices, texts


def encode(documents: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """Pieces of every whole text as the library encodes it, without begin and end ids and without sampling.

    Texts are normalised by longest prefix through the model's compiled character map, with the byte that each character
    came from; pieces are projected to the bytes they cover. Spans follow each other without a gap, but for what the
    normalisation drops; of the bytes of a character that no piece has, the last covers it and the others nothing.
    No shuffle; memory is that of a slice of one batch and a bounded table of parts met.

    Returns doc_id, ids, starts and ends (bytes of the UTF-8 text, end exclusive), and on demand `decoded`, the text made
    of the ids alone: one row for each input row, repeated rows and null ids included. A null text counts as empty: no
    ids, an empty text. Other columns of the input are left out. An empty table gives an empty result. `model_path`
    must be readable on every node.
    """

    def run(batches):
        model = pieces.load(model_path)
        for batch in slices(batches):
            offsets, found, made = [0], [], []
            for text in batch.column("text").to_pylist():
                one = model.encode(text)
                found.append(one)
                offsets.append(offsets[-1] + len(one[0]))
                if decoded:
                    made.append(model.decode(one[0].tolist()))
            at = pa.array(offsets, pa.int32())
            columns = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([f[i] for f in found]).astype(np.int32))) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, *([pa.array(made, pa.string())] if decoded else [])], names=["doc_id", "ids", "starts", "ends", *(["decoded"] if decoded else [])]
            )

    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>" + (", decoded string" if decoded else "")
    return map_arrow(texts(documents), run, schema)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from rows (doc_id, ids), as the library decodes them. Null ids count as none; an id outside the
    vocabulary is an error."""

    def run(batches):
        model = pieces.load(model_path)
        for batch in batches:
            made = [model.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "text"])

    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")), run, "doc_id long, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the byte that the last span ends at (0 without ids), out of
    `encode`'s rows: one row for each, whether it has ids or not."""
    joined = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), joined("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"),
    )
