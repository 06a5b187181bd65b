"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken
from ._common import map_arrow, slices, texts


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> pretoken.Counter:
    return pretoken.Counter(path)


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text as the tokenizer's library counts them.

    Pre-tokens that are proven to encode alone as one token count one; the others are merged once and
    remembered (a bounded table for each Python worker). Texts with a special string or with code points on which
    Unicode versions differ are encoded whole by the library. No shuffle; memory is that of a slice of one batch.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one row for each input row, repeated
    rows and null ids included. A null text counts as empty: 0 bytes, 0 tokens. Other columns of the input are left
    out. An empty table gives an empty result. `tokenizer_path` must be readable on every node.
    """

    def run(batches):
        counter = _counter(tokenizer_path)
        for batch in slices(batches):
            n_bytes, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(texts(documents), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
