"""Token counts by rank-synchronous merging (see ``bpe``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, pieces_of, texts_of


def token_counts(docs: DataFrame, path: str, limit: int = 1024, kind: str = "byte",
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass and without a shuffle.

    ``path`` is the vocabulary file, ``kind`` its rules ("byte" or "word", see ``tokens``).  A null or empty text
    has 0 bytes and 0 tokens; repeated rows give repeated results; null keys are kept; other columns are not read.
    Texts are taken in slices of a bounded number of bytes, a longer text is a slice of its own.
    """
    def count(batches):
        tool = encoder(kind, path)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                texts = texts_of(part, "text")
                n = tool.counts(texts)
                size = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), size, pa.array(n, pa.int64()), pa.array(np.greater(n, limit))],
                    names=["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(count, f"key {kind_of_key}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
