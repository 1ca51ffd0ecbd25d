"""Token ids of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmap.llm.bpe import default_vocabulary, encoder


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of each text without special tokens, whose strings are ordinary text.

    A map over the rows without a shuffle. Null and empty texts have the empty list. Texts of any length are encoded
    whole, in time linear in their length; repeated rows and null keys are kept. Other columns are ignored, also one
    that is named ``ids``; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "ids"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").toDF(key, "ids")
