"""Token counts of whole texts, encoded in batches; only lengths leave the workers.

Batches hold about equal numbers of bytes, whatever the lengths of their texts; a long text is cut into
portions at white space, where no token can cross.  Counts are those of the library with special
strings inside texts handled as its default.  Null and empty texts have 0 tokens, repeated rows are counted
each by itself, an empty table gives no rows, and extra columns are not read.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import n_bytes, own, tidy
from factloom.llm.tokens import BATCH, by_bytes, encoder, vocabulary


def count_tokens(df: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(vocabulary(name))
        for batch in batches:
            counts: list[int] = []
            for portion in by_bytes((t or "" for t in batch["text"].to_pylist()), BATCH, batch["n_bytes"].to_pylist()):
                if len(portion) == 1:
                    counts.append(sum(map(len, counter.encode(portion[0]))) // 4)
                else:
                    counts.extend(len(ids) // 4 for ids in counter.encode_all(portion))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = own(df, doc_id=doc_id, text=text).withColumn("n_bytes", n_bytes(F.col("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(tidy(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
