"""Token counts of whole texts: Arrow batches in, lengths only out.

Record batches are cut into runs of about equal bytes, whatever the number of
rows, and a text longer than ``split_bytes`` is worked on in parts cut at white
space, which the tokenizer drops and no token crosses.  Lengths are summed over
a text's parts, so a very long text never holds more than one part's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import BATCH_BYTES, byte_slices, safe_parts, text_or_empty
from tideline.llm.words import TABLE_BYTES, word_table


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id", split_bytes: int = BATCH_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Defined cases: a null text counts as empty and has 0 tokens; a null doc_id
    stays null; repeated rows are counted each; an empty table gives an empty
    result.  Other columns are not read.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer, False, table_bytes)
        for batch in byte_slices(batches, "text", split_bytes):
            n_bytes, n_tokens = [], []
            rows = [x.as_buffer() for x in batch.column(1)]
            if batch.num_rows == 1:
                raw = rows[0].to_pybytes()
                total = 0
                for part in safe_parts(raw, split_bytes):
                    words = table.split(part)
                    table.learn(set(words))
                    total += sum(table.lookup(words))
                n_bytes, n_tokens = [len(raw)], [total]
            else:
                split = [table.split(x.to_pybytes()) for x in rows]
                table.learn(set().union(*split))
                n_bytes = [x.size for x in rows]
                n_tokens = [sum(table.lookup(words)) for words in split]
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
