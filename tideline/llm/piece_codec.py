"""SentencePiece encoding and decoding by a table of distinct marked words.

When no piece of the model crosses a white-space marker, the segmentation of a
text is the concatenation of the segmentations of its marked words.  Each
worker segments a distinct marked word once, keeps its ids and decoded bytes in
a table, and joins them back by position; nothing is shuffled.  A long text is
worked on in parts cut at single spaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import BATCH_BYTES, byte_slices, text_or_empty
from tideline.llm.words import TABLE_BYTES, piece_table


_BETWEEN = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def text_parts(text: str, size: int) -> Iterator[str]:
    """Cut at single spaces, which are left out, into parts of about ``size`` characters."""
    start = 0
    while len(text) - start > size and (found := _BETWEEN.search(text, start + size)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def encode_decode(docs: DataFrame, model: str, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES, part_chars: int = BATCH_BYTES // 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids array<int>, decoded string].

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256
    that of the decoded text in UTF-8; ``with_ids`` adds the ids and the decoded
    text themselves.

    Defined cases: a null text counts as empty and has no ids; a null doc_id
    stays null; repeated rows are encoded each; an empty table gives an empty
    result.  Other columns are not read.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model, table_bytes)
        for batch in byte_slices(batches, "text", BATCH_BYTES // 2):
            texts = batch.column(1).to_pylist()
            if len(texts) == 1 and len(texts[0]) > part_chars:
                parts = []
                for part in text_parts(texts[0], part_chars):
                    chunks = table.chunks(part)
                    table.learn(set(chunks))
                    parts.append(table.encode(chunks))
                out = [(sum(x[0] for x in parts), b",".join(x[1] for x in parts), b" ".join(x[2] for x in parts))]
            else:
                split = [table.chunks(t) for t in texts]
                table.learn(set().union(*split))
                out = [table.encode(chunks) for chunks in split]
            hexes = [[hashlib.sha256(x[k]).hexdigest() for x in out] for k in (1, 2)]
            cols = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array(hexes[0]), pa.array(hexes[1])]
            if with_ids:
                cols += [pa.array([[int(i) for i in x[1].split(b",")] if x[0] else [] for x in out], pa.list_(pa.int32())), pa.array([x[2].decode() for x in out], pa.string())]
            yield pa.record_batch(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(code, schema)
