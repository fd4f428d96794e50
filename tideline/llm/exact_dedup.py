"""Exact deduplication against a history held in minimal perfect hash tables.

The digests of documents seen before (the history) are dealt into shards by
their leading bits.  Each shard builds a minimal perfect hash over its distinct
digests; a slot holds the whole digest and the locator of the document that
stays, with the number of its copies.  An arriving digest is looked up in its
shard's table and compared with the slot byte by byte: a perfect hash sends
every key, members or not, to some slot.  Members join the slot's group;
nonmembers are grouped among themselves.

Copies are aggregated to one row a digest before any shuffle, so a text that a
third of all rows share costs its shard one row from each map task.  The
verdicts go back to the rows by a join on the digest that adaptive execution
splits when one digest is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stash, text_or_empty

#: Distinct digests in a shard, about; a shard's table takes some 50 bytes a digest.
SHARD_KEYS = 200_000
GROUPS = "digest binary, keep_id long, group_size long, n_keep long"
GAMMA = 1.6
LEVELS = 40


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte keys: one bit vector a level, ranks give the slot.

    A key takes its place on the first level where no other remaining key
    claims it.  Keys left after the last level, if any, are kept in a sorted
    list behind the others.
    """

    def __init__(self, keys: np.ndarray):
        words = self._words(keys)
        left = np.arange(len(keys))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        placed = 0
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(8, int(GAMMA * len(left)))
            at = (_mix(words[left, 0], words[left, 1], level) % np.uint64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            self.levels.append((once, placed + np.cumsum(once) - 1))
            placed += int(once.sum())
            left = left[~once[at]]
        self.rest = {keys[i].tobytes(): placed + k for k, i in enumerate(left)}
        self.size = len(keys)

    @staticmethod
    def _words(keys: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not a member, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        words, left = self._words(keys), np.arange(len(keys))
        for level, (once, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(words[left, 0], words[left, 1], level) % np.uint64(len(once))).astype(np.int64)
            hit = once[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        if self.rest:
            for i in left:
                out[i] = self.rest.get(keys[i].tobytes(), -1)
        return out


def _digests(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(t.num_rows, 32)


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t.column(name), np.iinfo(np.int64).min).to_numpy()


def _merge(history: pa.Table, batch: pa.Table) -> pa.RecordBatch:
    """Groups of one shard: the history's slots with what the batch adds, then the batch's own."""
    old, new = _digests(history), _digests(batch)
    table = PerfectHash(old)
    slot_digest = np.zeros((table.size, 32), np.uint8)
    slot_values = {c: np.zeros(table.size, np.int64) for c in ("keep_id", "group_size", "n_keep")}
    where = table.slots(old)
    slot_digest[where] = old
    for c, v in slot_values.items():
        v[where] = _ints(history, c)
    at = table.slots(new)
    member = at >= 0
    member[member] = (slot_digest[at[member]] == new[member]).all(axis=1)
    into = at[member]
    got = {c: _ints(batch, c) for c in slot_values}
    keep, theirs = slot_values["keep_id"][into], got["keep_id"][member]
    slot_values["n_keep"][into] = np.where(theirs > keep, got["n_keep"][member], np.where(theirs < keep, slot_values["n_keep"][into], slot_values["n_keep"][into] + got["n_keep"][member]))
    slot_values["keep_id"][into] = np.maximum(keep, theirs)
    slot_values["group_size"][into] += got["group_size"][member]
    digests = np.concatenate([slot_digest, new[~member]])
    values = {c: np.concatenate([v, got[c][~member]]) for c, v in slot_values.items()}
    unknown = values["keep_id"] == np.iinfo(np.int64).min
    columns = [pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(values["keep_id"], pa.int64(), mask=unknown), *[pa.array(values[c], pa.int64()) for c in ("group_size", "n_keep")]]
    return pa.record_batch(columns, names=["digest", "keep_id", "group_size", "n_keep"])


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        for shard in pc.unique(t.column("shard")):
            part = t.filter(pc.equal(t.column("shard"), shard))
            yield _merge(part.filter(part.column("old")), part.filter(pc.invert(part.column("old"))))


def digest_groups(digests: DataFrame) -> DataFrame:
    """(doc_id, digest) to one row a digest: keep_id (the largest doc_id), group_size, n_keep (rows that bear keep_id)."""
    per_id = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.coalesce(F.max(F.struct("doc_id", "n"))["n"], F.lit(0)).alias("n_keep"),
    )


def merge_groups(history: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Groups of the history's and the batch's digests together; both as digest_groups() returns them."""
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    both = history.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
    return both.withColumn("shard", shard).repartition(shards, "shard").mapInArrow(_merge_shards, GROUPS)


def _digests_of(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(df[doc_id].cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(df, text), 256)).alias("digest"))


def write_table(groups: DataFrame, path: str, shards: int) -> None:
    """Store groups as a history, a folder for each of ``shards`` ranges of digests; ``read_table`` gives them back."""
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    groups.withColumn("shard", shard).repartition(shards, "shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """digest, keep_id, group_size, n_keep of a stored history."""
    return spark.read.schema(GROUPS).parquet(path).select("digest", "keep_id", "group_size", "n_keep")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", shard_keys: int = SHARD_KEYS, table: str | None = None, store: str | None = None) -> DataFrame:
    """One row per document with the document that stays of all with the same text.

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_keep.  Of equal
    texts the row with the largest doc_id stays.  ``history`` holds documents
    seen before (columns ``doc_id`` and ``text``), or ``table`` the folder of
    their groups: they take part in the groups but get no rows of their own.
    Without both, a half of ``docs`` dealt out by a hash of doc_id counts as the
    earlier arrival.  ``store`` names a folder for the groups of all, the next
    batch's ``table``.

    Defined cases: a null text counts as empty, so null and empty texts are
    copies of each other; a null doc_id is smaller than any other; rows that
    share text and doc_id are all ``kept`` when theirs is the largest (n_keep
    says how many: ``drop_copies`` keeps one of them); an empty table gives an
    empty result.  Other columns, whatever their names, are not read.
    """
    rows = stash(_digests_of(docs, text, doc_id), "digests")
    if table is not None:
        old, new = read_table(docs.sparkSession, table), digest_groups(rows)
    elif history is not None:
        old, new = digest_groups(stash(_digests_of(history, text, doc_id), "history")), digest_groups(rows)
    else:
        early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        old, new = digest_groups(rows.filter(early)), digest_groups(rows.filter(~early))
    known = 0 if table is None and history is None else old.count()
    shards = max(1, -(-(known + rows.count()) // shard_keys))
    groups = merge_groups(old, new, shards)
    if store is not None:
        write_table(groups, store, shards)
        groups = read_table(docs.sparkSession, store)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_keep",
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with their own columns.

    The verdicts (ids and digests only) are written to the shared folder first.
    """
    verdict = stash(exact_dedup(docs, text=text, doc_id=doc_id).filter("kept").select(F.col("doc_id").alias("_tl_id"), F.col("text_sha256").alias("_tl_digest"), "n_keep"), "exact")
    rows = docs.withColumn("_tl_id", docs[doc_id].cast("long"))

    def staying(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side.select(F.col("_tl_id").alias("_tl_keep")).distinct(), F.col("_tl_id").eqNullSafe(F.col("_tl_keep")), "left_semi")

    own = [F.col(f"`{c}`") for c in docs.columns]
    repeated = verdict.filter("n_keep > 1")
    if repeated.isEmpty() and verdict.filter("_tl_id is null").isEmpty():
        return staying(rows, verdict).select(*own)
    rows = rows.withColumn("_tl_digest", F.sha2(text_or_empty(docs, text), 256))
    match = (F.col("l._tl_digest") == F.col("r._tl_digest")) & F.col("l._tl_id").eqNullSafe(F.col("r._tl_id"))
    one = rows.alias("l").join(verdict.filter("n_keep = 1").alias("r"), match, "left_semi")
    few = rows.alias("l").join(repeated.distinct().alias("r"), match, "left_semi").dropDuplicates(["_tl_digest"])
    return one.unionByName(few).select(*own)
