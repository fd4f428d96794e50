"""Best-fit packing of token sequences after dominance reduction.

Token counts are at most the capacity, so the instance is a histogram of
lengths: its size is bounded by the capacity, whatever the number of documents.
The driver plans on the histogram alone:

1. Reduction after Martello and Toth: from the longest length on, sets that
   provably dominate every alternative are fixed for good and leave the
   instance.  A piece that no other fits beside is a sequence of its own; a
   piece and another that fill the capacity exactly dominate; where only one
   (or two) more can fit beside a piece, the longest that fits dominates (if it
   is at least as long as any two that fit together, or else that pair if
   nothing longer than it exists).
2. What remains is packed best-fit decreasing.

Pieces of equal length are interchangeable, so both steps work on runs: a
group of equal sequences has one entry with its multiplicity.  Every piece then
gets a rank among those of its length, counted in salted parts, and finds its
sequence and offset in the plan by that rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import BATCH_BYTES, byte_slices, stash, text_or_empty
from tideline.llm.common import safe_parts
from tideline.llm.words import TABLE_BYTES, word_table

#: Pieces in one part of a length's ranking, about; each length has the same number of parts.
RANK_ROWS = 50_000


@dataclass
class Group:
    """``count`` equal sequences; runs: (length, how many) in the order of their places."""

    count: int
    left: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Groups that some optimal packing has, and the lengths that remain."""
    left = {s: n for s, n in counts.items() if n}
    fixed: list[Group] = []

    def take(*members: int) -> None:
        """Fix a set as often as the lengths last: what dominates once does so while its members remain."""
        runs = {s: members.count(s) for s in members}
        times = min(left[s] // q for s, q in runs.items())
        fixed.append(Group(times, capacity - sum(members), list(runs.items())))
        for s, q in runs.items():
            left[s] -= times * q
            if not left[s]:
                del left[s]

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while s in left and (chosen := _dominating(left, s, capacity - s)) is not None:
                take(s, *chosen)
                changed = True
    return fixed, left


def _dominating(left: dict[int, int], s: int, room: int) -> tuple[int, ...] | None:
    """What goes beside one ``s`` in a set that dominates all other sets with it; None if none is proven."""
    if left.get(room, 0) > (room == s):
        return (room,)
    others = sorted((t, n - (t == s)) for t, n in left.items() if t <= room and n > (t == s))
    if not others:
        return ()
    if sum(n for t, n in others if 3 * t <= room) > 2 or _most(others, room, 3) > 2:
        return None
    best = others[-1][0]
    pair = _best_sum(others, room)
    if pair <= best:
        return (best,)
    # the longest that fits, with the longest beside it, dominates if any two that fit hold one no longer than the latter
    rest = [(t, n - (t == best)) for t, n in others if n > (t == best)]
    second = max((t for t, _ in rest if t <= room - best), default=0)
    longer = [t for t, n in rest if t > second for _ in range(min(n, 2))][:2]
    if second and (len(longer) < 2 or sum(longer) > room):
        return (best, second)
    return None


def _most(others: list[tuple[int, int]], room: int, enough: int) -> int:
    """How many of the shortest fit together, up to ``enough``."""
    k = 0
    for t, n in others:
        for _ in range(min(n, enough - k)):
            if t > room:
                return k
            room -= t
            k += 1
        if k == enough:
            break
    return k


def _best_sum(others: list[tuple[int, int]], room: int) -> int:
    """The largest sum of two that fit together, 0 if none do."""
    best = max((2 * t for t, n in others if n > 1 and 2 * t <= room), default=0)
    lo, hi = 0, len(others) - 1
    while lo < hi:
        both = others[lo][0] + others[hi][0]
        if both > room:
            hi -= 1
        else:
            best, lo = max(best, both), lo + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on runs: each piece goes where the least room is left that holds it."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []
    done: list[Group] = []

    def put(g: Group) -> None:
        if g.left not in by_room:
            by_room[g.left] = []
            insort(rooms, g.left)
        by_room[g.left].append(g)

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                put(Group(-(-n * s // (capacity // s * s)) if capacity // s * s else n, capacity))
                continue
            room = rooms[k]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            q = room // s
            full = min(g.count, n // q)
            if full:
                put(Group(full, room - q * s, [*g.runs, (s, q)]))
                n -= full * q
            rest = g.count - full
            if rest and n:  # fewer than q are left: they go into one sequence
                put(Group(1, room - n * s, [*g.runs, (s, n)]))
                n, rest = 0, rest - 1
            if rest:
                put(Group(rest, room, g.runs))
    for groups in by_room.values():
        done += [g for g in groups if g.runs]
    return done


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """A row for each run of each group: pieces of ``length`` from rank ``first`` on, ``per`` in a sequence."""
    rows, taken, sequence = [], {}, 0
    for g in groups:
        at = 0
        for s, q in g.runs:
            rows.append((s, taken.get(s, 0), q, sequence, at))
            taken[s] = taken.get(s, 0) + q * g.count
            at += s * q
        sequence += g.count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(len(rows), 5).T
    return dict(zip(("length", "first", "per", "sequence", "at"), cols))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids]: each document's ids and ``end_id``, cut only if longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer, True, table_bytes)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in byte_slices(batches, "text", BATCH_BYTES // 2):
            rows: list[tuple] = []
            raw = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            if len(raw) > 1:
                split = [table.split(t) for t in raw]
                table.learn(set().union(*split))
                ids = [b"".join([*table.lookup(words), tail]) for words in split]
            else:
                parts = []
                for part in safe_parts(raw[0], BATCH_BYTES // 2):
                    words = table.split(part)
                    table.learn(set(words))
                    parts.append(b"".join(table.lookup(words)))
                ids = [b"".join([*parts, tail])]
            for d, whole in zip(batch.column(0).to_pylist(), ids):
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    one = whole[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(one) // 4, zlib.crc32(one), one))
            cols = list(zip(*rows))
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
            yield pa.record_batch(out, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset.

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens.

    Defined cases: a null text counts as empty and is a piece of ``end_id``
    alone; a null doc_id stays null; repeated rows are packed each (pieces that
    agree in all columns may trade places); an empty table gives an empty
    result.  Other columns are not read.
    """
    pieces = stash(token_pieces(docs, tokenizer, capacity, end_id, text, doc_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = _slots(plan(counts, capacity))
    parts = max(16, -(-sum(counts.values()) // RANK_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    sized = pieces.groupBy("length", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sized.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("part", part).withColumn("inside", inside).join(before, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))
    step = np.int64(1) << np.int64(44)
    keys = slots["length"] * step + slots["first"]
    own = len(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * step + rank, side="right") - 1
            nth = rank - slots["first"][k]
            sequence = slots["sequence"][k] + nth // slots["per"][k]
            offset = slots["at"][k] + nth % slots["per"][k] * length
            yield pa.record_batch([*batch.columns[:own], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:own], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
