"""Removal of repeated 200-byte strings by partitioned suffix sorting.

Every start of a 200-byte string has an anchor: the place in the string where
the hash of the next ``GRAM`` bytes is least.  Equal strings have their anchors
at the same place, so only starts whose anchors agree need comparing.  Starts
next to each other mostly share their anchor; a *segment* is a run of starts
with one anchor, with the bytes that their strings cover.

1. Segments whose anchor occurs once in the corpus are dropped: their strings
   are unique.  This leaves the copies, whatever their number.
2. Segments with equal bytes are counted.  All strings of a segment that occurs
   twice or more are repeated, and one segment stands for the others.
3. Of the rest, those that share an anchor with a different segment are fetched
   and range-partitioned by the leading bytes of the anchor's suffix, with
   Spark's sampled splitters.  Each range sorts the suffixes of its segments
   eight bytes a character, going on into equal ones only, to a depth of 200
   bytes; equal neighbours are repeated strings.  A range ends only between
   different leading bytes, which are part of every string that could match, so
   no equal neighbours lie on two sides of a boundary.
4. The suffixes of an anchor with very many different segments (a passage in
   very many documents has two at its edges in each) are dealt on by their own
   leading bytes, into as many parts as it takes to keep each at about ``crowd``
   segments; a segment goes to a part with the starts that belong there.  Before
   that, equal suffixes of a batch are marked and go on as one.  A part that is
   still large is sorted in steps, of which each passes on one of each different
   suffix.

Segments count as equal if 64-bit hashes of their anchors and 128-bit hashes of
their bytes agree; suffixes are compared by their bytes.  Texts travel
compressed, and twice: for step 3 and for the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Shelf, byte_slices, stash, text_or_empty

LENGTH = 200
GRAM = 32
CROWD = 500
_CHUNK = 1 << 20
#: Bytes of segments whose suffixes are sorted in one step; suffixes of crowded anchors that are dealt in one.
_SORT = 24 << 20
_DEAL = 400_000
#: Bytes of text a Python step works on at a time; its arrays take some 150 bytes for each.
_STEP = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; doubles the span from 1 byte to GRAM."""
    h, span = _mix(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while span < GRAM:
        h = h[: len(h) - span] * np.uint64(0x9FB21C651E98DF25) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return _mix(h)


def segments(raw: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, anchor's place and anchor's hash of each segment; valid marks the starts."""
    starts = len(raw) - length + 1
    grams = _gram_hashes(raw)
    span = length - GRAM + 1
    low = grams & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while 2 * done <= span:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    anchor = (low[:starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[: starts - 1]]) & valid[:starts]
    first = np.flatnonzero(new)
    total = np.concatenate([[0], np.cumsum(valid[:starts])])
    stops = np.concatenate([first[1:], [starts]])
    return first, total[stops] - total[first], anchor[first], grams[anchor[first]]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """Runs of whole texts, or parts of a long text that overlap by length - 1: first text, its offset, bytes, text of each byte, valid starts."""
    if len(texts) == 1 and len(texts[0]) > _CHUNK:
        for at in range(0, len(texts[0]) - length + 1, _CHUNK):
            part = texts[0][at : at + _CHUNK + length - 1]
            yield 0, at, part, np.zeros(len(part), np.int64), np.arange(len(part)) <= len(part) - length
        return
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    yield 0, 0, whole, owner, np.arange(len(whole)) + length <= ends


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """key, gram, body, more (hashes of anchor and bytes), at (packed start, starts, place of the anchor) of every segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", _STEP):
            keys = batch.column(0).to_numpy()
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
            for _, base, whole, owner, valid in _pieces(texts, length):
                if len(whole) < length or not valid.any():
                    continue
                first, n, anchor, gram = segments(np.frombuffer(whole, np.uint8), valid, length)
                body = np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a : a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist())]), np.int64).reshape(-1, 2)
                start = first - begins[owner[first]] + base
                at = (start << 20) | (n << 10) | (anchor - first)
                yield pa.record_batch([pa.array(keys[owner[first]]), pa.array(gram.view(np.int64)), pa.array(np.ascontiguousarray(body[:, 0])), pa.array(np.ascontiguousarray(body[:, 1])), pa.array(at)], names=["key", "gram", "body", "more", "at"])

    return docs.mapInArrow(cut, "key long, gram long, body long, more long, at long")


def repeated_starts(whole: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings whole[s : s + length] equal another: sorted by eight bytes a character, equal ones by the next."""
    raw = np.frombuffer(whole + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    active, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(active):
            break
        key = np.ascontiguousarray(words[starts[active] + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, group))
        key, of = key[order], group[order]
        same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        names = np.cumsum(np.concatenate([[True], ~same]))
        active, group = active[order][keep], names[keep]
    out = np.zeros(len(starts), bool)
    out[active] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort_groups(length: int):
    """For rows (gram, part, key, first, single, starts, bytes) in the order of gram and part: repeated ranges of the single ones."""

    def flush(rows: list[tuple], last: bool) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Spans (key, span); unless it is the ``last`` step of a group, one row of each different suffix too."""
        starts, owner, at = [], [], 0
        for k, (_, _, _, _, _, chosen, body) in enumerate(rows):
            own = np.arange(len(body) - length + 1) if chosen is None else np.frombuffer(chosen, "<u2").astype(np.int64)
            starts.append(at + own)
            owner.append(np.full(len(own), k))
            at += len(body)
        whole, starts, owner = b"".join(r[6] for r in rows), np.concatenate(starts), np.concatenate(owner)
        begin = np.cumsum([0] + [len(r[6]) for r in rows[:-1]])
        hit = repeated_starts(whole, starts, length)
        spans = []
        single = np.array([r[4] for r in rows])[owner]
        for k in np.unique(owner[hit & single]).tolist():
            own = starts[(owner == k) & hit] - begin[k]
            breaks = np.flatnonzero(np.diff(own) > 1)
            for x, y in zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(own) - 1]):
                spans.append((rows[k][2], (rows[k][3] + int(own[x])) << 32 | (rows[k][3] + int(own[y]) + length)))
        rest = []
        if not last:
            seen = set()
            for s, k, again in zip(starts.tolist(), owner.tolist(), hit.tolist()):
                string = whole[s : s + length]
                if string not in seen:
                    seen.add(string)
                    rest.append((*rows[k][:3], rows[k][3] + s - int(begin[k]), rows[k][4] and not again, None, string))
        return spans, rest

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, grown = [], 0, _SORT
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "part", "key", "first", "single", "starts", "bytes")]
            spans: list[tuple[int, int]] = []
            for row in zip(*cols):
                if rows and size > _STEP and row[:2] != rows[-1][:2]:
                    spans += flush(rows, True)[0]
                    rows, size, grown = [], 0, _SORT
                elif size > grown:
                    of = [r for r in rows if r[:2] == row[:2]]
                    if len(of) < len(rows):
                        spans += flush([r for r in rows if r[:2] != row[:2]], True)[0]
                        rows = of
                    found, rows = flush(rows, False)
                    spans += found
                    size = sum(len(r[6]) for r in rows)
                    grown = size + _SORT
                rows.append(row)
                size += len(row[6])
            yield pa.record_batch([pa.array([k for k, _ in spans], pa.int64()), pa.array([x for _, x in spans], pa.int64())], names=["key", "span"])
        spans = flush(rows, True)[0] if rows else []
        yield pa.record_batch([pa.array([k for k, _ in spans], pa.int64()), pa.array([x for _, x in spans], pa.int64())], names=["key", "span"])

    return sort


def _fetch(length: int):
    """For rows (key, packed, segments): the bytes of each segment, those of crowded anchors by part; spans found on the way."""
    names = ["lead", "gram", "part", "key", "first", "single", "starts", "bytes", "span"]
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            crowd: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                key, packed, wanted = (batch.column(batch.schema.get_field_index(c))[k] for c in ("key", "packed", "wanted"))
                text, out = unpack.decompress(packed.as_py()), []
                for x in wanted.as_py():
                    first, n, place = x["at"] >> 20, x["at"] >> 10 & 1023, x["at"] & 1023
                    row = (text[first + place : first + place + 16], x["gram"], x["parts"], key.as_py(), first, x["single"], text[first : first + n + length - 1])
                    if x["parts"] > 1:
                        crowd.append(row)
                        held += n
                    else:
                        out.append((*row[:2], 0, *row[3:6], None, row[6], None))
                if held > _DEAL or crowd and k == batch.num_rows - 1:
                    out += _dealt(crowd, length)
                    crowd, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return fetch


def _dealt(crowd: list[tuple], length: int) -> list[tuple]:
    """Segments of crowded anchors by the parts of their suffixes, with the starts there; of equal suffixes in these one goes on, and the spans of the others."""
    whole = b"".join(r[6] for r in crowd)
    begin = np.cumsum([0] + [len(r[6]) for r in crowd[:-1]])
    sizes = np.array([len(r[6]) - length + 1 for r in crowd])
    owner = np.repeat(np.arange(len(crowd)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = begin[owner] + place
    hit = repeated_starts(whole, starts, length)
    single = np.array([r[5] for r in crowd])
    out: list[tuple] = []
    goes, known = np.ones(len(starts), bool), single[owner] & ~hit
    seen: set[bytes] = set()
    for i in np.flatnonzero(hit).tolist():
        string = whole[starts[i] : starts[i] + length]
        goes[i] = string not in seen
        seen.add(string)
    part = np.array([zlib.crc32(whole[x : x + 16]) for x in starts.tolist()], np.int64) % np.array([r[2] for r in crowd], np.int64)[owner] + 1
    stops = np.cumsum(sizes).tolist()
    for r, n, stop in zip(crowd, sizes.tolist(), stops):
        here = slice(stop - n, stop)
        if r[5]:
            for x, y in _runs(hit[here]):
                out.append((b"", 0, -1, r[3], 0, False, None, None, (r[4] + x) << 32 | (r[4] + y - 1 + length)))
        for is_single in (True, False):
            mine = np.flatnonzero(goes[here] & (known[here] == is_single))
            of = part[here][mine]
            for p in np.unique(of).tolist():
                chosen = mine[of == p]
                low, high = int(chosen[0]), int(chosen[-1]) + length
                out.append((r[0], r[1], p, r[3], r[4] + low, is_single, (chosen - low).astype("<u2").tobytes(), r[6][low:high], None))
    return out


def _result(length: int):
    """For rows (doc_id, packed, spans): what is removed and what is kept."""

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                text = unpack.decompress(packed.as_py())
                merged: list[list[int]] = []
                for x in sorted(spans or []):
                    a, b = x >> 32, x & 0xFFFFFFFF
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *[x for m in merged for x in m], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows))
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.record_batch([batch.column(0), *out], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return result


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Removed is every byte covered by a string of ``length`` bytes (40 to 800)
    that also starts anywhere else, judged on the input; matches never cross
    documents.

    Defined cases: a null text counts as empty; texts shorter than ``length``
    lose nothing; a null doc_id stays null; repeated rows are copies of each
    other, so all their bytes go if they are long enough; an empty table gives
    an empty result.  Other columns are not read.
    """
    if not GRAM + 8 <= length <= 800:
        raise ValueError("length must be from 40 to 800")
    body = text_or_empty(docs, text)
    keyed = docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in byte_slices(batches, "text", 1 << 20):
            packed = pa.array([squeeze.compress(x.as_buffer()) for x in batch.column(2)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), packed], names=["doc_id", "key", "packed"])

    texts = keyed.mapInArrow(pack, "doc_id long, key long, packed binary")
    with Shelf(docs.sparkSession) as shelf:
        found = _segment_rows(keyed.select("key", "text"), length)
        often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
        rows = shelf.put(found.join(often, "gram", "left_semi"), "segments")
        bodies = rows.groupBy("gram", "body", "more").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one"))
        bodies = shelf.put(bodies, "bodies")
        groups = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least")).filter("different > 1 and least = 1")
        copies = rows.join(bodies.filter("n > 1").select("gram", "body", "more"), ["gram", "body", "more"], "left_semi")
        whole = copies.select("key", F.expr("shiftleft(shiftright(at, 20), 32) | (shiftright(at, 20) + (shiftright(at, 10) & 1023) + %d)" % (length - 1)).alias("span"))
        parts = F.ceil(F.col("different") / crowd).cast("int").alias("parts")
        wanted = bodies.join(groups, "gram").select(F.col("one.key").alias("key"), F.struct("gram", F.col("one.at").alias("at"), (F.col("n") == 1).alias("single"), parts).alias("w"))
        wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
        once = texts.select("key", "packed").dropDuplicates(["key"]) if _may_repeat(keyed) else texts.select("key", "packed")
        schema = "lead binary, gram long, part int, key long, first long, single boolean, starts binary, bytes binary, span long"
        fetched = shelf.put(once.join(wanted, "key").select("key", "packed", "wanted").mapInArrow(_fetch(length), schema), "fetched")
        ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sortable = fetched.filter("span is null").repartitionByRange(ranges, "lead", "gram", "part").sortWithinPartitions("lead", "gram", "part")
        sorted_spans = sortable.select("gram", "part", "key", "first", "single", "starts", "bytes").mapInArrow(_sort_groups(length), "key long, span long")
        sorted_spans = sorted_spans.union(fetched.filter("span is not null").select("key", "span"))
        spans = stash(whole.union(sorted_spans).groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")
    joined = texts.join(spans, "key", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_result(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _may_repeat(keyed: DataFrame) -> bool:
    """Whether some rows agree in id and text: one pass over keys."""
    return not keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
