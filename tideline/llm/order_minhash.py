"""Near-duplicate detection by order MinHash, verified by banded alignment.

The k-mers are runs of five words, each labelled with its occurrence number in
its text.  A sketch takes the two smallest labelled k-mers under one hash
function and keeps them in text order, so it agrees with a probability that
falls with the edit distance, not only with the shared set.  Two texts are
candidates if at least one of ``SKETCHES`` sketches agrees, and near copies if
their word-level edit similarity, 1 - distance / longer length, is at least
``SIMILARITY``; the distance comes from a bit-parallel alignment in a band just
wide enough for that bound, so a verdict is exact for each candidate pair.

Equal texts are represented by one of them from the sketches on; buckets of one
text are dropped by the exchange that forms buckets.  Then three steps each
leave out pairs that earlier links have joined, which changes no class:

1. Star: a bucket's texts with its first one, if the bucket is small or the two
   share several sketches.  This joins most of a large group of near copies.
2. Buckets of at most ``SMALL`` texts: all pairs.
3. The texts of larger buckets that still hold several components meet by their
   rarest words instead of by buckets, so a passage in very many documents costs
   no more than its share.  Within the bound, an edit changes one word, so two
   near copies of up to ``d`` edits have one of their ``d`` + 1 rarest labelled
   words in common, whatever the order of rarity (word pairs: ``2 d`` + 1), and
   if common words alone do not suffice for the bound, a rare one.
   What two texts have in common is counted over all parts, by rows of many
   pairs, before any text is moved.  Every pair that this count and its lengths
   do not rule out is aligned, the likeliest first: this finds all near copies
   among these texts, with a common sketch or without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Shelf, byte_slices, safe_parts, stash, text_or_empty
from tideline.llm.components import components
from tideline.llm.words import forget

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 96
SMALL = 12
#: Common sketches from which on a text is compared with the first one of a larger bucket.
SURE = 12
#: Rare words in a part of step 3, about; texts that its order of rarity is learned from (more or fewer change no result).
PART = 1_000_000
LEARNED = 8192
LEARNED_WORDS = 1 << 21
#: Texts with one rare word in common that meet in one place; more are dealt into blocks.
HOT = 4000
#: Texts on a side of a square of pairs that are aligned together.
BLOCK = 64
#: Rounds of step 3 that align the likeliest candidate of each text; the rest comes last.
ROUNDS = 2
#: Texts in a block of step 3, pairs of which are aligned by squares; pairs in one row.
CROWD = 2048
SQUARE = 50_000
#: Cells, at least, that the pairs of step 3 are dealt into to be counted; as many as the square of the parts, if that is more.
CELLS = 32

_PRIME = 0x9E3779B97F4A7C15
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r\x0b\x0c")] = True
_POWERS: list[np.ndarray] = []
#: Bytes of text that words are hashed from at a time; bytes from which on a word has a hash of another kind.
_LONG = 1 << 20
_GIANT = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        ones = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([ones, np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_PRIME, pow(_PRIME, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every white-space separated word of all texts, and the number of words of each text.

    A text of more than ``_LONG`` bytes is worked on in parts cut at white space.
    """
    if all(len(t) <= _LONG for t in texts):
        return _block_hashes(texts)
    found = []
    for t in texts:
        parts = [np.zeros(0, np.uint64)]
        for part in safe_parts(t, _LONG):
            if len(part) <= 2 * _LONG:
                parts.append(_block_hashes([part])[0])
            else:  # words longer than a block
                words = part.split()
                parts.append(np.array([_giant(w) if len(w) > _GIANT else int(_block_hashes([w])[0][0]) for w in words], np.uint64))
        found.append(np.concatenate(parts))
    return np.concatenate(found), np.array([len(f) for f in found], np.int64)


def _block_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up[: len(raw)], dtype=np.uint64)])
    hashes = _mix((total[stops] - total[starts]) * down[starts])
    for k in np.flatnonzero(stops - starts > _GIANT).tolist():
        hashes[k] = _giant(raw[starts[k] : stops[k]].tobytes())
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))


def _giant(word: bytes) -> int:
    """Hash of a word too long for sums of powers."""
    return xxhash.xxh3_64_intdigest(word)


def labelled_kmers(hashes: np.ndarray, counts: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence numbers, text after text, and how many each text has.

    A text of fewer than k words, but at least one, has one k-mer of all its words.
    """
    short = (counts > 0) & (counts < k)
    n = np.where(counts >= k, counts - k + 1, short.astype(np.int64))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(_PRIME) + padded[at + j] * (at + j < (first + counts)[owner])
    out = _mix(out)
    key = out ^ _mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        again = np.unique(again)
        where = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
        part = np.flatnonzero(where)
        order = part[np.argsort(key[part], kind="stable")]
        runs = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        nth = np.arange(len(order)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(order)]])))
        out[order] = np.where(nth > 0, _mix(out[order] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), out[order])
    return out, n


_HASHES = np.random.Generator(np.random.PCG64(7)).integers(0, (1 << 64) - 1, (SKETCHES, 2), np.uint64, endpoint=True) | np.array([0, 1], np.uint64)


def sketches(kmers: np.ndarray, n: np.ndarray, number: int = SKETCHES) -> np.ndarray:
    """A row for each text with at least one k-mer: ``number`` order sketches of two k-mers each."""
    n = n[n > 0]
    starts = np.cumsum(n) - n
    out = np.empty((len(n), number), np.uint64)
    one = n == 1
    # a hash value carries its k-mer's place in its low bits
    low = np.uint64((1 << max(24, len(kmers).bit_length())) - 1)
    place = np.arange(len(kmers), dtype=np.uint64)
    for i in range(number):
        v = ((kmers ^ _HASHES[i, 0]) * _HASHES[i, 1]) & ~low | place
        first = (np.minimum.reduceat(v, starts) & low).astype(np.int64)
        v[first] = _MAX
        second = np.where(one, first, (np.minimum.reduceat(v, starts) & low).astype(np.int64))
        a, b = np.minimum(first, second), np.maximum(first, second)
        out[:, i] = _mix(kmers[a] * np.uint64(3) + np.where(one, np.uint64(0), _mix(kmers[b])))
    return out


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance of two sequences, or ``most`` + 1 if it is larger: bit-parallel, in a band of 2 * most + 1."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while n > lo and a[len(a) - 1 - (min(len(a), len(b)) - n)] == b[len(b) - 1 - (min(len(a), len(b)) - n)]:
        n -= 1
    cut = min(len(a), len(b)) - n
    a, b = a[lo : len(a) - cut], b[lo : len(b) - cut]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 1
    full, top = (1 << width) - 1, width - 1
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    vp, vn, distance, start = full ^ ((1 << (top - most)) - 1), 0, most, most + 1 - width
    limit = 2 * most + len(b) - len(a)
    steep = max(0, len(a) - most)
    row = top - 1
    for j, x in enumerate(b):
        pm = places.get(x, 0)
        if pm:
            pm = (pm >> start if start > 0 else pm << -start) & full
        d0 = (((pm & vp) + vp) ^ vp | pm | vn) & full
        hp = vn | full & ~(d0 | vp)
        hn = d0 & vp
        if j < steep:
            distance += not d0 >> top & 1
        else:
            distance += (hp >> row & 1) - (hn >> row & 1)
            row -= 1
        if distance > limit:
            return most + 1
        d0 >>= 1
        vp = hn | full & ~(d0 | hp)
        vn = d0 & hp
        start += 1
    return min(distance, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """Edit similarity of two word sequences if it is at least ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    d = edit_distance(a.tolist(), b.tolist(), most)
    return 1 - d / longer if d <= most else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, n_words, sketch for batches of doc_id and text."""
    forget()
    for batch in byte_slices(batches, "text", 1 << 20):
        raw = [x.as_buffer().to_pybytes() for x in batch.column(1)]
        hashes, counts = word_hashes(raw)
        kmers, n = labelled_kmers(hashes, counts)
        found = sketches(kmers, n).view(np.int64) if len(kmers) else np.zeros((0, SKETCHES), np.int64)
        offsets = np.concatenate([[0], np.cumsum((n > 0) * SKETCHES)]).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
        yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(t).digest()[:16] for t in raw], pa.binary()), pa.array(counts.astype(np.int64)), sketch], names=["doc_id", "digest", "n_words", "sketch"])


def sketch_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest, n_words, sketch of every row of ``docs``; the sketch of a text without words is empty."""

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(_sketched, "doc_id long, digest binary, n_words long, sketch array<long>")


def _comparable(a: str, b: str, least: float):
    """Lengths between which the similarity can be reached."""
    return F.abs(F.col(a) - F.col(b)) <= (1 - least) * F.greatest(a, b) + 1e-9


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, id, n_words, n, first) of the buckets of two texts or more: their size and the smallest id in them."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("sketch")[i]) for i in range(SKETCHES)])
    whole = Window.partitionBy("bucket")
    members = rows.select("id", F.col("n_words").cast("int").alias("n_words"), F.explode(keys).alias("bucket"))
    counted = members.select("bucket", "id", "n_words", F.count(F.lit(1)).over(whole).alias("n"), F.min(F.struct("id", "n_words")).over(whole).alias("first"))
    return counted.filter("n > 1")


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that hold texts of several components."""
    whole = Window.partitionBy("bucket")
    named = members.select("bucket", "id", "n_words").join(label, "id")
    ranged = named.withColumns({"low": F.min("root").over(whole), "high": F.max("root").over(whole)})
    return ranged.filter("low < high").drop("low", "high")


def _relabel(label: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """The labels after further links, which join whole components."""
    roots = links.join(label.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(label.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    apart = shelf.put(roots.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "roots")
    if apart.isEmpty():
        return label
    merged = components(apart, shelf)
    new = label.join(merged.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left")
    return shelf.put(new.select("id", F.coalesce("new", "root").alias("root")), "label")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) of texts that are in different components by now."""
    ra, rb = (label.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(ra, "a").join(rb, "b").filter("ra != rb").drop("ra", "rb")


def near_roots(members: DataFrame, docs: DataFrame, shelf: Shelf, least: float = SIMILARITY, small: int = SMALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, root) for the ``members`` of shared buckets: the largest id that near-copy links join each to.

    The texts of these are read once, as words.
    """
    label = shelf.put(members.select("id").distinct().select("id", F.col("id").alias("root")), "label")
    words = shelf.put(word_lists(label.select("id"), docs, text, doc_id), "words")

    star = members.filter(F.col("id") != F.col("first.id")).select(F.col("first.id").alias("a"), F.col("id").alias("b"), "n_words", F.col("first.n_words").alias("nb"), "n")
    often = star.filter(_comparable("n_words", "nb", least)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("n").alias("n"))
    label = _relabel(label, verified(often.filter((F.col("n") <= small) | (F.col("common") >= SURE)).select("a", "b", F.col("a").alias("hub")), words, shelf, least), shelf)

    few = shelf.put(_mixed(members.filter(F.col("n") <= small), label), "few")
    other = few.select("bucket", F.col("id").alias("b"), F.col("n_words").alias("nb"), F.col("root").alias("rb"))
    close = few.join(other, "bucket").filter((F.col("id") < F.col("b")) & (F.col("root") != F.col("rb")) & _comparable("n_words", "nb", least))
    label = _relabel(label, verified(close.select(F.col("id").alias("a"), "b").distinct().withColumn("hub", F.col("a")), words, shelf, least), shelf)

    shelf.drop("few")
    crowded = shelf.put(_mixed(members.filter(F.col("n") > small), label).select("id", "n_words", "root").distinct(), "crowded")
    if not crowded.isEmpty():
        words = shelf.put(words.join(crowded.select("id"), "id", "left_semi"), "crowded-words")
        met = shelf.put(_meetings(crowded, words, least), "met")
        for k in range(ROUNDS):
            apart = _apart(met.filter(F.col("x") < 0).select(F.col("y").alias("a"), F.col("b")[k].alias("b"), F.col("common")[k].alias("common")), label)
            likeliest = apart.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))
            label = _relabel(label, verified(likeliest.select("a", "b", F.col("b").alias("hub")), words, shelf, least), shelf)
        label = _relabel(label, _verified_squares(met.filter("x >= 0"), label, words, shelf, least), shelf)
    shelf.drop("members", "words", "few", "crowded", "crowded-words", "met", "left", "verified")
    return label


def most_edits(n: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The largest number of edits between a text of n words and any near copy."""
    longest = (n / least + 1e-9).astype(np.int64)
    return ((1 - least) * longest + 1e-9).astype(np.int64)


def elements(words: np.ndarray, size: int) -> np.ndarray:
    """Words, or pairs of consecutive words, as numbers that tell repeated ones apart by their occurrence."""
    x = words.astype(np.uint64)
    if size == 2 and len(x) > 1:
        x = x[:-1] * np.uint64(_PRIME) + x[1:]
    x = _mix(x)
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(x))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = x.copy()
    out[order] = np.where(nth > 0, _mix(ordered + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), ordered)
    return out


@dataclass(frozen=True)
class Rarity:
    """Order of elements from the rarest on: those not in ``common`` first; how many blocks the hot ones are dealt into."""

    size: int
    common: np.ndarray
    counts: np.ndarray
    hot: dict[int, int]

    def rarest(self, words: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The elements of which near copies have one in common, whether each is rare, and how many rare ones the text has."""
        found = elements(words, self.size)
        count = np.zeros(len(found), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            count = np.where(self.common[at] == found, self.counts[at], 0)
        n = self.size * int(most_edits(np.array([len(words)]), least)[0]) + 1
        order = np.lexsort((found, count))[:n]
        return found[order], count[order] == 0, int((count == 0).sum())


def learn_rarity(texts: list[np.ndarray], total: int, least: float = SIMILARITY) -> Rarity:
    """From some of ``total`` texts' words: the order of rarity for words or word pairs, whichever brings fewer texts together."""
    best = None
    for size in (1, 2):
        if size == 2 and least < SIMILARITY:
            break
        common, counts = np.unique(np.concatenate([elements(t, size) for t in texts]), return_counts=True)
        often = counts > 1
        order = Rarity(size, common[often], counts[often], {})
        keys, runs = np.unique(np.concatenate([order.rarest(t, least)[0] for t in texts]), return_counts=True)
        scale = total / len(texts)
        hot = {int(k): int(-(-n * scale // (HOT // 2))) for k, n in zip(keys[runs > 1], runs[runs > 1]) if n * scale > HOT}
        meetings = float((runs[runs > 1].astype(np.float64) ** 2).sum())
        if best is None or meetings < best[0] / 2:
            best = meetings, Rarity(size, order.common, order.counts, hot)
    return best[1]


def _dealt(found: np.ndarray, number: int, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sides of a text's elements: a hot element has a key for each pair of blocks with the text's own."""
    hot = [(k, x) for k, x in enumerate(found.tolist()) if x in rarity.hot] if rarity.hot else []
    if not hot:
        return found, np.zeros(len(found), np.uint8)
    plain = np.ones(len(found), bool)
    plain[[k for k, _ in hot]] = False
    keys, sides = [], []
    for _, x in hot:
        blocks = rarity.hot[x]
        own = number % blocks
        for other in range(blocks):
            keys.append((x + min(own, other) * 0x9FB21C651E98DF25 + max(own, other) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
            sides.append(0 if own == other else 1 if own < other else 2)
    return np.concatenate([found[plain], np.array(keys, np.uint64)]), np.concatenate([np.zeros(plain.sum(), np.uint8), np.array(sides, np.uint8)])


def _meetings(crowded: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(x, y, a, b, common): pairs of texts of the blocks x and y that may be near copies, and how many keys they have in common.

    Rows with x = -1 have the likeliest partners b of the text y.  ``crowded``
    has the ids, lengths and roots of the texts.
    """
    spark = crowded.sparkSession
    total, n_words = crowded.agg(F.count(F.lit(1)), F.sum("n_words")).first()
    texts = words.join(crowded, "id").select("id", "n_words", "root", "words")
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) <= int(min(1.0, LEARNED / total, LEARNED_WORDS / max(1, n_words)) * (1 << 20))
    # the order of rarity may be learned from any texts: it changes how many meet, not which near copies do
    learned = [np.frombuffer(r["words"], "<u4") for r in texts.filter(drawn & F.col("n_words").between(1, 4096)).limit(2 * LEARNED).select("words").collect()]
    rarity = learn_rarity(learned or [np.zeros(1, "<u4")], total, least)
    entries = crowded.agg(F.sum(F.col("n_words") * (1 - least) / least * rarity.size + 1).alias("n")).first()["n"]
    parts = int(entries // PART) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, n, root, raw in zip(*(batch.column(k) for k in range(4))):
                found, rare, n_rare = rarity.rarest(np.frombuffer(raw.as_buffer(), "<u4"), least)
                mixed = int(_mix(np.array([number.as_py()], np.int64).view(np.uint64))[0])
                for is_rare in (True, False):
                    keys, sides = _dealt(found[rare == is_rare], mixed, rarity)
                    part = (keys >> np.uint64(20)) % np.uint64(parts)
                    for p in np.unique(part).tolist():
                        own = part == p
                        rows.append((p, number.as_py(), n.as_py(), root.as_py(), n_rare, is_rare, keys[own].tobytes(), sides[own].tobytes()))
            cols = list(zip(*rows)) or [()] * 8
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["part", "id", "n_words", "root", "n_rare", "rare", "keys", "sides"])

    cells = max(CELLS, parts * parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            yield from _met(rows, rarity.size, cells, least)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            yield from _settled(rows)

    dealt = texts.mapInArrow(deal, "part long, id long, n_words long, root long, n_rare long, rare boolean, keys binary, sides binary")
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.repartition(min(parts, most), "part").sortWithinPartitions("part").mapInArrow(meet, "cell long, a binary, b binary, common binary, need binary")
    return met.repartition(min(cells, most), "cell").sortWithinPartitions("cell").mapInArrow(settle, "x long, y long, a array<long>, b array<long>, common array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with an equal first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if held and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def needed_rare(i: np.ndarray, j: np.ndarray, n: np.ndarray, n_rare: np.ndarray, size: int, least: float = SIMILARITY) -> np.ndarray:
    """How many rare elements the texts i and j must share to be near copies, at least (none: 0 or less).

    It is 1 in place of more where a text has more rare elements than its keys.
    """
    whole = np.maximum(n - size + 1, 1)
    most = size * ((1 - least) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64)
    need = np.maximum(whole[i], whole[j]) - most - np.minimum(whole[i] - n_rare[i], whole[j] - n_rare[j])
    keys = size * most_edits(n, least) + 1
    return np.where((n_rare[i] <= keys[i]) & (n_rare[j] <= keys[j]), need, np.minimum(need, 1))


def needed_common(i: np.ndarray, j: np.ndarray, n: np.ndarray, n_rare: np.ndarray, size: int, least: float = SIMILARITY) -> np.ndarray:
    """How many of their keys the texts i and j must share to be near copies, at least; only rare ones count where ``needed_rare`` is over 0.

    Near copies share all but ``most`` elements of the longer.  Of two texts' keys
    those of one, up to the less rare of their last ones, are all the elements of
    either that are as rare; so a shared element is a key of both, or it is one of
    the elements of this text that are no keys.  If that text has more rare
    elements than keys, its keys are all rare.
    """
    whole = np.maximum(n - size + 1, 1)
    keys = size * most_edits(n, least) + 1
    rest = np.maximum(whole - keys, 0)
    most = size * ((1 - least) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64)
    shared = np.maximum(whole[i], whole[j]) - most - np.maximum(rest[i], rest[j])
    rare = needed_rare(i, j, n, n_rare, size, least)
    return np.where((rare > 0) & (n_rare[i] <= keys[i]) & (n_rare[j] <= keys[j]), rare, shared)


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs and the sums of their counts."""
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def _met(rows: list[tuple], size: int, cells: int, least: float) -> Iterator[pa.RecordBatch]:
    """(cell, a, b, common, need): pairs of texts with keys of one part in common, how many, and how many they need of all parts."""
    _, every, n, roots, n_rare, rare, keys, sides = zip(*rows)
    ids, first, text = np.unique(np.array(every, np.int64), return_index=True, return_inverse=True)
    n, roots, n_rare = (np.array(c, np.int64)[first] for c in (n, roots, n_rare))
    each = [len(k) // 8 for k in keys]
    owner, is_rare = np.repeat(text, each), np.repeat(np.array(rare, bool), each)
    key = np.frombuffer(b"".join(keys), "<u8")
    side = np.frombuffer(b"".join(sides), np.uint8)
    order = np.argsort(key, kind="stable")
    owner, key, side, is_rare = owner[order], key[order], side[order], is_rare[order]
    pairs, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([pairs, *held]), np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)]))

    for i, j, by_rare in candidate_pairs(key, owner, side, is_rare, n, roots, least):
        useful = by_rare | (needed_rare(i, j, n, n_rare, size, least) <= 0)
        i, j = i[useful], j[useful]
        held.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
        if sum(map(len, held)) > 4_000_000:
            (pairs, counts), held = merged(), []
    pairs, counts = merged()
    i, j = pairs // len(ids), pairs % len(ids)
    need = needed_common(i, j, n, n_rare, size, least)
    cell = (_mix(ids.view(np.uint64).copy()) % np.uint64(cells)).astype(np.int64)[i]
    order = np.argsort(cell, kind="stable")
    cell, i, j, counts, need = cell[order], i[order], j[order], counts[order], need[order]
    if not len(cell):
        return
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    starts = np.unique(np.concatenate([new, np.arange(0, len(cell), SQUARE)]))
    cols = [ids[i].astype("<i8"), ids[j].astype("<i8"), counts.astype("<i4"), need.astype("<i4")]
    for k in range(0, len(starts), 64):
        some = starts[k : k + 64]
        ends = [*starts[k + 1 : k + 64].tolist(), int(starts[k + 64]) if k + 64 < len(starts) else len(cell)]
        packed = [pa.array([c[x:y].tobytes() for x, y in zip(some.tolist(), ends)], pa.binary()) for c in cols]
        yield pa.record_batch([pa.array(cell[some]), *packed], names=["cell", "a", "b", "common", "need"])


def _settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell that have enough in common over all parts, by the blocks of both texts.

    Texts that meet a common third one are put into the same block, as far as it goes.
    """
    one, other, counts, need = (np.frombuffer(b"".join(r[k] for r in rows), t).astype(np.int64) for k, t in ((1, "<i8"), (2, "<i8"), (3, "<i4"), (4, "<i4")))
    order = np.lexsort((other, one))
    one, other, counts, need = one[order], other[order], counts[order], need[order]
    new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (other[1:] != other[:-1])]))
    counts = np.add.reduceat(counts, new)
    enough = counts >= need[new]
    one, other, counts = one[new][enough], other[new][enough], counts[enough]
    if not len(one):
        return
    ids, text = np.unique(np.concatenate([one, other]), return_inverse=True)
    a, b = text[: len(one)], text[len(one) :]
    drawn = _mix(ids.view(np.uint64).copy())
    least_met = drawn.copy()
    np.minimum.at(least_met, a, drawn[b])
    np.minimum.at(least_met, b, drawn[a])
    block = np.empty(len(ids), np.int64)
    block[np.lexsort((drawn, least_met))] = np.arange(len(ids)) // CROWD + (int(rows[0][0]) << 32)
    turn = block[a] > block[b]
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    order = np.lexsort((-counts, block[b], block[a]))
    a, b, counts = a[order], b[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (block[a][1:] != block[a][:-1]) | (block[b][1:] != block[b][:-1])]))
    starts = np.unique(np.concatenate([new, np.arange(0, len(a), SQUARE)]))
    offsets = pa.array(np.concatenate([starts, [len(a)]]).astype(np.int32))
    names = ["x", "y", "a", "b", "common"]
    yield pa.record_batch([pa.array(block[a[starts]]), pa.array(block[b[starts]]), *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (ids[a], ids[b], counts)]], names=names)
    one, other, count = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([counts, counts])
    order = np.lexsort((-count, one))
    one, other, count = one[order], other[order], count[order]
    begin = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    near = np.minimum(begin[:, None] + np.arange(ROUNDS), np.concatenate([begin[1:], [len(one)]])[:, None] - 1).ravel()
    offsets = pa.array(np.arange(0, len(near) + 1, ROUNDS, dtype=np.int32))
    best = [pa.ListArray.from_arrays(offsets, pa.array(c[near])) for c in (ids[other], count)]
    yield pa.record_batch([pa.array(np.full(len(begin), -1)), pa.array(ids[one[begin]]), pa.nulls(len(begin), pa.list_(pa.int64())), *best], names=names)


def candidate_pairs(key: np.ndarray, owner: np.ndarray, side: np.ndarray, rare: np.ndarray, n: np.ndarray, roots: np.ndarray, least: float = SIMILARITY, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts i and j of different components with an equal key (they are sorted) and of lengths that near copies can have; whether it is rare."""
    root = roots[owner]

    def possible(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = owner[x], owner[y]
        most = ((1 - least) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64)
        ok = (root[x] != root[y]) & (np.abs(n[i] - n[j]) <= most) & ((side[x] == 0) | (side[x] != side[y]))
        return i[ok], j[ok], rare[x[ok]]

    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    stops = np.concatenate([starts[1:], [len(key)]]).astype(np.int64)
    if len(starts):
        several = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        starts, stops = starts[several], stops[several]
    short = stops - starts <= 64
    end = np.zeros(len(key), np.int64)
    for a, b in zip(starts[short].tolist(), stops[short].tolist()):
        end[a:b] = b
    live = np.flatnonzero(end)
    for away in range(1, 64):
        live = live[live + away < end[live]]
        if not len(live):
            break
        for k in range(0, len(live), step):
            yield possible(live[k : k + step], live[k : k + step] + away)
    for a, b in zip(starts[~short].tolist(), stops[~short].tolist()):
        here = np.arange(a, b)
        kinds, named = np.unique(root[here], return_inverse=True)
        main = named == np.argmax(np.bincount(named))
        lone, most = here[~main], here[main]
        size = max(1, step // len(here))
        for k in range(0, len(lone), size):
            some = lone[k : k + size]
            yield possible(np.repeat(some, len(most)), np.tile(most, len(some)))
            x, y = np.repeat(some, len(lone)), np.tile(lone, len(some))
            yield possible(x[x < y], y[x < y])


class Words:
    """A text's words, and its words and pairs of consecutive words in order, for counting what two texts have in common."""

    def __init__(self, words: np.ndarray):
        self.words = words
        pairs = words[:-1].astype(np.uint64) << np.uint64(32) | words[1:]
        self.counted = [np.unique(x, return_counts=True) for x in (words, pairs)]

    def may_match(self, other: Words, least: float = SIMILARITY) -> bool:
        """Whether the two have enough words, and pairs of them, in common to be near copies."""
        n, m = len(self.words), len(other.words)
        most = int((1 - least) * max(n, m) + 1e-9)
        if abs(n - m) > most:
            return False
        for k in (0, 1):
            (x, count), (y, theirs) = self.counted[k], other.counted[k]
            if len(x) > len(y):
                x, count, y, theirs = y, theirs, x, count
            at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
            common = int(np.minimum(count, theirs[at])[y[at] == x].sum()) if len(x) else 0
            if max(n, m) - k - common > (k + 1) * most:
                return False
        return True


def may_match(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences have enough words, and pairs of consecutive words, in common to be near copies."""
    return Words(a).may_match(Words(b), least)


def word_lists(ids: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, words) of the documents with these ids: 32-bit hashes of their words in order, as bytes.  Texts travel compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in byte_slices(batches, "text", 1 << 20):
            packed = pa.array([squeeze.compress(x.as_buffer()) for x in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), packed], names=["id", "packed"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in byte_slices(batches, "packed", 1 << 18):
            hashes, counts = word_hashes([unpack.decompress(x.as_buffer()) for x in batch.column(1)])
            low = (hashes >> np.uint64(32)).astype("<u4")
            parts = [x.tobytes() for x in np.split(low, np.cumsum(counts)[:-1])]
            yield pa.record_batch([batch.column(0), pa.array(parts, pa.binary())], names=["id", "words"])

    texts = docs.select(docs[doc_id].cast("long").alias("id"), text_or_empty(docs, text).alias("text")).filter("id is not null")
    # merge joins, here and below: the same plan at every size
    wanted = texts.mapInArrow(pack, "id long, packed binary").join(ids.hint("merge"), "id").select("id", "packed")
    return wanted.mapInArrow(words, "id long, words binary").dropDuplicates(["id"])


def _links(got: list[tuple[int, int, float]]) -> pa.RecordBatch:
    cols = list(zip(*got)) or [(), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, words: DataFrame, shelf: Shelf, least: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b, hub) those whose texts' edit similarity is at least ``least``: (a, b, similarity), the shelf's table "verified".

    The pairs of a hub are dealt into squares of about BLOCK texts a side, and a
    text goes once to each square that needs it.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts = None, {}
        for batch in batches:
            keys, ids, others = (batch.column(k).to_pylist() for k in range(3))
            raw, got = batch.column(3), []
            for k, (at, i, j) in enumerate(zip(keys, ids, others)):
                if at != key:
                    key, texts = at, {}
                if j is None:
                    texts[i] = Words(np.frombuffer(raw[k].as_buffer(), "<u4"))
                elif texts[i].may_match(texts[j], least) and (found := similar(texts[i].words, texts[j].words, least)) is not None:
                    got.append((i, j, found))
            yield _links(got)

    pairs = shelf.put(pairs, "pairs")
    sides = pairs.groupBy("hub").agg(*[F.ceil(F.approx_count_distinct(c) / BLOCK).alias(f"of_{c}") for c in ("a", "b")])
    cell = F.xxhash64("hub", F.pmod(F.xxhash64("a"), F.col("of_a")), F.pmod(F.xxhash64("b"), F.col("of_b")))
    dealt = shelf.put(pairs.join(sides, "hub").select(cell.alias("cell"), "a", "b"), "dealt")
    needed = dealt.select("cell", F.col("a").alias("id")).union(dealt.select("cell", "b")).distinct()
    texts = needed.hint("merge").join(words, "id").select("cell", "id", F.lit(None).cast("long").alias("other"), "words")
    rows = texts.union(dealt.select("cell", "a", "b", F.lit(None).cast("binary")))
    ordered = rows.repartition("cell").sortWithinPartitions("cell", F.col("other").isNotNull())
    found = shelf.put(ordered.mapInArrow(align, "a long, b long, similarity double"), "verified")
    shelf.drop("pairs", "dealt")
    return found


def _verified_squares(met: DataFrame, label: DataFrame, words: DataFrame, shelf: Shelf, least: float) -> DataFrame:
    """Links between texts of two blocks that may be near copies (x, y, a, b): the shelf's table "verified".

    A square gets each text that it needs once.  Pairs are tried in the order
    given, those that a link of the square has joined are left out.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, top, tried = None, {}, {}, set()

        def find(r: int) -> int:
            while top.setdefault(r, r) != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        for batch in batches:
            keys, ids, roots = (batch.column(k).to_pylist() for k in range(3))
            raw, got = batch.column(3), []
            for k, at in enumerate(keys):
                if at != key:
                    key, texts, top, tried = at, {}, {}, set()
                if ids[k] is not None:
                    texts[ids[k]] = roots[k], Words(np.frombuffer(raw[k].as_buffer(), "<u4"))
                    continue
                for i, j in zip(*(batch.column(c)[k].values.to_pylist() for c in (4, 5))):
                    (ri, x), (rj, y) = texts[i], texts[j]
                    if find(ri) == find(rj) or (i, j) in tried:
                        continue
                    tried.add((i, j))
                    if x.may_match(y, least) and (s := similar(x.words, y.words, least)) is not None:
                        got.append((i, j, s))
                        top[find(ri)] = find(rj)
                if len(tried) > 1 << 20:
                    tried = set()
            yield _links(got)

    ends = met.select("x", "y", F.explode(F.array_union("a", "b")).alias("id")).distinct()
    texts = ends.join(label, "id").hint("merge").join(words, "id")
    none = F.lit(None)
    rows = texts.select("x", "y", "id", "root", "words", none.cast("array<long>").alias("a"), none.cast("array<long>").alias("b"))
    rows = rows.union(met.select("x", "y", none.cast("long"), none.cast("long"), none.cast("binary"), "a", "b"))
    ordered = rows.repartition("x", "y").sortWithinPartitions("x", "y", F.col("id").isNull()).select(F.struct("x", "y").alias("key"), "id", "root", "words", "a", "b")
    return shelf.put(ordered.mapInArrow(align, "a long, b long, similarity double"), "verified")


def near_classes(docs: DataFrame, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, kept.

    A class holds texts that are joined by near-copy links, and their exact
    copies; class_id is its largest doc_id, the document that stays.

    Defined cases: a null text counts as empty; a text without words is a near
    copy of equal texts only; one of fewer than five words has all its words as
    one shingle, so it is found by texts with the same words in the same order;
    a row with a null doc_id is a class of its own, with class_id null, and
    stays; rows that share a doc_id are joined by it, and are all ``kept`` if it
    is the largest of their class; an empty table gives an empty result.  Other
    columns are not read.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5 and at most 1")
    with Shelf(docs.sparkSession) as shelf:
        table = shelf.put(sketch_table(docs, text, doc_id), "sketches")
        digests = shelf.put(table.select("doc_id", "digest"), "digests")
        # texts with copies are few beside those without, whose sketches needn't be dealt out to find it
        copies = shelf.put(digests.filter("doc_id is not null").groupBy("digest").agg(F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "id"), "copies")
        named = table.filter(F.col("doc_id").isNotNull() & (F.size("sketch") > 0)).select("digest", F.col("doc_id").alias("id"), "n_words", "sketch")
        reps = named.join(copies.select("digest"), "digest", "left_anti").unionByName(named.join(copies, ["digest", "id"], "left_semi").dropDuplicates(["digest"]))
        members = shelf.put(_shared_buckets(reps), "members")
        shelf.drop("sketches", "copies")
        root = near_roots(members, docs, shelf, least, text=text, doc_id=doc_id)
        lone = F.col("doc_id").isNull()
        of = digests.filter(~lone).groupBy("digest").agg(F.max("doc_id").alias("id")).join(root, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id"))
        known = digests.join(of, "digest", "left")
        return stash(known.select("doc_id", F.when(~lone, F.col("class_id")).alias("class_id"), (lone | (F.col("doc_id") == F.col("class_id"))).alias("kept")), "near")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their own columns; of repeated rows with one id, one."""
    verdict = near_classes(docs, least, text, doc_id).filter("doc_id is not null")
    # the ids that go are few beside those that stay; as a table of their own their size decides the join
    gone = stash(verdict.filter("not kept").select(F.col("doc_id").alias("_tl_id")).distinct(), "gone")
    again = stash(verdict.filter("kept").groupBy(F.col("doc_id").alias("_tl_id")).agg(F.count(F.lit(1)).alias("_tl_n")).filter("_tl_n > 1"), "again")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*docs.columns, docs[doc_id].cast("long").alias("_tl_id")).join(gone, "_tl_id", "left_anti")
    if again.isEmpty():
        return rows.select(*own)
    one = rows.join(again, "_tl_id", "left_anti").select(*own)
    return one.unionByName(rows.join(again, "_tl_id", "left_semi").dropDuplicates(["_tl_id"]).select(*own))
