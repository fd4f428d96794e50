"""Hierarchical language identification: the family first, then pairs of languages within it.

A text's features are frequencies of hashed byte bigrams and trigrams of its
lower-cased letters.  Linear support vector machines (squared hinge, fitted on
the driver from a bounded sample) separate the families one from the rest, and
the languages of each family one versus one; the language with the most won
duels, margins breaking ties, is the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import byte_slices, text_or_empty
from tideline.llm.words import forget

#: Bounds of the fitting sample: labelled rows a language, and in all.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 3200
BITS = 12
DIMS = 2 << BITS
SCALE = 40.0

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Characters of a text that are worked on at a time; a longer one is cut at white space.
_PART = 1 << 19
_SPACE = re.compile(r"\s")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
#: Entries of the feature rows that a product works on at a time.
_ENTRIES = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > _PART:
        space = _SPACE.search(text, start + _PART)
        stop = min(space.start() if space else len(text), start + 2 * _PART)
        yield text[start:stop]
        start = stop
    yield text[start:]


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].split("_")[0].lower(), "other")


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after another, and where each text's features end; 0 marks no feature."""
    parts = [b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    x = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    two = x[:-2] * np.uint32(256) + x[1:-1]
    three = two * np.uint32(256) + x[2:]
    low = np.uint32((1 << BITS) - 1)
    a = ((two * np.uint32(2654435761)) >> np.uint32(32 - BITS)) & low
    b = (((three * np.uint32(2246822519)) >> np.uint32(32 - BITS)) & low) + np.uint32(1 << BITS)
    space = x == 32
    a[space[:-2] & space[1:-1]] = 0
    b[(space[:-2] & space[1:-1]) | (space[1:-1] & space[2:])] = 0
    ends = np.cumsum([len(p) for p in parts])
    ends[-1] -= 2
    return np.stack([a, b]), ends


def features(text: str) -> np.ndarray:
    counts = sum(np.bincount(_hashed([p])[0].ravel(), minlength=DIMS) for p in _parts(text)).astype(np.float32)
    counts[0] = 0
    return counts * (SCALE / max(1.0, counts.sum()))


class Rows:
    """Feature rows by the numbers and values of the features they have, one at least; products hold little besides, whatever the number of rows."""

    def __init__(self, at: list[np.ndarray], x: list[np.ndarray]):
        self.at, self.x = at, x
        sizes = np.array([len(a) for a in at], np.int64)
        block = np.cumsum(sizes) // _ENTRIES
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
        self.blocks = [(slice(i, j), sizes[i:j], np.concatenate(at[i:j]), np.concatenate(x[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def taken(self, rows: np.ndarray) -> Rows:
        return Rows([self.at[k] for k in rows.tolist()], [self.x[k] for k in rows.tolist()])

    def squares(self) -> np.ndarray:
        return np.array([float((v.astype(np.float64) ** 2).sum()) for v in self.x])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Of each row the sum of its values times the weights of their features."""
        out = np.zeros(len(self.at))
        for rows, sizes, at, x in self.blocks:
            out[rows] = np.add.reduceat(x * w[at], np.cumsum(sizes) - sizes)
        return out

    def weighed(self, v: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its weight."""
        out = np.zeros(DIMS)
        for rows, sizes, at, x in self.blocks:
            out += np.bincount(at, weights=x * np.repeat(v[rows], sizes), minlength=DIMS)
        return out


def _svm(x: Rows, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights of a linear machine for labels -1 and 1: squared hinge loss, classes balanced, accelerated gradient."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (1.0 + 2 * cost * float((share * x.squares()).sum()))
    w = ahead = np.zeros(DIMS)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * x.times(ahead))
        new = ahead - step * (ahead - 2 * cost * x.weighed(share * slack * y))
        ahead, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    """Columns of ``weights``: one a family (if there are several), then one a pair of languages of a family."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        out, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.families:
            return out, scores
        margins, total = np.zeros((len(known), len(self.weights))), np.zeros(len(known), np.int64)
        held: list[tuple[int, str]] = []

        def add() -> None:
            rows = np.array([r for r, _ in held])
            got, ends = _hashed([p for _, p in held])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            np.add.at(total, rows, np.add.reduceat((got != 0).sum(axis=0), starts))
            for i, w in enumerate(self.weights):
                np.add.at(margins[:, i], rows, np.add.reduceat(w[got[0]] + w[got[1]], starts, dtype=np.float64))

        size = 0
        for row, k in enumerate(known):
            for part in _parts(texts[k]):
                if held and size + len(part) > 2 * _PART:
                    add()
                    held, size = [], 0
                held.append((row, part))
                size += len(part)
        add()
        margins *= (SCALE / np.maximum(1, total))[:, None]
        sure = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
        n = len(self.families) if len(self.families) > 1 else 0
        for row, k in enumerate(known):
            f = int(np.argmax(margins[row, :n])) if n else 0
            score = float(sure[row, f]) if n else 1.0
            codes = self.languages[f]
            at = n + sum(len(c) * (len(c) - 1) // 2 for c in self.languages[:f])
            won = {c: [0, 0.0, 1.0] for c in codes}
            for i, (a, b) in enumerate(combinations(codes, 2)):
                m, p = float(margins[row, at + i]), float(sure[row, at + i])
                for c, m_, p_ in ((a, m, p), (b, -m, 1 - p)):
                    won[c] = [won[c][0] + (m_ > 0), won[c][1] + m_, min(won[c][2], p_)]
            best = max(codes, key=lambda c: (won[c][0], won[c][1], c))
            out[k], scores[k] = best, score * won[best][2]
        return out, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``per_language`` labelled rows a language and ``rows`` in all, taken by a hash of the id.

    A language has 8 rows at least, so no more than ``rows`` / 8 languages are
    learned: those with the most rows.

    Rows count whose crc32(doc_id as text) mod 3 is not 1 and whose language and id are not null.
    """
    labelled = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[lang].cast("string").alias("lang"), text_or_empty(docs, text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows // 8).collect()}
    each = max(8, min(per_language, rows // max(1, len(counts))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    take = F.lit(False)
    for code, n in counts.items():
        take = take | ((F.col("lang") == code) & (draw < int(1_000_000 * min(1.0, 1.3 * each / n + 1e-6))))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = [(features(t) if has_letter(t) else np.zeros(DIMS, np.float32)) for t in batch.column(3).to_pylist()]
            at = [np.flatnonzero(x) for x in found]
            packed = [pa.array([c.tobytes() for c in cols], pa.binary()) for cols in ([i.astype("<i2") for i in at], [x[i].astype("<f4") for x, i in zip(found, at)])]
            yield pa.record_batch([*batch.columns[:3], *packed], names=["doc_id", "lang", "draw", "at", "x"])

    taken = labelled.filter(take).select("doc_id", "lang", draw.alias("draw"), "text").mapInArrow(sparse, "doc_id long, lang string, draw long, at binary, x binary")
    # as bytes: lists of numbers take some 200 MB of the driver
    got = taken.filter(F.length("at") > 0).collect()
    at, x, y, seen = [], [], [], {}
    for r in sorted(got, key=lambda r: (r["draw"], r["doc_id"])):
        if seen.setdefault(r["lang"], 0) < each:
            seen[r["lang"]] += 1
            at.append(np.frombuffer(r["at"], "<i2"))
            x.append(np.frombuffer(r["x"], "<f4"))
            y.append(r["lang"])
    return _model(Rows(at, x), y)


def _model(x: Rows, y: list[str]) -> LanguageModel:
    codes = sorted(set(y))
    families = tuple(sorted({family_of(c) for c in codes}))
    languages = tuple(tuple(c for c in codes if family_of(c) == f) for f in families)
    of, own = np.array(y), np.array([family_of(c) for c in y])
    weights = []
    if len(families) > 1:
        weights += [_svm(x, np.where(own == f, 1, -1)) for f in families]
    for group in languages:
        for a, b in combinations(group, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            weights.append(_svm(x.taken(rows), np.where(of[rows] == a, 1, -1)))
    table = np.array(weights, np.float32).reshape(len(weights), DIMS)
    table[:, 0] = 0
    return LanguageModel(families, languages, table)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Defined cases: ``und`` with score 0 for a null text, an empty one and one
    without a letter, and for every text if the model learned no language; a
    null doc_id stays null and isn't held out; repeated rows are predicted each;
    an empty table gives an empty result.  Other columns are not read.
    """

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 20):
            found, scores = model.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(guess, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language: those without a letter (predicted ``und``) are rejected.

    A null ``lang`` becomes the predicted language; a given one stays.
    """
    at, label = docs.columns.index(text), docs.columns.index(lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, text, 1 << 20):
            texts = batch.column(at).to_pylist()
            found, _ = model.predict(texts)
            given = batch.column(label)
            filled = pc.if_else(pc.is_null(given), pa.array(found, given.type), given)
            known = pa.array([has_letter(t) for t in texts], pa.bool_())  # also where the model learned no language
            batch = pa.record_batch([*batch.columns[:label], filled, *batch.columns[label + 1 :]], names=batch.schema.names)
            yield batch.filter(known)

    return docs.mapInArrow(keep, docs.schema)
