"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds, in the order in which spans are listed:

- ``email``, ``ip``, ``card``, ``phone``: the base kinds.  A proposal that fails
  its validator (octets, Luhn, digit count) is dropped and not retried.
- ``iban``: country code, two check digits and up to 30 more characters, in
  groups of four or closed; mod-97 must give 1.
- ``shortcard``: 13 to 15 digits passing Luhn, only next to a word that speaks
  of cards; never overlapping another kind's span.

All patterns run in time linear in the text: an address is sought from its
"@", runs of digits are entered at their start only, and quantifiers that could
backtrack over a run are possessive or bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import BATCH_BYTES, byte_slices, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "shortcard")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
_DIGITS = re.compile(r"[0-9]")

#: Words that make a kind more likely when they stand nearby.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT["shortcard"] = CONTEXT["card"]
#: Score of a confirmed span of each kind, and what a context word adds.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "shortcard": 0.4}
BOOST = 0.25
WINDOW = 48
_WORD = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)", re.IGNORECASE) for k, v in CONTEXT.items()}
#: What replaces a span of each kind.
MASK = {k: f"<{k.upper()}>" for k in KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor, at = at + 1, text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length that pass mod-97; what follows them is no part of them."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        length, stop, code = IBAN_LENGTH.get(m[0][:2]), m.start(), ""
        while length and len(code) < length and stop < m.end():
            code += text[stop].strip()
            stop += 1
        if length and len(code) == length and not text[stop : stop + 1].isalnum() and mod97(code):
            yield m.start(), stop
            at = stop


def near_word(kind: str, text: str, start: int, end: int) -> bool:
    return bool(_WORD[kind].search(text, max(0, start - WINDOW), min(len(text), end + WINDOW)))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of kinds, then of starts; offsets count code points."""
    out: list[tuple[str, int, int]] = [("email", *s) for s in emails(text)] if "@" in text else []
    short: list[tuple[int, int]] = []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                if len(digits) >= 16:
                    out.append(("card", *m.span()))
                else:
                    short.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
        out += [("iban", *span) for span in ibans(text)]
        for s, e in short:
            if near_word("shortcard", text, s, e) and not any(a < e and s < b for _, a, b in out):
                out.append(("shortcard", s, e))
    return [(k, s, e, min(1.0, SCORE[k] + BOOST * near_word(k, text, s, e))) for k, s, e in out]


def redact(text: str, spans: list[tuple[str, int, int, float]], least: float = 0.0) -> str:
    """The text with spans of at least that score replaced; of overlapping spans the first, then the longer, names the mask."""
    parts, at, stop = [], 0, 0
    for kind, s, e, score in sorted(spans, key=lambda x: (x[1], -x[2])):
        if score < least:
            continue
        if s < stop:  # the rest of an overlapping span goes too
            stop = max(stop, e)
            at = stop
            continue
        parts += [text[at:s], MASK[kind]]
        at = stop = e
    return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, scores.

    ``spans`` is kind:start:end, joined by commas, by kind as listed in KINDS
    and then by start; ``base_spans`` has the base kinds only; ``scores`` is
    aligned with spans.

    Defined cases: a null text counts as empty and has no spans (empty strings);
    a null doc_id stays null; repeated rows are searched each; an empty table
    gives an empty result.  Other columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            cols += [pa.array([sum(x[0] == k for x in s) for s in found], pa.int64()) for k in BASE]
            cols += [pa.array([_joined([x for x in s if x[0] in BASE]) for s in found]), pa.array([_joined(s) for s in found]), pa.array([[x[3] for x in s] for s in found], pa.list_(pa.float64()))]
            yield pa.record_batch(cols, names=["doc_id", *[f"n_{k}" for k in BASE], "base_spans", "spans", "scores"])

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return narrow.mapInArrow(search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, scores array<double>")


def mask_pii(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` with each span of at least the score ``least`` replaced by its kind's mask.

    Null texts stay null, ids are not read, repeated rows are masked each, other
    columns stay; an empty table gives an empty result.
    """
    at = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, BATCH_BYTES):
            out = [t if t is None else redact(t, find_spans(t), least) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)

