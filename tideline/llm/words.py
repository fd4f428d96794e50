"""Tables of distinct words for tokenizers whose pieces never cross white space.

A worker keeps one table for each tokenizer file across its tasks: every
distinct word is segmented once by the library, a batch's new words in one
call; texts are then put together from the table by position.  What a table
drops when it has grown beyond its bound is segmented anew when it comes again,
which costs time but never changes a result.  Steps of other operators that
hold much themselves drop the tables of their worker.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

#: Bytes that each of the two generations of a worker's table takes, about; bytes of a word from which on it is kept for its batch only.
TABLE_BYTES = 96 << 20
LONG_WORD = 64
#: Bytes of words that go to the library in one call.
_CALL = 1 << 20
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and following.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}
_PUNCTUATION = frozenset(PUNCTUATION)
#: A capital that may compose with what follows; letters of two bytes that start with C3 are no combining marks.
_MAY_COMPOSE = re.compile(rb"[A-Z][\x80-\xc2\xc4-\xff]")
_TABLES: dict[tuple, WordTable | PieceTable] = {}


class Generations:
    """Values of words, in two generations: when the younger is full, the older is dropped, so words in use stay known.

    Long words are known for one batch only: text without white space is one
    word, and seldom comes again.
    """

    #: Bytes of an entry besides its word, about.
    ENTRY = 160

    def __init__(self, bound: int):
        self.bound = bound
        self.known: dict = {}
        self.older: dict = {}
        self.brief: dict = {}
        self.size = 0

    def missing(self, words: set) -> list:
        """Those of a batch's words that are in neither generation; the others are known from now on."""
        self.brief = {}
        if self.size > self.bound:
            self.older, self.known, self.size = self.known, {}, 0
        new = words - self.known.keys()
        if not self.older:
            return list(new)
        out = []
        for w in new:
            got = self.older.get(w)
            if got is None:
                out.append(w)
            else:
                self.keep(w, got)
        return out

    def keep(self, word, value) -> None:
        if len(word) > LONG_WORD:
            self.brief[word] = value
        else:
            self.known[word] = value
            self.size += self.ENTRY + len(word)

    def lookup(self, words: list) -> Iterable:
        if not self.brief:
            return map(self.known.__getitem__, words)
        known, brief = self.known, self.brief
        return [known[w] if w in known else brief[w] for w in words]


class WordTable(Generations):
    """Ids (as bytes), or their number, of the word-level BPE of a tokenizers .json file, word by word.

    Words are split at ASCII white space only, which the tokenizer's own
    pattern always drops; any other white space stays inside a word and is left
    to the library.  Words of ASCII alone are lowered first, as the tokenizer
    does; others may compose before they are lowered, so they are left alone.
    A word's closing run of ASCII punctuation is a token group of its own in
    the tokenizer's pattern, so it is looked up apart.  Texts that hold "<|" are
    not lowered and their words with it not divided, so special strings are
    handled as the library does by default.

    For lengths a batch's new words go to the library in one batch encoding.  For
    ids, words of letters that normalization leaves alone go straight to the
    library's BPE model, in the byte-level alphabet, the others to batch encoding.
    """

    def __init__(self, path: str, as_ids: bool, bound: int = TABLE_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(bound)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.as_ids = as_ids

    def split(self, text: bytes) -> list[bytes]:
        if b"<|" in text:
            return text.split()
        if text.isascii() or not _MAY_COMPOSE.search(text):
            return text.lower().split()
        return [w.lower() if w.isascii() else w for w in text.split()]

    def learn(self, words: set[bytes]) -> None:
        """See to it that the table holds these words."""
        new, divided, parts = [], [], set()
        for w in self.missing(words):
            if w[-1] in _PUNCTUATION and len(halves := self._halves(w)) > 1:
                divided.append((w, *halves))
                parts.update(halves)
            else:
                new.append(w)
        known, brief = self.known, self.brief
        parts.difference_update(known)
        parts.difference_update(new)
        size = 0
        for w, value in self._segmented([*new, *parts]):
            if len(w) > LONG_WORD:
                brief[w] = value
            else:
                known[w] = value
                size += self.ENTRY + len(w)
        self.size += size
        for w, base, end in divided:
            value = (known[base] if base in known else brief[base]) + known.get(end, brief.get(end))
            if len(w) > LONG_WORD:
                brief[w] = value
            else:
                known[w] = value
                self.size += self.ENTRY + len(w)

    def _halves(self, word: bytes) -> tuple[bytes, ...]:
        base = word if b"<|" in word else word.rstrip(PUNCTUATION)
        if base and len(base) < len(word):
            text = base.decode("utf-8", "ignore")
            if text and unicodedata.normalize("NFC", text[-1]).lower()[-1].isalnum():
                return base, word[len(base) :]
        return (word,)

    def _segmented(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes | int]]:
        if self.as_ids:
            rest, tokenize = [], self.model.tokenize
            for word in words:
                text = word.decode()
                if text.isalpha() and (text.isascii() and text.islower() or unicodedata.is_normalized("NFC", text) and all(c.lower() == c for c in text)):
                    ids = [t.id for t in tokenize(text if text.isascii() else word.decode("latin-1").translate(BYTE_ALPHABET))]
                    yield word, struct.pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(word)
            words = rest
        start = 0
        while start < len(words):
            stop, size = start, 0
            while stop < len(words) and (stop == start or size < _CALL):
                size += len(words[stop])
                stop += 1
            part = words[start:stop]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                yield w, struct.pack(f"<{len(e)}I", *e.ids) if self.as_ids else len(e)
            start = stop


def word_table(path: str, as_ids: bool, bound: int = TABLE_BYTES) -> WordTable:
    key = (path, as_ids, bound)
    if key not in _TABLES:
        _TABLES[key] = WordTable(path, as_ids, bound)
    return _TABLES[key]


def forget() -> None:
    """Give up this worker's tables, for a step that has no use for them: a worker that an earlier operator has left serves the next one too."""
    _TABLES.clear()


class PieceTable(Generations):
    """Ids and decoded bytes of a sentencepiece model, one entry for each distinct marked word.

    A marked word is a run of markers (escaped spaces) with what follows up to
    the next marker.  The model must have no piece in which a marker follows
    another character, the identity normalizer and the dummy prefix; the
    constructor checks all three.
    """

    ENTRY = 320
    MARK = "▁"
    SPLIT = re.compile(r" *[^ ]+| +")

    def __init__(self, path: str, bound: int = TABLE_BYTES):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        super().__init__(bound)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        crossing = any(self.MARK in p.piece.lstrip(self.MARK) for p in proto.pieces)
        if crossing or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or any(p.type == 4 for p in proto.pieces):
            raise ValueError(f"{path}: pieces may cross markers, or the normalizer changes texts")
        self.sp = SentencePieceProcessor(model_file=path)
        self.lead = self.sp.piece_to_id("a")

    def chunks(self, text: str) -> list[str]:
        """Marked words without their first marker; joined by one space each they give the text."""
        if not text:
            return []
        if self.MARK in text:
            text = text.replace(self.MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in self.SPLIT.findall(" " + text)]

    def learn(self, words: set[str]) -> None:
        """See to it that the table holds these words."""
        part = self.missing(words)
        ids = [x if w else [self.sp.piece_to_id(self.MARK)] for w, x in zip(part, self.sp.encode(part, num_threads=1))]
        # a leading letter keeps decode() from taking the first marker for the dummy prefix
        texts = self.sp.decode([[self.lead, *x] for x in ids]) if part else []
        for w, x, t in zip(part, ids, texts):
            self.keep(w, ((",".join(map(str, x)) + ",").encode(), t[1:].encode()))

    def encode(self, chunks: list[str]) -> tuple[int, bytes, bytes]:
        """Number of ids, decimal ids joined by commas, decoded text in UTF-8."""
        got = list(self.lookup(chunks))
        ids = b"".join([x[0] for x in got])
        return ids.count(b","), ids[:-1], b"".join([x[1] for x in got])[1:]


def piece_table(path: str, bound: int = TABLE_BYTES) -> PieceTable:
    if (path, bound) not in _TABLES:
        _TABLES[path, bound] = PieceTable(path, bound)
    return _TABLES[path, bound]
