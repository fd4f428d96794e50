"""Exact copies, tokens, pieces, personal data, languages, dialogues against plain versions."""

import hashlib
import random
import re
import struct
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tideline.llm import language_id, order_minhash, pii, words
from tideline.llm.exact_dedup import PerfectHash, drop_copies, exact_dedup
from tideline.llm.perspectives import rotate
from tideline.llm.piece_codec import encode_decode
from tideline.llm.token_counts import count_tokens, safe_parts
from tideline.llm.words import PieceTable, WordTable

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "A b", "é É é", "don't 's", "ΑΣ Σ.", "İ, x", "<|endoftext|> <|x", "x" * 3000, "a  b \n\t c ", "▁ ▁a", "漢字 ﷺ 12", "1 2  3", "\x00 ​", "same", "same", "J̌ H̱ T̈ W̊ Y̊ J̌, x", "Å".lower() + "Å Å", "漢" * 300]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, piece int, keep_id string"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(k, t, "en", "s", 0, "clash", 7, "x") for k, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 256, (5000, 32)).astype(np.uint8)
    table = PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    other = np.random.default_rng(2).integers(0, 256, (500, 32)).astype(np.uint8)
    assert ((table.slots(other) >= -1) & (table.slots(other) < 5000)).all()
    assert PerfectHash(keys[:0]).slots(other).tolist() == [-1] * 500


def brute_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    largest = lambda ids: max((d for d in ids if d is not None), default=None)
    return sorted((repr(d), repr(largest(groups[t or ""])), len(groups[t or ""]), d == largest(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_exact_dedup(spark, odd, none):
    rng = random.Random(1)
    rows = [(k, rng.choice(["p", "q", None, "", "hot", "hot", "hot", f"t{k}"])) for k in range(300)] + [(None, "hot"), (None, "lone"), (None, "lone"), (5, "hot"), (299, "p"), (299, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(df, shard_keys=20).collect())
    assert got == brute_groups(rows)
    assert exact_dedup(odd).count() == len(ODD) and exact_dedup(none).collect() == []
    kept = drop_copies(df)
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})
    assert drop_copies(odd).columns == odd.columns and drop_copies(none).collect() == []


def test_exact_dedup_against_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (9, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c"), (6, "b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(new, old).collect()}
    assert got == {3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True), 6: (9, 3, False)}


def test_stored_history(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    assert exact_dedup(batch([(1, "a"), (2, "b"), (9, "b")]), store=first, shard_keys=1).filter("kept").count() == 2
    got = exact_dedup(batch([(3, "a"), (4, "c"), (5, "c"), (6, "b")]), table=first, store=second).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True), 6: (9, 3, False)}
    last = exact_dedup(batch([(10, "c"), (11, None)]), table=second).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in last} == {10: (10, 3), 11: (11, 1)}


def test_word_and_piece_tables():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(WORD), SentencePieceProcessor(model_file=PIECE)
    words, table = WordTable(WORD, True, 8000), PieceTable(PIECE, 6000)
    parts = ["a", "B", "é", "É", "é", "Σ", "ΑΣ", "İ", "ß", " ", "  ", "\n", "\x1c", ".", ",", "!!", "'s", "'t", "don't", "1", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "▁", "漢字", "ﷺ", "́", "J", "̌", "H", "̱", "T", "̈", "W", "̊", "…", "_", "😀", "\x00", "ing", "the", "क़", "x'"]
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        split = words.split(text.encode())
        words.learn(set(split))
        ids = library.encode(text, add_special_tokens=False).ids
        assert b"".join(words.lookup(split)) == struct.pack(f"<{len(ids)}I", *ids), text
        chunks = table.chunks(text)
        table.learn(set(chunks))
        ids = pieces.encode(text)
        assert table.encode(chunks) == (len(ids), ",".join(map(str, ids)).encode(), pieces.decode(ids).encode()), text


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    want = {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(ODD)}
    for split_bytes in (1 << 20, 10):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(odd, WORD, split_bytes=split_bytes, table_bytes=2000).collect()}
        assert got == want
    assert {r["doc_id"] for r in count_tokens(odd, WORD, limit=5).filter("over_limit").collect()} == {k for k, (_, n) in want.items() if n > 5}
    assert count_tokens(none, WORD).collect() == []
    text = b"ab cd  efghijkl\nm" * 50
    parts = list(safe_parts(text, 20))
    assert b"".join(parts) == text and max(map(len, parts)) < 40


def test_piece_codec(spark, odd, none):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE)
    for r in encode_decode(odd, PIECE).collect():
        ids = sp.encode(ODD[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert encode_decode(none, PIECE).collect() == []
    rng = random.Random(8)
    texts = ["".join(rng.choices(["ab", "é", " ", "  ", "▁", "c,", "\n", " d"], k=400)) for _ in range(20)] + ["x" * 5000, " " * 3000]
    whole = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_decode(frame(spark, texts), PIECE, with_ids=False).collect()}
    cut = encode_decode(frame(spark, texts).repartition(len(texts)), PIECE, with_ids=False, part_chars=50)
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cut.collect()} == whole
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    assert [r["n_tokens"] for r in encode_decode(twice, PIECE).collect()] == [len(sp.encode("a b"))] * 3
    assert len({r["n_tokens"] for r in count_tokens(twice, WORD).collect()}) == 1 and count_tokens(twice, WORD).filter("doc_id is null").count() == 2


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_spans():
    rng = random.Random(1)
    for _ in range(20000):
        parts = rng.choice(["ab1.@-", "0129.", "0123456789 -", "+12()- .", "a1@.+ -é", "5 -"])
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE] == plain_pii(text), text


def test_pii_more(spark, none):
    text = "é IBAN DE89 3704 0044 0532 0130 00, amex card 378282246310005; write to x.y@mail.example.com"
    kinds = {k: score for k, _, _, score in pii.find_spans(text)}
    assert kinds == {"email": 1.0, "iban": 1.0, "shortcard": 0.65} or set(kinds) == {"email", "iban", "shortcard"}
    for number in ("ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"):
        for after in ("", " 2024", " BIC", ".", " DE89 3704 0044 0532 0130 00"):
            assert ("iban", 2, 2 + len(number)) in [s[:3] for s in pii.find_spans("x " + number + after)], number + after
    assert not pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 and 378282246310005")
    assert pii.redact(text, pii.find_spans(text)).startswith("é IBAN <IBAN>, amex card <SHORTCARD>; write to <EMAIL>")
    for slow in ("a" * 10**5, "1" * 10**5, "@" * 10**5, "a@" * 10**5, "+1" * 10**5, "+" + "1(" * 10**5, "A1" * 10**5):
        start = time.time()
        pii.find_spans(slow)
        assert time.time() - start < 10
    df = frame(spark, [None, "", text, "ip 1.2.3.4 and 999.1.1.1"])
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert got[0]["spans"] == "" == got[1]["base_spans"] and got[3]["n_ip"] == 1 and got[3]["spans"] == "ip:3:10" and len(got[2]["scores"]) == 3
    masked = pii.mask_pii(df).orderBy("doc_id").collect()
    assert masked[0]["text"] is None and masked[3]["text"] == "ip <IP> and 999.1.1.1" and masked[3]["digest"] == "clash"
    assert pii.find_pii(none).collect() == [] and pii.mask_pii(none).collect() == []


def test_language(spark, none):
    rng = random.Random(5)
    syllables = {"en": "the ing th wh er and", "de": "sch ich ung der ein zu", "fr": "eau que ment oi les é", "es": "ción os ado la ñ ez"}
    make = lambda code: " ".join("".join(rng.choices(syllables[code].split(), k=rng.randint(1, 3))) for _ in range(30))
    rows = [(k, make(code), code) for k, code in enumerate(["en", "de", "fr", "es"] * 60)] + [(900, None, "en"), (901, "", "fr"), (902, "12 !!", None), (None, make("en"), "en"), (903, make("de"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.families == ("germanic", "romance") and model.languages == (("de", "en"), ("es", "fr"))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    tested = [(got[k]["lang_pred"], code) for k, _, code in rows if k is not None and k < 900 and got[k]["held_out"]]
    assert len(tested) > 40 and sum(a == b for a, b in tested) / len(tested) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902)) and got[903]["lang_pred"] == "de" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["doc_id"] for r in language_id.keep_known(df, model).filter("doc_id >= 900").collect()} == {903}
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.keep_known(df, nothing).count() == 242
    assert language_id.predict(none, model).collect() == []
    odd = spark.createDataFrame([(1, "² ½ Ⅷ ①", "en", 5), (1, "² ½ Ⅷ ①", "en", 5), (None, "der " * 400_000, None, 1)], "doc_id long, text string, lang string, score int")
    assert sorted((r["lang_pred"], r["doc_id"] is None) for r in language_id.predict(odd, model).collect()) == [("de", True), ("und", False), ("und", False)]
    kept = language_id.keep_known(odd, model)
    assert kept.columns == odd.columns and [(r["doc_id"], r["lang"], r["score"]) for r in kept.collect()] == [(None, "de", 1)]


def plain_rotation(rows):
    out = {}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, (role or "unknown").replace("<|", "<\\|"), (text or "").replace("<|", "<\\|")))
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))
        for who in {t[1] for t in turns} - {"system"}:
            text, spans = "", []
            for _, speaker, said in turns:
                text += "<|assistant|>\n" if speaker == who else "<|system|>\n" if speaker == "system" else f"<|user name={speaker}|>\n"
                start = len(text)
                text += said + "<|end|>\n"
                if speaker == who:
                    spans.append(text[start:])
            out[c, who] = (text, spans)
    return out


def test_word_tables_go_when_sketches_are_made():
    words.word_table(WORD, True).learn({b"one", b"two"})
    batch = pa.record_batch([pa.array([1]), pa.array(["one two three four five six"])], names=["doc_id", "text"])
    assert [b.num_rows for b in order_minhash._sketched(iter([batch]))] == [1]
    assert not words._TABLES


def test_language_fit_is_small_on_the_driver(spark):
    letters = {"de": "abcdefghijklmnop", "fi": "klmnopqrstuvwxyzåä"}
    rng = random.Random(5)
    words = {c: ["".join(rng.choices(x, k=rng.randint(2, 7))) for _ in range(4000)] for c, x in letters.items()}
    df = spark.createDataFrame([(k, " ".join(rng.choices(words[c], k=250)), c) for k in range(6000) for c in [("de", "fi")[k % 2]]], "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language_id.fit(df, per_language=1600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert model.predict([" ".join(words["fi"][:40]), " ".join(words["de"][:40])])[0] == ["fi", "de"]


def test_feature_rows_as_a_matrix():
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((300, language_id.DIMS)) < 0.2, rng.random((300, language_id.DIMS)), 0).astype(np.float32)
    at = [np.flatnonzero(r).astype("<i2") for r in dense]
    rows = language_id.Rows(at, [r[a] for r, a in zip(dense, at)])
    some = np.arange(1, 300, 3)
    w, v = rng.random(language_id.DIMS), rng.random(300)
    assert len(rows.blocks) > 1
    assert np.allclose(rows.times(w), dense @ w) and np.allclose(rows.weighed(v), v @ dense) and np.allclose(rows.squares(), (dense**2).sum(axis=1))
    assert np.allclose(rows.taken(some).times(w), dense[some] @ w)


@pytest.mark.parametrize(("block_turns", "part_rows"), [(64, 1024), (3, 1024), (3, 2)])
def test_rotation(spark, block_turns, part_rows):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["ann", "bob", "system", None]), rng.choice(["hi", "é <|end|>", None, f"t{t}"])) for c in [1, 2, None] for t in range(rng.randint(1, 9))]
    rows += [(1, None, "ann", "late"), (2, 1, "bob", "again"), (2, 1, "bob", "again"), (2, 1, "bob", "again"), (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    got = {}
    for r in rotate(df, block_turns=block_turns, part_rows=part_rows).orderBy("block", "part").collect():
        text, spans = got.setdefault((r["conv_id"], r["perspective"]), ("", []))
        got[r["conv_id"], r["perspective"]] = (text + r["rendered"], spans + [r["rendered"][s["start"] : s["stop"]] for s in r["mask"]])
        assert r["n_masked"] == sum(s["stop"] - s["start"] for s in r["mask"])
    want = plain_rotation(rows)
    assert got == want
    assert rotate(df.limit(0)).collect() == []
