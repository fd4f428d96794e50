"""Repeated strings, near copies, packing, pictures and the pipeline against plain versions."""

import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tideline.llm import image_copies, packing
from tideline.llm.common import Shelf
from tideline.llm.components import components
from tideline.llm.order_minhash import drop_near_copies, edit_distance, labelled_kmers, may_match, near_classes, similar, sketch_table, word_hashes
from tideline.llm.substring_dedup import _pieces, remove_repeats, repeated_starts, segments

SF = "/root/testdata/sf0.001"


def plain_repeats(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(4)
    words = ["the", "é", "ing", "ción", "wh", "x"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(n))
    passage, base = make(30), make(60)
    texts = [make(rng.randint(0, 80)) for _ in range(40)]
    texts += [make(rng.randint(5, 30)) + passage + make(rng.randint(5, 30)) for _ in range(12)]
    texts += [base, base, base.replace("ing", "INGS", 1), "ab" * 200, "a" * 150, "a" * 90, "", None, None, make(20) * 3]
    return texts


@pytest.mark.parametrize(("length", "crowd"), [(60, 2000), (60, 2), (48, 3)])
def test_repeated_strings(spark, length, crowd):
    texts = repeats_corpus()
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[3], 1), (7, texts[7], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, length, crowd).collect())
    want = plain_repeats([(t or "").encode() for _, t, _ in rows], length)
    assert got == Counter((row[0], *w) for row, w in zip(rows, want))


def test_repeated_strings_edge(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == []
    whole = os.urandom(400) * 2
    assert repeated_starts(whole, np.arange(601)).sum() == 2 * 201
    monster = os.urandom(2_500_000)
    parts = list(_pieces([monster], 200))
    assert sum(valid.sum() for *_, valid in parts) == len(monster) - 199 and len(parts) == 3
    first, n, anchor, _ = segments(np.frombuffer(monster[:5000], np.uint8), np.arange(5000) <= 4800)
    assert n.sum() == 4801 and (anchor >= first + n - 1).all() and (anchor - first <= 168).all()


def plain_classes(rows, least=0.8):
    hashes, counts = word_hashes([(t or "").encode() for _, t in rows])
    words = np.split(hashes, np.cumsum(counts)[:-1])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or counts[i] and counts[j] and similar(words[i], words[j], least) is not None:
                parent[find(i)] = find(j)
    top = {}
    for i, (d, _) in enumerate(rows):
        top[find(i)] = max(top.get(find(i), -1), d)
    return {d: top[find(i)] for i, (d, _) in enumerate(rows)}


def near_corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    edit = lambda ws, share: [word() if rng.random() < share else w for w in ws]
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts = [base] + [edit(base, 0.03) for _ in range(25)]
    texts += [[word() for _ in range(rng.randint(0, 90))] for _ in range(20)]
    texts += [passage + [word() for _ in range(60)] for _ in range(20)]
    texts += [t[:-3] for t in texts[30:36]] + [["one", "two"], ["one", "two"], ["one", "three"], [], ["x"] * 50, ["x"] * 48]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_near_copies(spark):
    rows = near_corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(df).collect()}
    assert got == plain_classes(rows)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_crowded_buckets(spark):
    """Variants that an original joins: every pair with a common sketch counts, however large the bucket."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        texts = [base] + [[word() if rng.random() < share else w for w in base] for share in [rng.uniform(0.08, 0.15) for _ in range(100)]]
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    hashes, counts = word_hashes([t.encode() for _, t in rows])
    words = np.split(hashes, np.cumsum(counts)[:-1])
    table = {r["doc_id"]: r["sketch"] for r in sketch_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sketch = np.array([table[k] for k, _ in rows])
    links = [(i, j) for i in range(len(rows)) for j in np.flatnonzero((sketch[:i] == sketch[i]).any(axis=1)).tolist() if similar(words[i], words[j]) is not None]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = plain_classes(rows)
    assert all(got[i] == got[j] for i, j in links) and all(whole[k] == whole[c] for k, c in got.items())
    assert got == whole
    for i, j in links[:500]:
        assert may_match(*((words[k] >> np.uint64(32)).astype("<u4") for k in (i, j)))


@pytest.mark.parametrize("similarity, least", [(0.8, 0.94), (0.82, 0.97), (0.85, 0.99), (0.9, 0.99)])
def test_sketch_recall(spark, similarity, least):
    """Pairs of just that similarity, in changed words, share a sketch."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(200):
        a = rng.integers(0, 1 << 40, 400)
        b = a.copy()
        at = rng.permutation(400)[: int((1 - similarity) * 400 + 1e-9)]
        b[at] = rng.integers(0, 1 << 40, len(at))
        rows += [(2 * k, " ".join(map(str, a))), (2 * k + 1, " ".join(map(str, b)))]
    got = sketch_table(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sketch").collect()
    sketch = np.array([r["sketch"] for r in sorted(got)])
    assert (sketch[::2] == sketch[1::2]).any(axis=1).mean() >= least


def test_pairs_of_several_parts_are_counted(spark, monkeypatch):
    """Different texts about one passage aren't moved to be aligned, whatever the number of parts; near copies are."""
    from tideline.llm import order_minhash

    monkeypatch.setattr(order_minhash, "PART", 500)
    monkeypatch.setattr(order_minhash, "LEARNED", 1)
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 31, 12)
    texts = [np.concatenate([passage, rng.integers(0, 1 << 31, 108)]).astype("<u4") for _ in range(60)]
    near = texts[7].copy()
    near[rng.permutation(120)[:20]] += 1
    texts.append(near)
    crowded = spark.createDataFrame([(k, len(t), k) for k, t in enumerate(texts)], "id long, n_words int, root long")
    words = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "id long, words binary")
    met = order_minhash._meetings(crowded, words, 0.8).filter("x >= 0").collect()
    assert {tuple(sorted(p)) for r in met for p in zip(r["a"], r["b"])} == {(7, 60)}


@pytest.mark.parametrize("size", [1, 2])
def test_needed_common_is_safe(size):
    """No near copies have fewer keys in common than are asked for."""
    from tideline.llm import order_minhash as o

    rng = np.random.default_rng(size)
    make = lambda n: np.minimum(rng.zipf(1.3, n), 1 << 20).astype("<u4")
    texts = []
    for n in rng.integers(1, 120, 150).tolist():
        t = make(n)
        texts.append(t)
        for share in (0.1, 0.2, 0.25):
            x = list(t)
            for _ in range(int(share * n)):
                at, kind = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, 3))
                x[at : at + (kind > 0)] = [int(make(1)[0])] * (kind < 2)
            texts.append(np.array(x or [1], "<u4"))
    every, counts = np.unique(np.concatenate([o.elements(t, size) for t in texts[::9]]), return_counts=True)
    order = o.Rarity(size, every[counts > 1], counts[counts > 1], {})
    found = [order.rarest(t, 0.8) for t in texts]
    n, n_rare, seen = np.array([len(t) for t in texts]), np.array([f[2] for f in found]), 0
    for k in range(0, len(texts), 4):
        for i, j in ((k + x, k + y) for x in range(4) for y in range(x)):
            if similar(texts[i], texts[j]) is None:
                continue
            seen += 1
            one, other = np.array([i]), np.array([j])
            rare_only = o.needed_rare(one, other, n, n_rare, size)[0] > 0
            keys = [set(found[x][0][found[x][1] | (not rare_only)].tolist()) for x in (i, j)]
            assert len(keys[0] & keys[1]) >= max(1, o.needed_common(one, other, n, n_rare, size)[0])
    assert seen > 200


def test_mixed_buckets_without_a_join_of_buckets(spark):
    """Members of buckets of several components, a row for each, without a join of a bucket's rows with each other."""
    from tideline.llm.order_minhash import _mixed

    members = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 3, 5)], "bucket long, id long, n_words int")
    label = spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "id long, root long")
    mixed = _mixed(members, label)
    assert sorted((r["bucket"], r["id"], r["n_words"], r["root"]) for r in mixed.collect()) == [(2, 1, 5, 2), (2, 3, 5, 3)]
    assert "LeftSemi" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_with_each_table(spark):
    """Writing a temporary table leaves no shuffle behind, and the session's setting as it was."""
    from tideline.llm import common

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held(), spark.conf.get(common._CLEANUP, None)
    common.stash(spark.range(1000).repartition(7, "id"), "test")
    for _ in range(40):
        if held() <= before[0]:
            break
        time.sleep(0.25)
    assert (held() <= before[0], spark.conf.get(common._CLEANUP, None)) == (True, before[1])


def test_near_copies_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (None, None), (4, "w " * 40), (4, "w " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in near_classes(df).collect())
    assert got == Counter({(1, 2, False): 1, (2, 2, True): 1, (3, 3, True): 1, (None, None, True): 2, (4, 4, True): 2})
    assert sorted(map(repr, (r["doc_id"] for r in drop_near_copies(df).collect()))) == sorted(map(repr, [2, 3, None, None, 4]))
    assert near_classes(df.limit(0)).collect() == []


def test_edit_distance_and_kmers():
    rng = random.Random(1)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[-1] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    for _ in range(4000):
        k = rng.choice([2, 5, 50])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.8 else [rng.randrange(k) for _ in range(rng.randint(0, 25))]
        most, d = rng.randint(0, 10), plain(a, b)
        got = edit_distance(a, b, most)
        assert got == d if d <= most else got > most
    hashes, counts = word_hashes([b"a b c d e f g", b"", b"x y", b"a b\tc  d e f g a b c d e", b"  "])
    kmers, n = labelled_kmers(hashes, counts)
    assert counts.tolist() == [7, 0, 2, 12, 0] and n.tolist() == [3, 0, 1, 8, 0]
    assert kmers[0] in kmers[4:] and len(set(kmers[4:].tolist())) == 8


def test_long_texts(monkeypatch):
    from tideline.llm import order_minhash

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)).encode() for _ in range(4)] + [b"x" * 9000 + b" y", b"", b" a  b "]
    whole, n = word_hashes(texts)
    monkeypatch.setattr(order_minhash, "_LONG", 64)
    parts, m = word_hashes(texts)
    assert (n == m).all() and (parts == whole).all() and n.tolist() == [len(t.split()) for t in texts]


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    top = {}
    for x in parent:
        top[find(x)] = max(top.get(find(x), 0), x)
    with Shelf(spark) as shelf:
        got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), shelf).collect()}
    assert got == {x: top[find(x)] for x in parent}


def fewest(items, capacity):
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            put(i + 1, [b + items[i] * (n == k) for n, b in enumerate(bins)])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def test_reduction_is_safe():
    rng, worse = random.Random(2), 0
    for t in range(600):
        capacity = rng.choice([10, 12, 20, 30])
        items = sorted((rng.randint(1 if t % 2 else capacity // 5, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_dominated(dict(Counter(items)), capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(g.count for g in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        groups = packing.plan(dict(Counter(items)), capacity)
        assert all(sum(s * q for s, q in g.runs) + g.left == capacity and g.left >= 0 for g in groups)
        held = Counter()
        for g in groups:
            for s, q in g.runs:
                held[s] += q * g.count
        assert held == Counter(items)
        worse += sum(g.count for g in groups) - fewest(items, capacity)
    assert worse <= 6


def test_pack(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma!", "12"], k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "same text"] + ["same text"] * 30
    rows = [(k, t, 3) for k, t in enumerate(texts)] + [(None, "x", 1), (5, texts[5], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), capacity=50, with_ids=True).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 50)):
            one = ids[at : at + 50]
            want[d, k, at, len(one), zlib.crc32(np.array(one, "<u4").tobytes()), tuple(one)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 50
    assert len(sequences) <= 1.05 * sum(r["length"] for r in out) / 50 + 1
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_images(spark):
    gray = np.random.default_rng(1).integers(0, 256, (20, 30)).astype(np.uint8)
    assert (image_copies.read_image(image_copies.write_png(gray)) == gray).all()
    assert (image_copies.read_image(b"P5 30 20 255\n" + gray.tobytes()) == gray).all()
    assert image_copies.read_image(b"junk") is None and image_copies.read_image(None) is None and image_copies.read_image(b"P5 x") is None
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(60)] + [(60, [7.0, 1.0]), (None, [1.0]), (61, None)], "vec_id long, embedding array<float>")
    pictures = image_copies.draw(vectors, False)
    flat = spark.createDataFrame([(100, bytearray(b"junk")), (101, None), (102, bytearray(image_copies.write_png(np.full((96, 96), 9, np.uint8)))), (103, bytearray(image_copies.write_png(gray)))], "image_id long, image binary")
    found = image_copies.find_copies(image_copies.draw(vectors.filter("vec_id % 4 = 0"), True), pictures.union(flat)).collect()
    pairs = {(r["query_id"], r["image_id"]) for r in found if r["kind"] == "copy"}
    asked = {k for k in range(0, 60, 4)}
    assert len(pairs & {(k, k) for k in asked}) >= 0.9 * len(asked) and len(pairs) <= len(asked) + 1
    members = {r["image_id"]: r["rep_id"] for r in found if r["kind"] == "image"}
    assert members[60] == 7 and members[5] == 5 and members[100] == 100 and 101 not in members and None not in members
    assert {r["query_id"]: r["rep_id"] for r in found if r["kind"] == "query"} == {**{k: k for k in asked}, 60: 60}
    assert (60, 7) in pairs
    assert image_copies.find_copies(pictures.limit(0), pictures.limit(0)).collect() == []
    clash = pictures.union(pictures.filter("image_id < 3")).selectExpr("image_id", "image", "1 AS corners", "2 AS n", "3 AS part", "4 AS digest")
    big = image_copies.draw(vectors.filter("vec_id = 8"), True).selectExpr(f"image_id + {1 << 60} AS image_id", "image")
    again = {(r["query_id"], r["image_id"]) for r in image_copies.find_copies(big.union(big), clash).filter("kind = 'copy'").collect()}
    assert again == {((1 << 60) + 8, 8)}


def warped(gray, angle=0.0, scale=1.0):
    """Turned about its middle and resized, bilinear."""
    h, w = gray.shape
    yy, xx = np.mgrid[0 : int(h * scale), 0 : int(w * scale)].astype(float)
    u, v = (xx - (xx.shape[1] - 1) / 2) / scale, (yy - (xx.shape[0] - 1) / 2) / scale
    c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
    x, y = c * u + s * v + (w - 1) / 2, -s * u + c * v + (h - 1) / 2
    x0, y0 = np.clip(x.astype(int), 0, w - 2), np.clip(y.astype(int), 0, h - 2)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    f = gray.astype(float)
    out = f[y0, x0] * (1 - fx) * (1 - fy) + f[y0, x0 + 1] * fx * (1 - fy) + f[y0 + 1, x0] * (1 - fx) * fy + f[y0 + 1, x0 + 1] * fx * fy
    out[(x < 0) | (x > w - 1) | (y < 0) | (y > h - 1)] = 0
    return np.rint(out).astype(np.uint8)


def test_image_recall(spark):
    """Edited copies of every kind, against all pairs compared without tables."""
    noise = np.random.default_rng(5)
    edits = [
        lambda g: g[12:84, 10:82],
        lambda g: np.rint(g * 0.8 + 24).astype(np.uint8),
        lambda g: warped(g, 10),
        lambda g: warped(g, 30),
        lambda g: np.rot90(g).copy(),
        lambda g: warped(g, 0, 1.2),
        lambda g: warped(g, 0, 0.7),
        lambda g: np.rint(image_copies._box(g[None].astype(np.float32), 1)[0] / 9).astype(np.uint8),
        lambda g: np.clip(g + noise.normal(0, 4, g.shape), 0, 255).astype(np.uint8),
    ]
    vectors = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(40)], "vec_id long, embedding array<float>")
    pictures = image_copies.draw(vectors, False)
    grays = {r["image_id"]: image_copies.read_image(bytes(r["image"])).astype(np.uint8) for r in pictures.collect()}
    rows = [(100 * e + k, bytearray(image_copies.write_png(edit(grays[k])))) for e, edit in enumerate(edits) for k in range(10)]
    asked = spark.createDataFrame(rows, "image_id long, image binary")
    got = {(r["query_id"], r["image_id"]) for r in image_copies.find_copies(asked, pictures).filter("kind = 'copy'").collect()}
    for e in range(len(edits)):
        assert sum((100 * e + k, k) in got for k in range(10)) >= 9, e
    table = lambda df: {r["image_id"]: np.frombuffer(r["corners"], image_copies.CORNER) for r in image_copies.corners(df).collect()}
    queries, targets = table(asked), table(pictures)
    brute = set()
    for q, one in queries.items():
        for t, other in targets.items():
            if image_copies.agreement(one, other)[0] >= image_copies.needed(one, other):
                brute.add((q, t))
    assert got <= brute and len(got) >= 0.95 * len(brute) and all(q % 100 == t for q, t in brute)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tideline.llm import pii

    out = corpus_pipeline.run(spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, -1))
    rows = [(d, t) for d, t in rows if last[t] == d]
    classes = plain_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in rows:
        ids = [*library.encode(pii.redact(t, pii.find_spans(t)), add_special_tokens=False).ids, 1]
        want |= {(d, k, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("digest", F.lit("clash"))
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name


def test_common_corners_meet_by_longer_keys(spark):
    """Corners that agree in one table's short key alone: a few such images meet, very many don't, but for equal corners."""
    rng = np.random.default_rng(6)
    short = image_copies._CHOICES[0][: image_copies.KEY_BITS]

    def frames(asked, images):
        rows = []
        for k in range(images):
            own = np.zeros(3, image_copies.CORNER)
            bits = rng.integers(0, 2, (3, 256)).astype(np.uint8)
            bits[:, short] = np.arange(3)[:, None] == np.arange(len(short)) % 3
            own["bits"] = np.packbits(bits, axis=1)
            rows.append((k, 3, own.tobytes()))
        schema = "image_id long, n long, corners binary"
        return spark.createDataFrame(rows[:asked], schema), spark.createDataFrame(rows, schema)

    def pairs(asked, images):
        with Shelf(spark) as shelf:
            return sorted((r[0], r[1]) for r in image_copies.candidates(*frames(asked, images), shelf).collect())

    assert pairs(3, image_copies.COMMON) == [(q, i) for q in range(3) for i in range(image_copies.COMMON)]
    assert pairs(10, 300) == [(k, k) for k in range(10)]
