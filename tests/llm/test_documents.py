"""The document operators against brute force, on a small table with awkward rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import bpe, doubling, fmindex, jaccard, lines, packing, quality, toxicity
from sparkloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, g int, row string, prefix string"


def awkward():
    """Documents with copies, near copies, shared passages, periodic text, nulls, repeated rows and clashing columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() if rng.random() < 0.9 else word() + "\n" for _ in range(n))
    passage, base = text(90), text(300)
    out = [text(rng.randint(1, 200)) for _ in range(12)]
    out += [base, base, base.upper().lower(), base.replace("a", "A", 1)]
    for k in range(6):
        words = base.split(" ")
        words[k * 7] = "changed"
        out.append(" ".join(words))
    out += [text(40) + " " + passage + " " + text(30) for _ in range(4)] + [passage, passage[: len(passage) // 2]]
    out += ["x " * 300, "x " * 400, "abc " * 500, "z" * 3000, "z" * 900, "\n" * 50, "", "   ", None, "one", "one two", "ONE two", "Σας \x01 \x85 x", "a\r\nb\r\nc " * 60]
    rows = [(k, t) for k, t in enumerate(out)]
    rows += [(3, out[3]), (4, "another text of a known id"), (None, base), (None, None), (7, None), (500, base), (500, base)]
    return [(i, t, "en", "s", len(t or ""), "clash", 1, "r", None) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in got} and len(got) >= len({x for e in edges for x in e if e[0] != e[1]})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, width):
    raw = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return frozenset(tuple(raw[k : k + width]) for k in range(max(1, len(raw) - width + 1))) if raw else frozenset()


def brute_components(rows, percent, width):
    ids = [(i, shingle_set(t, width)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, x) in enumerate(ids):
        for j, y in ids[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in ids}


@pytest.mark.parametrize("crowd,block", [(64, 1024), (2, 3)])
def test_jaccard(docs, rows, crowd, block, monkeypatch):
    """Short lists alone, and nearly all lists crowded and in several blocks."""
    monkeypatch.setattr(jaccard.links, "__defaults__", (85, 4, crowd, block))
    want = brute_components(rows, 85, 4)
    got = keyed(jaccard.join(docs), "doc_id", "n_shingles", "component_id")
    expect = []
    for i, t, *_ in rows:
        s = shingle_set(t, 4)
        expect.append((i, len(s), want[i] if i is not None and s else i))
    assert got == sorted(expect, key=repr)


def test_jaccard_hints_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "HINTS", 0)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect() if r.doc_id is not None and r.n_shingles}
    want = brute_components(rows, 85, 4)
    assert got == {i: want[i] for i in got}


def test_jaccard_stage(docs, none, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute_components(rows, 80, 5)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, *_ in rows if i is not None and want[i] == i)
    assert jaccard.join(none).count() == 0


@pytest.mark.parametrize("crowd", [4096, 1])
def test_fmindex(docs, rows, none, crowd, monkeypatch):
    monkeypatch.setattr(fmindex.earlier_spans, "__defaults__", (12, crowd, 5))
    texts = [(i if i is not None else 1 << 63, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - 11):
            k = tuple(w[p : p + 12])
            first[k] = min(i, first.get(k, i))
    expect = []
    for (i, w), (doc_id, *_) in zip(texts, rows, strict=True):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 11):
            if first[tuple(w[p : p + 12])] < i:
                gone[p : p + 12] = True
        expect.append((doc_id, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert keyed(fmindex.dedup(docs, 12), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expect, key=repr)
    out = fmindex.dedup_text(docs, 12)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert fmindex.dedup(none).count() == 0


def test_fm_index_counts():
    """Backward search finds every pattern as often as it stands in the texts."""
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, 40), 0) for _ in range(6)])
    stop = np.repeat(np.arange(40, 246, 41), 41)
    index = fmindex.FMIndex(text, stop, np.repeat(np.arange(6), 41), 6)
    flat = text.tolist()
    for size in range(1, 7):
        for p in range(len(flat) - size):
            pattern = flat[p : p + size]
            if 0 in pattern:
                continue
            low, high = np.array([0]), np.array([len(text)])
            for c in reversed(pattern):
                low, high = index.step(np.array([c]), low, high)
            assert high[0] - low[0] == sum(flat[q : q + size] == pattern for q in range(len(flat) - size + 1))


@pytest.mark.parametrize("symbols", [2, 9])
def test_fm_index_matching_statistics(symbols):
    """How much of a text, from each place on, a text of a smaller owner holds."""
    rng = np.random.default_rng(symbols)
    texts = [rng.integers(1, 1 + symbols, rng.integers(1, 50)) for _ in range(12)]
    texts += [np.concatenate([texts[0], texts[3]]), texts[5], texts[5][:20]]
    owner = rng.permutation(len(texts)) // 2
    text = np.concatenate([np.append(t, 0) for t in texts])
    size = np.array([len(t) + 1 for t in texts])
    index = fmindex.FMIndex(text, np.repeat(np.cumsum(size) - 1, size), np.repeat(owner, size), 12)
    holds = lambda x, k: any(x == y[q : q + len(x)] for y, o in zip(plain, owner, strict=True) if o < owner[k] for q in range(len(y) - len(x) + 1))
    plain = [t.tolist() for t in texts]
    for k, got in enumerate(index.statistics(texts, owner)):
        want = [next(n for n in range(min(12, len(plain[k]) - p), -1, -1) if not n or holds(plain[k][p : p + n], k)) for p in range(len(plain[k]))]
        assert got.tolist() == want


@pytest.mark.parametrize("op,length", [(fmindex, 12), (doubling, 400)])
def test_windows_of_long_texts_in_parts(docs, op, length, monkeypatch):
    """Texts longer than a part give what they give whole."""
    from sparkloom.llm import spans, windows

    data = np.frombuffer(b"".join((r.text or "").encode() for r in docs.collect()), "u1")
    offsets = np.array([0, 900, 900, len(data)])
    units = spans.BYTES[data]
    whole, words = windows.runs_of(units, offsets, length, 10), windows.word_hashes(data, offsets)
    cover = lambda r: {(int(s + k), int(s + d), int(g)) for s, n, d, g in zip(r.start, r.count, r.reach, r.gram, strict=True) for k in range(n)}
    monkeypatch.setattr(windows, "PART", 1000)
    parts, again = windows.runs_of(units, offsets, length, 10), windows.word_hashes(data, offsets)
    assert cover(parts) == cover(whole) and len(parts.start) > len(whole.start)
    assert all((a == b).all() for a, b in zip(words, again, strict=True))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_doubling(docs, rows, none, crowd, monkeypatch):
    monkeypatch.setattr(doubling.recurring_spans, "__defaults__", (400, crowd, 3))
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = {}
    for b in texts:
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    expect = []
    for b, (i, *_) in zip(texts, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype("i1")])) == 1).sum())
        expect.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, "u1")[~gone].tobytes()).hexdigest()))
    assert keyed(doubling.dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expect, key=repr)
    assert doubling.dedup(none).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in rows]
    got = packing.pack(docs, size=256, group_pieces=10, with_ids=True).collect()
    expect = [(i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)) for (i, *_), x in zip(rows, want, strict=True) for s in range(0, len(x), 256)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == sorted(expect, key=repr)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    lengths = -np.sort(-rng.integers(1, 101, 300))
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths.tolist():
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= n
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_bpe(docs, rows, none):
    import public_tokenizers
    import tiktoken

    enc = bpe.encoder(bpe.ranks_path())
    own = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: k for k, b in enumerate(enc.bytes_of)}, special_tokens={})
    expect = []
    for i, t, *_ in rows:
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        expect.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert keyed(bpe.encode(docs), *cols) == sorted(expect, key=repr)
    for chunk, overlap, spread in ((40, 12, 100), (7, 3, 10_000), (25, 40, 30)):  # nearly all stitched, often through one long word
        assert keyed(bpe.encode(docs, chunk=chunk, overlap=overlap, spread=spread), *cols) == sorted(expect, key=repr)
    assert bpe.encode(none).count() == 0


def test_lines(spark, docs, none, rows):
    a = "first line here\nsecond line here\nthird line here\n\nfifth line here and it is a long one"
    small = [(1, a), (2, "own start\n" + a + "\nown end"), (3, "second line here\nnothing else"), (4, a), (5, None), (6, ""), (7, a.replace("third", "3rd"))]
    df = spark.createDataFrame([(i, t, "x") for i, t in small], "doc_id long, text string, gone string")
    out = {r.doc_id: r for r in lines.dedup(df, rare=2, min_lines=2, min_bytes=30).collect()}
    text = {r.doc_id: r.text for r in lines.dedup_text(df, rare=2, min_lines=2, min_bytes=30).collect()}
    assert text == {1: a, 2: "own start\nown end", 3: "second line here\nnothing else", 4: "", 5: None, 6: "", 7: "3rd line here"}
    assert [(out[k].n_lines, out[k].n_removed) for k in range(1, 8)] == [(5, 0), (7, 5), (2, 0), (5, 5), (0, 0), (0, 0), (5, 4)]
    assert all(out[k].kept_sha256 == hashlib.sha256((text[k] or "").encode()).hexdigest() for k in text)
    whole = lines.dedup_text(docs)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert lines.dedup(none).count() == 0
    # the first holder of a line keeps it
    kept = {line for r in whole.collect() for line in (r.text or "").split("\n")}
    assert {line for _, t, *_ in rows for line in (t or "").split("\n") if line.strip()} <= kept


def test_lines_ask_holders_of_windows(spark):
    """A block goes although its lines' first holders, each another document, don't hold the block."""
    small = [(1, "one\ntwo\nx"), (2, "y\nthree"), (3, "four\nz"), (4, "v\none\ntwo\n\nthree\nfour\nw"), (5, "p\none\ntwo\n\nthree\nfour\nq")]
    small += [(6, "m" * 90 + "\nr"), (7, "a\nshort"), (8, "b\n" + "m" * 90 + "\nshort"), (9, "c\n" + "m" * 90 + "\nshort\nd")]
    df = spark.createDataFrame(small, "doc_id long, text string")
    for rare in (50, 1):
        text = {r.doc_id: r.text for r in lines.dedup_text(df, rare=rare).collect()}
        assert text == dict(small) | {5: "p\nq", 8: "b\nshort", 9: "c\nd"}


def test_lines_second_and_moved_copies():
    """Every run of enough lines or bytes that the partner holds goes, however often and wherever it stands."""
    rng = random.Random(8)
    assert lines.common_blocks([1, 7, 1], [1, 9], [90, 5, 90], 3, 80) == [0, 2]
    assert lines.common_blocks([4, 5, 6, 1, 2, 3], [1, 2, 3, 4, 5, 6], [5] * 6, 3, 80) == [0, 1, 2, 3, 4, 5]
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        sizes = [[0, 5, 20, 35, 50, 90][h] for h in a]
        want = set()
        for i, j in itertools.combinations(range(len(a) + 1), 2):
            enough = sum(z > 0 for z in sizes[i:j]) >= 3 or sum(sizes[i:j]) >= 80
            if enough and any(b[k : k + j - i] == a[i:j] for k in range(len(b))):
                want |= set(range(i, j))
        assert set(lines.common_blocks(a, b, sizes, 3, 80)) == want
    assert lines.held_runs([3] * 5, [3] * 3) == [1, 2, 3, 3, 3]


def test_lines_against_all_earlier_documents(spark):
    """Over many documents: a line goes if and only if it stands in a block that any earlier document holds."""
    rng = random.Random(12)
    word = [f"{k} " + "w" * rng.choice([3, 12, 30, 45, 90]) for k in range(25)]
    small = [(d, [rng.choice(word) for _ in range(rng.randrange(14))]) for d in range(60)]
    want = {}
    for d, x in small:
        gone = set()
        for i, j in itertools.combinations(range(len(x) + 1), 2):
            enough = j - i >= 3 or sum(map(len, x[i:j])) >= 80
            if enough and any(y[k : k + j - i] == x[i:j] for e, y in small if e < d for k in range(len(y))):
                gone |= set(range(i, j))
        want[d] = "\n".join(line for k, line in enumerate(x) if k not in gone)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in small], "doc_id long, text string")
    for rare in (50, 2):
        assert {r.doc_id: r.text for r in lines.dedup_text(df, rare=rare).collect()} == want


def brute_lines(rows, min_lines=3, min_bytes=80):
    """The texts left where every line goes that stands in a block which an earlier (id, text hash) holds."""
    lines_of = [(key, (text or "").split("\n") if text else []) for key, text in rows]
    out = []
    for key, x in lines_of:
        gone = set()
        for i in range(len(x)):
            for j in range(len(x), i, -1):
                solid = [k for k in range(i, j) if x[k].strip(" \t\r\v\f")]
                enough = len(solid) >= min_lines or sum(len(x[k].encode()) for k in solid) >= min_bytes
                if enough and any(other < key and any(y[k : k + j - i] == x[i:j] for k in range(len(y) - (j - i) + 1)) for other, y in lines_of):
                    gone |= set(range(i, j))
                    break
        out.append((key, [line for k, line in enumerate(x) if k not in gone]))
    return out


def test_lines_of_awkward_rows(docs, rows, spark):
    """The query's operator, with its own parameters, against all blocks of all earlier documents."""
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t, *_ in rows}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    keys = [((i if i is not None else 1 << 63, hashes[t]), t) for i, t, *_ in rows]
    want = []
    for (i, *_), (_, t), (_, kept) in zip(rows, keys, brute_lines(keys), strict=True):
        n = len(t.split("\n")) if t else 0
        want.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert keyed(lines.dedup(docs), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_patience():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [rng.randrange(12) for _ in range(rng.randrange(20))]
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]


def labelled(spark, bad, good, label):
    docs, labels = [], []
    rng = random.Random(9)
    for k in range(400):
        wrong = k % 4 == 1
        docs.append((k, "\n".join((bad if wrong else good)(rng) for _ in range(rng.randint(1, 6))), "x"))
        labels.append((k, int(wrong == (label == "toxic"))))
    docs += [(400, None, "x"), (401, "", "x"), (None, "some text", "x"), (3, docs[3][1], "x")]
    labels += [(3, labels[3][1]), (None, 1), (9999, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def f1(out, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    rows = [(truth[r.doc_id], r.predicted) for r in out.collect() if r.held_out and truth.get(r.doc_id) is not None]
    hit = sum(a == b == 1 for a, b in rows)
    return 2 * hit / max(1, sum(a for a, _ in rows) + sum(b for _, b in rows))


def test_toxicity(spark, none):
    plain = lambda r: " ".join(r.choice(["the", "red", "house", "stands", "on", "a", "hill", "near", "old", "water"]) for _ in range(30))
    nasty = lambda r: plain(r) + " " + " ".join(r.choice(["idiot", "scumbag", "loserish"]) for _ in range(3))
    docs, labels = labelled(spark, nasty, plain, "toxic")
    out = toxicity.score(docs, labels)
    assert out.count() == 404 and f1(out, labels, "toxic") > 0.95
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where("held_out and crc32(cast(doc_id as string)) % 4 <> 2").count() == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 280 < kept.count() < 320
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    scores = {(r.doc_id, r.score) for r in out.collect() if r.doc_id in (400, 401)}
    assert len({s for _, s in scores}) == 1 and all(0 <= s < 0.3 for _, s in scores)  # null and empty texts show no feature
    again = toxicity.score(docs.withColumn("score", docs.doc_id).withColumn("row", docs.text), labels).where("doc_id = 3").collect()
    assert len(again) == 2 and len({r.score for r in again}) == 1  # repeated rows, clashing names
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0
    long = docs.unionByName(spark.createDataFrame([(3, "idiot " * 30_000, "x")], docs.schema))
    assert toxicity.score(long, labels).where("doc_id = 3").count() == 3  # texts of any length teach


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.2
    flip = lambda p: np.where(rng.random(3000) < p, ~y, y)
    copy = flip(0.3)
    votes = np.stack([flip(0.05), flip(0.1), copy, copy, copy, flip(0.1)], 1)
    post, rates, parent = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == y).mean() > 0.95
    assert parent[:3].tolist() == [-1, -1, -1] and parent[3] == 2 and parent[4] in (2, 3) and parent[5] == -1
    assert rates[1, 0, 0] > rates[1, 0, 2]
    told = np.log(rates[1, :, 3] / rates[0, :, 3])  # a copy says nothing beyond its original
    assert abs(told[1]) < 0.01 and rates[:, 0, 3].max() < 0.01
    alone, _, _ = toxicity.label_model(votes[:, [0, 1, 2, 5]], 0.2)
    assert np.abs(post - alone).mean() < 0.01


def test_quality(spark, none):
    good = lambda r: " ".join(r.choice(["the", "house", "stands", "on", "hill", "old", "water"]) + r.choice(["", "", ","]) for _ in range(20)) + "."
    bad = lambda r: " ".join(r.choice(["THE", "HOUSE", "ON"]) + "!!" for _ in range(20))
    docs, labels = labelled(spark, bad, good, "quality")
    out = quality.score(docs, labels)
    assert out.count() == 404 and f1(out, labels, "quality") > 0.95
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, labels).count() == 0
    assert quality.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    scores = {r.score for r in out.collect() if r.doc_id in (400, 401)}
    assert len(scores) == 1  # null and empty texts are one empty line
    again = quality.score(docs.withColumn("score", docs.doc_id).withColumn("row", docs.text), labels).where("doc_id = 3").collect()
    assert len(again) == 2 and len({r.score for r in again}) == 1


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(6)
    unary, trans, first = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    marg, pair, log_z = quality.forward_backward(unary, trans, first)
    total, want, want_pair = 0.0, np.zeros((9, 2)), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = list(itertools.product((0, 1), repeat=b - a))
        w = np.exp([sum(unary[a + k, s] for k, s in enumerate(p)) + sum(trans[s, t] for s, t in zip(p, p[1:])) for p in paths])
        total += np.log(w.sum())
        for p, v in zip(paths, w / w.sum(), strict=True):
            for k, s in enumerate(p):
                want[a + k, s] += v
            for s, t in zip(p, p[1:]):
                want_pair[s, t] += v
    assert np.allclose(marg, want) and np.allclose(pair, want_pair) and np.isclose(log_z, total)


def thue_morse(size):
    """A word and its complement that collide in every polynomial modulo a power of two."""
    bits = [k.bit_count() & 1 for k in range(size)]
    return ["".join(letters[b] for b in bits) for letters in ("ab", "ba", "-Y", "Y-")]


@pytest.mark.parametrize("size", [1024, 8192])
def test_hashes_tell_thue_morse_words_apart(spark, size):
    """Words and lines that a hash modulo 2**64 can't tell apart: what brute force gives, through op1, op4, op5 and op10."""
    t, u, v, w = thue_morse(size)
    frame = " ".join(f"w{k}" for k in range(30))
    texts = [f"{t} x y z", f"{u} x y z", f"{frame} {t} {frame}", f"{frame} {u} {frame}", f"{v}\nshort", f"{w}\nshort", f"{frame} {u} {frame}"]
    rows = [(k, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 85, 4)
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == want and want[1] == 1
    assert {r.doc_id: r.n_removed for r in fmindex.dedup(df).collect()} == dict.fromkeys(range(6), 0) | {6: 61}
    count = {}
    for _, x in rows:
        for p in range(len(x) - 399):
            count[x[p : p + 400]] = count.get(x[p : p + 400], 0) + 1
    gone = {k: len({q for p in range(len(x) - 399) if count[x[p : p + 400]] > 1 for q in range(p, p + 400)}) for k, x in rows}
    assert {r.doc_id: r.n_removed for r in doubling.dedup(df).collect()} == gone
    assert {r.doc_id: r.n_removed for r in lines.dedup(df).collect()} == dict.fromkeys(range(6), 0) | {6: 1}


def test_very_long_texts(spark):
    """A text of over a million bytes and its copy, through every operator on texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(15_500))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text), (2, text), (3, "short one")], "doc_id long, text string").repartition(2)
    by = lambda out: {r.doc_id: r for r in out.collect()}
    assert {i: r.component_id for i, r in by(jaccard.join(df)).items()} == {1: 1, 2: 1, 3: 3}
    assert {i: (r.n_words, r.n_removed) for i, r in by(fmindex.dedup(df)).items()} == {1: (186_000, 0), 2: (186_000, 186_000), 3: (2, 0)}
    assert {i: (r.n_removed, r.n_spans) for i, r in by(doubling.dedup(df)).items()} == {1: (len(text), 1), 2: (len(text), 1), 3: (0, 0)}
    assert {i: r.n_removed for i, r in by(lines.dedup(df)).items()} == {1: 0, 2: 15_500, 3: 0}
    got = by(bpe.encode(df))
    assert got[1].ids_sha256 == got[2].ids_sha256 and got[2].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    enc = bpe.encoder(bpe.ranks_path())
    assert got[1].n_tokens == len(enc.bpe.encode_ordinary(text))
    pieces = [r for r in packing.pack(df).collect() if r.doc_id == 1]
    assert sorted(r.start for r in pieces) == list(range(0, pieces[0].doc_tokens, 4096)) and sum(r.length for r in pieces) == pieces[0].doc_tokens


def test_stages_of_empty_tables(none):
    for stage in (jaccard.keep_one, fmindex.dedup_text, lines.dedup_text):
        out = stage(none)
        assert out.columns == none.columns and out.count() == 0


def test_pipeline(spark, tmp_path):
    """run() against brute-force versions of its stages; the classifier's own decisions are taken as they are."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = ["\n".join(line(rng.randint(2, 14)) for _ in range(rng.randint(2, 9))) for _ in range(70)]
    passage, block = line(70), "\n".join(line(4) for _ in range(4))
    texts += [texts[0], texts[1] + " more", line(9) + " " + passage + " " + line(9), line(8) + "\n" + block, block + "\n" + line(12), line(5) + " " + passage]
    nasty = [line(6) + " " + " ".join(rng.choice(["idiot", "scumbag", "loser"]) for _ in range(4)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts + nasty)] + [(500, None), (501, ""), (None, texts[2]), (502, texts[3]), (502, texts[3])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    labels = spark.createDataFrame([(k, 1, int(k >= len(texts))) for k in range(len(texts) + len(nasty))], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    flags = {(r.doc_id, r.predicted) for r in toxicity.score(docs, labels).collect()}
    bad = {i for i, p in flags if p}
    assert bad and all(i is not None and len(texts) <= i < 500 for i in bad)
    left = [(i, t) for i, t in rows if i not in bad]
    from pyspark.sql import functions as F

    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    number = lambda i: i if i is not None else 1 << 63
    cut = brute_lines([((number(i), h[t]), t) for i, t in left])
    left = [(i, t if t is None else "\n".join(kept)) for (i, t), (_, kept) in zip(left, cut, strict=True)]
    low = brute_components(left, 80, 5)
    left = [(i, t) for i, t in left if i is None or low[i] == i]
    first = {}
    for i, t in left:
        w = (t or "").encode().split()
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(number(i), first.get(tuple(w[p : p + 50]), number(i)))
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in left:
        w = (t or "").encode().split()
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < number(i) for q in range(p, p + 50)}
        t = t if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, 0, len(ids), zlib.crc32(ids.tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert keyed(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)


def test_ranks_stream_over_batches(monkeypatch):
    """A sorted partition in batches of any size gives the ranks of the whole; one row of it waits at a time."""
    import pyarrow as pa

    class Here:
        @staticmethod
        def get():
            return Here()

        def partitionId(self):
            return 3

    monkeypatch.setattr(doubling, "TaskContext", Here)
    rng = random.Random(1)
    for trial in range(60):
        pairs = sorted((rng.randrange(4), rng.randrange(5)) for _ in range(rng.randint(1, 40)))
        left, right = trial % 2 == 0, trial % 3 == 0
        table = pa.RecordBatch.from_pydict({"run": list(range(len(pairs))), "g": [0] * len(pairs), "crowded": [False] * len(pairs), "m": pa.array([0] * len(pairs), pa.int32()), "x": [x for x, _ in pairs], "y": [y for _, y in pairs]})
        size = rng.randint(1, 7)
        batches = lambda: iter([table.slice(k, size) for k in range(0, len(pairs), size)])  # noqa: B023, E731
        got = [r for b in doubling._number({3: (100, left, right)})(batches()) for r in b.to_pylist()]
        order = sorted(set(pairs))
        want = []
        for k, p in enumerate(pairs):
            alone = pairs.count(p) == 1 and not (left and p == pairs[0]) and not (right and p == pairs[-1])
            if not alone:
                want.append((k, 100 + order.index(p)))
        assert [(r["run"], r["rank"]) for r in got] == want
        end = next(doubling._ends(batches())).to_pylist()[0]
        assert (end["x0"], end["y0"]) == pairs[0] and (end["x1"], end["y1"]) == pairs[-1] and end["pairs"] == len(order)


def test_lines_take_time_in_proportion(spark):
    """Two copies of a text of 100,000 lines: nothing looks through all deleted lines for each line."""
    import time

    took = []
    for n in (10_000, 100_000):
        text = "\n".join(f"line {k} of a text" for k in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nits own end")], "doc_id long, text string")
        began = time.time()
        assert {r.doc_id: r.text for r in lines.dedup_text(df).collect()} == {1: text, 2: "its own end"}
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 20
