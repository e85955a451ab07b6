"""The filter audit, the fingerprints and the trie of conversations against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import audit, fingerprints, queries, trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text)


def brute_audit(rows, labels):
    fails = {}
    for k, (i, text, part) in enumerate(rows):
        t, w = text or "", words(text or "")
        late = any(j is not None and (u or "") == t and (i is None or j < i) for j, u, _ in rows)
        fails[k] = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), late]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {p or "" for *_, p in rows}:
        mine = [k for k in fails if (rows[k][2] or "") == part]
        shapley = [0] * 5
        found = []
        for order in itertools.permutations(range(5)):
            alive = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in alive if fails[k][f]}
                shapley[f] += len(gone)
                redundant = sum(fails[k][f] for k in mine if k not in alive)
                unique = sum(fails[k] == [x == f for x in range(5)] for k in mine)
                alive -= gone
                found.append((part, "".join("ABCDE"[x] for x in order), step, len(alive), len(gone), redundant, unique, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit(spark):
    rng = random.Random(4)
    pool = ["word", "other", "UPPER", "x#", "été", "A", "tab\tbed", "\x85inside"]
    texts = [" ".join(rng.choice(pool[: rng.randint(1, 8)]) if rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 199, 200, 201, 400]))) for _ in range(60)]
    texts += ["", None, None, "  ", "\nlead", "A" * 3 + "b" * 97, "A" * 3 + "b" * 96, "w " * 30_000]
    rows = [(k, t, rng.choice(["en", "fr", "", None])) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k], "en") for k in range(20)] + [(5, texts[5], "fr"), (5, texts[6], "fr"), (None, texts[0], "en"), (None, "only null", None), (None, "only null", None), (3, texts[3], rows[3][2])]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 110, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 1, "clash", "m") for i, t, p in rows], "doc_id long, text string, lang string, n int, h string, mask string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in AUDIT) for r in audit.audit(docs, said).collect())
    assert got == brute_audit(rows, labels)
    assert audit.audit(docs.limit(0), said).count() == 0
    assert sorted(tuple(r[c] for c in AUDIT) for r in audit.audit(docs, said.limit(0)).collect()) == brute_audit(rows, [])


def test_parity_sums_add_up(spark):
    """Sums of shards are the sums of the whole, where no text stands in two of them."""
    docs = spark.createDataFrame([(k, f"text {k} #" if k % 3 else "T" * k, "en") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    both = [audit.parity_sums(docs.where(w), labels) for w in ("doc_id < 15", "doc_id >= 15", "true")]
    p = [{r.label: np.array(r.p) for r in x.collect()} for x in both]
    assert all((p[0][k] + p[1][k] == p[2][k]).all() for k in p[2])


def brute_compare(rows):
    key = lambda i: (i is None, -(i or 0))
    order = sorted({key(i) for i, _ in rows})
    return {k: order[(order.index(k) + 1) % len(order)] for k in order}


def test_fingerprints(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "εpsilon", "\U0001f600", "zeta"]) + str(rng.randrange(100)) for _ in range(n))
    rows = [(k * 7, sentence(rng.choice([1, 3, 20, 100, 600]))) for k in range(40)] + [(1, ""), (2, None), (3, "ab"), (4, "abc"), (-5, "é" * 10), (None, "null id text " * 5), (None, "other null"), (7, rows_ := "same id, other text"), (14, "x" * 5000)]
    rows += [rows[3], rows[3], (1000, sentence(30_000))]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, fingerprint string, k int").repartition(3)
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(rows) and rows_
    th = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    after = brute_compare(rows)
    key = lambda i: (i is None, -(i or 0))
    least = {k: min((t or "" for i, t in rows if key(i) == k), key=th.get) for k in after}
    print_of = lambda t: fingerprints.packed(next(fingerprints.sketches(pa.array([t]))))
    want = []
    for i, t in rows:
        t, u = t or "", least[after[key(i)]]
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        a, b, c = print_of(t), print_of(e), print_of(u)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.to_text(a), fingerprints.to_text(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.near_edited for r in got if r.n_chars < 3} == {1.0}
    assert fingerprints.compare(docs.limit(0)).count() == 0
    assert fingerprints.compare(spark.createDataFrame([(1, "a text alone")], "doc_id long, text string")).first().near_next == 1.0
    made = fingerprints.fingerprints(docs)
    assert sorted(made.columns) == sorted(docs.columns) and {r.fingerprint for r in made.collect()} == {r.fingerprint for r in got}


def true_sketch(text, width=fingerprints.WIDTH):
    return {text[k : k + width] for k in range(max(1, len(text) - width + 1))} if text else set()


def test_sketches_keep_what_lies_below_the_threshold(monkeypatch):
    """Against every shingle's hash one by one; and long texts in parts give what they give whole."""
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 40, 300, 9000):
        text = "".join(rng.choice("abéε\U0001f600 ") for _ in range(n))
        one = [int(fingerprints.shingles(np.frombuffer(s.encode(), "u1"), np.array([0, len(s.encode())]), 10**6)[0][0]) for s in true_sketch(text)]
        bar, h = next(fingerprints.sketches(pa.array([text])))
        kept = sorted(x for x in one if x < fingerprints.ALL // fingerprints.SCALE)
        if len(kept) >= fingerprints.LEAST:
            assert bar == fingerprints.ALL // fingerprints.SCALE and h.tolist() == kept
        else:
            assert h.tolist() == sorted(one)[: fingerprints.LEAST] and bar == (sorted(one)[fingerprints.LEAST] if len(one) > fingerprints.LEAST else fingerprints.ALL)
        with monkeypatch.context() as m:
            m.setattr(fingerprints, "PART", 50)
            again = next(fingerprints.sketches(pa.array([text])))
            assert again[0] == bar and (again[1] == h).all()
            m.setattr(fingerprints, "LEAST", 5)


def test_likeness_estimates_containment_of_unequal_documents():
    rng = random.Random(3)
    letters = "abcdefghijklmnop "
    far, small_far = [], []
    for _ in range(60):
        small = "".join(rng.choice(letters) for _ in range(rng.randint(2000, 4000)))
        share = rng.random()
        part = small[: int(len(small) * share)]
        large = "".join(rng.choice(letters) for _ in range(20_000)) + part + "".join(rng.choice(letters) for _ in range(9000))
        a, b = (fingerprints.packed(next(fingerprints.sketches(pa.array([t])))) for t in (small, large))
        x, y = true_sketch(small), true_sketch(large)
        far.append(abs(fingerprints.likeness(a, b) - len(x & y) / len(x)))
        both = fingerprints.merge(a, b)
        joint = np.union1d(*(fingerprints.unpacked(s)[1] for s in (a, b)))
        assert (fingerprints.unpacked(both)[1] == joint).all()
        small_far.append(fingerprints.likeness(both, b))
    assert np.mean(far) < 0.05 and max(far) < 0.2 and min(small_far) == 1.0


def brute_trie(rows, share=20, heads=4, rebuild=True):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in conv.items()}
    if rebuild:
        new = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % heads
            new[c] = own.get(c - int(math.fmod(c, share)), [])[:h] + own[c][h:]
        own = new
    members = {}
    for c, x in own.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in cs if len(own[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(q not in kids for q in sub), sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in sub if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def conversations(seed, n=120):
    rng = random.Random(seed)
    say = ["hello", "hello there", "", None, "a  b\tc", "été x", "bye"]
    rows = []
    for c in rng.sample(range(-30, 400), n):
        rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(say[: rng.randint(1, 7)])) for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9]))]
    same = [(t, "user", f"turn {t}") for t in range(5)]
    rows += [(c, *x) for c in range(500, 540) for x in same]
    rows += [(600, 1, "user", "twice"), (600, 1, "user", "twice"), (600, None, "user", "z"), (None, 0, "user", "nowhere"), (600, 2, "user", "long " * 3000)]
    rows += [(601, t, "user", "again") for t in range(700)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, fp string, depth int"


@pytest.mark.parametrize("keep", [(1 << 62) - 1, 1])
def test_trie(spark, keep):
    """As it is, and with hashes of one bit, which collide everywhere; conversations over several partitions."""
    rows = conversations(keep % 7)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    turns, ids = trie.with_shared_heads(df)
    got = sorted((tuple(r[c] for c in TRIE) for r in trie.nodes(turns, ids, keep).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_as_given(spark):
    rows = [r for r in conversations(3, 40) if r[0] != 601]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r[c] for c in TRIE) for r in trie.nodes(df).collect()), key=repr)
    assert got == brute_trie(rows, rebuild=False)
    assert trie.nodes(df.limit(0)).count() == 0
    turns, ids = trie.with_shared_heads(df.limit(0))
    assert trie.nodes(turns, ids).count() == 0


def test_digests_of_many_ends_stream(spark, monkeypatch):
    ends = [(d, d * 3, 0, c) for d in (1, 2) for c in random.Random(d).sample(range(10**6), 12_000)] + [(5, 1, 0, 77)]
    df = spark.createDataFrame(ends, "depth long, fp long, salt long, conv_id long").repartition(7)
    got = {(r.depth, r.fp): r.ends_sha256 for r in trie.end_digests(df).collect()}
    want = {(d, f): hashlib.sha256(",".join(str(c) for x, *_, c in sorted(ends, key=lambda e: e[3]) if x == d).encode()).hexdigest() for d, f, *_ in ends}
    assert got == want


def test_queries_of_this_round_have_whole_results(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_audit(spark, sf).count() == 600 * spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().count()
    assert queries.op12_fingerprints(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    root = queries.op13_trie(spark, sf).where("depth = 0").collect()
    assert len(root) == 1 and root[0].n_convs == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
