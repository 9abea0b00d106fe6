"""Vector codes, the conversation trie and language-model scores against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import oracle_rows, spark_rows
from stallgrid.llm import language_model as L
from stallgrid.llm import prefix_trie as P
from stallgrid.llm import queries
from stallgrid.llm import vector_codes as V
from stallgrid.llm.common import id_crc


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_conversation_trie"])
@pytest.mark.parametrize("size", ["0.01"])
def test_query_equals_sql(spark, name, size):
    got, names = spark_rows(queries.QUERIES[name](spark, f"/root/testdata/sf{size}"))
    want, sql_names = oracle_rows(queries.ORACLE_SQL[name], f"/root/testdata/sf{size}")
    assert names == sql_names and got == want


# ---- vector codes ----


def test_dots_are_exact_for_any_limb():
    rng = np.random.default_rng(5)
    for high in (1, 2**12, 2**27, 2**29):
        x, y = rng.integers(-high, high, (40, 8)), rng.integers(-high, high, (16, 8))
        want = np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x], object)
        for bits in (None, 3, 7, 24):
            assert (V.exact_dots(x, y, bits).astype(object) == want).all()
        parts = V.limbs(x, 7)
        assert sum(p.astype(object) * 2 ** (7 * i) for i, p in enumerate(parts)).tolist() == x.astype(object).tolist()
        assert all(abs(p).max() <= 2**7 for p in parts)
    assert 2 ** (2 * V.limb_bits(8)) * 8 < 2**53 and 2 ** (2 * V.limb_bits(1000)) * 1000 < 2**53


def test_nearest_beyond_int64_and_ties():
    x = np.array([[2**61, -(2**61)], [5, 5]], object)
    e = np.array([[0, 0], [2**61, -(2**61)], [10, 10], [0, 0]], object)
    code, error = V.nearest(x, e)
    assert code.tolist() == [1, 0] and error.tolist() == [0, 50]
    assert V.nearest(np.array([[2**40, 0]]), np.array([[0, 0]]))[1].tolist() == [2**63 - 1]


def codes_by_hand(rows, parts, entries, rounds, scale):
    kept = sorted(((i is None, i or 0, [math.floor(scale * x) for x in v], label, i) for i, v, label in rows), key=lambda r: r[:3])
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[2])[p] for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda own, book: min((far(own, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in kept:
                groups[best(cut(r[2])[p], books[p])[1]].append(cut(r[2])[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, labels = [], Counter()
    for _, _, v, label, i in kept:
        found = [best(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        labels[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[n]) for i, c, e, n in out), key=repr), digest


VECTORS = "vec_id bigint, embedding array<double>, label string, code int"


def test_codes_against_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vector(), rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(300)]
    same = vector()
    rows += [(400 + i, same, "hot") for i in range(100)] + [(-1, vector(), "x"), (7, vector(), "x"), (7, vector(), None), (None, vector(), "y")]
    odd = [(1000, None, "a"), (1001, [1.0] * 7 + [None], "a"), (1002, [float("nan")] * 8, "b"), (1003, [float("inf")] + [0.0] * 7, "b"), (-9, [0.5] * 6, "a"), (-8, [], "a"), (1004, [-float("inf")] * 8, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], VECTORS).repartition(5)
    got, books = V.compress(table, parts=4, entries=5, rounds=3, scale=64)
    want, digest = codes_by_hand(rows, 4, 5, 3, 64)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want
    assert V.codebook_digest(books) == digest


def test_codes_of_wide_and_few_vectors(spark):
    few = [(2, [1e12, -1e12, 3.5, 0.0], "a"), (1, [1e12, 1e12, -0.1, 0.0], "a")]
    got, books = V.compress(spark.createDataFrame([(*r, 0) for r in few], VECTORS), parts=2, entries=16, rounds=2)
    want, digest = codes_by_hand(few, 2, 16, 2, 4096)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want and V.codebook_digest(books) == digest
    for rows in ([], [(1, None, "a", 0)], [(1, [], None, 0)]):
        assert V.compress(spark.createDataFrame(rows, VECTORS))[0].count() == 0


# ---- conversation trie ----


def trie_by_hand(strings):
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                words[s[:d]] = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", s[d - 1][1]) if w])
        ends[s].append(c)
    children = Counter(s[:-1] for s in members if s)
    rows = []
    for s, m in members.items():
        under = [t for t in members if t[: len(s)] == s]
        ids = ",".join(map(str, sorted(ends.get(s, []))))
        rows.append((
            min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], sum(1 for t in under if not children[t]),
            sum((len(members[t]) - 1) * words[t] for t in under), hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    return out


CHAT = "conv_id bigint, turn bigint, role string, text string, words int, key string"


def chats(seed, n=120):
    rng = random.Random(seed)
    texts = ["a b", "a  b c ", "", None, "same", "\x1fx\x0by", "z" * 300]
    rows = []
    for c in range(n):
        if c % 3 == 0:  # one group of copies holds a third of the conversations
            rows += [(c, t, "user", "same", 0, "k") for t in range(4)]
        else:
            rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(texts), 0, None) for t in range(rng.randrange(1, 7))]
    return rows + [(None, 1, "user", "lost", 0, "k"), (500, 3, None, None, 0, None), (501, None, "user", "only", 0, None)]


@pytest.mark.parametrize("n", [3, 60])
@pytest.mark.parametrize("small", [0, 50_000])
def test_trie_against_brute_force(spark, monkeypatch, n, small):
    monkeypatch.setattr(P, "SMALL", small)
    monkeypatch.setattr(P, "END_IDS", 3)
    monkeypatch.setitem(vars(P), "RANGE_TURNS", max(1, 400 // n))
    rows = chats(n)
    table = spark.createDataFrame(rows, CHAT).repartition(3)
    got = P.trie_nodes(P.shared_heads(table), 400)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_hand(rebuilt(rows))


def test_trie_of_little_and_long(spark):
    assert P.trie_nodes(P.shared_heads(spark.createDataFrame([], CHAT)), 0).count() == 0
    long = lambda c, n: [(c, t, "user", f"turn {t % 3}", 0, "k") for t in range(n)]
    rows = [*long(20, 3000), *long(40, 2999), (41, 0, "user", "x", 0, "k")]
    got = {(r.depth, r.conv_id): r for r in P.trie_nodes(P.shared_heads(spark.createDataFrame(rows, CHAT)), len(rows)).collect()}
    assert got[0, 20].n_convs == 3 and got[2999, 20].n_convs == 2 and got[3000, 20].n_convs == 1 and got[3000, 20].n_leaves == 1
    assert got[1, 20].saved_tokens >= 2 * 2999 and max(d for d, _ in got) == 3000


def test_extents_against_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 65):
        lcp = rng.integers(0, 5, n)
        table = P.RangeMinima(lcp)
        at, least = rng.integers(0, n, 200), rng.integers(0, 6, 200)
        left, right = table.left_extent(at, least), table.right_extent(at, least)
        for i, d, low, high in zip(at, least, left, right, strict=True):
            a = i
            while a > 0 and lcp[a] >= d:
                a -= 1
            b = i
            while b + 1 < n and lcp[b + 1] >= d:
                b += 1
            assert (low, high) == (a, b)
        low, high = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
        assert table.minimum(low, high).tolist() == [lcp[a : b + 1].min() for a, b in zip(low, high, strict=True)]


# ---- language model ----


def random_model(k=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    return L.Model(L._normal(rng.random(k)), L._normal(rng.random((k, k))), L._normal(rng.random((k, classes))).T.copy())


def paths(kinds, m):
    """(states, probability) of every path through the states."""
    for p in itertools.product(range(len(m.start)), repeat=len(kinds)):
        x = m.start[p[0]] * m.emits[kinds[0], p[0]]
        for i in range(1, len(kinds)):
            x *= m.moves[p[i - 1], p[i]] * m.emits[kinds[i], p[i]]
        yield p, x


def test_forward_and_counts_against_all_paths():
    m, rng = random_model(), np.random.default_rng(2)
    docs = [rng.integers(0, 5, n) for n in (3, 1, 6, 1, 4, 6)]
    lengths, kinds = np.array([len(d) for d in docs]), np.concatenate(docs)
    steps = L.Steps(lengths)
    scale, _ = L.forward(steps, steps.arrange(kinds), m)
    logs = np.add.reduceat(np.log10(scale)[steps.place], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for d, log in zip(docs, logs, strict=True):
        total = sum(x for _, x in paths(d, m))
        assert log == pytest.approx(math.log10(total), abs=1e-12)
        for p, x in paths(d, m):
            starts[p[0]] += x / total
            for i, s in enumerate(p):
                emits[d[i], s] += x / total
                if i:
                    moves[p[i - 1], s] += x / total
    for got, want in zip(L.expected_counts(lengths, kinds, m), (starts, moves, emits), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def tokens_by_hand(text):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w] + ["\n"]


def test_tokens(spark):
    texts = ["A  bÀ c\x1fD\x0b\n e ", "", None, " ", "x\x00y x\x00Y"]
    lengths, tokens, words = L.tokenized(pa.array(texts, pa.string()))
    stop = np.cumsum(lengths)
    got = [[words[t].decode() for t in tokens[b - n : b]] for b, n in zip(stop, lengths, strict=True)]
    assert got == [tokens_by_hand(t) for t in texts]


DOCS = "doc_id bigint, text string, n_tokens int, score double"


def check_scores(spark, rows, settings):
    docs = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], DOCS).repartition(4)
    got = L.score_texts(docs, id_crc() % 5 == 1, settings).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in tokens_by_hand(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = tokens_by_hand(t)
        want.append((i, held(i), len(own), sum(1 for w in own if c[w]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_scores_with_odd_rows(spark):
    rng = random.Random(4)
    words = {k: [f"{k}{i}" for i in range(30)] + ["the"] for k in "ab"}
    rows = [(i, " ".join(rng.choices(words["ab"[i % 2]], k=rng.randrange(1, 60)))) for i in range(200)]
    rows += [(None, "The A1"), (None, None), (300, ""), (301, None), (5, "a1 a2 unheard"), (5, "a1 a2 unheard"), (302, "x" * 50_000), (303, "a1 " * 30_000)]
    got = check_scores(spark, rows, L.Settings(states=2, classes=512, rounds=4))
    # Texts of one kind of word are likelier under states than under one unigram table.
    kinds = [r for r in got if r.doc_id is not None and r.doc_id < 200 and r.n_tokens > 10]
    assert sum(r.score for r in kinds) > sum(r.base_score for r in kinds) + 0.1 * sum(r.n_tokens for r in kinds)
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 5}) <= 2


def test_scores_of_nothing_and_without_training(spark):
    s = L.Settings(states=2, classes=16, rounds=1)
    assert L.score_texts(spark.createDataFrame([], DOCS), id_crc() % 5 == 1, s).count() == 0
    only_held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    check_scores(spark, [(i, "some words") for i in only_held], s)


def test_scores_are_probabilities(spark):
    """Over all texts of up to two words out of the known ones and one unknown a class, and all longer ones, scores add up to 1."""
    rows = [(i, t) for i, t in enumerate(["a b", "b a a", "c", "a", "", "b c", "c c a b"] * 5)]
    docs = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], DOCS)
    s = L.Settings(states=2, classes=4, rounds=2)
    records = L.encode(docs, F.lit(False), s.classes)
    counts = L.corpus_counts(L.dictionary_counts(records, s.classes), s.classes)
    model = L.first_model(records, counts, s)
    for _ in range(s.rounds):
        model = L.baum_welch(records, model, counts, s)
    assert model.start.sum() == pytest.approx(1) and np.allclose(model.moves.sum(axis=1), 1) and np.allclose(model.emits.sum(axis=0), 1)
    c = Counter(w for _, t in rows for w in tokens_by_hand(t))
    for k in range(s.classes + 1):
        mine = [w for w in c if L.word_class(w.encode(), s.classes) == k]
        shares = [(c[w] + 0.5) / (counts.by_class[k] + 0.5 * (counts.words_of_class[k] + 1)) for w in mine] + [0.5 / (counts.by_class[k] + 0.5 * (counts.words_of_class[k] + 1))]
        assert sum(shares) == pytest.approx(1)


def test_rounds_raise_the_likelihood(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"{'abc'[i % 3]}{j}" for j in range(20)], k=20))) for i in range(90)]
    docs = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], DOCS)
    fit = [sum(r.score for r in L.score_texts(docs, F.lit(False), L.Settings(states=3, classes=256, rounds=n, common=0.01)).collect()) for n in (0, 2, 6)]
    assert fit[0] <= fit[1] + 1e-6 and fit[1] <= fit[2] + 1e-6


def test_model_query_on_given_documents(spark, sf):
    got = queries.QUERIES["op13_language_model"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs.doc_id}
    c = Counter(w for i, t in zip(docs.doc_id, docs.text, strict=True) if not held[i] for w in tokens_by_hand(t))
    n, v = sum(c.values()), len(c)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        own, r = tokens_by_hand(t), got[got.doc_id == i].iloc[0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(1 for w in own if c[w]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), abs=1e-6)
    for flag in (True, False):
        part = got[got.held_out == flag]
        assert part.score.sum() > part.base_score.sum()
