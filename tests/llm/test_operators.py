"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import oracle_rows, spark_rows
from stallgrid.llm import chat_format, decontaminate, language_id, license_scan, ngram_join, packing, quality, run_length_index, suffix_dedup, token_counts, toxicity
from stallgrid.llm import queries as Q

TEXTS = st.text(st.sampled_from(list("abe  \n\t▁é中<>|/s.,'0 ΣİǺ\x00\x1c\xa0　")), max_size=14)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    got, names = spark_rows(Q.QUERIES[name](spark, sf))
    want, sql_names = oracle_rows(Q.ORACLE_SQL[name], sf)
    assert names == sql_names and got == want


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))


# ---- odd rows and empty tables ----

OPERATORS = {
    "language": lambda s, d: language_id.identify(d, language_id.fit_centroids(d)),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.fit_toxicity(d, s.createDataFrame([(5, 1), (4, 0), (None, 1), (9, None)], "doc_id bigint, toxic int"))),
    "decontaminate": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([(1, "the cat sat on the mat and it was"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")),
    "drop_leaks": lambda s, d: decontaminate.drop_leaks(d, s.createDataFrame([(1, "the cat sat on the mat and it was")], "item_id bigint, text string")),
    "license": lambda s, d: license_scan.license_scan(d),
    "quality": lambda s, d: quality.quality_filter(d),
    "join": lambda s, d: ngram_join.jaccard_classes(d),
    "representatives": lambda s, d: ngram_join.keep_representatives(d),
    "repeats": lambda s, d: suffix_dedup.mark_repeats(d, parts=8),
    "drop_repeats": lambda s, d: suffix_dedup.drop_repeats(d),
    "packing": lambda s, d: packing.pack_pieces(packing.token_pieces(d)),
    "tokens": lambda s, d: token_counts.token_counts(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, odd, name):
    n = odd.count()
    got = OPERATORS[name](spark, odd).collect()
    if name in ("language", "toxicity", "license", "quality", "join", "repeats", "tokens"):
        assert len(got) == n
    by = {r.doc_id: r for r in got}
    if name == "language":
        assert {i for i in by if by[i].lang_pred == "und"} == {1, 2, 3, 8} and all(by[i].rejected for i in (1, 2, 3, 8))
    if name == "join":
        assert by[5].class_id == by[6].class_id == 5 and by[5].n_links == 2 and by[2].n_links == by[1].n_links == 0
    if name == "repeats":
        assert by[6].kept == b"" and by[5].spans == [] and by[None].spans == []
    if name == "decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(5, 1), (6, 1)}
    if name == "representatives":
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == [-3, 1, 2, 3, 4, 5, 8, 9]
    assert OPERATORS[name](spark, odd.limit(0)).collect() == []


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "[INST] \\ </s>"), (None, None, "user\n", "a"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    ex = chat_format.format_conversations(t).orderBy("conv_id", "example").collect()
    # Rows of one turn stand in the order of their roles, nulls first: the reply is the last of three.
    assert [(r.conv_id, r.target_turn_no) for r in ex] == [(None, None), (1, 2), (2, 0), (2, 1)]
    turns = chat_format.format_conversations(t).where("is_last AND conv_id IS NULL").select(chat_format.read_turns(F.col("text")).alias("t")).first().t
    assert [(x.role, x.text) for x in turns] == [("user\n", "a")]
    assert chat_format.format_conversations(t.limit(0)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab\\n\n<s>/[]INST"), max_size=6), st.text(st.sampled_from("ab\\\n<s>/[]INST|"), max_size=12)), min_size=1, max_size=4))
def test_chat_round_trip(spark, turns):
    t = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    got = chat_format.format_conversations(t).where("is_last").select(chat_format.read_turns(F.col("text")).alias("t")).first().t
    assert [(x.role, x.text) for x in got] == turns


# ---- brute force ----


def test_language_held_out(spark):
    rows = Q.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_against_brute_force(spark, sf):
    """Every row's nearest centroid by grams counted one by one."""
    docs = spark.read.parquet(sf + "/documents.parquet")
    m = language_id.fit_centroids(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, m).collect()}
    for r in docs.limit(40).collect():
        b = " ".join("".join(chr(x) if x >= 0x80 or 0x61 <= x <= 0x7A else " " for x in r.text.lower().encode()).split())
        raw = b" " + b.encode("latin-1") + b" "
        v = np.zeros(language_id.DIM)
        for k in range(len(raw) - 1):
            pair = (raw[k] * 2654435761 + raw[k + 1] * 2246822519) % 2**32
            v[pair >> 19] += 1
            if k + 2 < len(raw):
                v[(pair + raw[k + 2] * 3266489917 + 374761393) % 2**32 >> 19] += 1
        x = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * m.idf
        cos = m.vectors @ (x / np.linalg.norm(x))
        best = int(cos.argmax())
        assert got[r.doc_id].lang_pred == m.languages[best] and abs(got[r.doc_id].score - cos[best]) < 1e-4
        assert got[r.doc_id].rejected == (cos[best] < m.least[best])
    far = language_id.identify(spark.createDataFrame([(1, "zzqx xqzz qqzx zxqq")], "doc_id bigint, text string"), m).first()
    assert far.rejected and far.lang_pred in m.languages
    assert all(0 < x < 0.5 for x in m.least) and len(set(m.least)) > 1


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = Q.QUERIES["op2_toxicity"](spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.9


def test_edit_automaton_against_distance():
    def near(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    terms = ["stupid", "worthless", "moronic", "scum", "idiot", "clown"]
    m = toxicity.Automaton([(t, False) for t in terms], frozenset(["clown"]))
    random.seed(3)
    words = list(terms)
    for _ in range(600):
        w = list(random.choice(terms))
        for _ in range(random.randint(1, 2)):
            p = random.randrange(len(w))
            kind = random.choice("idst")
            w[p : p + (kind != "i") + (kind == "t")] = [] if kind == "d" else w[p : p + 2][::-1] if kind == "t" else [random.choice("abcdefu")]
        words.append("".join(w) or "x")

    def may(t, w):
        return t != "clown" and (near(t, w) <= 1 if len(t) >= 6 else w[0] == t[0] and near(t[1:], w[1:]) <= 1)

    _, _, got = m.words(" ".join(words))
    for w, v in zip(words, got.tolist(), strict=True):
        want = toxicity.EXACT if w in terms else toxicity.NEAR if any(may(t, w) for t in terms) else 0
        assert v == want, w


def test_stems_take_endings_and_edits():
    m = toxicity.Automaton([("achlich", True), ("boco", True)])
    words = ["achlichung", "achlich", "aclichung", "achlch", "boco", "bocoas", "bcoas", "xboco"]
    assert m.words(" ".join(words))[2].tolist() == [2, 2, 1, 1, 2, 2, 0, 0]


def test_toxicity_is_not_diluted_and_sees_through_spellings():
    terms = [(t, False) for t in toxicity.SEED_TERMS]
    m = toxicity.ToxicityModel(terms, toxicity.Automaton(terms), np.array([*toxicity.FEATURES.values()]), toxicity.BIAS)
    score = lambda t: float(m.score(toxicity.features(np.array([toxicity.evidence(t, m.automaton)])))[0])
    clean, abuse = "the garden was green and people walked there " * 300, "you are a worthless idiot"
    assert score(clean) < score("what an idiot he was") < score(abuse) == score(clean + abuse + " " + clean)
    plain = score("well idiot then")
    for spelling in ("id10t", "i.d.i.o.t", "i-d-i-o-t", "idiooooot", "\uff49\uff44\uff49\uff4f\uff54", "IDIOT"):
        assert score(f"well {spelling} then") == plain, spelling
    assert toxicity.plain("U.S. a-b 1.2.3 www") == "u.s. a-b 1.2.3 w"


def test_most_hits_of_any_stretch():
    m = toxicity.Automaton([(t, False) for t in toxicity.SEED_TERMS])
    rng = random.Random(8)
    for _ in range(40):
        words = [rng.choice(["idiot", "green", "tree", "cloud"]) for _ in range(rng.randrange(1, 200))]
        hits = [i for i, w in enumerate(words) if w == "idiot"]
        want = max((sum(1 for j in hits if i <= j < i + toxicity.STRETCH_WORDS) for i in hits), default=0)
        assert toxicity.evidence(" ".join(words), m)[6] == want


def test_toxicity_context():
    m = toxicity.Automaton([("stupid", False)])
    # words, hits, misspelled, no quotation, exact of these, addressed of these
    for text, want in {
        'he said "stupid" to all': (5, 1, 0, 0, 0, 0), "you are stupid": (3, 1, 0, 1, 1, 1), "a stupd thing": (3, 1, 1, 1, 0, 0), "the word stupid is old": (5, 1, 0, 0, 0, 0),
        'say "hello" to the stupid and "bye"': (7, 1, 0, 1, 1, 0), "« stupid »": (1, 1, 0, 0, 0, 0), "": (0, 0, 0, 0, 0, 0),
    }.items():
        assert toxicity.evidence(text, m)[:6] == want, text


def test_toxicity_orders_plain_misspelled_quoted_clean(spark):
    d = "/root/testdata/sf0.01"
    m = toxicity.fit_toxicity(spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet"))
    for model in (m, toxicity.fit_toxicity(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int"))):
        texts = ["you are a worthless idiot", "you are a worthles idoit", 'he wrote "you are a worthless idiot" there', "the table is round"]
        score = model.score(toxicity.features(np.array([toxicity.evidence(t, model.automaton) for t in texts])))
        assert score[0] > score[1] > score[2] >= score[3] and score[1] >= 0.7 > score[2]


def test_toxicity_query_against_brute_force(spark, sf):
    """Hits of the query's own lexicon, found by comparing every word with every term."""
    docs = spark.read.parquet(sf + "/documents.parquet")
    held = F.pmod(toxicity.id_crc(), F.lit(3)) == 1
    m = toxicity.fit_toxicity(docs.where(~held), spark.read.parquet(sf + "/labels.parquet").where(~held))
    got = {r.doc_id: r for r in Q.QUERIES["op2_toxicity"](spark, sf).collect()}
    plain = {t for t, stem in m.terms if not stem}
    stems = tuple(t for t, stem in m.terms if stem)
    for r in docs.collect():
        words = "".join(c if c.isalnum() else " " for c in r.text.lower()).split()
        fold = lambda w: "".join(toxicity.LOOKALIKES.get(c, c) for c in w)
        assert got[r.doc_id].n_exact == sum(fold(w) in plain or fold(w).startswith(stems) for w in words), r.doc_id


def test_leaks_with_edits():
    random.seed(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(k, " ".join(random.choice(words) for _ in range(random.randint(12, 60))).encode()) for k in range(30)]
    ix = decontaminate.ItemIndex(items, 0.2, decontaminate.repetitions_for(0.99))
    docs, want = [], set()
    for n in range(300):
        k = random.randrange(len(items))
        w = items[k][1].split()
        for _ in range(random.randint(0, int(0.2 * len(w)))):
            w[random.randrange(len(w))] = b"zz"
        base = [random.choice(words).encode() for _ in range(100)]
        docs.append(b" ".join(base[:50] + w + base[50:]))
        want.add((n, k))
    got = {(d, k) for d, k, *_ in ix.leaks(docs)}
    assert len(want & got) >= 0.99 * len(want)
    for d, k, edits, first, size, n in ix.leaks(docs[:40]):
        a, b = decontaminate.words_of(items[k][1]), decontaminate.words_of(docs[d])[first : first + size]
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        assert prev[-1] == edits <= 0.2 * n


def test_leaks_query_against_all_pairs(spark, sf):
    """Every document against every item by the full edit distance, and items with insertions and deletions too."""
    items = spark.read.parquet(sf + "/benchmark.parquet")
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text")
    random.seed(9)
    planted = []
    for n, it in enumerate(items.orderBy("item_id").limit(12).collect()):
        w = it.text.split()
        for _ in range(int(0.2 * len(decontaminate.words_of(it.text.encode()))) // 2):
            p = random.randrange(len(w))
            w[p : p + random.choice([0, 1])] = [] if random.random() < 0.5 else ["zz"]
        planted.append((10**6 + n, "aa bb cc " * 9 + " ".join(w) + " dd ee" * 9))
    every = docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(every, items).collect()}
    want = {}
    number: dict = {}
    seq = lambda t: np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of(t.encode())], np.int64)
    texts = {r.doc_id: seq(r.text or "") for r in every.collect()}
    for it in items.collect():
        a = seq(it.text or "")
        most = int(0.2 * len(a) + 1e-9)
        for i, b in texts.items():
            if len(a) and np.isin(a, b).sum() >= len(a) - most:
                dist = decontaminate.edit_distance(a, b, most)[0]
                if dist <= most:
                    want[(i, it.item_id)] = dist
    assert set(got) <= set(want) and len(want) >= 10
    assert len(got) >= 0.99 * len(want)


def test_license_join_against_containment(spark):
    random.seed(2)
    templates = [(f"t{k}", " ".join(f"w{random.randrange(30)}" for _ in range(random.randint(3, 9)))) for k in range(12)]
    texts = ["\n".join(" ".join(f"w{random.randrange(30)}" for _ in range(random.randint(0, 40))) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license_scan.license_scan(df, templates, 0.8).collect():
        want = sorted(label for line in texts[r.doc_id].split("\n") for label, t in templates if len(set(t.split()) & set(line.split())) >= 0.8 * len(set(t.split())) - 1e-9)
        assert sorted(b.label for b in r.blocks) == want


def test_license_notices_on_several_lines(spark):
    texts, want = [], []
    for label, notice, *_ in license_scan.TEMPLATES:
        w = notice.split()
        for width in (3, 7, 12, len(w)):
            lines = [" ".join(w[k : k + width]) for k in range(0, len(w), width)]
            texts.append("some words before\n# " + "\n# ".join(lines) + "\nand behind it")
            want.append((label, 3))
    long = " ".join(f"l{k}" for k in range(180))
    texts += ["x " * 90 + long + " y" * 90, "x\n" * 90 + long.replace(" ", "\n"), "the mit\n" + "of it\n" * 40 + "license under released"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.blocks + r.wrapped for r in license_scan.license_scan(df, [*license_scan.TEMPLATES, ("long", long)]).collect()}
    for i, (label, _) in enumerate(want):
        assert label in {b.label for b in got[i] if b.holds}, texts[i]
    assert [{b.label for b in got[len(want) + k]} for k in range(3)] == [{"long"}, {"long"}, set()]
    assert all(b.containment <= 1 for bs in got.values() for b in bs)


def test_license_relatives_are_told_apart(spark):
    lines = {
        "Released under the Apache License": set(), "Released under the GPL license": set(), "Licensed under CC BY 4.0": set(),
        "This work is licensed under the GNU General Public License, version 2": set(), "This work is licensed under the GNU Lesser General Public License, version 3": set(),
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": {"cc-by-nc-4.0"}, "it was released under the same license as before": set(),
        "the license that MIT was released under": set(), "use it under the MIT license": {"mit"}, "Licensed under the Apache License, Version 1.1": set(),
        "Released under the MIT License": {"mit"}, "released, in 2020, under the MIT license (see below)": {"mit"}, "Licensed under the Apache License, Version 2.0 or later": {"apache-2.0"},
        "This work is licensed under the GNU General Public License, version 3": {"gpl-3.0"}, "Licensed under CC BY-NC 4.0": {"cc-by-nc-4.0"},
        "This work is licensed under a Creative Commons Attribution 4.0 International License": {"cc-by"},
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: {b.label for b in r.blocks if b.holds} for r in license_scan.license_scan(df).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def labels_by_hand(text):
    """Labels of all lines (windows of long ones) and of all stretches over line ends, by counting words."""
    lines = [license_scan.normal_bytes(x).split() for x in (text or "").split("\n")]
    words, ends, out = [w for x in lines for w in x], set(), set()
    for x in lines:
        ends.add((ends and max(ends) or 0) + len(x))
    templates = license_scan.template_words()
    index = license_scan.TemplateIndex(templates, {}, 0.8)
    for k, t in enumerate(templates):
        need, of, size = len(t.distinct) * 0.8 - 1e-9, set(t.words), index.stretch[k]
        if len(of & set(words)) < need:
            continue
        blocks = [b for x in lines for b in ([x] if len(x) <= index.block_words else [x[i : i + index.block_words] for i in range(0, len(x) - index.block_words // 2, index.block_words // 2)])]
        blocks += [words[i : i + size] for i in range(len(words)) if any(i < e < min(i + size, len(words)) for e in ends)]
        if any(len(of & set(b)) >= need and index.holds(k, b) for b in blocks):
            out.add(t.label)
    return out


def test_license_query_against_all_blocks(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    found = 0
    for r in Q.QUERIES["op4_license_scan"](spark, sf).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        base = {label for _, label in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), first, last, ",".join(sorted(base)))
        assert set(filter(None, r.labels.split(","))) == base | labels_by_hand(texts[r.doc_id]), r.doc_id
        found += bool(r.labels)
    assert found


def test_license_phrases(spark):
    df = spark.createDataFrame([(1, "CC-BY cc by\ngeneral PUBLIC\nLicense all rights reserved"), (2, None)], "doc_id bigint, text string")
    r = {x.doc_id: x for x in license_scan.license_scan(df).collect()}
    assert [(p.word, p.label) for p in r[1].places] == [(0, "cc-by"), (2, "cc-by"), (4, "gpl"), (7, "reserved")] and r[2].n_words == 0


def test_join_against_brute_force(spark):
    random.seed(4)
    base = [[f"v{random.randrange(500)}" for _ in range(random.randint(4, 60))] for _ in range(25)]
    texts = []
    for _ in range(260):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2])):
            w[random.randrange(len(w))] = "q"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) for w in map(str.split, texts)]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    small, ngram_join.BLOCK = ngram_join.BLOCK, 16  # leaves are compared in blocks too
    try:
        got = {r.doc_id: r for r in ngram_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    finally:
        ngram_join.BLOCK = small
    assert sum(got[i].n_links for i in got) >= 0.99 * sum(links)
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(got[i].class_id == find(i) for i in got) >= 0.99 * len(sets)


@pytest.mark.parametrize("depth", [1, 4, 6, 8])
def test_trees_find_pairs_at_every_depth(depth):
    rng = np.random.default_rng(depth)
    n = 3000
    one = rng.integers(0, 2**32, (n, ngram_join.PLACES), dtype=np.uint64).astype(np.uint32)
    two = np.where(rng.random(one.shape) < 0.8, one, ~one)
    found = np.zeros(n, bool)
    for tree in range(ngram_join.repetitions_for(0.995, 0.8, depth)):
        pair, path = np.arange(n), ngram_join.mix64(np.arange(n, dtype=np.uint64) * np.uint64(4096) + np.uint64(tree))
        for _ in range(depth):  # the nodes in which both sets of a pair stand
            rows, a = ngram_join._children(path, one[pair], 0.25)
            _, b = ngram_join._children(path, two[pair], 0.25)
            pair, path = pair[rows[a == b]], a[a == b]
        found[pair] = True
    assert found.mean() >= 0.99


def test_join_of_a_large_varied_family(spark):
    random.seed(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for n in range(1500):  # a varied text of the family, and a near copy of it at a similarity of about 0.8
        w = list(base)
        for k in range(random.randint(12, 40)):
            w[random.randrange(len(w))] = f"x{n}.{k}"
        near = list(w)
        for k in range(6):
            near[random.randrange(len(w))] = f"y{n}.{k}"
        texts += [w, near]
    number: dict = {}
    rows = [sorted({number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(len(w) - 4)}) for w in texts]
    owners: dict = {}
    for i, r in enumerate(rows):
        for v in r:
            owners.setdefault(v, []).append(i)
    common = np.zeros((len(rows), len(rows)), np.int16)
    for o in owners.values():
        common[np.ix_(o, o)] += 1
    size = np.array([len(r) for r in rows])
    link = common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-9
    want = link.sum(1) - 1
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")).collect()}
    found = np.array([got[i] for i in range(len(texts))])
    assert (found <= want).all()
    assert found.sum() >= 0.995 * want.sum()


def test_representatives_of_rows_without_or_with_one_id(spark):
    w = " ".join(f"w{i}" for i in range(40))
    v = " ".join(f"v{i}" for i in range(40))
    rows = [(None, "one text without id"), (None, "another text without id"), (None, "another text without id"), (None, w), (None, None), (None, ""), (1, w), (2, w + " x"), (3, v), (3, "a second text of three"), (3, w), (4, v + " y"), (4, v), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in ngram_join.keep_representatives(df).collect()))
    assert kept == sorted([(0, "one text without id"), (0, "another text without id"), (0, ""), (0, ""), (1, w), (3, v), (3, "a second text of three"), (5, "")])
    links = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df).where("doc_id IS NOT NULL").collect()}
    assert links == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (3, 3, 0), (3, 1, 2), (4, 3, 2), (5, 5, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=10), st.lists(st.text("abz", min_size=1, max_size=30), min_size=1, max_size=5))
def test_matching_statistics(pieces, patterns):
    raw = [x.encode() for x in pieces + patterns]
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
    start, n = np.cumsum(size) - size, len(pieces)
    index = run_length_index.RunLengthIndex(data, start[:n], size[:n], cap=8)
    for who, at, pos, held in index.matching_statistics(data, start[n:], size[n:]):
        for w, a, p, h in zip(who, at, pos, held, strict=True):
            q = raw[n + w][a:]
            best = max(k for k in range(len(q) + 1) if any(q[:k] in x for x in raw[:n]))
            assert min(h, 8) == min(best, 8) and index.text[p : p + min(h, 8)].tobytes() == q[: min(h, 8)]


def test_run_length_index_follows_the_runs():
    """A family of near copies takes little more runs than one of them."""
    rng = np.random.default_rng(3)
    one = rng.integers(97, 123, 4000).astype(np.uint8)
    many = np.tile(one, 50)
    many[rng.integers(0, len(many), 40)] = 65
    runs = [run_length_index.RunLengthIndex(x, np.arange(0, len(x), 4000), np.full(len(x) // 4000, 4000)).n_runs for x in (one, many)]
    assert runs[1] < 1.5 * runs[0]


def test_shared_windows_come_from_the_index(monkeypatch):
    """Family by family against brute force; without the index nothing is found."""
    random.seed(12)
    base = [bytes(random.choice(b"abcdefgh") for _ in range(90)) for _ in range(4)]
    pieces, docs = [], []
    for n in range(60):
        t = bytearray(random.choice(base))
        if random.random() < 0.8:
            t[random.choice([*range(0, 20), *range(70, 90)])] = 0x5A
        a = random.randint(0, 12)
        pieces.append(bytes(t[a : random.randint(78, 90)]))
        docs.append(n // 2)
    # The minimizer of all windows here is the text at place 30 of the base.
    offs = [next(p.index(b[34:58]) for b in base if b[34:58] in p) for p in pieces]
    keep = [i for i in range(60) if pieces[i] not in pieces[:i]]
    pieces, docs, offs = [pieces[i] for i in keep], np.array([docs[i] for i in keep]), np.array([offs[i] for i in keep])
    low = np.maximum(0, offs + 24 - 50)
    high = np.minimum([len(p) for p in pieces], offs + 50)
    pieces, offs = [p[a:b] for p, a, b in zip(pieces, low.tolist(), high.tolist(), strict=True)], offs - low
    want = {(i, a) for i, p in enumerate(pieces) for a in range(len(p) - 49) if any(docs[j] < docs[i] and p[a : a + 50] in q for j, q in enumerate(pieces))}
    found = lambda: set(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(pieces, docs, offs, 50)), strict=True))
    assert found() == want and len(want) > 50
    monkeypatch.setattr(run_length_index.RunLengthIndex, "matching_statistics", lambda *a: iter(()))
    assert found() == set()


def test_repeats_of_rows_with_one_id(spark):
    """Repeated rows stay, and two texts under one id are cut each by itself."""
    a, b = "".join(chr(97 + i % 23) for i in range(0, 800, 7)), "".join(chr(97 + i * i % 19) for i in range(150))
    rows = [(1, a), (1, a), (2, a + " x"), (2, b), (3, "y " + b), (3, "nothing"), (None, a), (None, a)]
    got = sorted((r.doc_id or 0, r.kept.decode()) for r in suffix_dedup.mark_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(1, a), (1, a), (2, " x"), (2, b), (3, "y "), (3, "nothing"), (0, a), (0, a)])


def test_repeats_against_brute_force(spark):
    random.seed(6)
    words = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 6))) for _ in range(60)]
    base = [" ".join(random.choice(words) for _ in range(60)) for _ in range(6)]
    docs = {}
    for i in random.sample(range(-40, 4000), 90):
        t, u = random.choice(base), random.choice(base)
        docs[i] = random.choice([t, t[:40] + "X" + t[40:], t[random.randint(0, 60) :] + u[: random.randint(0, 200)], "ab " * random.randint(0, 60), u[:49]])
    raw = {i: t.encode() for i, t in docs.items()}
    first = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            first.setdefault(raw[i][p : p + 50], i)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    for r in suffix_dedup.mark_repeats(df, parts=12).collect():
        t = raw[r.doc_id]
        m = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < r.doc_id:
                m[p : p + 50] = 1
        e = np.flatnonzero(np.diff(np.concatenate([[0], m])))
        assert [(s.start, s.end) for s in r.spans] == list(zip(e[::2].tolist(), e[1::2].tolist(), strict=True))
        assert r.kept == bytes(b for b, x in zip(t, m, strict=False) if not x)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = packing.pack_pieces(packing.token_pieces(rows), group_pieces=60).collect()
    full = {r.doc_id: np.array([*Tokenizer.from_file(path).encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in rows.collect()}
    place: dict = {}
    for r in got:
        part = full[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, full.values()))
    for p in place.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(place) <= -(-sum(map(len, full.values())) // 2048) + 4


def test_packing_of_what_cannot_be_certified(spark):
    """Groups keep their size in every exchange, rows with one id are pieces of their own, and all are packed."""
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 else 7, 0, 0, int(x), i) for i, x in enumerate(rng.integers(600, 901, 3000))]
    got = packing.pack_pieces(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), group_pieces=300).collect()
    assert sorted(r.ids_crc32 for r in got) == list(range(3000))
    place: dict = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in place.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048
    _, _, n = packing.best_fit_decreasing(np.array([r[3] for r in rows]), 2048)
    assert len(place) <= 1.03 * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_is_one(lengths):
    best = len(lengths)

    def fill(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= lengths[k]:
                fill(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]])
        fill(k + 1, [*rooms, 20 - lengths[k]])

    fill(0, [])
    x = np.array(lengths)
    _, _, n = packing.best_fit_decreasing(x, 20)
    assert packing.lower_bound(x, 20) <= best <= n


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_tokens_at_every_prefix(text):
    known = token_counts.library_steps()
    encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode
    _, words = next(token_counts.learned(pa.array([text]), known))
    steps = token_counts.prefix_steps(words, known)
    want = [len(encode(text[:p])) for p in range(len(text) + 1)]
    assert token_counts.prefix_table(steps).tolist() == [token_counts.count_prefix(steps, p) for p in range(len(text) + 1)] == want
    for limit in range(0, want[-1] + 1):
        assert token_counts.longest_within(steps, limit) == max(p for p, n in enumerate(want) if n <= limit)


def test_tokens_of_long_texts_without_a_space():
    """One step a character: a million characters take seconds, and every count at the end of a cut is the library's."""
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    known = token_counts.library_steps()
    started = time.time()
    _, words = next(token_counts.learned(pa.array([text]), known))
    steps = token_counts.prefix_steps(words, known)
    assert time.time() - started < 60 and len(steps) == len(text)
    encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode
    for cut in (1, 1000, 4096, 20_011):
        assert token_counts.count_prefix(steps, cut) == len(encode(text[:cut]))
    tail = "日本語" * 2000
    _, words = next(token_counts.learned(pa.array([tail]), known))
    assert token_counts.count_prefix(token_counts.prefix_steps(words, known), len(tail)) == len(encode(tail))


def test_token_query_equals_library(spark, sf):
    encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.QUERIES["op9_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
        cut = len(texts[r.doc_id]) // 2
        assert token_counts.count_prefix(bytes(r.prefix_steps), cut) == len(encode(texts[r.doc_id][:cut])) and len(encode(texts[r.doc_id][: r.fit_chars])) <= 4096


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_encoder_equals_library(text):
    e = packing._encoder(None)
    assert next(iter(e.encode([text]))) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_quality_rules(spark):
    rows = [(1, "the cat and the dog ran to the house of the man"), (2, "# $ % & * < > | # $ % & the of and a"), (3, "one two")]
    got = {r.doc_id: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and not got[2].kept and "few_words" in got[3].failed_rules


def test_sha_digest_of_kept_bytes(spark, sf):
    r = Q.QUERIES["op7_suffix_dedup"](spark, sf).where("n_removed = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = spark.createDataFrame(stage(spark, left, sf).toPandas(), docs.schema)
        seen.append((name, {r.doc_id for r in left.select("doc_id").collect()}))
        assert left.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == seen[-1][1]
    assert seen[0][1] >= seen[1][1] >= seen[2][1] >= seen[3][1]


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    """Rows without an id or with a shared one go through all stages; empty tables give an empty result."""
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tail = base.orderBy("doc_id").limit(6).collect()
    texts = [" ".join(reversed(r.text[:4000].split())) for r in tail]
    odd = [(None, texts[0] + " one more", "en", "a"), (None, texts[1] + " two more", "en", "a"), (None, "a third text that is short but has words", "en", "a"), (900001, texts[2] + " x", "en", "b"), (900001, texts[3] + " y", "en", "b"), (900002, None, None, None), (900003, "", "en", "b"), (900004, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "b")]
    kind = base.schema["n_chars"].dataType.simpleString()
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], f"doc_id bigint, text string, lang string, source string, n_chars {kind}")
    folder = str(tmp_path / "odd")
    base.where(~F.col("doc_id").isin([r.doc_id for r in tail])).unionByName(more.select(*base.columns)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.doc_id is None and r.piece == 0 for r in out) >= 3
    assert len({(r.ids_crc32, r.length) for r in out if r.doc_id == 900001 and r.piece == 0}) == 2
    empty = str(tmp_path / "empty")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
