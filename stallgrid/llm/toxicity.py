"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the words around each hit.

The lexicon holds whole words and stems (a stem accepts any ending). It is fixed seed terms plus terms learned
from labelled documents. The trie and the automata for one edit (insertion, deletion, substitution, swap of
neighbours) are combined into one deterministic automaton, which is run over all words of a batch at once: one
table lookup per word and character, and words that left the lexicon drop out after a few characters. Terms of
``MIN_EDIT`` letters and more may hold an edit, those under ``MIN_FREE_EDIT`` letters not in the first letter; a
term beside which clean documents often hold another word takes none.

Each hit is weighed by its context window: between quotation marks, or near a word of report and no word of
address, it is quotation; near a word of address it is abuse. Evidence is counted in steps: any hit, hits that
are no quotation, exact ones of these, addressed ones of these. A logistic score with weights that are never
negative is fitted to it, so that a plain term never scores below a misspelled one, that one never below
quotation, and quotation never below no hit. The fit keeps near given weights where the labels say nothing, as
they do about kinds of evidence that the sample lacks.

Labelled documents are a sample of at most about ``sample_rows`` rows, whatever the table's size; the lexicon is
at most ``max_terms`` terms, so the automaton has a bounded size. Of several labels of one document the largest counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, spread

# Seed terms, words of report, words of address, quotation marks.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
REPORT = frozenset("said says wrote writes called calls quoted quote reported term word sagte schrieb nannte genannt zitat wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're u yourself du dich dein deine ihr sie tu te toi ton vous votre tú ti tus usted vosotros".split())
OPENING, CLOSING = "\"'“‘«„‹(", "\"'”’»“›)"
WINDOW_WORDS, STRETCH_WORDS = 6, 60

_WORD = re.compile(r"[^\W_]+")
MIN_EDIT, MIN_FREE_EDIT, MIN_STEM, MAX_STEM, MAX_WORD = 4, 6, 4, 7, 20
# Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
EXACT, NEAR = 2, 1  # what an accepting state tells


class Automaton:
    """Deterministic automaton of (trie x one-edit Levenshtein) over characters; built once, run in numpy."""

    def __init__(self, terms: list[tuple[str, bool]], firm: frozenset[str] = frozenset()):
        """``terms`` are words and stems (True); those in ``firm`` take no edit."""
        self.alphabet = {c: i + 2 for i, c in enumerate(sorted(set("".join(t for t, _ in terms))))}  # 0: end, 1: any other
        codes = np.ones(0x3000, np.int16)
        for c, i in self.alphabet.items():
            if ord(c) < len(codes):
                codes[ord(c)] = i
        for sign, letter in LOOKALIKES.items():
            codes[ord(sign)] = self.alphabet.get(letter, 1)
        self.codes = codes
        # Nodes at which a term ends, or through which one passes, that may hold an edit: anywhere, or behind its first letter.
        free_end: set[int] = set()
        near_end: set[int] = set()
        children: list[dict[int, int]] = [{}]
        kind: list[int] = [0]  # 0: none, 1: a word ends, 2: a stem ends
        free: list[bool] = [False]
        near: list[bool] = [False]
        for term, stem in terms:
            may_free = len(term) >= MIN_FREE_EDIT and term not in firm
            may_near = len(term) >= (MIN_FREE_EDIT if stem else MIN_EDIT) and term not in firm
            at = 0
            for c in term:
                i = self.alphabet[c]
                if i not in children[at]:
                    children[at][i] = len(children)
                    children.append({})
                    kind.append(0)
                    free.append(False)
                    near.append(False)
                at = children[at][i]
                free[at] |= may_free
                near[at] |= may_near
            kind[at] = max(kind[at], 1 + stem)
            free_end |= {at} if may_free else set()
            near_end |= {at} if may_near else set()

        # A state: node, what was edited (0 nothing, 1 behind the first letter, 2 the first letter), and the
        # character that a swap still waits for.
        def close(states: set[tuple[int, int, int]]) -> frozenset:
            """Adds deletions of one term character."""
            out = set(states)
            for node, edited, wait in states:
                if not wait and not edited:
                    out |= {(child, 1 if node else 2, 0) for child in children[node].values() if (near if node else free)[child]}
            return frozenset(out)

        def step(states: frozenset, c: int) -> frozenset:
            out: set[tuple[int, int, int]] = set()
            for node, edited, wait in states:
                if wait:
                    if wait == c:
                        out.add((node, edited, 0))
                    continue
                if c in children[node]:
                    out.add((children[node][c], edited, 0))
                if not edited:
                    now, may = (1, near) if node else (2, free)
                    out.add((node, now, 0))  # insertion
                    for i, child in children[node].items():
                        if not may[child]:
                            continue
                        out.add((child, now, 0))  # substitution
                        if c in children[child]:  # swap: c now, i next
                            out.add((children[child][c], now, i))
            return close(out)

        start = close({(0, 0, 0)})
        ids, queue, table, self.exact_stem, self.near_stem, ends = {start: 1}, [start], [[0] * (len(self.alphabet) + 2)], [False], [False], [0]
        while queue:
            states = queue.pop(0)
            row = [0] * (len(self.alphabet) + 2)
            done = {(kind[n], bool(e)) for n, e, wait in states if kind[n] and not wait and (e == 0 or n in (near_end, free_end)[e - 1])}
            ends.append(EXACT if any(not e for _, e in done) else NEAR if done else 0)
            self.exact_stem.append((2, False) in done)
            self.near_stem.append((2, True) in done)
            for c in range(1, len(self.alphabet) + 2):
                to = step(states, c)
                if to:
                    if to not in ids:
                        ids[to] = len(ids) + 1
                        queue.append(to)
                    row[c] = ids[to]
            table.append(row)
        self.table = np.array(table, np.int32)
        self.ends = np.array(ends, np.int8)
        self.stem = np.where(self.exact_stem, EXACT, np.where(self.near_stem, NEAR, 0)).astype(np.int8)

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """EXACT, NEAR or 0 for each word codes[start:end]."""
        out = np.zeros(len(starts), np.int8)
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        step = 0
        while len(alive):
            at = starts[alive] + step
            over = at >= ends[alive]
            if over.any():
                out[alive[over]] = np.maximum(out[alive[over]], self.ends[state[over]])
                alive, state, at = alive[~over], state[~over], at[~over]
            state = self.table[state, codes[at]]
            stem = self.stem[state]
            hit = stem > 0
            if hit.any():
                out[alive[hit]] = np.maximum(out[alive[hit]], stem[hit])
            go = (state > 0) & (stem < EXACT)
            alive, state = alive[go], state[go]
            step += 1
        return out

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, verdicts) of the words of a lower-cased text."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = points < len(self.codes)
        codes = np.ones(len(points), np.int16)
        codes[low] = self.codes[points[low]]
        letter = _LETTER[np.minimum(points, len(_LETTER) - 1)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, self.run(codes, starts, ends)


_LETTER = np.array([chr(i).isalnum() for i in range(0x3000)] + [True])

#: Kinds of evidence, each with the weight that it has where the labels say nothing; below them what a text has at least.
FEATURES = {"hits": 0.3, "abuse": 1.0, "exact": 0.6, "addressed": 0.6, "peak": 0.3, "any_abuse": 5.0, "any_exact": 1.5}
BIAS = -4.0


def _in_marks(before: str, after: str) -> bool:
    """Whether a stretch between the two stands in quotation marks: one is open before it and closes behind it."""
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    if opened < 0 or not any(c in after for c in CLOSING):
        return False
    mark = before[opened]
    # A mark that opens and closes alike is open if it stands there an odd number of times.
    return before.count(mark) % 2 == 1 if mark in CLOSING else not any(c in before[opened + 1 :] for c in CLOSING)


#: Letters with a sign between any two, and letters written three times and more.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][.*_-]){3,}[^\W_](?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")


def plain(text: str) -> str:
    """A text in lower case, full-width and other compatible letters as plain ones, without signs inside words and stretched letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _STRETCHED.sub(r"\1", _SPACED.sub(lambda m: re.sub("[.*_-]", "", m[0]), text.lower()))


def evidence(text: str, automaton: Automaton) -> tuple[int, int, int, int, int, int, int]:
    """Words, hits, misspelled hits, hits that are no quotation, exact ones of these, addressed ones, most of any stretch of words."""
    text = plain(text)
    starts, ends, verdict = automaton.words(text)
    hits = np.flatnonzero(verdict)
    meant = []
    abuse = exact = addressed = 0
    for h in hits.tolist():
        a, b = max(0, h - WINDOW_WORDS), min(len(starts), h + WINDOW_WORDS + 1)
        # The window's words with the marks beside its first and last one.
        before = text[max(starts[a] - 3, ends[a - 1] if a else 0) : starts[h]]
        after = text[ends[h] : min(ends[b - 1] + 3, starts[b] if b < len(starts) else len(text))]
        around = set(_WORD.findall(before)) | set(_WORD.findall(after))
        to_someone = not around.isdisjoint(ADDRESS)
        if _in_marks(before, after) or (not to_someone and not around.isdisjoint(REPORT)):
            continue
        abuse += 1
        meant.append(h)
        exact += verdict[h] == EXACT
        addressed += to_someone
    at = np.array(meant, np.int64)
    peak = int((np.searchsorted(at, at + STRETCH_WORDS) - np.arange(len(at))).max()) if meant else 0
    return len(starts), len(hits), int((verdict[hits] == NEAR).sum()), abuse, int(exact), addressed, peak


def features(found: np.ndarray) -> np.ndarray:
    """The FEATURES of rows of ``evidence``."""
    _, hits, _, abuse, exact, addressed, peak = found.T.astype(np.float64)
    return np.stack([np.log1p(hits), np.log1p(abuse), np.log1p(exact), np.log1p(addressed), peak, abuse > 0, exact > 0], axis=1)


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]
    automaton: Automaton
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, stem, toxic, clean: documents of the sample that hold a word, or a word that begins with a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1), strict=True):
                words = {w for w in _WORD.findall((t.as_py() or "").lower()) if 3 < len(w) <= MAX_WORD and not w.isdigit()}
                seen[y.as_py()].update([(w, False) for w in words])
                seen[y.as_py()].update({(w[:k], True) for w in words for k in range(MIN_STEM, min(MAX_STEM, len(w) - 1) + 1)})
        keys = list(seen[0].keys() | seen[1].keys())
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
                ["term", "stem", "toxic", "clean"],
            )

    return sample.mapInArrow(run, "term string, stem boolean, toxic bigint, clean bigint").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_terms(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int = 100) -> list[tuple[str, bool]]:
    """Seed terms and the words and stems that set toxic documents apart: the best ``max_terms`` by support.

    They are learned from the toxic documents that no seed term explains. A term is in five of these at least, 25
    times as often as in clean ones, and that by more than chance (G test, one in ten million). A whole word stays
    beside its stem, since it may be misspelled.
    """
    share = n_toxic / max(1, n_toxic + n_clean)
    both, part = F.col("toxic") + F.col("clean"), lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    apart = F.when(both > 0, 2 * (part("toxic", max(share, 1e-9)) + part("clean", max(1 - share, 1e-9)))) > 28
    good = _term_counts(sample).where((F.col("toxic") >= 5) & (F.col("toxic") / max(1, n_toxic) >= 25 * (F.col("clean") + 0.05) / max(1, n_clean)) & apart)
    rows = good.orderBy(F.col("toxic").desc(), F.length("term"), "term", "stem").limit(20 * max_terms).collect()
    support = {(r.term, r.stem): r.toxic for r in rows}
    terms = [(t, False) for t in SEED_TERMS]
    for (term, stem), n in sorted(support.items(), key=lambda x: (-x[1], x[0][1], -len(x[0][0]) if x[0][1] else 0, x[0][0])):
        if len(terms) >= max_terms + len(SEED_TERMS):
            break
        covered = (term, stem) in terms or (stem and any(s and term.startswith(t) for t, s in terms))
        # A stem that adds nothing to a whole word stays out, and one that adds nothing to a longer stem too.
        same = stem and any(t.startswith(term) and n <= 1.1 * support.get((t, s), 0 if t not in SEED_TERMS else n) for t, s in terms)
        if not covered and not same:
            terms.append((term, stem))
    return terms


def _shorter(word: str) -> set[str]:
    """The word, and the word without any one letter: words within one edit of each other share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def firm_terms(sample: DataFrame, terms: list[tuple[str, bool]], n_clean: int, rare: float = 0.0005) -> frozenset[str]:
    """Terms that take no edit: more than a share ``rare`` of clean documents holds a word one edit away from them.

    What comes to the driver are spellings within one edit of the lexicon, whose number the lexicon bounds.
    """
    shared = sample.sparkSession.sparkContext.broadcast(Automaton(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0):
                text = plain(t.as_py() or "")
                starts, ends, verdict = shared.value.words(text)
                found.update({text[starts[i] : ends[i]][: 2 * MAX_WORD] for i in np.flatnonzero(verdict == NEAR).tolist()})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    near = sample.where("toxic = 0").select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    owners: dict[str, set[str]] = {}
    for term, _ in terms:
        for x in _shorter(term):
            owners.setdefault(x, set()).add(term)
    stems, seen = sorted({len(t) for t, stem in terms if stem}), Counter()
    for r in near:
        # A stem may end before the word does.
        begins = {r.word} | {r.word[: k + d] for k in stems for d in (-1, 0, 1)}
        for term in set().union(*(owners.get(x, ()) for b in begins for x in _shorter(b))):
            seen[term] += r.n
    return frozenset(t for t, n in seen.items() if n > rare * n_clean)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of at least a tenth of the given ones, by projected Newton steps on the posterior around these."""
    z = np.hstack([x, np.ones((len(x), 1))])
    given = np.array([*FEATURES.values(), BIAS])
    least = np.array([*(0.1 * v for v in FEATURES.values()), -np.inf])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-3
    w = given.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - penalty @ (w - given)
        free = ~((w <= least) & (slope < 0))
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        new = np.maximum(w + np.clip(step, -1, 1), least)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, max_terms: int = 100, text: str = "text") -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled rows, at most half of them toxic; null labels are left out.

    Without toxic rows the lexicon is the seed terms and every exact hit counts.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = {k: min(1.0, sample_rows / 2 / v) for k, v in n.items()}
    # The sample's size is bounded by sample_rows, so that sending it to every worker is safe at any scale.
    chosen = F.broadcast(labels.where(spread() < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))))
    sample = checkpointed(docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text")).join(chosen, "doc_id").select("text", "toxic"))
    explained = F.lower(F.coalesce("text", F.lit(""))).rlike(r"(?<![\p{L}\p{N}])(" + "|".join(SEED_TERMS) + r")(?![\p{L}\p{N}])")
    other = sample.where((F.col("toxic") == 0) | ~explained)
    left = {r[0]: r[1] for r in other.groupBy("toxic").count().collect()}
    terms = learn_terms(other, left[1], left.get(0, 0), max_terms) if left.get(1) else [(t, False) for t in SEED_TERMS]
    automaton = Automaton(terms, firm_terms(sample, terms, left.get(0, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(evidence(t.as_py() or "", shared.value), np.int64).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "y"])

    plain = ToxicityModel(terms, automaton, np.array([*FEATURES.values()]), BIAS)
    got = sorted((bytes(r.x), r.y) for r in sample.mapInArrow(run, "x binary, y int").collect())
    if not got or not any(k for _, k in got):
        return plain
    x, y = features(np.stack([np.frombuffer(v, np.int64) for v, _ in got])), np.array([k for _, k in got], float)
    return ToxicityModel(terms, automaton, *_fit_logistic(x, y))


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """doc_id, score, n_exact, n_near, n_quoted of every row: hits by spelling, and how many of them are quotation.

    Null text is empty: no hit. Rows with equal or null ids are scored on their own; equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = np.array([evidence(t.as_py() or "", m.automaton) for t in batch.column(1)], np.int64).reshape(-1, 7)
            _, hits, near, abuse, _, _, _ = found.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(features(found))), pa.array(hits - near), pa.array(near), pa.array(hits - abuse)], ["doc_id", "score", "n_exact", "n_near", "n_quoted"])

    src = docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, score double, n_exact bigint, n_near bigint, n_quoted bigint")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(id_crc(), F.lit(3)) == 1
    model = fit_toxicity(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    out = toxicity(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_exact", "n_near", "n_quoted")
