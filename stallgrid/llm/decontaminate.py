"""Benchmark decontamination: CGK random-walk embedding, repeated bit-sampling LSH, exact edit verification.

Texts and items are sequences of words (lower-cased; ASCII marks separate). An item of n words leaks into a
document if some stretch of the document is within floor(``rate`` * n) word insertions, deletions and
substitutions of it.

1. Windows of item size start at every word. A match keeps all but the allowed edits of the item's words, and so
   of its rarer half; windows with fewer words of either kind cannot match and are dropped. This loses nothing.
2. The CGK embedding walks over a sequence for 3n steps: step j writes the symbol it stands on, and moves on or
   stays by a random bit of (j, symbol). Sequences at edit distance k come out at Hamming distance O(k^2), most
   often O(k). Words outside all items are one symbol.
3. Each repetition samples ``BITS`` places of the embedding; a window and an item that agree there are a
   candidate. ``repetitions`` many are run; the recall they are chosen for is in ``repetitions_for``.
4. Candidates whose common words suffice for the allowed edits are verified by exact edit distance.

Everything is one pass over the documents without a shuffle. Items are sent to the workers in blocks of
``BLOCK_ITEMS``; more items mean more passes, never a larger broadcast: what a block found is written down and its
broadcast dropped before the next block is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_chunks

BITS = 2
BLOCK_ITEMS = 20_000
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def repetitions_for(recall: float, agree: float = 0.55, bits: int = BITS) -> int:
    """Repetitions after which a pair whose embeddings agree in a share ``agree`` of places is found with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch b[start:end] nearest to all of a; ``most`` + 1 if none is within ``most``.

    Rows of the dynamic program are whole-array steps; the start of the best stretch is carried along.
    """
    n = len(b)
    place = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), place.copy()
    for i, w in enumerate(a):
        diag = cost[:-1] + (b != w)
        up = cost[1:] + 1
        new, origin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], origin[0] = i + 1, 0
        take = diag <= up
        new[1:] = np.where(take, diag, up)
        origin[1:] = np.where(take, start[:-1], start[1:])
        # Insertions run along the row: the least of new[k] + (j - k) over k <= j.
        key = (new - place) * (n + 2) + place
        best = np.minimum.accumulate(key)
        at = best % (n + 2)
        cost, start = new[at] + place - at, origin[at]
        if cost.min() > most:
            return most + 1, 0, 0
    j = int(np.argmin(cost))
    return int(cost[j]), int(start[j]), j


class _Class:
    """Items of like length: window size, and the fewest words of any item, and of any rarer half, in a match."""

    def __init__(self, members: list[int], items: list[np.ndarray], most: list[int], spread: np.ndarray):
        self.items = members
        self.size = max(len(items[k]) for k in members)
        # An allowed edit may push a word out of the window, so counts reach past the item by the edits.
        self.reach = self.size + max(most[k] for k in members)
        self.least = min(len(items[k]) - most[k] for k in members)
        self.rare = np.zeros(len(spread) + 1, bool)  # by word number; the last is for words outside all items
        self.least_rare = self.size
        for k in members:
            x = items[k]
            half = x[np.argsort(spread[x], kind="stable")[: -(-len(x) // 2)]]
            self.rare[half] = True
            self.least_rare = min(self.least_rare, int(np.isin(x, half).sum()) - most[k])


class ItemIndex:
    """One block of items: their words as numbers, and their sampled embedding places."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, repetitions: int, seed: int = 7):
        rows = [(i, words_of(t)) for i, t in items]
        rows = [(i, w) for i, w in rows if w]
        self.ids = [i for i, _ in rows]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
        self.items = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in rows]
        self.most = [int(rate * len(x) + 1e-9) for x in self.items]
        self.member = {(k, w) for k, x in enumerate(self.items) for w in x.tolist()}
        keys = np.array([k * (len(self.vocab) + 1) + w for k, w in self.member], np.int64) if self.member else np.zeros(0, np.int64)
        self.member_keys = np.sort(keys)
        # Items of like length share windows: a window has the length of the longest of its class.
        self.classes: list[_Class] = []
        by_len = sorted(range(len(self.items)), key=lambda k: len(self.items[k]))
        spread = np.zeros(len(self.vocab), np.int64)
        for x in self.items:
            spread[np.unique(x)] += 1
        at = 0
        while at < len(by_len):
            low = len(self.items[by_len[at]])
            end = at
            while end < len(by_len) and len(self.items[by_len[end]]) <= max(low, int(low * 1.15)):
                end += 1
            self.classes.append(_Class(by_len[at:end], self.items, self.most, spread))
            at = end
        rng = np.random.default_rng(seed)
        self.samples = []  # per class and repetition: places, seed of the walk, key -> items
        for c in self.classes:
            size, group = c.size, c.items
            sizes = np.array([len(self.items[k]) for k in group])
            small, strung, begins = int(sizes.min()), np.concatenate([self.items[k] for k in group]), np.cumsum(sizes) - sizes
            for _ in range(repetitions):
                places = np.sort(rng.choice(max(1, 2 * small), size=min(BITS, max(1, 2 * small)), replace=False))
                walk = int(rng.integers(1, 2**62))
                keyed: dict[int, list[int]] = {}
                for k, key in zip(group, self.embed(strung, begins, sizes, places, walk).tolist(), strict=True):
                    keyed.setdefault(key, []).append(k)
                names = np.array(sorted(keyed), np.int64)
                self.samples.append((size, places, walk, names, [keyed[int(x)] for x in names]))

    def embed(self, seq: np.ndarray, starts: np.ndarray, size: int | np.ndarray, places: np.ndarray, walk: int) -> np.ndarray:
        """Keys of the sampled places of the windows seq[start : start + size]; places past a window's end are blank."""
        v = len(self.vocab) + 2
        at, key = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        wanted = set(places.tolist())
        for j in range(int(places[-1]) + 1):
            inside = at < size
            symbol = np.where(inside, seq[np.minimum(starts + at, len(seq) - 1)], -2)
            if j in wanted:
                key = key * v + symbol + 2
            bit = ((symbol + 2 + j * 1_000_003).astype(np.uint64) * np.uint64(walk | 1)) >> np.uint64(63)
            at += bit.astype(np.int64)
        return key

    def leaks(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, edits, first word, words, item words) of all leaks into the documents."""
        if not self.items:
            return []
        gap = max(c.reach for c in self.classes) + 2
        blank = np.full(gap, -1, np.int32)
        parts, where, stop = [], [], []
        total = 0
        for d in docs:
            ids = np.fromiter(map(self.vocab.get, words_of(d), repeat(-1)), np.int32)
            where.append(total)
            stop.append(total + len(ids))
            parts += [ids, blank]
            total += len(ids) + gap
        seq = np.concatenate(parts)
        hits, rare = np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32)
        np.cumsum(seq >= 0, out=hits[1:])
        found: dict[tuple[int, int], set[int]] = {}
        n_samples = len(self.samples) // len(self.classes)
        where_a, stop_a = np.array(where), np.array(stop)
        for c, cls in enumerate(self.classes):
            np.cumsum(cls.rare[seq], out=rare[1:])
            # The gap behind the last document is longer than any reach, so no start is left out.
            near = np.flatnonzero(rare[cls.reach :] - rare[: total + 1 - cls.reach] >= cls.least_rare)
            starts = near[hits[np.minimum(near + cls.reach, total)] - hits[near] >= cls.least]
            # A window starts in a document, not in the gap behind one.
            starts = starts[starts < stop_a[np.searchsorted(where_a, starts, side="right") - 1]]
            if not len(starts):
                continue
            for size_, places, walk, names, items in self.samples[c * n_samples : (c + 1) * n_samples]:
                key = self.embed(seq, starts, size_, places, walk)
                pos = np.minimum(np.searchsorted(names, key), len(names) - 1)
                ok = np.flatnonzero(names[pos] == key)
                for w in ok.tolist():
                    doc = int(np.searchsorted(where_a, starts[w], side="right")) - 1
                    for k in items[pos[w]]:
                        found.setdefault((doc, k), set()).add(int(starts[w]))
        return self._verified(seq, where_a, stop_a, found)

    def _verified(self, seq, where, stop, found) -> list[tuple[int, int, int, int, int, int]]:
        if not found:
            return []
        pairs = [(d, k, s) for (d, k), ss in found.items() for s in ss]
        d, k, s = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        length = np.array([len(x) for x in self.items])[k]
        most = np.array(self.most)[k]
        # Common words of the window and that one item, at once for all candidates.
        common = np.zeros(len(pairs), np.int64)
        for j in range(int((length + most).max())):
            on = j < length + most
            w = seq[np.minimum(s + j, len(seq) - 1)]
            q = k * (len(self.vocab) + 1) + w
            p = np.minimum(np.searchsorted(self.member_keys, q), len(self.member_keys) - 1)
            common += on & (w >= 0) & (self.member_keys[p] == q)
        keep = np.flatnonzero(common >= length - most)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in keep[np.lexsort((s[keep], -common[keep]))].tolist():
            pair = (int(d[i]), int(k[i]))
            if pair in out:
                continue
            m = int(most[i])
            a = max(int(where[pair[0]]), int(s[i]) - m)
            stretch = seq[a : min(int(stop[pair[0]]), int(s[i]) + int(length[i]) + m)]
            dist, start, end = edit_distance(self.items[pair[1]], stretch, m)
            if dist <= m:
                out[pair] = (dist, a + start - int(where[pair[0]]), end - start)
        return [(doc, item, *v, len(self.items[item])) for (doc, item), v in sorted(out.items())]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.2, recall: float = 0.99, text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_word, words, item_words: one row per document and item that leaks into it.

    Nulls: a null text has no words, a row with a null item_id or item text is no item. Items without words never
    match. Repeated items with the same text are reported each; of several places in a document the nearest
    found first. Rows with equal doc_id are searched on their own; a text of any length is searched as a whole.
    """
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    n_blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    src = docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, edits int, first_word int, words int, item_words int"

    def search(block: list[tuple[int, bytes]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(ItemIndex(sorted(block), rate, repetitions_for(recall)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                for first, raw in text_chunks(batch.column(1)):
                    got = ix.leaks(raw)
                    if got:
                        doc, item, *rest = zip(*got, strict=True)
                        ids = batch.column(0).take(pa.array([first + x for x in doc]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([ix.ids[x] for x in item], pa.int64()), *(pa.array(x, pa.int32()) for x in rest)], schema_names)

        return src.mapInArrow(run, schema), shared

    schema_names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for b in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        one, shared = search([(r.item_id, r.text.encode("utf-8", "replace")) for r in part])
        if n_blocks > 1:
            one = checkpointed(one)
            shared.unpersist()
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` into which no item leaks; rows with a null doc_id stay."""
    leaked = find_leaks(docs, items, **how).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaks of every benchmark item into every document."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
