"""N-gram Jaccard self-join by chosen paths.

Texts are sets of 5-word shingles (words: lower-cased runs between white space). All pairs with Jaccard
similarity of at least ``threshold`` are links.

1. Texts with equal shingle sets form a class; only classes go on (named by their digest). Copies are counted,
   never expanded into pairs.
2. Each class carries ``PLACES`` min-hashes of its set. A repetition grows a tree: a node samples places (one,
   and with probability 1/threshold - 1 a second one), and its sets are split by their min-hash there. Nodes with
   at most ``SMALL`` sets are brute-forced, and so are dense ones, which keep most of their parent's sets; the
   others are split again, to depth ``DEPTH``. Trees are rebuilt with other samples until a pair at the threshold
   is found with the target recall: enough trees for ``SPLITS`` splits over all sets, and more of them over the sets
   that were split further, for the depth that was reached. All trees draw from the same min-hashes, which
   ``repetitions_for`` takes into account.
3. Only leaves with two sets or more matter, and of leaves with the same members one is kept. Their sets are
   fetched and all pairs of a leaf are compared exactly, by products of 0/1 matrices. Leaves with more than
   ``BLOCK`` sets are compared as pairs of blocks, in separate tasks. A pair in several leaves counts in the
   first of them only, so no list of pairs is ever built: a task returns numbers of links and a spanning forest.
4. Connected components of the forests, by label propagation with pointer jumping, give the class id.

Texts with fewer than five words are one shingle of all their words. A text without words (or null) is a class
of its own, with no links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PrefixHash, checkpointed, mix64, text_chunks

WORDS, PLACES, SMALL, SPLITS, DEPTH, BLOCK = 5, 64, 64, 4, 8, 256
#: Rows of a partition of what is left of a table.
PART_ROWS = 100_000
_SEEDS = np.random.default_rng(11).integers(1, 2**32, (PLACES, 2), dtype=np.uint64)
_GAPS = bytes(0x20 if c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) else c for c in range(256))


def repetitions_for(recall: float, threshold: float, depth: int = SPLITS, places: int = PLACES) -> int:
    """Trees after which a pair at the threshold has met with probability ``recall``, if its nodes were split ``depth`` times.

    All trees sample the same ``places``. So trees miss independently only for a given number of places at which
    the pair agrees, and the chance to meet is averaged over that number.
    """
    second, agree = 1 / threshold - 1, np.arange(places + 1)
    weight = np.array([math.comb(places, k) * threshold**k * (1 - threshold) ** (places - k) for k in range(places + 1)])
    meet = np.ones(places + 1)
    for _ in range(depth):  # probability that at least one of a node's samples keeps the pair together down to a leaf
        one = agree / places * meet
        meet = 1 - (1 - one) * (1 - second * one)
    trees = 1
    while weight @ (1 - (1 - meet) ** trees) < recall:
        trees += 1
        if trees > 10_000:
            raise ValueError("too few min-hashes for this recall and threshold")
    return trees


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(_GAPS).split() for t in texts]
    joined = [b" ".join(w) for w in words]
    buffer = np.frombuffer(b"".join(joined), np.uint8)
    prefix = PrefixHash(buffer)
    out, at = [], 0
    starts_all = np.flatnonzero(buffer == 0x20) + 1
    for w, j in zip(words, joined, strict=True):
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        a, b = np.searchsorted(starts_all, [at + 1, at + len(j)])
        starts = np.concatenate([[at], starts_all[a:b]])
        ends = np.concatenate([starts[1:] - 1, [at + len(j)]])
        if len(w) < WORDS:
            h = prefix.of(starts[:1], ends[-1:])
        else:
            h = prefix.of(starts[: len(w) - WORDS + 1], ends[WORDS - 1 :])
        out.append(np.unique(h))
        at += len(j)
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES min-hashes (32 bits) of each set; zeros for an empty one."""
    out = np.zeros((len(sets), PLACES), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        high = (flat >> np.uint64(32)).astype(np.uint32)
        for k, (a, b) in enumerate(_SEEDS.astype(np.uint32)):
            h = low * (a | np.uint32(1)) + high * (b | np.uint32(1))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            out[some, k] = np.minimum.reduceat(h, first)
    return out


def _children(path: np.ndarray, signs: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): the places that each node samples depend on the node alone."""
    h = mix64(path)
    rows = np.arange(len(path))
    place = (h % np.uint64(PLACES)).astype(np.int64)
    two = np.flatnonzero((mix64(h) >> np.uint64(11)).astype(np.float64) / 2**53 < second)
    other = (place[two] + 1 + (mix64(h[two] + np.uint64(5)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    rows, place = np.concatenate([rows, two]), np.concatenate([place, other])
    child = mix64(h[rows] * np.uint64(31) + (place.astype(np.uint64) << np.uint64(32)) + signs[rows, place].astype(np.uint64))
    return rows, child


def set_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest (of the shingle set; null if empty), signs (min-hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in text_chunks(batch.column(1)):
                sets = shingle_sets(raw)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs = [m.tobytes() for m in min_hashes(sets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(digest, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "digest", "signs"])

    src = docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, digest binary, signs binary")


def _grow(frontier: DataFrame, second: float, trees: range = range(0)) -> DataFrame:
    """Child nodes (path, class_id, up) of (path, class_id, signs, n); with ``trees`` the roots of these.

    ``up`` is the number of sets in the parent node; null below a root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.stack([np.frombuffer(s.as_py(), np.uint32) for s in batch.column("signs")])
            ids = batch.column("class_id").to_numpy()
            roots = [mix64(np.full(len(ids), 1000 + r, np.uint64)) for r in trees] or [batch.column("path").to_numpy().view(np.uint64)]
            for root in roots:
                rows, child = _children(root, signs, second)
                up = pa.nulls(len(rows), pa.int64()) if trees else batch.column("n").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[rows]), up], ["path", "class_id", "up"])

    # No row comes twice: a child's path names its parent, the place and the min-hash there.
    return frontier.mapInArrow(run, "path bigint, class_id bigint, up bigint")


def _compact(df: DataFrame, rows: int, read: int = 0) -> DataFrame:
    """``df`` in a partition for each ``PART_ROWS`` of its ``rows``, or of a quarter of those that it is made from.

    So what is left of a table takes few files, and no task reads much.
    """
    return df.coalesce(max(1, -(-rows // PART_ROWS), -(-read // (4 * PART_ROWS))))


def _trees(signs: DataFrame, threshold: float, trees: range) -> tuple[DataFrame, DataFrame | None, int]:
    """Leaves (path, class_id) with two sets or more, the nodes behind ``SPLITS`` splits, and the depth reached."""
    second = 1 / threshold - 1
    level = checkpointed(_grow(signs, second, trees))
    rows = level.count()
    leaves = beyond = None
    for depth in range(1, DEPTH + 1):
        if depth == SPLITS + 1:
            beyond = level
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), F.max("up").alias("up"))
        # A node that keeps most of its parent's sets holds near copies: more splits would only repeat it.
        dense = F.coalesce(F.col("n") >= threshold * F.col("up"), F.lit(False))
        end = F.lit(depth == DEPTH) | (F.col("n") <= SMALL) | dense
        nodes = checkpointed(sizes.where("n >= 2").select("path", "n", end.alias("end")))
        ended, left = nodes.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("end"), ~F.col("end")))).first()
        done = checkpointed(_compact(level.join(nodes.where("end").select("path"), "path", "left_semi").select("path", "class_id"), ended, rows))
        leaves = done if leaves is None else leaves.unionByName(done)
        if not left:
            return leaves, beyond, depth
        split = level.select("path", "class_id").join(nodes.where("NOT end").select("path", "n"), "path")
        if depth == 1:  # from here on only sets in large nodes matter
            signs = checkpointed(_compact(signs.join(split.select("class_id").distinct(), "class_id", "left_semi"), left, rows))
        level = checkpointed(_compact(_grow(split.join(signs, "class_id"), second), left, rows))
        rows = 2 * left


def path_leaves(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(leaf, class_id) of all leaves with two sets or more; of leaves with the same members only one."""
    signs = classes.select("class_id", "signs")
    grown = repetitions_for(recall, threshold)
    leaves, beyond, depth = _trees(signs, threshold, range(grown))
    # A pair with a set whose nodes all end within SPLITS splits is settled; the others are looked for in more trees.
    while depth > SPLITS and (target := repetitions_for(recall, threshold, depth)) > grown:
        if beyond is not None:
            alive = beyond.select("class_id").distinct()
            signs = checkpointed(_compact(signs.join(alive, "class_id", "left_semi"), alive.count(), signs.count()))
        more, _, reached = _trees(signs, threshold, range(grown, target))
        leaves, beyond, depth, grown = leaves.unionByName(more), None, max(depth, reached), target
    # Leaves with equal members: number of members, and two sums over scrambled ids.
    members = leaves.groupBy("path").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("class_id")).alias("x"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("y"), F.min("class_id").alias("low"), F.max("class_id").alias("high")
    )
    kept = members.groupBy("n", "x", "y", "low", "high").agg(F.min("path").alias("leaf"))
    return leaves.withColumnRenamed("path", "leaf").join(kept.select("leaf", "n"), "leaf")


def _similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of Jaccard >= threshold between the sets of a and b, exactly."""
    la, lb = (np.array([len(x) for x in s]) for s in (a, b))
    ua, ub = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ua, ub)  # hashes on one side only count in the sizes alone
    common = np.zeros((len(a), len(b)), np.float32)
    step = max(1, 4_000_000 // (len(a) + len(b)))

    def columns(values: np.ndarray, lens: np.ndarray, part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(lens), len(part)), np.float32)
        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
        ok = part[at] == values
        m[np.repeat(np.arange(len(lens)), lens)[ok], at[ok]] = 1
        return m

    for k in range(0, len(shared), step):
        part = shared[k : k + step]
        common += columns(ua, la, part) @ columns(ub, lb, part).T
    return common >= threshold * (la[:, None] + lb[None, :] - common) - 1e-4


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links and a spanning forest of one leaf, or of one pair of its blocks."""
        rows = rows.sort_values(["side", "class_id"])
        leaf = int(rows["leaf"].iloc[0])
        one = rows[rows["side"] == 0]
        two = rows[rows["side"] == 1]
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        if not len(one) or not (same or len(two)):
            return pd.DataFrame({"class_id": [], "links": [], "root": []}).astype("int64")
        two = one if same else two
        sets = [[np.frombuffer(s, np.uint64) for s in x["shingles"]] for x in (one, two)]
        link = _similar(*sets, threshold)
        if same:
            np.fill_diagonal(link, False)
        # A pair that shares a smaller leaf is counted there.
        held: list[np.ndarray] = []
        earlier = sorted({v for x in (one["leaves"], two["leaves"]) for ls in x for v in ls if v < leaf})
        place = {v: i for i, v in enumerate(earlier)}
        for x in (one["leaves"], two["leaves"]):
            m = np.zeros((len(x), len(earlier)), np.float32)
            for i, ls in enumerate(x):
                m[i, [place[v] for v in ls if v < leaf]] = 1
            held.append(m)
        first = link & ~((held[0] @ held[1].T) > 0) if earlier else link
        ids = [x["class_id"].to_numpy() for x in (one, two)]
        weights = [x["copies"].to_numpy(np.int64) for x in (one, two)]
        n1 = first @ weights[1]
        out = [pd.DataFrame({"class_id": ids[0], "links": n1})]
        if not same:
            out.append(pd.DataFrame({"class_id": ids[1], "links": first.T @ weights[0]}))
        # Spanning forest by breadth-first search over the matrix.
        roots = [np.full(len(i), -1, np.int64) for i in ids]
        for i in range(len(ids[0])):
            if roots[0][i] >= 0 or not link[i].any():
                continue
            front, root = np.array([i]), ids[0][i]
            roots[0][i] = root
            while len(front):
                right = np.flatnonzero(link[front].any(axis=0) & (roots[1] < 0))
                roots[1][right] = root
                if same:
                    roots[0][right] = root
                    front = right
                else:
                    front = np.flatnonzero(link[:, right].any(axis=1) & (roots[0] < 0))
                    roots[0][front] = root
        found = pd.concat(out, ignore_index=True)
        found["root"] = np.concatenate(roots[: 1 if same else 2])
        found.loc[found["root"] < 0, "root"] = found["class_id"]
        return found[(found["links"] > 0) | (found["root"] != found["class_id"])]

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes of ``edges``."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    both = checkpointed(both)
    rows = both.count()
    label = checkpointed(_compact(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), rows))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("new"), "component")
        # Pointer jumping: take over the component of the component.
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("component"), F.col("component").alias("old"))
        new = checkpointed(_compact(new, rows))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def _labelled(docs: DataFrame, threshold: float, recall: float, text: str) -> DataFrame:
    """doc_id, digest, class_id, n_links and head (doc_id and digest that stand for the row's class) of every row.

    The join works on sets, named by a number from their digest (class_id inside the join), so that several texts
    under one doc_id are sets of their own. Class and head are null for a set that only rows without an id have.
    """
    all_rows = checkpointed(set_classes(docs, text))
    # One row per distinct set; signs are the same within it. A text without words stays alone.
    per = all_rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("signs").alias("signs"))
    classes = checkpointed(per.withColumn("class_id", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint")))
    leaves = checkpointed(path_leaves(classes, threshold, recall))
    own = leaves.groupBy("class_id").agg(F.collect_set("leaf").alias("leaves")).join(classes.select("class_id", "least_id", "copies", "digest"), "class_id")
    src = docs.select(F.col("doc_id").cast("bigint").alias("least_id"), F.col(text).cast("string").alias("text"))
    texts = own.join(src, "least_id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in text_chunks(batch.column("text")):
                sets = shingle_sets(raw)
                part = batch.slice(first, len(raw))
                right = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == part.column("digest")[i].as_py()]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(right, pa.int64())) for c in ("class_id", "copies", "leaves")), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["class_id", "copies", "leaves", "shingles"])

    sets = texts.mapInArrow(fetch, "class_id bigint, copies bigint, leaves array<bigint>, shingles binary").dropDuplicates(["class_id"])
    member = sets.join(leaves.select("leaf", "n", F.col("class_id")), "class_id")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = member.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("class_id", F.lit(3)), F.col("blocks")).cast("int"))
    # A set of block i takes part in the pairs (i, j) and (j, i); a small leaf is the one pair (0, 0).
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("leaf", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), (F.col("mine") > F.col("with")).cast("int").alias("side"), "class_id", "copies", "leaves", "shingles")
    pairs = checkpointed(keyed.groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), "class_id bigint, links bigint, root bigint"))
    links = pairs.groupBy("class_id").agg(F.sum("links").alias("links"))
    comp = components(pairs.where("root <> class_id"), "class_id", "root")
    placed = classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    heads = placed.groupBy("component").agg(F.min(F.struct(F.col("least_id").alias("doc_id"), "digest")).alias("head"))
    named = placed.join(heads, "component").join(links, "class_id", "left")
    named = named.select("digest", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"))
    return all_rows.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "digest", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "head")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, text: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group of linked documents) and n_links of every row.

    ``n_links`` counts all other rows with a similarity of at least ``threshold``, copies included. Rows with a
    null doc_id are their own class with a null id unless a row with an id has the same set. Repeated rows are
    copies of each other. Several texts under one doc_id are judged each on its own.
    """
    return _labelled(docs, threshold, recall, text).select("doc_id", "class_id", "n_links")


def _with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_digest``, the digest of their shingle set (null if empty)."""
    at = docs.columns.index(text)
    names = [*docs.columns, "_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in text_chunks(batch.column(at)):
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(raw)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(raw)).columns, pa.array(digest, pa.binary())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_digest", T.BinaryType())]))


def keep_representatives(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The row with the smallest doc_id of each group of linked documents, decided per (doc_id, shingle set).

    Of rows with equal doc_id and set one is kept. A row without an id is left out only if another row has its set;
    of several such rows without any id one is kept. Rows with neither id nor words are all kept.
    """
    rows = _labelled(docs, threshold, 0.995, "text")
    key = lambda i, d: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.hex(d))
    head = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.digest") == F.col("digest"))
    left_out = rows.where(F.col("head").isNotNull() & ~head).select(key(F.col("doc_id"), F.col("digest")).alias("_key")).distinct()
    alone = F.col("doc_id").isNull() & F.col("_digest").isNull()
    keyed = _with_digest(docs).withColumn("_key", F.when(alone, F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))).otherwise(key(F.col("doc_id").cast("bigint"), F.col("_digest"))))
    return keyed.join(left_out, "_key", "left_anti").dropDuplicates(["_key"]).select(*docs.columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, 5-word shingles, Jaccard of 0.8 or more."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
