"""Conversation prefix trie: the nodes of the trie of all conversations, by sorted turns and range minima.

A conversation is the string of its turns' digests. The conversations are sorted, range by range, and each range
finds the longest common prefixes (LCP, in turns) of neighbours and a sparse table of their range minima. A prefix of
d turns that first stands in row i belongs to the rows around i that no LCP below d parts from it: both ends of that
interval are found by binary search over the table, each on its own, for all prefixes of the range at once. The
members of a node are its interval, its smallest member a range minimum of ids, and its subtree the stretch of
prefixes between its own place and the end of its interval in the order (row, depth), so that sums over subtrees are
differences of running sums.

A range may begin or end inside a node. Such open nodes are prefixes of a range's first or last row; what each range
knows of them is a sum, a minimum or a count, and these are added up by the node's digest. A range knows from its
neighbour's last row which of its prefixes are new there. How many open nodes there are is known before they are
joined to their children: a small number is broadcast, a large one joined with salt, since the root and a common
first turn have very many children. The ids of conversations that end in one node are hashed where they lie; only
those of open nodes travel, as short strings of several hundred ids in order.

Leaves are counted as nodes minus nodes that have a child; the first child of each node, in sorted order, stands for
its parent there, and is told by the row before it.

Odd rows. Rows without a conv_id belong to no conversation. Turns of one conversation are taken by turn, null first,
equal ones by digest, repeated rows each for itself; null role or text is empty. A conversation is one row of 16
bytes a turn. No rows: no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes of a turn's digest, turns that a range holds on average, ids of one string of an open node's ends.
TURN, RANGE_TURNS, END_IDS = 16, 500_000, 400
#: Open nodes that are broadcast to their children; more are joined with salt.
SMALL, SALT = 50_000, 32
#: Conversations of one family of ids, whose first one lends its head, and one more than the turns of the longest head.
FAMILY, HEADS = 20, 4

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_ROW = f"kind string, node binary, parent binary, {_NODE}, own_first bigint, range int, chunk int, ids string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (hex) and words of every row of a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.left(F.sha2(named, 256), F.lit(2 * TURN)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


def shared_heads(conversations: DataFrame) -> DataFrame:
    """conv_id, key (its turns' digests in order), words (of each turn), with heads from the family's first conversation.

    A conversation takes the first crc32(its id) % 4 turns of the conversation c - c % 20 in place of its own.
    """
    rows = turns(conversations).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    own = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    none = F.array().cast(own.schema["own"].dataType)
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, HEADS - 1))).over(W.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    every = own.withColumn("head", F.coalesce(head, none)).withColumn("h", h)
    made = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return every.select("conv_id", made.alias("t")).select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("key"), F.transform("t", lambda x: x["words"]).alias("words"))


def sorted_ranges(strings: DataFrame, n_turns: int) -> DataFrame:
    """``strings`` in ranges of bounded size, each sorted by (key, conv_id), written down with its number."""
    n = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // RANGE_TURNS))
    return checkpointed(strings.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("range", F.spark_partition_id()))


def common_turns(a: bytes, b: bytes) -> int:
    n, low = min(len(a), len(b)) // TURN, 0
    while low < n:  # binary search for the first turn that differs
        mid = (low + n + 1) // 2
        low, n = (mid, n) if a[: mid * TURN] == b[: mid * TURN] else (low, mid - 1)
    return low


def range_borders(ranges: DataFrame) -> dict[int, tuple[int, int, int]]:
    """range -> (LCP with the row before it, or -1; that row's turns; LCP of its last row with the row behind it, or -1).

    One first and one last row of each range, in order.
    """

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for f in frames:
            if len(f):
                first = first if first is not None else f.iloc[0]
                last = f.iloc[-1]
        if first is not None:
            yield pd.DataFrame({"range": [first["range"]], "first": [first["key"]], "last": [last["key"]]})

    out: dict[int, tuple[int, int, int]] = {}
    before, at = None, None
    for r in ranges.select("range", "key").mapInPandas(ends, "range int, first binary, last binary").orderBy("range").toLocalIterator():
        lcp = -1 if before is None else common_turns(bytes(before), bytes(r.first))
        if at is not None:
            out[at] = (*out[at][:2], lcp)
        out[r.range] = (lcp, 0 if before is None else len(before) // TURN, -1)
        before, at = r.last, r.range
    return out


class RangeMinima:
    """Sparse table over an array: minima of stretches of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least value of places left..right, both included."""
        out = np.empty(len(left), self.rows[0].dtype)
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[left[at]], row[right[at] - (1 << int(level)) + 1])
        return out

    def right_extent(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place r with all of at+1..r at or over ``least``."""
        at, n = at.copy(), len(self.rows[0])
        for level in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[level], 1 << level
            fits = at + step < n
            fits[fits] = row[at[fits] + 1] >= least[fits]
            at[fits] += step
        return at

    def left_extent(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place l with all of l+1..at at or over ``least``."""
        at = at.copy()
        for level in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[level], 1 << level
            fits = at - step >= 0
            fits[fits] = row[at[fits] - step + 1] >= least[fits]
            at[fits] -= step
        return at


def neighbour_lcps(keys: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it; -1 for the first."""
    tokens = np.frombuffer(b"".join(keys), np.dtype([("a", np.uint64), ("b", np.uint64)]))
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    lcp = np.zeros(len(keys), np.int64)
    live, depth = np.arange(1, len(keys)), 0
    while len(live):
        live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
        here, there = tokens[start[live] + depth], tokens[start[live - 1] + depth]
        live = live[(here["a"] == there["a"]) & (here["b"] == there["b"])]
        depth += 1
        lcp[live] = depth
    lcp[0] = -1
    return lcp


def _digest(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * TURN]).digest()[:TURN]


def range_nodes(keys: list[bytes], ids: np.ndarray, words: list[np.ndarray], number: int, border: tuple[int, int, int]) -> pd.DataFrame:
    """The nodes that a sorted range holds (kind: 'whole', or 'open' with the range's share), and strings of ids ('ids')."""
    before, before_turns, behind = border
    m = len(keys)
    lengths = np.array([len(k) // TURN for k in keys], np.int64)
    lcp = neighbour_lcps(keys, lengths)
    table, smallest = RangeMinima(lcp), RangeMinima(ids)
    # Each prefix where it first stands in the range: (row, depth), in this order.
    new = lengths - lcp
    first = np.concatenate([[0], np.cumsum(new)])
    row = np.repeat(np.arange(m), new)
    depth = lcp[row] + 1 + np.arange(len(row)) - first[row]
    left, right = table.left_extent(row, depth), table.right_extent(row, depth)
    n = right - left + 1
    least = smallest.minimum(left, right)
    own = ~((row == 0) & (depth <= before))
    # The parent: one turn less in the same row, or a prefix that began in an earlier one.
    parent = np.arange(len(row)) - 1
    branch = np.flatnonzero((row > 0) & (depth == lcp[row] + 1))
    begun = table.left_extent(row[branch], depth[branch] - 1)
    parent[branch] = first[begun] + depth[branch] - 1 - (lcp[begun] + 1)
    # A parent's first child: the parent is as new as the child, or the row before it is the parent itself.
    shared = np.where(row == 0, before, lcp[row])
    above = np.where(row == 0, before_turns, lengths[row - 1])
    eldest = own & (depth > 0) & ((depth - 1 > shared) | ((depth - 1 == shared) & (above == depth - 1)))
    flat = np.concatenate([np.asarray(w, np.int64) for w in words]) if len(row) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])[row] + depth - 1
    own_words = np.where(depth > 0, flat[np.where(depth > 0, at, 0)] if len(flat) else 0, 0)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    stop, place = first[right + 1], np.arange(len(row))
    under = lambda x: (s := sums(x))[stop] - s[place]
    leaves = under(own & ~eldest) + eldest
    saved = under(n * own_words - own * own_words)
    counted = own & (depth > 0)
    children = np.bincount(parent[counted], minlength=len(row))
    is_open = ((left == 0) & (depth <= before)) | ((right == m - 1) & (depth <= behind))
    # Rows that end in a node: its first rows, as equal strings stand together.
    same = np.concatenate([[False], (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])])
    runs = np.flatnonzero(~same)
    run_of = np.full(m, -1, np.int64)
    run_of[runs] = np.concatenate([runs[1:], [m]])
    nothing = hashlib.sha256(b"").hexdigest()
    ends, chunks = [nothing] * len(row), []
    for c in np.flatnonzero((depth == lengths[row]) & (run_of[row] > 0)).tolist():
        i = int(row[c])
        mine = ids[i : run_of[i]].tolist()
        if is_open[c]:
            name = _digest(keys[i], int(depth[c]))
            chunks += [(name, k // END_IDS, ",".join(map(str, mine[k : k + END_IDS]))) for k in range(0, len(mine), END_IDS)]
        else:
            ends[c] = hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
    parent_open = np.where(depth > 0, is_open[parent], False)
    names = [_digest(keys[int(row[c])], int(depth[c])) if is_open[c] else None for c in range(len(row))]
    parents = [_digest(keys[int(row[c])], int(depth[c]) - 1) if parent_open[c] else None for c in range(len(row))]
    above_id = np.where((depth > 0) & ~parent_open, least[parent], 0)
    nodes = pd.DataFrame({
        "kind": np.where(is_open, "open", "whole"), "node": names, "parent": parents, "conv_id": least, "depth": depth,
        "parent_conv_id": pd.array(above_id, "Int64"), "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": ends, "own_first": eldest.astype(np.int64),
    })
    nodes.loc[(depth == 0) | parent_open, "parent_conv_id"] = pd.NA
    # The share of an open node: what its first range adds for being an eldest child itself is added once, at the end.
    nodes.loc[is_open, "n_leaves"] -= eldest[is_open]
    strings = pd.DataFrame(chunks, columns=["node", "chunk", "ids"])
    return pd.concat([nodes, strings.assign(kind="ids")], ignore_index=True).assign(range=number)


def _nodes_of_ranges(ranges: DataFrame, borders: dict[int, tuple[int, int, int]]) -> DataFrame:
    names = [c.split()[0] for c in _ROW.split(", ")]
    whole = [c.split()[0] for c in _ROW.split(", ") if c.split()[1] in ("bigint", "int")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids, words, number = [], [], [], None
        for f in frames:
            if len(f):
                keys += [bytes(k) for k in f["key"]]
                ids.append(f["conv_id"].to_numpy(np.int64))
                words += f["words"].tolist()
                number = int(f["range"].iloc[0])
        if number is not None:
            out = range_nodes(keys, np.concatenate(ids), words, number, borders[number])
            yield out.reindex(columns=names).astype(dict.fromkeys(whole, "Int64"))

    return ranges.select("range", "key", "conv_id", "words").mapInPandas(run, _ROW)


def _end_digests(strings: DataFrame) -> DataFrame:
    """node, ends_sha256: one running hash over each node's strings of ids, in order; nothing is gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for f in frames:
            done = []
            for name, ids in zip(f["node"], f["ids"], strict=True):
                name = bytes(name)
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    placed = strings.select("node", "range", "chunk", "ids").repartition("node").sortWithinPartitions("node", "range", "chunk")
    return placed.mapInPandas(run, "node binary, ends_sha256 string")


def trie_nodes(strings: DataFrame, n_turns: int) -> DataFrame:
    """The nodes of the trie of ``strings`` (conv_id, key, words); ``n_turns`` says how many ranges to make."""
    columns = [c.split()[0] for c in _NODE.split(", ")]
    ranges = sorted_ranges(strings, n_turns)
    borders = range_borders(ranges)
    found = checkpointed(_nodes_of_ranges(ranges, borders))
    whole = found.where("kind = 'whole'")
    total = lambda c: F.sum(c).alias(c)
    shares = found.where("kind = 'open'").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), total("n_convs"), total("n_children"),
        F.sum(F.col("n_leaves") + F.col("own_first")).alias("n_leaves"), total("saved_tokens"),
    )
    ends = _end_digests(found.where("kind = 'ids'"))
    shares = shares.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    shares = checkpointed(shares)
    parents = shares.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    above = shares.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("_above")).select(*columns)
    children = whole.where("parent IS NOT NULL")
    if sum(lcp + 1 for lcp, _, _ in borders.values()) <= SMALL:
        children = children.join(F.broadcast(parents), "parent")
    else:
        salted = parents.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        children = children.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int")).join(salted, ["parent", "_salt"])
    children = children.withColumn("parent_conv_id", F.col("_above")).select(*columns)
    return whole.where("parent IS NULL").select(*columns).unionByName(children).unionByName(above)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with heads shared by families of 20."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie_nodes(shared_heads(conversations), conversations.count())


#: crc32 of a conv_id's digits: one step takes in a byte, eight more shift it through.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(c) + 1), lambda i: list_concat([ord(substr(c, i, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"""
OP12_SQL = f"""WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM t)),
r AS MATERIALIZED (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, n) AS s FROM (
  SELECT c.conv_id, 0 AS part, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h UNION ALL SELECT c.conv_id, 1, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h) GROUP BY conv_id),
a AS MATERIALIZED (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN r USING (conv_id)),
p AS MATERIALIZED (SELECT conv_id, len(s) AS size, d, sha256(CAST(list_slice(s, 1, d) AS VARCHAR) || '/' || d) AS id, CASE WHEN d > 0 THEN sha256(CAST(list_slice(s, 1, d - 1) AS VARCHAR) || '/' || (d - 1)) END AS up,
  CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(s[d].text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM a)),
n AS MATERIALIZED (SELECT id, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY id),
k AS (SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
pair AS (SELECT DISTINCT x.id AS top, y.id AS id FROM p x JOIN p y ON y.conv_id = x.conv_id AND y.d >= x.d),
u AS (SELECT pair.top AS id, count(*) FILTER (k.id IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens FROM pair JOIN n ON n.id = pair.id LEFT JOIN k ON k.id = pair.id GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN u ON u.id = n.id LEFT JOIN k ON k.id = n.id LEFT JOIN n m ON m.id = n.up"""
