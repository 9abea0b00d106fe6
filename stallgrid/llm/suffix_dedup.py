"""Removal of long repeated byte strings, over documents cut into pieces that can be indexed in parallel.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id.

Every window of ``length`` bytes has a minimizer: its leftmost k-gram with the smallest hash. Consecutive windows
with one minimizer form a piece. Equal windows have equal minimizers, so pieces can be dealt out by minimizer,
and each task sees all places of its windows. Steps:

1. The minimizers of all documents meet in hash ranges: those found in one document only drop out. What is left
   goes back to the documents' groups. A minimizer that one scan step saw in several documents is known to be
   repeated at once; of these documents only two are sent to its range.
2. Each group of documents sends its pieces with a repeated minimizer to the minimizer's range. Exact copies of
   whole documents drop out first: all of a copy goes, and its strings are in the smallest doc_id of the copies.
   Of equal pieces in a group only the smallest document's is sent, the others are marked at once. So a passage
   that stands in a third of all documents sends one piece a group.
3. In a range, equal pieces meet: the smallest document owns them, in all others they are removed. Different
   pieces around one minimizer may still share windows, and these are found by a run-length index
   (run_length_index.py) and matching statistics. A shared window holds length - k bytes besides the k-gram,
   half of them on one side; windows with the half in front are compared among the pieces with equal bytes there,
   the others among those with equal bytes behind. The documents of such a family are split into the smaller half
   and the larger half by doc_id; one index holds the smaller halves of all families, the larger halves stream
   their matching statistics against it, and what matches over ``length`` bytes is marked. Both halves go on as
   families of their own, the larger one without what was marked, until one document is left in each. So every
   window is compared with all smaller documents, in as many rounds as the largest family can be halved.
4. Marked stretches return to their documents, which cut them out.

Text is shuffled once, by document group; steps 2 and 4 use the same shuffle. Groups and ranges are of a size in
bytes, whatever the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, checkpointed, text_chunks
from .run_length_index import RunLengthIndex

K = 24
#: Text of a document group and of a hash range, in bytes.
GROUP_BYTES, RANGE_BYTES = 6_000_000, 4_000_000
_TOP = np.uint64(2**64 - 1)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for every i."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def pieces_of(texts: list[bytes], length: int, k: int = K):
    """Pieces of the texts: (text number, minimizer place, first window, last window, minimizer hash).

    Places are bytes within the text.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    long = np.flatnonzero(lens >= length)
    if not len(long):
        return empty
    buffer = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    lens = lens[long]
    ends = np.cumsum(lens)
    n, w = len(buffer), length - k + 1
    prefix = PrefixHash(buffer)
    grams = prefix.of(np.arange(n - k + 1), np.arange(k, n + 1)) | np.uint64(1)
    grams[grams == _TOP] -= np.uint64(2)
    # k-grams that reach into the next text never win.
    over = (ends[:-1, None] - np.arange(1, k)[None, :]).ravel()
    grams[over[over < len(grams)]] = _TOP
    low = _slide(grams, w, np.minimum)  # low[i]: of the window that starts at i
    text = np.repeat(np.arange(len(lens)), lens)
    valid = np.arange(len(low)) + length <= ends[text[: len(low)]]
    pad = np.zeros(w - 1, np.uint64)
    masked = np.where(valid, low, 0).astype(np.uint64)
    wins = np.flatnonzero(_slide(np.concatenate([pad, masked, pad]), w, np.maximum) == grams)
    # A new piece begins where the minimum changes, its place is left behind, or a text begins.
    change = np.zeros(len(low), bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | (text[1 : len(low)] != text[: len(low) - 1])
    change &= valid
    first = np.flatnonzero(change)
    at = np.searchsorted(wins, first)
    while True:
        wrong = np.flatnonzero(grams[wins[at]] != low[first])
        if not len(wrong):
            break
        at[wrong] += 1
    place = wins[at]
    stop = np.concatenate([first[1:], [len(low)]])
    last = np.minimum(stop - 1, ends[text[first]] - length)
    begin = (ends - lens)[text[first]]
    return long[text[first]], place - begin, first - begin, last - begin, low[first]


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _splits(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        cut = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cut):
            yield int(keys[part[0]]), part


def _joined(rows: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: True where a combination is there for the first time."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _group_of(ids: np.ndarray, n_groups: int) -> np.ndarray:
    """The document group of each id; ``group_column`` says the same to Spark."""
    return (ids ^ (ids.view(np.uint64) >> np.uint64(17)).view(np.int64)) % n_groups


def group_column(n_groups: int) -> Column:
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 17)), F.lit(n_groups))


def _short(ids: np.ndarray) -> bytes:
    """Ids as the smallest one and 32-bit distances from it; as they are where that is too little."""
    low = ids.min()
    near = ids.max() - low < 2**32
    return (b"\4" + low.tobytes() + (ids - low).astype(np.uint32).tobytes()) if near else b"\10" + ids.tobytes()


def _long(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.int64, offset=1)
    return np.frombuffer(raw, np.uint32, offset=9) + np.frombuffer(raw, np.int64, 1, 1)


# ---- step 1 ----


def _send_minimizers(length: int, n: int, n_groups: int):
    """At the scan: minimizers (h, d) for the ranges; (g, h) for the groups of documents that share one here.

    The latter only pass through a range, which is chosen by the group.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        keep = _firsts(h, d)
        h, d = h[keep], d[keep]
        at = np.flatnonzero(_firsts(h))
        count = np.diff(np.append(at, len(h)))
        nth = np.arange(len(h)) - np.repeat(at, count)
        rows: list[tuple] = []
        some = np.flatnonzero(nth < 2)
        for part, p in _splits(_range_of(h[some], n)):
            rows.append((part, None, h[some[p]].tobytes(), _short(d[some[p]])))
        many = np.flatnonzero(np.repeat(count, count) > 1)
        for group, p in _splits(_group_of(d[many], n_groups)):
            rows.append((group % n, group, np.unique(h[many[p]]).tobytes(), None))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "g", "h", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, raw in text_chunks(batch.column(1)):
                doc, _, _, _, h = pieces_of(raw, length)
                held.append((h, ids[first + doc]))
                size += len(h)
                if size > 600_000:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _find_repeated(n_groups: int):
    """In a range: the minimizers of two documents or more, per document group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ready, own = rows[rows["g"].notna()], rows[rows["g"].isna()]
        out = list(zip(ready["g"].astype("int64"), ready["h"], strict=True))
        if len(own):
            h, d = _joined(own["h"], np.uint64), np.concatenate([_long(x) for x in own["d"]])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            at = np.flatnonzero(_firsts(h))
            many = np.repeat(np.add.reduceat(_firsts(h, d).astype(np.int64), at) > 1, np.diff(np.append(at, len(h))))
            out += [(group, np.unique(h[many][p]).tobytes()) for group, p in _splits(_group_of(d[many], n_groups))]
        return pd.DataFrame(out, columns=["g", "h"])

    return run


# ---- step 2 ----


def _send_pieces(length: int, n: int):
    """The pieces of a document group with a repeated minimizer, per range; stretches (r, s, e) marked already."""

    def run(key: tuple, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        columns = ["part", "g", "n", "body", "r", "s", "e"]
        copies = set(known["copy"].dropna().map(int))
        some = known[known["h"].notna()]
        if not len(some) or not len(docs):
            return pd.DataFrame(out, columns=columns)
        group, wanted = int(key[0]), np.unique(_joined(some["h"], np.uint64))
        ids, rows, texts = docs["doc_id"].to_numpy(np.int64), docs["_r"].to_numpy(np.int64), docs["text"].to_list()
        pick = [i for i in range(len(ids)) if int(rows[i]) not in copies]
        held: list[list[np.ndarray]] = []
        data: list[bytes] = []
        step: list[int] = []
        size = 0
        for j, i in enumerate(pick):
            step.append(i)
            size += len(texts[i] or "")
            if size < 1_000_000 and j + 1 < len(pick):
                continue
            raw = [(texts[x] or "").encode("utf-8", "replace") for x in step]
            doc, place, first, last, h = pieces_of(raw, length)
            ok = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            who = np.array(step)[doc[ok]]
            held.append([h[ok], ids[who], rows[who], first[ok], last[ok] + length - first[ok], place[ok] - first[ok]])
            data += [raw[a][b : b + c] for a, b, c in zip(doc[ok].tolist(), first[ok].tolist(), held[-1][4].tolist(), strict=True)]
            step, size = [], 0
        if not data:
            return pd.DataFrame(out, columns=columns)
        h, d, r, first, lens, off = (np.concatenate(x) for x in zip(*held, strict=True))
        # Of equal pieces the smallest document's goes on; in larger documents all of such a piece is marked.
        least: dict[bytes, int] = {}
        for i in np.argsort(d, kind="stable").tolist():
            least.setdefault(data[i], int(d[i]))
        over = d > np.fromiter((least[x] for x in data), np.int64, len(data))
        if over.any():
            spans = merged(r[over], first[over], first[over] + lens[over])
            out.append((group % n, group, 0, None, *(x.tobytes() for x in spans)))
        packer, left = zstandard.ZstdCompressor(level=1), np.flatnonzero(~over)
        for part, p in _splits(_range_of(h[left], n)):
            p = left[p]
            body = b"".join(c[p].astype(np.int64).tobytes() for c in (d, r, first, lens, off)) + b"".join([data[i] for i in p.tolist()])
            out.append((part, group, len(p), packer.compress(body), None, None, None))
        return pd.DataFrame(out, columns=columns)

    return run


# ---- step 3 ----


def _numbered(keys: list[bytes]) -> np.ndarray:
    """The number of each key among the distinct ones, by first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(k, len(seen)) for k in keys), np.int64, len(keys))


def _halved(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, family: np.ndarray, length: int, marks: np.ndarray) -> None:
    """Mark in ``marks``, by first byte, the windows of data[start : start + size] that a smaller doc of the family has."""
    while True:
        order = np.lexsort((doc, family))
        start, size, doc, family = start[order], size[order], doc[order], family[order]
        fresh = _firsts(family)
        number = np.cumsum(fresh) - 1
        rank = np.cumsum(_firsts(family, doc))
        rank -= rank[np.flatnonzero(fresh)][number]
        n_docs = np.zeros(number[-1] + 1 if len(number) else 0, np.int64)
        np.maximum.at(n_docs, number, rank + 1)
        go = n_docs[number] > 1
        if not go.any():
            return
        upper = (rank >= (n_docs[number] + 1) // 2) & go
        lower = go & ~upper
        index = RunLengthIndex(data, start[lower], size[lower], cap=length)
        for who, at, _, held in index.matching_statistics(data, start[upper], size[upper]):
            hit = held >= length
            marks[start[upper][who[hit]] + at[hit]] = True
        # What is left of the larger half: runs of windows that were not marked.
        n_windows = size[upper] - length + 1
        owner = np.repeat(np.flatnonzero(upper), n_windows)
        place = np.repeat(start[upper] - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(int(n_windows.sum()))
        free = ~marks[place]
        edge = _firsts(owner) if len(owner) else np.zeros(0, bool)
        first = np.flatnonzero(free & (edge | ~np.concatenate([[False], free[:-1]])))
        last = np.flatnonzero(free & np.concatenate([edge[1:] | ~free[1:], [True]]))
        start, size, doc, family = (
            np.concatenate([start[lower], place[first]]), np.concatenate([size[lower], place[last] - place[first] + length]),
            np.concatenate([doc[lower], doc[owner[first]]]), np.concatenate([2 * number[lower], 2 * number[owner[first]] + 1]),
        )


def repeated_windows(pieces: list[bytes], docs: np.ndarray, offs: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of every window of different pieces that a piece of a smaller document has too.

    ``offs`` are the places of the pieces' minimizers. Every match is found by the run-length index.
    """
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(lens) - lens
    data, half = np.frombuffer(b"".join(pieces), np.uint8), (length - k + 1) // 2
    marks = np.zeros(len(data), bool)
    places = offs.tolist()
    # Windows with half of the context before the minimizer, and those with more of it behind.
    low, high = np.maximum(0, offs - half + 1), np.minimum(lens, offs - half + length)
    who = np.flatnonzero(offs >= half)
    _halved(data, start[who], high[who], docs[who], _numbered([pieces[i][places[i] - half : places[i] + k] for i in who.tolist()]), length, marks)
    who = np.flatnonzero(lens - low >= length)
    _halved(data, start[who] + low[who], lens[who] - low[who], docs[who], _numbered([pieces[i][places[i] : places[i] + k + half] for i in who.tolist()]), length, marks)
    hit = np.flatnonzero(marks)
    piece = np.searchsorted(start, hit, side="right") - 1
    return piece, hit - start[piece]


def _find_marks(length: int):
    """In a range: the stretches of each row to remove, per document group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ready, own = rows[rows["body"].isna()], rows[rows["body"].notna()]
        out = list(zip(ready["g"], ready["r"], ready["s"], ready["e"], strict=True))
        if not len(own):
            return pd.DataFrame(out, columns=["g", "r", "s", "e"])
        unpack = zstandard.ZstdDecompressor()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        texts: list[bytes] = []
        for m, body in zip(own["n"], own["body"], strict=True):
            raw = unpack.decompress(body)
            for j in range(5):
                cols[j].append(np.frombuffer(raw, np.int64, m, 8 * m * j))
            end = 40 * m + np.cumsum(cols[3][-1])
            texts += [raw[a:b] for a, b in zip((end - cols[3][-1]).tolist(), end.tolist(), strict=True)]
        g = np.repeat(own["g"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
        docs, row, first, lens, offs = (np.concatenate(c) for c in cols)
        # Equal pieces are one: the smallest document owns it, in the others all of it goes.
        piece = _numbered(texts)
        order = np.lexsort((docs, piece))
        head = order[_firsts(piece[order])]
        whole = docs > docs[head][piece]
        where, at = repeated_windows([texts[i] for i in head.tolist()], docs[head], offs[head], length)
        # A window of a piece goes in every place where its owner has the piece.
        keep = np.flatnonzero(~whole)
        keep = keep[np.argsort(piece[keep], kind="stable")]
        low, high = np.searchsorted(piece[keep], where), np.searchsorted(piece[keep], where, side="right")
        times = high - low
        to = keep[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        begin = first[to] + np.repeat(at, times)
        group = np.concatenate([g[whole], g[to]])
        spans = np.concatenate([row[whole], row[to]]), np.concatenate([first[whole], begin]), np.concatenate([(first + lens)[whole], begin + length])
        for one, p in _splits(group):
            out.append((one, *(x.tobytes() for x in merged(*(x[p] for x in spans)))))
        return pd.DataFrame(out, columns=["g", "r", "s", "e"])

    return run


def merged(d: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Unions of the stretches [s, e) of each document; touching ones are one."""
    if not len(d):
        return d, s, e
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    number = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
    width = int(e.max()) + 2
    reach = np.maximum.accumulate(e + number * width) - number * width
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], reach[np.concatenate([at[1:] - 1, [len(d) - 1]])]


# ---- step 4 ----


def _cut(columns: list[str], length: int):
    """Documents with their spans and what is left."""

    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        some = known[known["r"].notna()]
        copies = set(known["copy"].dropna().map(int))
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(some):
            for a, b, c in zip(*(x.tolist() for x in merged(*(_joined(some[c], np.int64) for c in ("r", "s", "e")))), strict=True):
                spans.setdefault(a, []).append((b, c))
        kept, out, sizes = [], [], []
        for i, t in zip(docs["_r"], docs["text"], strict=True):
            raw = (t or "").encode("utf-8", "replace")
            mine = [(0, len(raw))] if int(i) in copies and len(raw) >= length else spans.get(int(i), [])
            at, parts = 0, []
            for b, c in mine:
                parts.append(raw[at:b])
                at = c
            kept.append(b"".join(parts) + raw[at:])
            out.append([{"start": b, "end": c} for b, c in mine])
            sizes.append(len(raw))
        return docs[columns].assign(n_bytes=sizes, spans=out, kept=kept, kept_text=[x.decode("utf-8", "ignore") for x in kept])

    return run


def mark_repeats(docs: DataFrame, length: int = 50, parts: int | None = None) -> DataFrame:
    """``docs`` with n_bytes, spans (removed byte stretches, maximal), kept (the remaining bytes) and kept_text.

    A stretch may begin or end inside a character; kept_text leaves out the bytes of such torn characters.

    Null text is empty. Rows with a null doc_id keep everything and count for nobody. Rows with one doc_id are
    judged as one document's text each, so repeated rows stay. Texts under ``length`` bytes are untouched.
    ``parts`` is the number of hash ranges and of document groups, by default one for ``RANGE_BYTES`` and for
    ``GROUP_BYTES`` of text, and two for each core at least.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept", "kept_text", "_g", "_r")]
    src = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("text", F.col("text").cast("string"))
    # A row is named by its id and text.
    sure = src.where("doc_id IS NOT NULL").withColumn("_r", F.xxhash64("doc_id", "text"))

    # 128-bit digests stand for whole texts; texts under the length are never removed.
    digests = sure.where(F.octet_length("text") >= length).select("doc_id", "_r", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    first = checkpointed(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    total, least = sure.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 2 * spark.sparkContext.defaultParallelism
    n, n_groups = (parts or max(least, -(-total // x)) for x in (RANGE_BYTES, GROUP_BYTES))
    n_groups |= 1  # odd, so that evenly spaced ids spread

    g = group_column(n_groups)
    copies = checkpointed(digests.join(first, "digest").where("doc_id > first").select(g.alias("g"), F.col("_r").cast("string").alias("copy")))
    grouped = sure.withColumn("_g", g)
    send = sure.select("doc_id", "text").mapInArrow(_send_minimizers(length, n, n_groups), "part bigint, g bigint, h binary, d binary")
    known = send.groupBy("part").applyInPandas(_find_repeated(n_groups), "g bigint, h binary")
    nothing = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    known = known.withColumn("copy", F.lit(None).cast("string")).unionByName(copies.select("g", *nothing("h"), "copy"))
    pieces = grouped.groupBy("_g").cogroup(known.groupBy("g")).applyInPandas(_send_pieces(length, n), "part bigint, g bigint, n bigint, body binary, r binary, s binary, e binary")
    marks = pieces.groupBy("part").applyInPandas(_find_marks(length), "g bigint, r binary, s binary, e binary")
    marks = marks.withColumn("copy", F.lit(None).cast("string")).unionByName(copies.select("g", *nothing("r", "s", "e"), "copy"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_text string"
    cut = grouped.groupBy("_g").cogroup(marks.groupBy("g")).applyInPandas(_cut(columns, length), schema)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = src.where("doc_id IS NULL").select("*", F.octet_length(raw).cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), raw.alias("kept"), F.coalesce("text", F.lit("")).alias("kept_text"))
    return cut.unionByName(whole)


def drop_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Documents with repeated stretches cut out of their text; those of which nothing is left go."""
    cut = mark_repeats(docs, length)
    text = F.when(F.size("spans") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).where("octet_length(kept) > 0 OR n_bytes = 0").select(*docs.columns)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of every document after removal of 50-byte strings that start in a smaller document."""
    cut = mark_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
