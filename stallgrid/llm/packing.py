"""Best-fit packing of token sequences, with bounds that certify each partition.

1. Texts are encoded and cut: documents longer than a sequence give full pieces and one rest.
2. The pieces are dealt over partitions by hash; each runs best-fit decreasing. Dual feasible functions give a
   lower bound on the sequences that any packing of the partition's pieces needs.
3. A partition that meets its bound is certified and final. The others keep their full sequences and exchange the
   pieces of the rest: these are dealt out anew over as many partitions as they need and rerun best-fit decreasing,
   round after round, until all are certified, one partition is left, or a round saved no sequence.

In every round a partition has about ``group_pieces`` pieces, whatever their number and lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREE, checkpointed

#: Words kept by a worker process, and the longest that is kept; both bound memory only, not results.
CACHE_WORDS, CACHE_CHARS = 500_000, 40
#: Words that the tokenizer gets at once, and what stands between them.
BATCH_WORDS, MARK = 400, "~"
#: Marks that end a word without changing the ids before them, and the letters behind which they do so: up to U+024F
#: a letter is one whatever the normaliser does, unless lower-casing gives it a mark.
_TAILS, _LETTERS = frozenset(".,;:!?"), frozenset(c for c in map(chr, range(0x250)) if c.lower().isalpha())
SEQUENCE = 2048
_ENCODERS: dict[str, _Encoder] = {}
FREE.append(_ENCODERS.clear)


class _Encoder:
    """Ids of texts by a word-level tokenizer: white space always separates, so words are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def learn(self, words: set[str]) -> list[str]:
        """Encode words that are not known yet; returns those that are too long to be kept.

        A letter word with a mark behind it has the ids of both; case does not count in ASCII words.
        """
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known, new = {"": b""}, [w for w in words if w]
            self.known = known
        marked = [w for w in new if w[-1] in _TAILS and w[-2:-1] in _LETTERS]
        whole = [w for w in new if not (w[-1] in _TAILS and w[-2:-1] in _LETTERS)]
        cores = dict.fromkeys(whole) | dict.fromkeys([w[:-1] for w in marked])
        folded = {w: w.lower() for w in cores if w not in known and w.isascii() and w.isalpha()}
        known.update(self._encoded([w for w in set(folded.values()).union(w for w in cores if w not in folded) if w not in known]))
        for w, x in folded.items():
            known[w] = known[x]
        for w in marked:
            known[w] = known[w[:-1]] + self.tails[w[-1]]
        return [w for x in (whole, marked, folded.values(), cores) for w in x if len(w) > CACHE_CHARS]

    @cached_property
    def tails(self) -> dict[str, bytes]:
        return {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in _TAILS}

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Many words go as one text, with a mark between them that is one token by itself and in no other word."""
        plain = [w for w in words if MARK not in w]
        batches = [plain[k : k + BATCH_WORDS] for k in range(0, len(plain), BATCH_WORDS)]
        alone, out = [w for w in words if MARK in w], {}
        joined = self.tokenizer.encode_batch_fast([f" {MARK} ".join(b) for b in batches], add_special_tokens=False)
        for batch, e in zip(batches, joined, strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if len(cut) != len(batch) - 1:
                alone += batch
                continue
            raw, ends = ids.tobytes(), (4 * cut).tolist()
            out.update((w, raw[x:y]) for w, x, y in zip(batch, [0, *(c + 4 for c in ends)], [*ends, len(raw)], strict=True))
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        long = self.learn(set().union(*words))
        get = self.known.__getitem__
        for w in words:
            yield b"".join(map(get, w))
        for w in long:
            self.known.pop(w, None)


def _encoder(path: str | None) -> _Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        encoder = _Encoder(path)
        # Words are encoded apart, white space and case as this kind of vocabulary takes them: hold that against the library.
        samples = ["AbC dEF x", " two  spaces ", "line\nend\ttab", "Éclair ﬁ İ 12", "a.b </w> 's", ""]
        whole = encoder.tokenizer.encode_batch_fast(samples, add_special_tokens=False)
        if list(encoder.encode(samples)) != [np.array(e.ids, "<u4").tobytes() for e in whole]:
            raise ValueError(f"{path} does not encode words apart from each other in lower case")
        _ENCODERS[path] = encoder
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, capacity: int = SEQUENCE, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary) of every piece; null text is empty (one id, the end)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            first, held, size = 0, [], 0
            for i, t in enumerate(batch.column(1)):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > 500_000 or i + 1 == batch.num_rows:
                    rows: list[tuple] = []
                    for k, ids in enumerate(encoder.encode(held)):
                        ids += end
                        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                            part = ids[at : at + 4 * capacity]
                            rows.append((first + k, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                    at, *cols, parts = zip(*rows, strict=True)
                    arrays = [batch.column(0).take(pa.array(at)), *(pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(parts, pa.binary())] * with_ids, names + ["ids"] * with_ids)
                    first, held, size = i + 1, [], 0

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by two families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    from_here = np.cumsum(counts[::-1])[::-1]
    volume = np.concatenate([[0], np.cumsum(counts * size)])
    # For each e: items over capacity - e count as a whole bin, items under e as nothing.
    for e in np.flatnonzero(counts[: capacity // 2 + 1]):
        large = int(from_here[capacity - e + 1]) if capacity - e + 1 <= capacity else 0
        middle = int(volume[capacity - e + 1] - volume[e])
        best = max(best, large + -(-middle // capacity))
    # Rounding functions: sizes at multiples of capacity / (k + 1) keep their share, others are rounded down.
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * size, capacity)
        units = np.where(rest == 0, whole * k, whole * (k + 1))  # in units of capacity / (k * (k + 1))
        best = max(best, -(-int((counts * units).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, offset in it, bins): items by falling length, each into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r: some bin has room r
    for i in order:
        need = int(lengths[i])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            free[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, n


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = 20_000, max_rounds: int = 12) -> DataFrame:
    """``pieces`` with sequence_id, offset and certified; ``length`` must be from 1 to ``capacity``.

    ``certified`` says that the group in which a piece was packed last met its lower bound. Rows with equal or null
    ids are pieces of their own. ``max_rounds`` bounds the exchanges; every piece is packed after each of them.
    """
    pieces = checkpointed(pieces)
    n_groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint, certified boolean, final boolean"

    def pack(round_no: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lengths = rows["length"].to_numpy(np.int64)
            bins, offsets, n = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            full = np.bincount(bins, weights=lengths, minlength=n)[bins] >= capacity
            rows = rows.assign(
                # Round, group and bin make the number: unique without any coordination.
                sequence_id=(np.int64(round_no) << np.int64(58)) + (np.int64(key[0]) << np.int64(28)) + bins,
                offset=offsets, certified=n == bound, final=full | (n == bound),
            )
            return rows[[*columns, "sequence_id", "offset", "certified", "final"]]

        return run

    todo, done, before = pieces, None, None
    for round_no in range(max_rounds):
        # The row number is stable, since the rows come from a checkpoint; it spreads rows with equal ids.
        group = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(round_no)), F.lit(n_groups))
        packed = checkpointed(todo.withColumn("group", group).groupBy("group").applyInPandas(pack(round_no), schema))
        sequences, opened, left = packed.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)) for c in (F.col("offset") == 0, (F.col("offset") == 0) & ~F.col("final"), ~F.col("final")))).first()
        last = not left or n_groups == 1 or round_no + 1 == max_rounds or (before is not None and sequences >= before)
        part = packed if last else packed.where("final")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        before, n_groups = opened, -(-left // group_pieces)
        todo = packed.where("NOT final").select(*columns)
    return done.drop("final")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of at most 2048 tokens."""
    return pack_pieces(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
