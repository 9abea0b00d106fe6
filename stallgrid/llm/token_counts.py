"""Token counts at every prefix, by prefix dynamic programming.

A text is cut before its spaces: a piece of the vocabulary holds the space mark only in front (or is made of marks
alone), so merges never cross from a word into the space before the next one. Within a word the recurrence is over
characters. The encoding of a prefix ends in exactly one piece, and what stands before that piece is the encoding of
the shorter prefix:

    last[j], count[j] = p, count[j - |p|] + tokens of p

for the one piece p that ends at character j and whose merges, next to those of last[j - |p|], do not cross from one
into the other. Whether two pieces stay apart is found once for each pair by merging the characters of both, and
kept. A character that is no piece becomes its bytes, and nothing merges with it. So a word of any length takes one
step for each character and never is encoded again; words are gone through in order, so that they share the steps of
common prefixes, and those of a word are kept as one byte a character (what the character adds to the count).

The table of a document is the string of these steps: the count of any prefix is their sum up to there. The query
stores it, and how many characters fit the limit is read off it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREE

MARK = "▁"
#: Words and pairs of pieces kept by a worker process, and the longest word that is kept; bounds of memory, not of results.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 900_000, 40, 2_000_000
_SPLIT = re.compile(r" +[^ ]*")
_START = -1  # in place of a piece before the first one, and behind a character that nothing merges with


class Pieces:
    """The vocabulary of a BPE model: pieces by what merges are ranked by, and which pairs of pieces stay apart."""

    def __init__(self, scores: dict[str, float]):
        names = sorted(set(scores) | {ch for piece in scores for ch in piece})
        self.ids = {piece: i for i, piece in enumerate(names)}
        self.names = names
        self.scores = scores
        # A single character that only parts of pieces have is spelled in bytes where it stays alone.
        self.tokens = [1 if p in scores else len(p.encode("utf-8", "surrogatepass")) for p in names]
        self.longest = max(map(len, names), default=1)
        self.apart: dict[int, bool] = {}

    def stays(self, before: int, piece: int) -> bool:
        """Whether the merges of both leave the two as they are."""
        key = before * len(self.names) + piece
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            left = self.names[before] if before >= 0 else ""
            right = self.names[piece]
            known = self.apart[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _merged(self, text: str) -> list[str]:
        """The characters of a short text, merged: the best pair first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [self.scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(ranked)
            if best == -np.inf:
                break
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class WordSteps:
    """word (without its leading space mark) -> what the mark and each character add to the count of the prefix."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.steps: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """The words that are not known yet, in order: each goes on from what it shares with the one before it."""
        if len(self.steps) + len(words) > CACHE_WORDS:
            self.steps.clear()
        piece_of, tokens, longest, stays = self.pieces.ids.get, self.pieces.tokens, self.pieces.longest, self.pieces.stays
        stay_known, width = self.pieces.apart.get, len(self.pieces.names)
        last, count, step, done = [_START], [0], [], ""
        for word in sorted(w for w in words if w not in self.steps):
            text = MARK + word.replace(" ", MARK)
            same, most = 0, min(len(text), len(done))
            while same < most and text[same] == done[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], step[same:]
            for j in range(same + 1, len(text) + 1):
                i = j - 1
                stop = j - longest if j > longest else 0
                while i >= stop:  # pieces of few characters are the common case
                    piece = piece_of(text[i:j])
                    if piece is not None:
                        known = stay_known(last[i] * width + piece)
                        if known or (known is None and stays(last[i], piece)):
                            last.append(piece)
                            count.append(count[i] + tokens[piece])
                            break
                    i -= 1
                else:
                    last.append(_START)
                    count.append(count[j - 1] + len(text[j - 1].encode("utf-8", "surrogatepass")))
                step.append((count[j] - count[j - 1]) & 255)
            done = text
            self.steps[word] = bytes(step)

    def forget_long(self, words: set[str]) -> None:
        for word in words:
            if len(word) > CACHE_CHARS:
                del self.steps[word]


def words_of(text: str) -> list[str]:
    """The words of a text, each without the one space mark that the encoder puts in front of it."""
    if MARK in text:  # the library writes spaces as this mark, so the two are one character to it
        text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _SPLIT.findall(" " + text)]
    return text.split(" ")


def prefix_steps(words: list[str], known: WordSteps) -> bytes:
    """What each character of a text adds to the count of the prefix that it ends, one signed byte each."""
    if words == [""]:
        return b""
    steps = b"".join(map(known.steps.__getitem__, words))
    # The mark before the first word is no character of the text.
    return bytes([(steps[0] + steps[1]) & 255]) + steps[2:]


def prefix_table(steps: bytes) -> np.ndarray:
    """Tokens of the first 0, 1, ... characters, out of the stored steps."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def count_prefix(steps: bytes, chars: int) -> int:
    """Exact tokens of the first ``chars`` characters."""
    return int(np.frombuffer(steps[:chars], np.int8).sum(dtype=np.int64))


def longest_within(steps: bytes, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens; a longer prefix may have fewer than a shorter one."""
    return int(np.flatnonzero(prefix_table(steps) <= limit)[-1])


_KNOWN: dict[str, WordSteps] = {}


def _free() -> None:
    for known in _KNOWN.values():
        known.steps.clear()


FREE.append(_free)


def learned(texts: pa.Array, known: WordSteps, limit: int = 4_000_000) -> Iterator[tuple[str, list[str]]]:
    """Every text (null: empty) with its words, which ``known`` has then; texts of about ``limit`` characters go together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        held.append((t, words_of(t)))
        size += len(t)
        if size > limit or i + 1 == len(texts):
            words = set().union(*(w for _, w in held))
            known.learn(words)
            yield from held
            known.forget_long(words)
            held, size = [], 0


def library_steps(model: str | None = None) -> WordSteps:
    """The words known to this process for a sentencepiece BPE model (by default the public 32k one).

    The recurrence holds for models that merge characters by the score of the piece that results, and that leave texts
    as they are but for the space mark. The model is held against the library on samples when it is loaded.
    """
    import public_tokenizers
    import sentencepiece

    path = model or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _KNOWN:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        known = WordSteps(Pieces({library.id_to_piece(i): library.get_score(i) for i in plain}))
        some = [library.id_to_piece(i) for i in plain[:: max(1, len(plain) // 200)]]
        samples = ["a  b ", " ", "ﬁ① x", *(f"{a}{b} {a}".replace(MARK, " ") for a, b in zip(some, reversed(some), strict=True))]
        for text, words in learned(pa.array(samples), known):
            if len(library.encode(text)) != count_prefix(prefix_steps(words, known), len(text)):
                raise ValueError(f"{path} does not encode by merging characters of unchanged text")
        _KNOWN[path] = known
    return _KNOWN[path]


def token_counts(docs: DataFrame, limit: int = 4096, model: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars and prefix_steps of every row.

    prefix_steps has one signed byte a character: what it adds to the tokens of the prefix that it ends (see
    ``count_prefix``). ``fit_chars`` is the length of the longest prefix with at most ``limit`` tokens. Null text is
    empty: 0 tokens. One pass, no shuffle. ``model`` is a path that the workers can read; rows with equal ids are
    counted on their own.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_steps"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library_steps(model)
        for batch in batches:
            out: list[tuple] = []
            for t, words in learned(batch.column(1), known):
                steps = prefix_steps(words, known)
                n = count_prefix(steps, len(t))
                out.append((len(t.encode("utf-8", "surrogatepass")), n, n > limit, len(t) if n <= limit else longest_within(steps, limit), steps))
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, prefix_steps binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document by the public 32k sentencepiece model at every prefix, against a limit of 4096."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
