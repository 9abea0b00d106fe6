"""Language-model scores by a hidden Markov model whose training counts come from every training document.

Texts become tokens: words without white space, A-Z in lower case, and one end. A latent state gives a token in two
steps: the state emits the word's class, P(class | state), and the class the word, P(word | class). A class is the
crc32 of the word modulo ``classes``; the end has a class of its own. P(word | class) = (c + 0.5) / (C + 0.5 (V + 1))
with the count c of the word, and the count C and number V of the class's words, over the whole training corpus: one
share of each class is left for words never seen. So the tables of a state have a fixed size, while what is counted,
each word of the corpus, grows with it, and nothing is cut.

Baum-Welch runs over the whole corpus: tasks add up the expected counts of all their documents (scaled forward and
backward passes, many documents in step), Spark adds up the tasks, and the driver gets one row a class and state. A
bounded sample of documents only gives the states to start from: a mixture of unigram models.

The score is log10 of the probability of the token sequence: the scaled forward recursion over its classes, exact but
for rounding, plus log10 P(word | class) of its words. The two parts, and the base score, need the corpus counts of
a document's words. Documents are therefore kept as records of about 16 MB of text, each with its dictionary; each
dictionary word meets its count by one shuffle on the word, and the counts return to their record by one on the
record. A frequent word counts once a record there, so that no word is a large key.

Odd rows. Null text is empty: one token, the end. Rows without a doc_id are held out or not by the crc32 of the empty
text; rows with equal ids are each scored, and counted, on their own. With no training documents all classes are
alike. No rows: no result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, mix64, shared_checkpoints

#: Text of one record; bounds a task's memory, not the result.
RECORD_BYTES = 16_000_000
#: The end of a text, as an entry of dictionaries: no word has white space.
END = b"\n"
_RECORD = "part bigint, doc_id array<bigint>, held array<boolean>, lengths binary, tokens binary, words binary, classes binary, counts binary"


@dataclass(frozen=True)
class Settings:
    """States, classes of words, rounds of Baum-Welch; the sample that gives the start, in documents and their longest.

    ``common`` is how many tokens of each class are dealt to the states like all tokens, on top of those that were seen:
    what is seldom seen tells states little apart.
    """

    states: int = 8
    classes: int = 32_768
    rounds: int = 3
    sample_docs: int = 500
    sample_tokens: int = 4_000
    common: float = 3.0


@dataclass
class Counts:
    """Of the training corpus: tokens, distinct tokens, and by class (the last one is the end's) the tokens and distinct words."""

    tokens: int
    distinct: int
    by_class: np.ndarray
    words_of_class: np.ndarray
    ends: int


@dataclass
class Model:
    start: np.ndarray  # states
    moves: np.ndarray  # from state, to state
    emits: np.ndarray  # class, state


def _pack(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x, np.int32).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(b: bytes) -> bytes:
    return pa.decompress(b[8:], int(np.frombuffer(b[:8], np.int64)[0]), codec="zstd", asbytes=True)


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(_raw(b), np.int32)


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(tokens of each text, their dictionary places one text after another, the dictionary); place 0 is the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    words = upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]
    coded = flat.filter(real).dictionary_encode()
    lengths = words + 1
    tokens = np.zeros(int(lengths.sum()), np.int32)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(lengths) - 1] = False
    tokens[inside] = coded.indices.to_numpy() + 1
    return lengths, tokens, [END, *coded.dictionary.cast(pa.binary()).to_pylist()]


def word_class(word: bytes, classes: int) -> int:
    return classes if word == END else zlib.crc32(word) % classes


def _class_column(word: str, classes: int) -> Column:
    return F.when(F.col(word) == F.lit(bytearray(END)), classes).otherwise(F.pmod(F.crc32(word), F.lit(classes))).cast("int")


def encode(docs: DataFrame, held: Column, classes: int, text: str = "text") -> DataFrame:
    """Records of documents: ids, whether held out, lengths and tokens, and the dictionary with classes and training counts."""

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        n = -(-int(total[-1]) // RECORD_BYTES) if len(total) else 0
        cuts = np.unique(np.searchsorted(total, np.arange(1, n) * (int(total[-1]) / n), side="left") + 1) if n > 1 else np.zeros(0, int)
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch):
                lengths, tokens, words = tokenized(piece.column(2))
                trained = ~piece.column(1).to_numpy(zero_copy_only=False)
                counts = np.bincount(tokens[np.repeat(trained, lengths)], minlength=len(words))
                kinds = np.fromiter((word_class(w, classes) for w in words), np.int32, len(words))
                row = [part, piece.column(0).to_pylist(), piece.column(1).to_pylist(), _pack(lengths), _pack(tokens), _pack(b" ".join(words[1:])), _pack(kinds), _pack(counts)]
                part += 1
                kinds_of = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds_of, strict=True)], [c.split()[0] for c in _RECORD.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    return checkpointed(rows.mapInArrow(run, _RECORD))


def dictionary_counts(records: DataFrame, classes: int) -> DataFrame:
    """part, place, c, class and leads of each dictionary entry: its count in all training documents; one entry a word leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                blob, n = _raw(words), _ints(counts)
                entries = [END, *(blob.split(b" ") if blob else [])]
                yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), pa.array(np.full(len(n), part)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["word", "part", "place", "n"])

    pairs = records.select("part", "words", "counts").mapInArrow(run, "word binary, part bigint, place int, n int")
    word = W.partitionBy("word")
    rows = pairs.withColumn("leads", F.row_number().over(word.orderBy("part", "place")) == 1).withColumn("c", F.sum("n").over(word))
    rows = rows.select("part", "place", "c", _class_column("word", classes).alias("class"), "leads")
    spark = records.sparkSession
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/word-counts-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def corpus_counts(entries: DataFrame, classes: int) -> Counts:
    rows = entries.where("leads AND c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row a class
    c, v = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
    for r in rows:
        c[r["class"]], v[r["class"]] = r.c, r.v
    return Counts(int(c.sum()), int(v.sum()), c, v, int(c[classes]))


class Steps:
    """Places of the tokens of many documents in step: all first tokens, all second ones, ..., the longest document first."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.live = len(lengths) - np.concatenate([[0], np.cumsum(np.bincount(lengths))])[1:-1] if len(lengths) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.live)]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        turn = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        self.place = self.first[turn] + np.repeat(rank, lengths)

    def arrange(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.place] = x
        return out


def forward(steps: Steps, kinds: np.ndarray, model: Model, dtype: type = np.float64, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(the scale of every token in step order, whose product over a document is its probability; the scaled states)."""
    emits, moves, start = model.emits.astype(dtype), model.moves.astype(dtype), model.start.astype(dtype)
    scale = np.empty(len(kinds), dtype)
    states = np.empty((len(kinds), len(start)), dtype) if keep else None
    alpha = None
    for t, n in enumerate(steps.live.tolist()):
        at = slice(steps.first[t], steps.first[t] + n)
        x = emits[kinds[at]]
        x *= start if alpha is None else alpha[:n] @ moves
        total = x.sum(axis=1)
        x /= total[:, None]
        scale[at] = total
        if keep:
            states[at] = x
        alpha = x
    return scale, states


def expected_counts(lengths: np.ndarray, kinds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected (starts, moves, emissions) of documents one after another, by their tokens' classes."""
    steps = Steps(lengths)
    kinds = steps.arrange(kinds)
    scale, states = forward(steps, kinds, model, np.float32, keep=True)
    emits, back = model.emits.astype(np.float32), model.moves.astype(np.float32).T
    pairs = np.zeros(model.moves.shape)
    ahead = None  # of the tokens behind: emission x backward value / scale
    for t in range(len(steps.live) - 1, -1, -1):
        n, a = int(steps.live[t]), int(steps.first[t])
        mine = states[a : a + n]
        beta = np.ones((n, len(back)), np.float32)
        if ahead is not None:
            pairs += mine[: len(ahead)].T @ ahead
            beta[: len(ahead)] = ahead @ back
        ahead = emits[kinds[a : a + n]] * beta
        ahead /= scale[a : a + n, None]
        mine *= beta
    emitted = np.stack([np.bincount(kinds, weights=states[:, k], minlength=len(emits)) for k in range(len(back))], axis=1)
    return states[: int(steps.live[0])].sum(axis=0, dtype=np.float64) if len(steps.live) else np.zeros(len(back)), pairs * model.moves, emitted


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _model(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, counts: Counts, alike: float) -> Model:
    """The model of expected counts: a state emits a class as often as the corpus, times how much the class prefers it."""
    common = (counts.by_class + 0.5) / (counts.tokens + 0.5 * len(counts.by_class))
    states = _normal(emitted.sum(axis=0) + 1)
    prefers = (emitted + alike * states) / (emitted.sum(axis=1, keepdims=True) + alike) / states
    emits = common[:, None] * prefers
    return Model(_normal(starts + 0.1), _normal(moves + 0.1), emits / emits.sum(axis=0))


def first_model(records: DataFrame, counts: Counts, s: Settings) -> Model:
    """Where Baum-Welch starts: a mixture of unigram models of a bounded sample, as states that documents seldom leave."""
    share = int(min(1.0, s.sample_docs / max(counts.ends, 1)) * (2**53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held, lengths, tokens, classes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lengths, kinds = _ints(lengths), _ints(classes)[_ints(tokens)]
                # Drawn by the place in the table: repeated texts, and rows without an id, have no common fate.
                draw = mix64(np.arange(len(lengths), dtype=np.uint64) + (np.uint64(part) << np.uint64(20))) >> np.uint64(11)
                picked = np.flatnonzero(~np.array(held, bool) & (draw < np.uint64(share)) & (lengths <= s.sample_tokens))
                stop = np.cumsum(lengths)
                bags = [kinds[stop[i] - lengths[i] : stop[i]].tolist() for i in picked]
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.int32()))], ["bag"])

    bags = [r.bag for r in records.select("part", "held", "lengths", "tokens", "classes").mapInArrow(run, "bag array<int>").limit(4 * s.sample_docs).collect()]
    even = np.full(s.states, 1.0)
    moves = np.full((s.states, s.states), 0.02) + np.eye(s.states)
    if not bags:
        return _model(even, moves, np.zeros((s.classes + 1, s.states)), counts, s.common)
    kinds, at = np.unique(np.concatenate([np.array(b) for b in bags]), return_inverse=True)
    x = np.zeros((len(bags), len(kinds)), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(bags)), [len(b) for b in bags]), at), 1)
    common = x.sum(axis=0) / x.sum()
    best, rng = None, np.random.default_rng(0)
    for _ in range(6):
        weight = np.full(s.states, 1 / s.states)
        unigrams = _normal(x[rng.choice(len(x), s.states, replace=len(x) < s.states)] + 50 * common)
        for _ in range(15):
            like = x @ np.log(unigrams).T + np.log(weight)
            top = like.max(axis=1, keepdims=True)
            belongs = np.exp(like - top)
            fit = float((np.log(belongs.sum(axis=1)) + top[:, 0]).sum())
            belongs = _normal(belongs)
            weight, unigrams = _normal(belongs.sum(axis=0) + 1), _normal(belongs.T @ x + 50 * common)
        if best is None or fit > best[0]:
            best = fit, weight, belongs.T @ x
    emitted = np.zeros((s.classes + 1, s.states))
    emitted[kinds] = best[2].T
    return _model(best[1] * len(bags), moves * 20 * len(bags), emitted, counts, s.common)


def baum_welch(records: DataFrame, model: Model, counts: Counts, s: Settings) -> Model:
    """One round over all training documents of all records."""
    k, c = s.states, s.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((c + k + 1, k))  # classes, then moves, then starts
        for batch in batches:
            for held, lengths, tokens, classes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lengths, trained = _ints(lengths), ~np.array(held, bool)
                kinds = _ints(classes)[_ints(tokens)][np.repeat(trained, lengths)]
                starts, moves, emitted = expected_counts(lengths[trained], kinds, model)
                sums[:c] += emitted
                sums[c : c + k] += moves
                sums[c + k] += starts
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(sums[rows, i]) for i in range(k)]], ["place", *[f"s{i}" for i in range(k)]])

    parts = records.select("held", "lengths", "tokens", "classes").mapInArrow(run, "place int, " + ", ".join(f"s{i} double" for i in range(k)))
    sums = np.zeros((c + k + 1, k))
    for r in parts.groupBy("place").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).collect():  # a row a class
        sums[r.place] = r[1:]
    return _model(sums[c + k], sums[c : c + k], sums[:c], counts, s.common)


def score_record(lengths: np.ndarray, tokens: np.ndarray, classes: np.ndarray, c: np.ndarray, model: Model, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of a record's documents; ``c`` has the corpus count of each dictionary entry."""
    steps = Steps(lengths)
    scale, _ = forward(steps, steps.arrange(classes[tokens]), model)
    inside = np.log10((c + 0.5) / (counts.by_class[classes] + 0.5 * (counts.words_of_class[classes] + 1)))
    base = np.log10((c + 0.5) / (counts.tokens + 0.5 * (counts.distinct + 1)))
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    of_docs = lambda x: np.add.reduceat(x, begin)
    return of_docs((c > 0)[tokens].astype(np.int64)), of_docs(base[tokens]), of_docs(np.log10(scale)[steps.place] + inside[tokens])


def score_texts(docs: DataFrame, held: Column, settings: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, by a model of the rows not held out."""
    records = encode(docs, held, settings.classes, text)
    entries = dictionary_counts(records, settings.classes)
    counts = corpus_counts(entries, settings.classes)
    model = first_model(records, counts, settings)
    for _ in range(settings.rounds):
        model = baum_welch(records, model, counts, settings)
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast((model, counts))  # states x classes, whatever the corpus

    def run(record: pa.Table, found: pa.Table) -> pa.Table:
        model, counts = shared.value
        out = []
        for row in record.to_pylist():
            c = np.empty(found.num_rows, np.int64)
            c[found.column("place").to_numpy()] = found.column("c").to_numpy()
            lengths = _ints(row["lengths"]).astype(np.int64)
            known, base, score = score_record(lengths, _ints(row["tokens"]), _ints(row["classes"]), c, model, counts)
            cols = [row["doc_id"], row["held"], lengths, known, np.full(len(lengths), counts.tokens), base, score]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            out.append(pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    left = records.select("part", "doc_id", "held", "lengths", "tokens", "classes").groupBy("part")
    return left.cogroup(entries.select("part", "place", "c").groupBy("part")).applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 5 is 1 are held out of the counts."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), id_crc() % 5 == 1)
