"""Language ID by nearest centroid: normalised TF-IDF byte n-grams, several clusters per language, cosine.

Texts are lower-cased; ASCII bytes that are no letters become single spaces. Byte pairs and triples are hashed
to ``DIM`` numbers; a text is the L2-normalised vector of (1 + ln tf) * idf. Each language gets up to ``k``
centroids by spherical k-means. A text takes the language of the centroid with the highest cosine. It is
rejected if it has no letter, or if it is too far away: if that cosine is less than half of what the farthest
sample of that very centroid had.

The classifier is fitted on a sample of at most about ``per_lang`` rows a language, whatever the table's size.
Each language is clustered by itself on the executors; what reaches the driver are centroids and n-gram counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_crc, spread, text_chunks

DIM = 8192
#: A cluster of fewer samples has no centroid of its own.
LEAST_CLUSTER = 5
_SPACES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Hashed counts of byte pairs and triples: one row of DIM numbers per (lower-cased UTF-8) text."""
    parts = [b" " + b" ".join(t.translate(_SPACES).split()) + b" " for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    a = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(parts), dtype=np.int64) * DIM, lens)
    ends = np.cumsum(lens)
    pair = a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519)
    triple = pair + a[2:] * np.uint32(3266489917) + np.uint32(374761393)
    inside = np.ones(len(doc), bool)
    inside[ends - 1] = False  # grams never reach into the next text
    out = np.bincount(doc[inside] + (pair[inside] >> np.uint32(19)), minlength=len(parts) * DIM)
    inside[np.maximum(ends - 2, 0)] = False
    out += np.bincount(doc[inside] + (triple[inside] >> np.uint32(19)), minlength=len(parts) * DIM)
    return out.reshape(len(parts), DIM)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(counts.shape, np.float32)
    hit = counts > 0
    v[hit] = 1 + np.log(counts[hit].astype(np.float32))
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # one row per centroid
    idf: np.ndarray
    least: np.ndarray  # lowest cosine that is not rejected, per centroid

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', cosine, rejected) per text."""
        n = len(texts)
        lang, score, reject = ["und"] * n, np.zeros(n), np.ones(n, bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        step: list[int] = []
        size = 0
        for j, i in enumerate(known):
            step.append(i)
            size += len(texts[i])
            if len(step) == 64 or size > 1_000_000 or j + 1 == len(known):
                if len(self.languages):
                    cos = _vectors(gram_counts([texts[i].lower().encode("utf-8", "replace") for i in step]), self.idf) @ self.vectors.T
                    best = cos.argmax(axis=1)
                    top = cos[np.arange(len(step)), best]
                    score[step] = np.clip(top, 0, 1)
                    reject[step] = top < self.least[best]
                    for i, b in zip(step, best, strict=True):
                        lang[i] = self.languages[b]
                step, size = [], 0
        return lang, score, reject


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, own centroid of each row); clusters under ``LEAST_CLUSTER`` rows are given up one by one."""
    # First centres: rows at even ranks of the similarity to the mean, so that lone outliers do not take them.
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    c = x[order[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]]
    while True:
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        sizes = np.bincount(own, minlength=len(c))
        if len(c) == 1 or sizes.min() >= LEAST_CLUSTER:
            return c, own
        c = np.delete(c, int(sizes.argmin()), axis=0)


def _cluster(idf: np.ndarray, k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "v"])
        x = _vectors(np.stack([np.frombuffer(v, "<u2") for v in rows["v"]]), idf)
        c, own = _spherical_kmeans(x, k)
        cos = np.einsum("ij,ij->i", x, c[own])
        least = [0.5 * float(cos[own == j].min()) for j in range(len(c))]
        return pd.DataFrame({"lang": key[0], "no": range(len(c)), "vector": [v.astype("<f4").tobytes() for v in c], "least": least})

    return run


def fit_centroids(labelled: DataFrame, per_lang: int = 250, k: int = 4, text: str = "text", lang: str = "lang") -> Centroids:
    """Fit on rows with a non-null language: about ``per_lang`` of each, chosen by a hash of doc_id.

    Rows without a letter are no samples. Repeated rows count as often as they are there; rows with equal ids are
    chosen together. With no labelled row the model is empty and rejects everything.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col("doc_id").cast("bigint"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    empty = Centroids([], np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros(0))
    if not counts:
        return empty
    share = F.element_at(F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(per_lang / n))]), F.col("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs = [], []
            for i, t in enumerate(batch.column(2)):
                t = t.as_py() or ""
                if has_letter(t):
                    c = gram_counts([t.lower().encode("utf-8", "replace")])[0]
                    keep.append(i)
                    vecs.append(np.minimum(c, 65535).astype("<u2").tobytes())
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(vecs, pa.binary())], ["doc_id", "lang", "v"])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for v in batch.column(0):
                df += np.frombuffer(v.as_py(), "<u2") > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    # A few partitions hold the bounded sample, and each gives one row of counts. Rows without an id are drawn by their place.
    place = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = checkpointed(rows.where(F.when(F.col("doc_id").isNull(), place).otherwise(spread()) < share).mapInArrow(vectors, "doc_id bigint, lang string, v binary").repartition(8))
    seen = sample.select("v").mapInArrow(present, "n bigint, df binary").collect()
    n = sum(r.n for r in seen)
    if not n:
        return empty
    idf = np.log((1 + n) / (1 + sum(np.frombuffer(r.df, np.int64) for r in seen))).astype(np.float32) + 1
    got = sorted(sample.groupBy("lang").applyInPandas(_cluster(idf, k), "lang string, no int, vector binary, least double").collect(), key=lambda r: (r.lang, r.no))
    return Centroids([r.lang for r in got], np.stack([np.frombuffer(r.vector, "<f4") for r in got]), idf, np.array([r.least for r in got]))


def identify(docs: DataFrame, model: Centroids, text: str = "text", keep: Column | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; null text, empty text and text without a letter: 'und', 0, rejected.

    One pass without a shuffle. Columns of ``docs`` named lang_pred, score or rejected are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    src = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in text_chunks(batch.column(at)):
                lang, score, reject = shared.value.predict([b.decode("utf-8", "replace") for b in raw])
                part = batch.slice(first, len(raw))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(reject)], [*names, "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(id_crc(), F.lit(4)) == 2
    model = fit_centroids(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
