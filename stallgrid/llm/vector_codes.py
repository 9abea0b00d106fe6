"""Vector code compression: integer product quantisation with exact nearest entries.

Components become integers floor(scale * x), vectors are cut into equal parts, and each part position has a codebook
of its own, refined by rounds of assign and average. All arithmetic is on integers, so that codes do not depend on
how the rows are dealt out. The nearest entry is argmin(|e|^2 - 2 x.e); the dot products go through float64 BLAS,
which is exact below 2^53 only, so integers are split into limbs (two's complement: the top limb has the sign)
so narrow that no product of a pair of limbs, summed over a part, can reach 2^53; the partial products are shifted
and added in int64. Where distances themselves could leave int64, rows are compared by Python integers instead.

Every round is one pass over the vectors: tasks add up the parts of each entry, Spark adds up the tasks, and the
driver gets parts x entries x positions sums, whatever the number of rows.

Odd rows. A vector that is null, or holds null, NaN or an infinity, is dropped, and so is one whose length is not the
most common one of the rest (of equally common ones the larger) or that cannot be cut into equal parts. Rows
without an id or with equal ids are coded like any other; a null id comes behind all others when entries start, and
equal ids come in the order of their components. Fewer rows than entries leave fewer entries. No rows: no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: Bits that a float64 holds exactly, and those of int64 that distances may use.
EXACT, WIDE = 53, 62
#: Rows that are compared with a codebook at once; bounds memory only.
BLOCK = 20_000


def limb_bits(length: int) -> int:
    """The widest limb for which ``length`` products of two limbs add up to less than 2^53."""
    return (EXACT - max(length - 1, 0).bit_length() - 1) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays y0, y1, ... with x = y0 + y1 2^bits + ...; all but the last are below 2^bits, the last has the sign."""
    out, rest = [], x
    while rest.size and (rest.min() < -(1 << bits) or rest.max() >= 1 << bits):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_dots(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """x @ y.T of int64 matrices, exact as long as the results fit int64."""
    bits = bits or limb_bits(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    others = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(others):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it) of each row; ties go to the lower index.

    Object arrays (Python integers) are compared as such; their distances are cut at the largest int64.
    """
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    top = max((abs(int(m)) for a in (x, entries) if a.size for m in (a.min(), a.max())), default=0)
    wide = x.dtype == object or 4 * top * top * max(x.shape[1], 1) >= 1 << WIDE
    if wide:
        x, entries = x.astype(object), entries.astype(object)
    norms = (entries * entries).sum(axis=1)
    for k in range(0, len(x), BLOCK):
        part = x[k : k + BLOCK]
        dots = part.dot(entries.T) if wide else exact_dots(part, entries)
        far = norms[None, :] - 2 * dots
        best = far.argmin(axis=1)
        code[k : k + BLOCK] = best
        least = far[np.arange(len(part)), best] + (part * part).sum(axis=1)
        error[k : k + BLOCK] = np.minimum(least, 2**63 - 1) if wide else least
    return code, error


def _kept(batch: pa.RecordBatch, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that are kept, their integer components, as Python integers where int64 is too narrow)."""
    column = batch.column("_vector")
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    rows = np.flatnonzero((lengths == size) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    good = np.isfinite(values).all(axis=1)
    rows, values = rows[good], np.floor(values[good] * float(scale))
    if values.size and np.abs(values).max() >= 2.0**62:
        return rows, np.array([[int(v) for v in row] for row in values], object).reshape(len(rows), size)
    return rows, values.astype(np.int64)


def _vectors(table: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    return table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("_vector"), F.col(label).alias("label"))


def vector_size(vectors: DataFrame, parts: int) -> int:
    """The most common length of the vectors that have no null or non-finite component and can be cut; 0 if there is none."""
    sound = ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = vectors.where("_vector IS NOT NULL").where(sound).groupBy(F.size("_vector").alias("size")).agg(F.count("*").alias("n"))
    best = sizes.where((F.col("size") > 0) & (F.col("size") % parts == 0)).agg(F.max(F.struct("n", "size")).alias("x")).collect()[0].x
    return best["size"] if best else 0


def first_entries(vectors: DataFrame, size: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The codebooks to start with: the parts of the vectors with the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _kept(batch, size, scale)
            ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            first = sorted((i is None, i or 0, x[n].tolist()) for n, i in enumerate(ids))[:entries]
            yield pa.RecordBatch.from_pylist([{"unknown": a, "vec_id": b, "x": [str(v) for v in c], "key": [float(v) for v in c]} for a, b, c in first], pa.schema([("unknown", pa.bool_()), ("vec_id", pa.int64()), ("x", pa.list_(pa.string())), ("key", pa.list_(pa.float64()))]))

    found = vectors.mapInArrow(run, "unknown boolean, vec_id bigint, x array<string>, key array<double>").orderBy("unknown", "vec_id", "key").limit(entries).collect()
    x = np.array([[int(v) for v in r.x] for r in found], object).reshape(len(found), size)
    return np.split(x, parts, axis=1)


def _as_integers(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if book.dtype == object and all(abs(int(v)) < 2**62 for v in book.flat) else book


def _part_sums(vectors: DataFrame, books: list[np.ndarray], size: int, scale: int) -> DataFrame:
    """part, entry, position, total, n: the componentwise sums of the parts that are nearest to each entry."""
    width = size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = _kept(batch, size, scale)
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                code, _ = nearest(own, book)
                for e in np.unique(code):
                    total[p][e] += own[code == e].astype(object).sum(axis=0) if own.dtype == object else own[code == e].sum(axis=0)
                n[p] += np.bincount(code, minlength=len(book))
        rows = [(p, e, i, str(total[p][e, i]), int(n[p][e])) for p in range(len(books)) for e in np.flatnonzero(n[p]).tolist() for i in range(width)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["part", "entry", "position", "total", "n"])

    sums = vectors.mapInArrow(run, "part int, entry int, position int, total string, n bigint")
    return sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def fit_codebooks(vectors: DataFrame, size: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """The codebooks behind ``rounds`` of assigning every part and averaging (floor); unused entries stay as they are."""
    books = [_as_integers(b) for b in first_entries(vectors, size, parts, entries, scale)]
    for _ in range(rounds):
        fresh = [b.astype(object) for b in books]
        for r in _part_sums(vectors, books, size, scale).collect():  # at most parts x entries x positions rows
            fresh[r.part][r.entry, r.position] = int(r.total) // r.n
        books = [_as_integers(b) for b in fresh]
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def assign_codes(vectors: DataFrame, books: list[np.ndarray], size: int, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every kept vector."""
    width = size // max(len(books), 1)
    kind = vectors.schema["label"].dataType
    hexed = np.array([f"{i:02x}" for i in range(max((len(b) for b in books), default=0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _kept(batch, size, scale)
            code, error = np.full(len(rows), "", object), np.zeros(len(rows), object)
            for p, book in enumerate(books):
                own, far = nearest(x[:, p * width : (p + 1) * width], book)
                code = code + hexed[own].astype(object)
                error = error + far.astype(object)
            at = pa.array(rows)
            error = pa.array([min(int(e), 2**63 - 1) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(code, pa.string()), error], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id bigint, label {kind.simpleString()}, code string, error bigint")


def with_label_errors(coded: DataFrame, share: int = 200) -> DataFrame:
    """``coded`` and label_error: the errors of all rows of a label together; rows without a label are one group.

    Labels that hold more than one in ``share`` of the rows are fewer than ``share``: these alone are broadcast. The
    rows of the others meet their sums by a shuffle on the label, in which no key is large.
    """
    total = coded.count()
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    sums = coded.groupBy("label").agg(whole.alias("label_error"), F.count("*").alias("_n"))
    hot = F.broadcast(sums.where(F.col("_n") * share > total).select(F.col("label").alias("_label"), F.col("label_error"), F.lit(True).alias("_hot")))
    rows = coded.join(hot, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rest = rows.where("_hot IS NULL").drop("label_error", "_hot")
    cold = sums.where(F.col("_n") * share <= total).select(F.col("label").alias("_label"), "label_error")
    rest = rest.join(cold, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return rows.where("_hot").drop("_hot").unionByName(rest)


def compress(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of every kept vector; the codebooks, one array of integers a part)."""
    vectors = _vectors(table, vector, vec_id, label)
    size = vector_size(vectors, parts)
    vectors = vectors.where(F.lit(size > 0))
    books = fit_codebooks(vectors, size, parts, entries, rounds, scale) if size else []
    return with_label_errors(checkpointed(assign_codes(vectors, books, size, scale))), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 parts, 16 entries, 6 rounds, components as multiples of 1/4096, over all embeddings."""
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(codebook_digest(books)))


def _rounds_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds as one CTE after another: b0 the first entries, a_r the assignment to b_r, b_(r+1) the averages."""
    floor = "(t - ((t % n) + n) % n) // n"
    ctes = [
        "good AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"x AS (SELECT vec_id, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM good))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM good QUALIFY row_number() OVER (ORDER BY vec_id) <= {entries})",
        "b0 AS (SELECT part, entry, pos, v FROM x JOIN s USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS dist FROM x JOIN b{r} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL)")
        ctes.append(f"a{r} AS (SELECT vec_id, part, entry, dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT x.part, a.entry, x.pos, CAST(sum(x.v) AS BIGINT) AS t, count(*) AS n FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL)")
            ctes.append(f"b{r + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.v ELSE {floor} END AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)")
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return "WITH " + ",\n".join(ctes) + f""",
c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN good ON good.vec_id = c.vec_id, h"""


OP11_SQL = _rounds_sql()
