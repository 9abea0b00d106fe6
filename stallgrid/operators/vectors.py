"""Vector search as matrix products over blocks, and an index by random projections for the neighbours of all vectors.

``blocked_matches`` is exact: the vectors of a shop are packed into matrices of bounded size, so are the requests, and
every pair of matrices of a shop is one product, of which each request keeps its nearest rows. Matrices of a shop are
dealt to lanes, so that a large shop is not one key. It serves stated sets of requests.

``neighbours`` serves every vector at once. Each of several tables sorts the distinct vectors of a shop by the sides
on which they lie of random hyperplanes; vectors near each other share long prefixes of these bits, so the sorted rows
are compared block by block with their own block and the two beside it. Blocks have a fixed number of rows, however
many vectors look alike, and a shop of up to two blocks is compared whole. The nearest of each table are ranked again
by exact distances. Equal vectors are one row, with the first few products that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.operators.scratch import written
from stallgrid.operators.skew import first_rows, join_by_share

#: Rows of a packed matrix, and lanes that the matrices of a shop are dealt to.
PACKED, LANES = 1024, 16


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    x = np.asarray(x, np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _packed(rows: DataFrame, vector: str, kept: list[str]) -> DataFrame:
    """shop_id, size, matrix (unit rows), and an array of each kept column: up to PACKED vectors of one shop and length."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    arrays = ", ".join(f"{c} array<{kinds[c]}>" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size = t.column("_size")[0].as_py()
            matrix = _units(_matrix(t.column("_vector").chunk(0), size)).tobytes()
            cols = [pa.array([t.column("shop_id")[0].as_py()]), pa.array([size], pa.int32()), pa.array([matrix], pa.binary())]
            for c in kept:
                one = t.column(c).chunk(0)
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one))
            return pa.RecordBatch.from_arrays(cols, ["shop_id", "size", "matrix", *kept])

        for batch in batches:
            shops, sizes = batch.column("shop_id").to_pylist(), batch.column("_size").to_pylist()
            keys = list(zip(shops, sizes, strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b:
                    if held and (held[0].column("shop_id")[0].as_py(), held[0].column("_size")[0].as_py()) != keys[a]:
                        yield flush()
                    n = min(b - a, PACKED - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, n))
                    a += n
                    if sum(h.num_rows for h in held) == PACKED:
                        yield flush()
        if held:
            yield flush()

    sound = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = rows.where(F.col(vector).isNotNull()).where(sound).select("shop_id", F.size(vector).alias("_size"), F.col(vector).cast("array<double>").alias("_vector"), *kept)
    dealt = named.repartition("shop_id", F.pmod(F.xxhash64(kept[0]), F.lit(LANES))).sortWithinPartitions("shop_id", "_size")
    return dealt.mapInArrow(run, f"shop_id string, size int, matrix binary, {arrays}")


def blocked_matches(queries: DataFrame, vectors: DataFrame, within: float | None = None, k: int | None = None, skip_self: bool = False) -> DataFrame:
    """query_id, product_id, dist (six digits): the vectors of a request's shop by cosine distance.

    queries: query_id, shop_id, query_vec, and a collection if only its products may match. vectors: shop_id,
    product_id, embedding, and collections for that. Rows nearer than ``within``, of which a block of requests keeps the
    ``k`` nearest of each block of vectors, and the result the ``k`` nearest of these; both are optional. Vectors that
    are null, empty or not finite match nothing, nor do those of another length. ``skip_self`` leaves out the product
    that has the request's own id.
    """
    scoped = "collection" in queries.columns and "collections" in vectors.columns
    q = _packed(queries, "query_vec", ["query_id", *(["collection"] if scoped else [])])
    v = _packed(vectors, "embedding", ["product_id", *(["collections"] if scoped else [])])
    q = q.withColumnsRenamed({"matrix": "q_matrix"}).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    v = v.withColumn("lane", F.pmod(F.xxhash64(F.col("product_id")[0]), F.lit(LANES)).cast("int"))
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("query_id"), batch.column("product_id")
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                a = np.frombuffer(batch.column("q_matrix")[i].as_py()).reshape(-1, size)
                b = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(-1, size)
                far = 1 - a @ b.T
                if scoped:
                    own = batch.column("collections")[i].as_py()
                    wanted = batch.column("collection")[i].as_py()
                    inside = {c: np.array([c in (x or ()) for x in own]) for c in set(wanted) if c is not None}
                    for n, c in enumerate(wanted):
                        if c is not None:
                            far[n, ~inside[c]] = np.inf
                query_ids, product_ids = names[i].values, np.array(ids[i].as_py(), object)
                if skip_self:
                    far[np.array([str(x) for x in query_ids.to_pylist()], object)[:, None] == product_ids[None, :]] = np.inf
                good = far < (np.inf if within is None else within)
                shown = np.round(far, 6)
                if k is not None and k < far.shape[1]:
                    # Rows as near as the k-th nearest stay, so that the product's id decides between equal ones later.
                    edge = np.partition(np.where(good, shown, np.inf), k - 1, axis=1)[:, k - 1 : k]
                    good &= shown <= edge
                    if (good.sum(axis=1) > k).any():
                        order = np.lexsort((np.broadcast_to(product_ids.astype(str), far.shape), np.where(good, shown, np.inf)), axis=1)
                        first = np.zeros_like(good)
                        np.put_along_axis(first, order[:, :k], True, axis=1)
                        good &= first
                at, to = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(at)), pa.array(product_ids[to], pa.string()), pa.array(shown[at, to])], ["query_id", "product_id", "dist"])

    rows = q.join(v, ["shop_id", "size", "lane"]).mapInArrow(run, f"query_id {kind}, product_id string, dist double")
    if k is None:
        return rows
    n = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "product_id"))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def _centre(rows: DataFrame, size: int) -> np.ndarray:
    """The mean of the unit vectors; one row from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            total += _units(_matrix(batch.column("embedding"), size)).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64())], ["i", "x", "n"])

    sums = rows.select("embedding").mapInArrow(run, "i int, x double, n bigint").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # bounded: a row a component
    return np.array([r.x / max(r.n, 1) for r in sums])


def neighbours(vectors: DataFrame, k: int = 12, tables: int = 6, block: int = 2048, bits: int = 32, seed: int = 7) -> DataFrame:
    """shop_id, anchor_id, product_id, dist, rank: up to ``k`` nearest candidates of every vector, without itself.

    vectors: shop_id, product_id, embedding, and optionally candidate (false: an anchor only). Exact for shops of up to
    two blocks of distinct vectors; beyond that recall grows with ``tables`` and ``block`` (see the tests and README).
    Vectors that are null or not finite, or not of the most common length, have no neighbours and are none. Vectors,
    pairs of them and lists are written, since several branches read them.
    """
    v = vectors.withColumn("candidate", F.coalesce("candidate", F.lit(False)) if "candidate" in vectors.columns else F.lit(True))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(sound & (F.size("embedding") > 0)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    key = F.unhex(F.left(F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256), F.lit(32)))
    v = written(v.select("shop_id", "product_id", "candidate", "embedding", key.alias("vec")))
    best = v.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "size")).alias("x")).collect()[0].x  # bounded: one row
    size = best["size"] if best else 0
    v = v.where(F.size("embedding") == size)
    distinct = written(v.groupBy("shop_id", "vec").agg(F.first("embedding").alias("embedding"), F.max("candidate").alias("candidate")))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((size, tables * bits))
    centre = _centre(distinct, size) if size else np.zeros(0)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(_matrix(batch.column("embedding"), size))
            side = ((unit - centre) @ planes) > 0
            rows = [pa.array([u.tobytes() for u in unit], pa.binary())]
            for t in range(tables):
                place = side[:, t * bits : (t + 1) * bits] @ weights
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(place), batch.column("shop_id"), batch.column("vec"), batch.column("candidate"), *rows], ["t", "place", "shop_id", "vec", "candidate", "unit"])

    placed = distinct.mapInArrow(project, "t int, place bigint, shop_id string, vec binary, candidate boolean, unit binary")
    dealt = placed.repartitionByRange("shop_id", "t", "place", "vec").sortWithinPartitions("shop_id", "t", "place", "vec")
    most = k + 4  # some more than asked for, as products decide between vectors that are equally near

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches, block):
            yield from _compared(group, size, most)

    # Nine lists a table at most for each vector, of which the nearest go on; then each other vector once.
    found = dealt.mapInArrow(compare, "shop_id string, vec binary, near array<struct<dist:double,other:binary>>")
    nearest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, most + tables)
    near = found.groupBy("shop_id", "vec").agg(nearest.alias("near")).select("shop_id", "vec", F.explode("near").alias("x"))
    near = near.groupBy("shop_id", "vec", "x.other").agg(F.min("x.dist").alias("dist"))
    # Nearest of all are the other products of the vector itself.
    pairs = written(near.unionByName(distinct.where("candidate").select("shop_id", "vec", F.col("vec").alias("other"), F.lit(0.0).alias("dist"))))
    order = [F.col("dist").asc(), F.col("product_id").asc()]
    few = first_rows(v.where("candidate").select("shop_id", F.col("vec").alias("other"), "product_id"), k + 1, ["shop_id", "other"], F.col("product_id").asc(), spread="product_id")
    lists = first_rows(join_by_share(pairs, few.groupBy("shop_id", "other").agg(F.sort_array(F.collect_list("product_id")).alias("ids")), ["shop_id", "other"]).select("shop_id", "vec", "dist", F.explode("ids").alias("product_id")), k + 1, ["shop_id", "vec"], *order, spread="product_id")
    lists = written(lists.groupBy("shop_id", "vec").agg(F.sort_array(F.collect_list(F.struct("dist", "product_id"))).alias("near")))
    rows = join_by_share(v.select("shop_id", "vec", F.col("product_id").alias("anchor_id")), lists, ["shop_id", "vec"])
    own = F.slice(F.filter("near", lambda x: x["product_id"] != F.col("anchor_id")), 1, k)
    return rows.select("shop_id", "anchor_id", F.posexplode(own).alias("_at", "x")).select("shop_id", "anchor_id", "x.product_id", "x.dist", (F.col("_at") + 1).alias("rank"))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[list[pa.Table]]:
    """Neighbouring blocks of one (shop, table): [block], or [block, the one behind it], each block once in front."""
    held: list[pa.RecordBatch] = []
    before: pa.Table | None = None
    key = None

    def cut() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return t

    for batch in batches:
        keys = list(zip(batch.column("shop_id").to_pylist(), batch.column("t").to_pylist(), strict=True))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if keys[a] != key:
                last = cut() if held else None
                if before is not None:
                    yield [before, last] if last is not None else [before]
                if last is not None:
                    yield [last]
                before, key = None, keys[a]
            while a < b:
                n = min(b - a, block - sum(h.num_rows for h in held))
                held.append(batch.slice(a, n))
                a += n
                if sum(h.num_rows for h in held) == block:
                    full = cut()
                    if before is not None:
                        yield [before, full]
                    before = full
    last = cut() if held else None
    if before is not None:
        yield [before, last] if last is not None else [before]
    if last is not None:
        yield [last]


def _compared(group: list[pa.Table], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """vec and its ``most`` nearest candidates: of the first block's rows in both blocks, of the second block's in the first."""
    names = [t.column("vec").to_pylist() for t in group]
    units = [np.frombuffer(b"".join(t.column("unit").to_pylist())).reshape(-1, size) for t in group]
    fit = [np.array(t.column("candidate").to_pylist(), bool) for t in group]
    shop = group[0].column("shop_id")[0].as_py()
    for a, b in [(0, 0), *([(0, 1), (1, 0)] if len(group) > 1 else [])]:
        to = np.flatnonzero(fit[b])
        if not len(to):
            continue
        like = units[a] @ units[b][to].T
        if a == b:
            like[to, np.arange(len(to))] = -np.inf
        n = min(most, len(to))
        best = np.argpartition(-like, n - 1, axis=1)[:, :n]
        dist = np.round(1 - np.take_along_axis(like, best, 1), 6)
        good = np.isfinite(dist)  # a row is not its own neighbour
        ends = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(dist[good]), pa.array(np.array(names[b], object)[to[best[good]]], pa.binary())], ["dist", "other"])
        yield pa.RecordBatch.from_arrays([pa.array([shop] * len(like), pa.string()), pa.array(names[a], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["shop_id", "vec", "near"])
