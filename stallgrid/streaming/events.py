"""The event jobs over streams: event time, watermarks, keyed state. The batch forms are in operators.events.

State is kept per (shop, term), or for many (shop, session) and (shop, session, term) together: these are dealt to a
fixed number of buckets by hash, as most keys have few events and a call for each would cost more than they do. Events come in any order within the
watermark's delay: each waits until the watermark has passed it, and is then taken in the order of time. State is
bounded by that delay and the window it serves, and is dropped by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTION = "event_id bigint, shop_id string, session_token string, ts timestamp, kind string, results_count int, term string, product_id string, order_id string, revenue double"


def _micros(frame: pd.DataFrame) -> pd.Series:
    return frame["ts"].astype("datetime64[us]").astype("int64")


#: Buckets that sessions are dealt to; each has one state.
SESSION_BUCKETS = 1024


def _dealt(rows: DataFrame, keys: list[str]) -> GroupedData:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(SESSION_BUCKETS)).cast("int")).groupBy("_bucket")


def _stored(frame: pd.DataFrame) -> bytes:
    """A table as it is kept in a state."""
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _loaded(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def _known(column: pd.Series) -> list:
    """The values of a text column, a missing one as None."""
    return [x if isinstance(x, str) else None for x in column]


_EVENT = "array<struct<at:bigint,event:bigint,token:string>>"


def _waiting(state: GroupState, held: list, frames: Iterator[pd.DataFrame]) -> tuple[list, list]:
    """(events that the watermark has passed, in the order of time and id; those that still wait).

    An event before the watermark can have no unknown predecessor any more.
    """
    rows = [(x[0], x[1], x[2]) for x in held]
    if not state.hasTimedOut:
        f = pd.concat(list(frames), ignore_index=True)
        tokens = [None if t is None or t != t else t for t in f["session_token"]]
        rows += zip(_micros(f).tolist(), f["event_id"].tolist(), tokens, strict=True)
    rows.sort(key=lambda x: x[:2])
    passed = state.getCurrentWatermarkMs() * 1000
    n = sum(1 for x in rows if x[0] < passed)
    return rows[:n], rows[n:]


def _kept(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"event_id": pd.array([e for e, _ in rows], "int64"), "ts": pd.to_datetime([at for _, at in rows], unit="us")})


def _wake(state: GroupState, waiting: list, idle_until: int) -> None:
    """The next time that a key has something to do: its first waiting event is passed, or its memory is of no use any more."""
    at = waiting[0][0] if waiting else idle_until
    state.setTimeoutTimestamp(max(at // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def collapse_repeats_stream(searches: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """event_id, ts of searches that do not repeat a kept one of their shop, term and token within ``seconds``.

    A search without a token repeats any kept one of its shop and term. Searches come in any order; each waits until
    the watermark has passed it. A (shop, term) keeps what waits, and the last kept search of each token of the window.
    """
    least = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ([], [])
        due, waiting = _waiting(state, held, frames)
        known = {x[2]: x[0] for x in last}
        newest = max(known.values(), default=None)
        kept = []
        for at, event, token in due:
            before = newest if token is None else known.get(token)
            if before is None or at - before > least:
                kept.append((event, at))
                known[token] = newest = at
        first = min(waiting[0][0] if waiting else state.getCurrentWatermarkMs() * 1000, state.getCurrentWatermarkMs() * 1000)
        known = {t: at for t, at in known.items() if at >= first - least}
        if waiting or known:
            state.update((waiting, [(at, 0, t) for t, at in known.items()]))
            _wake(state, waiting, max(known.values(), default=0) + least)
        elif state.exists:
            state.remove()
        yield _kept(kept)

    keyed = searches.withWatermark("ts", late).groupBy("shop_id", "term")
    return keyed.applyInPandasWithState(step, "event_id bigint, ts timestamp", f"waiting {_EVENT}, last {_EVENT}", "append", GroupStateTimeout.EventTimeTimeout)


def cap_events_stream(events: DataFrame, limit: int = 60, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """At most ``limit`` events of a session per fixed window that starts at its first event, whatever order they come in."""
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        begun: dict[tuple, tuple[int, int]] = {}
        if state.exists:
            held, known = map(_loaded, state.get)
            rows = list(zip(_known(held["shop"]), _known(held["session"]), held["at"].tolist(), held["event"].tolist(), strict=True))
            begun = {(a, b): (at, n) for a, b, at, n in zip(_known(known["shop"]), _known(known["session"]), known["start"].tolist(), known["n"].tolist(), strict=True)}
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(_known(f["shop_id"]), _known(f["session_token"]), _micros(f).tolist(), f["event_id"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = [x for x in rows if x[2] >= passed]
        kept = []
        for shop, session, at, event in sorted((x for x in rows if x[2] < passed), key=lambda x: x[2:]):
            start, n = begun.get((shop, session), (None, 0))
            if start is None or at - start >= span:
                start, n = at, 0
            begun[shop, session] = (start, n + 1)
            if n < limit:
                kept.append((event, at))
        # A window that is over for all that may still come is forgotten.
        begun = {k: v for k, v in begun.items() if v[0] + span > passed}
        if waiting or begun:
            held = pd.DataFrame(waiting, columns=["shop", "session", "at", "event"])
            known = pd.DataFrame([(*k, *v) for k, v in begun.items()], columns=["shop", "session", "start", "n"])
            state.update((_stored(held), _stored(known)))
            at = min(x[2] for x in waiting) if waiting else max(v[0] for v in begun.values()) + span
            state.setTimeoutTimestamp(max(at // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield _kept(kept)

    keyed = _dealt(events.withWatermark("ts", late), ["shop_id", "session_token"])
    return keyed.applyInPandasWithState(step, "event_id bigint, ts timestamp", "waiting binary, begun binary", "append", GroupStateTimeout.EventTimeTimeout)


def attribute_stream(actions: DataFrame, kind: str, hours: int, same_term: bool = False, late: str = "10 minutes") -> DataFrame:
    """event_id, shop_id, ts, product_id, order_id, search_id of each action of ``kind``; search_id is null where no search is near enough.

    A null search_id of a click is what a synthetic search is made from. An action waits until the watermark has
    passed it, and is then given to the latest search at or before it, in whatever order the two came in. A bucket
    of keys keeps their waiting actions and the searches of their window.
    """
    keys = ["shop_id", "session_token"] + (["term"] if same_term else [])
    window = hours * 3_600_000_000
    columns = [*keys, "event_id", "product_id", "order_id", "at", "search"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [_loaded(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [f.assign(at=_micros(f), search=f["kind"] == "search")[columns] for f in frames]
        rows = pd.concat(parts, ignore_index=True)
        passed = state.getCurrentWatermarkMs() * 1000
        # In the order of key, time, searches first, id, the last search in front of an action is the one it is given to.
        group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        at, search, event = rows["at"].to_numpy(np.int64), rows["search"].to_numpy(bool), rows["event_id"].to_numpy(np.int64)
        order = np.lexsort((event, ~search, at, group))
        rows, group, at, search, event = rows.iloc[order], group[order], at[order], search[order], event[order]
        last = np.maximum.accumulate(np.where(search, np.arange(len(rows)), -1))
        good = (last >= 0) & (group[last] == group) & (at - at[last] <= window)
        due = ~search & (at < passed)
        found = pd.DataFrame({
            "event_id": event[due], "shop_id": _known(rows["shop_id"][due]), "ts": pd.to_datetime(at[due], unit="us"), "product_id": _known(rows["product_id"][due]), "order_id": _known(rows["order_id"][due]),
            "search_id": pd.array(event[last[due]], "Int64"),
        })
        found.loc[~good[due], "search_id"] = pd.NA
        # A search serves actions that wait or may still come: none of them is before the watermark.
        keep = np.where(search, at >= passed - window, at >= passed)
        if keep.any():
            state.update((_stored(rows[keep]),))
            waits = at[keep & ~search]
            state.setTimeoutTimestamp(max((int(waits.min()) if len(waits) else int(at[keep].max()) + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield found.astype({"event_id": "int64", "ts": "datetime64[us]"})

    rows = actions.where(F.col("kind").isin("search", kind) & F.col("session_token").isNotNull()).withWatermark("ts", late)
    return _dealt(rows, keys).applyInPandasWithState(step, "event_id bigint, shop_id string, ts timestamp, product_id string, order_id string, search_id bigint", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def unique_orders_stream(purchases: DataFrame, late: str = "1 day") -> DataFrame:
    """Purchases without repeats of their (shop, order) within the watermark."""
    return purchases.withWatermark("ts", late).dropDuplicatesWithinWatermark(["shop_id", "order_id"])


def daily_activity_stream(searches: DataFrame, late: str = "1 day") -> DataFrame:
    """shop_id, day, searches over tumbling days."""
    g = searches.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "shop_id").agg(F.count("*").alias("searches"))
    return g.select("shop_id", F.to_date("window.start").alias("day"), "searches")


def popularity_stream(actions: DataFrame, folder: str, weights: dict[str, float], hours: int = 24, late: str = "1 day") -> None:
    """Increments of popularity, run over what is there now; ``popularity_totals`` reads them.

    Clicks and carts count as they come. Purchases wait for their search (``attribute_stream``); of those that have
    one, the first of each order counts, once. A batch writes under its number what it adds, so a repeated batch
    replaces itself; orders that earlier batches wrote are left out. As purchases are let go in the order of time, the
    first that is written is the first of the order.
    """
    spark = actions.sparkSession
    light = {k: v for k, v in weights.items() if k != "purchase"}
    w = F.element_at(F.create_map(*[x for k, v in light.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))

    def count(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("kind").isin(*light) & F.col("product_id").isNotNull()).groupBy("shop_id", "product_id").agg(F.sum(w).alias("increment"))
        rows.write.mode("overwrite").parquet(f"{folder}/actions/batch={number}")

    def order(batch: DataFrame, number: int) -> None:
        own = F.when(F.col("order_id").isNull(), F.col("event_id"))
        first = F.row_number().over(W.partitionBy("shop_id", "order_id", own).orderBy("ts", "event_id"))
        rows = batch.where("search_id IS NOT NULL").withColumn("_n", first).where("_n = 1").select("shop_id", "order_id", "product_id")
        if number > 0:
            seen = spark.read.schema(_ORDER).parquet(*[f"{folder}/orders/batch={n}" for n in range(number)]).select("shop_id", "order_id").where("order_id IS NOT NULL")
            rows = rows.join(seen, ["shop_id", "order_id"], "left_anti")
        rows.select("shop_id", "order_id", "product_id").write.mode("overwrite").parquet(f"{folder}/orders/batch={number}")

    bought = attribute_stream(actions, "purchase", hours, late=late)
    for name, stream, write in (("actions", actions, count), ("orders", bought, order)):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()


_ORDER = "shop_id string, order_id string, product_id string"


def popularity_totals(spark: SparkSession, folder: str, weights: dict[str, float]) -> DataFrame:
    """shop_id, product_id, increment of everything that ``popularity_stream`` has written."""
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    light = read("actions", "shop_id string, product_id string, increment double")
    heavy = read("orders", _ORDER).where("product_id IS NOT NULL").select("shop_id", "product_id", F.lit(weights["purchase"]).alias("increment"))
    return light.unionByName(heavy).groupBy("shop_id", "product_id").agg(F.sum("increment").alias("increment"))


#: Buckets of a shop's products in a stored catalog; a batch rewrites only those that it touches.
CATALOG_BUCKETS = 64


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64("shop_id", "product_id"), F.lit(CATALOG_BUCKETS)).cast("int"))


def catalog_stream(changes: DataFrame, start: DataFrame, folder: str, as_of: str) -> object:
    """A running query that applies product changes batch by batch to a catalog stored by bucket.

    A batch reads the buckets that its changes fall into, as the batches before it left them, and writes these
    under its own number; the others stay where they are. A repeated batch replaces what it wrote.
    """
    from stallgrid.operators.merge import apply_changes

    spark = changes.sparkSession
    _bucket(start).write.mode("ignore").partitionBy("_bucket").parquet(f"{folder}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        mine = _bucket(batch)
        touched = [r[0] for r in mine.select("_bucket").distinct().collect()]  # bounded: at most CATALOG_BUCKETS rows
        if touched:
            current = catalog_version(spark, folder, number - 1, touched)
            _bucket(apply_changes(current, mine.drop("_bucket"), as_of)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/batch={number}")
        spark.createDataFrame([(number, b) for b in touched], "batch int, bucket int").write.mode("overwrite").parquet(f"{folder}/log/number={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def catalog_version(spark: SparkSession, folder: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The catalog behind batch ``number`` (the last one, if it is not given): every bucket as its latest batch left it."""
    begun = spark.read.parquet(f"{folder}/batch=-1")
    latest = dict.fromkeys(range(CATALOG_BUCKETS) if buckets is None else buckets, -1)
    if number is None or number >= 0:
        log = spark.read.schema("batch int, bucket int").option("recursiveFileLookup", "true").parquet(f"{folder}/log").where("bucket IS NOT NULL")
        rows = (log if number is None else log.where(F.col("batch") <= number)).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # bounded: a row a bucket
        latest |= {r.bucket: r.batch for r in rows if r.bucket in latest}
    out = None
    for batch in sorted(set(latest.values())):
        own = [b for b, x in latest.items() if x == batch]
        part = begun if batch < 0 else spark.read.schema(begun.schema).parquet(f"{folder}/batch={batch}")
        part = part.where(F.col("_bucket").isin(own)).drop("_bucket")
        out = part if out is None else out.unionByName(part)
    return out


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote; complete results keep their last batch."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={max(last)}")
