"""Reports from partials equal those from all searches, behind batches in any order, corrections and compaction."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stallgrid.operators import analytics as A
from stallgrid.operators import partials as PA

SCHEMA = "search_id bigint, shop_id string, ts timestamp, term string, results_count int, clicked boolean, converted boolean, purchased boolean, revenue double, product_id string, bucket string"
AS_OF = "2024-02-01 00:00:00"


def searches(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        clicked = rng.random() < 0.4
        bought = clicked and rng.random() < 0.5
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(31 * 1440 - 1))
        out.append((i, rng.choice("aab"), ts, rng.choice(["x", "y", "z", " ", "rare " + str(i % 50)]), rng.choice([0, 1, 7, None]), clicked, bought, bought, 2.5 if bought else None, rng.choice(["p1", "p2", None]) if clicked else None, rng.choice(["a", "b", None])))
    return out


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def reports(spark, folder):
    r = PA.Reports(spark, folder, AS_OF)
    products = spark.createDataFrame([("a", "p1", "One")], "shop_id string, product_id string, title string")
    return {
        "totals": r.funnel_totals(10), "delta": r.period_delta(10), "top": r.top_terms(20, 5), "zero": r.zero_terms(20, 5), "none": r.no_click_terms(31, 9, 2), "clicked": r.top_clicked(products, 20, 5),
        "arms": r.ab_arms(20, 5), "activity": r.activity(7, 4), "daily": r.daily_series(20),
    }


def from_all(spark, s):
    products = spark.createDataFrame([("a", "p1", "One")], "shop_id string, product_id string, title string")
    t = A.funnel_totals(s, AS_OF, 10)
    return {
        "totals": t, "delta": A.period_delta(t), "top": A.top_terms(s, AS_OF, 20, 5), "zero": A.zero_terms(s, AS_OF, 20, 5), "none": A.no_click_terms(s, AS_OF, 31, 9, 2), "clicked": A.top_clicked(s, products, AS_OF, 20, 5),
        "arms": A.ab_arms(s, AS_OF, 20, 5), "activity": A.activity(s, AS_OF, 7, 4), "daily": A.daily_series(s, AS_OF, 20).where(F.col("day") < "2024-02-01"),
    }


def test_partials_of_batches_equal_all_searches(spark, tmp_path):
    rows = searches()
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA)
    early = [(*r[:5], False, False, False, None, None, r[10]) for r in rows[:200]]
    folder = str(tmp_path / "partials")
    PA.write_partials(folder, 0, frame(early))
    PA.write_partials(folder, 1, frame(rows[200:300]))
    for _ in range(2):  # a repeated batch replaces itself
        PA.write_partials(folder, 2, frame(rows[:200] + rows[300:]), frame(early))
    want = {k: rows_of(v) for k, v in from_all(spark, frame(rows)).items()}
    assert {k: rows_of(v) for k, v in reports(spark, folder).items()} == want
    PA.compact_partials(spark, folder, 3)
    assert {k: rows_of(v) for k, v in reports(spark, folder).items()} == want
    shops = spark.createDataFrame([("a", "growth", None), ("b", "none", None)], "shop_id string, plan_name string, plan_override string")
    got = {r.shop_id: (r.days, r.searches) for r in PA.Reports(spark, folder, AS_OF).plan_window(A.clamp_days(shops, 365)).collect()}
    end = datetime.datetime(2024, 2, 1)
    assert got == {s: (d, sum(1 for r in rows if r[1] == s and r[2] >= end - datetime.timedelta(days=d))) for s, d in (("a", 30), ("b", 7))}


def test_partials_read_the_days_of_the_window(spark, tmp_path):
    folder = str(tmp_path / "partials")
    PA.write_partials(folder, 0, spark.createDataFrame(searches(), SCHEMA))
    plan = PA.Reports(spark, folder, AS_OF).top_terms(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    with pytest.raises(ValueError):
        PA.Reports(spark, folder, "2024-02-01 10:00:00")


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame(searches(60), SCHEMA).mapInPandas(counted, SCHEMA)
    PA.write_partials(str(tmp_path / "partials"), 0, rows)
    assert seen.value == 60
