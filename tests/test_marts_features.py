"""Hand-computed fixtures for marts, window features and forecasts."""

from datetime import date

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import forecast as FC
from tessera.operators import marts as M
from tessera.operators import quality as Q


def _tx(spark):
    rows = [("t1", 1, 10, "9.99", date(2024, 1, 1)), ("t2", 1, 10, "10.00", date(2024, 1, 1)),
            ("t3", 1, 11, "0.01", date(2024, 1, 3)), ("t4", 2, 11, "5.00", date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id long, article_id long, p string, t_dat date")
    return df.withColumn("price", F.col("p").cast("decimal(18,2)")).drop("p")


def test_customer_mart_exact_cents(spark):
    tx = _tx(spark)
    rv = spark.createDataFrame([(1, 1, 4), (2, 1, 5)], "review_id long, customer_id long, rating int")
    got = {r["customer_id"]: r for r in M.customer_mart(tx, rv).collect()}
    c1 = got[1]
    assert (c1["order_count"], c1["total_spend"]) == (3, 20.0)
    assert c1["avg_order_value"] == 6.67                       # 20.00 / 3 = 6.666… → 6.67
    assert c1["avg_review_rating"] == 4.5 and got[2]["avg_review_rating"] is None
    assert c1["last_purchase_date"] == date(2024, 1, 3)


def test_demand_mart_and_dim(spark):
    arts = spark.createDataFrame([(10, "A"), (11, "B")], "article_id long, product_type string")
    got = {(r["article_id"], r["t_dat"]): r for r in M.demand_mart(_tx(spark), arts).collect()}
    r = got[(10, date(2024, 1, 1))]
    assert (r["daily_units_sold"], r["daily_revenue"], r["product_type"]) == (2, 19.99, "A")


def test_windows_and_densify(spark):
    s = spark.createDataFrame([("A", date(2024, 1, d), v) for d, v in [(1, 1), (2, 2), (4, 4), (5, 5)]],
                              "k string, d date, u long")
    rows = FE.trailing_sum(s, "k", "d", "u", 2, "s2").orderBy("d").collect()
    assert [r["s2"] for r in rows] == [1, 3, 6, 9]             # rows, not days (sparse series)
    dense = FE.densify_days(s, "k", "d", ["u"]).orderBy("d").collect()
    assert [r["u"] for r in dense] == [1, 2, 0, 4, 5]          # day 3 filled with 0
    lag = FE.lags(FE.densify_days(s, "k", "d", ["u"]), "k", "d", "u", (2,)).orderBy("d").collect()
    assert [r["lag_2_u"] for r in lag] == [None, None, 1, 2, 0]
    avg = FE.trailing_avg(s, "k", "d", "u", 3, "a3").orderBy("d").collect()
    assert [round(r["a3"], 6) for r in avg] == [1.0, 1.5, round(7 / 3, 6), round(11 / 3, 6)]
    cal = FE.calendar_cols(spark.createDataFrame([(date(2024, 1, 6),)], "d date"), "d").first()
    assert (cal["weekday"], cal["is_weekend"]) == (5, 1)      # Saturday, Monday = 0


def test_naive_forecast(spark):
    s = spark.createDataFrame([("A", date(2024, 1, 1 + i), float(i)) for i in range(14)]
                              + [("B", date(2024, 1, 1), 1.0)], "k string, d date, y double")
    got = FC.naive_forecast(s, "k", "d", "y", horizon=3).orderBy("step").collect()
    assert {r["k"] for r in got} == {"A"}                      # B has < 14 points
    assert [r["forecast"] for r in got] == [10.0] * 3          # mean of 7..13
    assert (got[0]["lower"], got[0]["upper"], str(got[0]["date"])) == (8.5, 11.5, "2024-01-15")


def test_trend_forecast_recovers_line(spark):
    s = spark.createDataFrame([("A", date(2024, 1, 1 + i), 2.0 + 3.0 * i) for i in range(28)],
                              "k string, d date, y double")
    f = FC.trend_forecast(s, "k", "d", "y", horizon=2).orderBy("step").collect()
    assert [round(r["forecast"], 6) for r in f] == [2.0 + 3.0 * 28, 2.0 + 3.0 * 29]
    assert FC.mape(s, "k", "d", "y").first()["mape_pct"] == 0.0


def test_dedup_and_quarantine(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "key string, v long, s string")
    got = {r["key"]: r["s"] for r in Q.dedup_latest(df, ["key"], ["v"]).collect()}
    assert got == {"k": "new", "j": "x"}
    raw = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    ok, bad = Q.cast_or_quarantine(raw, {"n": "int"})
    assert sorted((r.n for r in ok.collect()), key=str) == [1, None]
    assert [(r.n, r.failed_columns) for r in bad.collect()] == [("x", ["n"])]
