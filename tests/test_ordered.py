"""Ordered scans and greedy suppression against plain loops, with one key far more common than the rest."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import greedy
from fleetlens.functions.greedy import greedy_accept
from fleetlens.functions.ordered import number_segment, ordered_scan
from fleetlens.functions.spread import spread_join
from fleetlens.operators.intake import suppress_within_ttl


def skewed_rows(seed, n=400, span=2_000):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.randrange(span), i, rng.choice([None, rng.randrange(50)]), rng.randrange(9))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 100), (3, 5_000)])
def test_ordered_scan(spark, seed, width):
    rows = skewed_rows(seed)
    df = spark.createDataFrame(rows, "key string, at long, id long, v long, w long").withColumn("segment", number_segment("at", width))
    got = ordered_scan(
        df, ["key"], ["at", "id"], "segment", lag={"lag_v": "v", "lag_id": "id"}, lead={"next_id": "id"}, running_sum={"sum_w": "w"},
        running_max_before={"max_w": "w"}, last_value={"last_v": "v"}, row_number="rn",
    )
    result = {r.id: (r.lag_v, r.lag_id, r.sum_w, r.max_w, r.last_v, r.rn, r.next_id) for r in got.collect()}
    for key in {r[0] for r in rows}:
        lag_v = lag_id = top = last = None
        total = 0
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, (_, _, i, v, w) in enumerate(mine, 1):
            following = mine[n][2] if n < len(mine) else None
            total, last = total + w, v if v is not None else last
            assert result[i] == (lag_v, lag_id, total, top, last, n, following)
            lag_v, lag_id, top = v, i, w if top is None else max(top, w)


@pytest.mark.parametrize("seed,width,fan,block", [(1, 10, 2, 60), (2, 35, 3, 200), (3, 500, 64, 90), (4, 20, 2, 1), (5, 15, 3, 6), (6, 10, 2, 5_000)])
def test_greedy_accept(spark, monkeypatch, seed, width, fan, block):
    monkeypatch.setattr(greedy, "FAN", fan)
    rng = random.Random(seed)
    rows = [(k, at, at + rng.randint(1, block if rng.random() < 0.9 else 20 * block), i) for k, at, i, _, _ in skewed_rows(seed)]
    df = spark.createDataFrame(rows, "key string, at long, until long, id long").withColumn("segment", number_segment("at", width))
    got = {r.id for r in greedy_accept(df, ["key"], "at", "until", "id", "segment").filter("accepted").collect()}
    want, blocked = set(), {}
    for k, at, until, i in sorted(rows, key=lambda r: (r[1], r[3])):
        if at >= blocked.get(k, -1):
            want.add(i)
            blocked[k] = until
    assert got == want


def test_spread_join(spark):
    rows = skewed_rows(5)
    many = spark.createDataFrame(rows, "key string, at long, id long, v long, w long")
    one = spark.createDataFrame([("hot", 1), ("a", 2)], "key string, x int")
    for how in ("inner", "left"):
        got = spread_join(many, one, ["key"], ["id"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, "key", how).collect()))


def test_null_is_a_key(spark):
    rows = [(k, t, t * 10 + i) for i, k in enumerate(["a", None, "b", ""]) for t in range(0, 200, 7)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumns({"j": F.when(F.col("t") % 2 == 0, F.lit(None).cast("int")).otherwise(1), "segment": number_segment("t", 20)})
    got = ordered_scan(df, ["k", "j"], ["t"], "segment", lag={"before": "v"}, running_sum={"total": "v"}, row_number="n")
    w = Window.partitionBy("k", "j").orderBy("t")
    want = df.select(*df.columns, F.lag("v").over(w).alias("before"), F.sum("v").over(w).alias("total"), F.row_number().over(w).cast("long").alias("n"))
    assert sorted(map(str, got.withColumn("n", F.col("n").cast("long")).collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


def test_null_keys_are_suppressed(spark):
    hour = 3_600_000_000
    rows = [(k, i, i * hour // 2, i * hour // 2 + (2 * hour if i == 0 else 1_000_000), False) for k in ("r", None) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id string, attempt_id long, started_us long, finished_us long, handled boolean")
    got = suppress_within_ttl(df)
    assert got.columns == [*df.columns, "accepted"]
    accepted = {(r.run_id, r.attempt_id) for r in got.filter("accepted").collect()}
    assert {i for k, i in accepted if k is None} == {i for k, i in accepted if k == "r"} == {0, 4, 5, 6, 7}
