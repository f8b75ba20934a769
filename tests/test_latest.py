"""Counts by latest level on a stream against a batch computation."""

import random
from collections import Counter

from pyspark.sql import functions as F

from riskmart.session import scratch_path
from riskmart.sources.readers import stream_source
from riskmart.streaming import latest as L

SCHEMA = "k string, level string, ts timestamp, n long, extra string"


def land(spark, root, rows):
    df = spark.createDataFrame([(k, lv, t, n, "x") for k, lv, t, n in rows], SCHEMA.replace("ts timestamp", "ts long"))
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run(spark, root, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    s = stream_source(spark, f"{root}/in", schema, "parquet", 1)
    q = L.run_latest(L.changes(s, "k", "level", "ts", "n", **options), root, f"{root}/ckpt")
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return {r["level"]: r["n"] for r in L.counts(spark, root).collect()}, state


def wanted(rows):
    last = {}
    for k, lv, t, n in rows:
        if None not in (k, lv, t) and (k not in last or (t, n or 0) > last[k][0]):
            last[k] = ((t, n or 0), lv)
    return dict(Counter(lv for _, lv in last.values()))


def test_moves_late_rows_ties_hot_key_and_restart(spark):
    rnd = random.Random(3)
    root = scratch_path(spark, "t-latest")
    rows = []
    for part in range(3):
        new = []
        for i in range(120):
            k = "hot" if i % 3 == 0 else f"p{rnd.randrange(15)}"
            # times go back between parts, some are equal, some values are missing
            new.append((k if rnd.random() > .03 else None, rnd.choice(["Low", "Medium", "High", None]),
                        rnd.choice([None, 5, 5, rnd.randrange(100)]), part * 1000 + i))
        rows += new + new[:10]                  # repeated rows
        land(spark, root, new + new[:10])
        got, _ = run(spark, root)               # the stream stops and starts again on its checkpoint
        assert got == wanted(rows)
    before = spark.read.parquet(f"{root}/changes").count()
    assert run(spark, root)[0] == wanted(rows)  # nothing new, nothing counted twice
    assert spark.read.parquet(f"{root}/changes").count() == before
    assert spark.conf.get(L.PROVIDER) != L.ROCKSDB


def test_unseen_keys_expire_and_state_stays_small(spark):
    root = scratch_path(spark, "t-expire")
    day = 86400
    for d in range(8):                           # every day ten new keys, seen that day only, and one that stays
        land(spark, root, [(f"d{d}-{i}", "High" if i % 2 else "Low", d * day + i, i) for i in range(10)]
             + [("stays", "Medium", d * day + 50, 99)])
        got, state = run(spark, root, keep_ms=2 * day * 1000)
    # the watermark stands at the last day: keys of the last two days and the one that stays
    assert got["Medium"] == 1
    assert 20 <= got["Low"] + got["High"] <= 30
    assert state[-1] <= 2 * 31 + 31              # value, timer and timer index of at most three days' keys
