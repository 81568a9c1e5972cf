import bisect
import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from docloom.operators import classify, ocr, scan
from docloom.streaming import links, throttle

DAY = dt.datetime(2024, 1, 1)


def events(spark, seed=3, n=600, hot=0.9):
    rng = random.Random(seed)
    rows = [(rng.choice([1, None, 2, 3]) if rng.random() > hot else 7, i, DAY + dt.timedelta(seconds=rng.randrange(n)), rng.choice([None, None, i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, id long, ts timestamp, v long").repartition(5)


def test_running_values_equal_windows_whatever_the_parts(spark):
    rows, df = events(spark)
    con = duckdb.connect()
    con.sql("create table e (k bigint, id bigint, ts timestamp, v bigint)")
    con.executemany("insert into e values (?, ?, ?, ?)", rows)
    w = "over (partition by k order by ts, id rows between unbounded preceding and current row)"
    want = sorted(con.sql(f"select id, sum(v) {w}, last_value(v ignore nulls) {w}, count(*) {w} from e").fetchall())
    for parts in (1, 4, 23):
        a = {r.id: r.s for r in scan.running_sum(df, ["k"], ["ts", "id"], F.col("v"), "s", parts).collect()}
        b = {r.id: r.h for r in scan.running_last(df, ["k"], ["ts", "id"], F.col("v"), "h", parts).collect()}
        c = {r.id: r.n for r in scan.running_sum(df, ["k"], ["ts", "id"], F.lit(1), "n", parts).collect()}
        assert [(i, a[i], b[i], c[i]) for i in sorted(a)] == want, parts
    assert classify.running_count(df.limit(0), "k", "id").count() == 0 and throttle.last_value(df.limit(0), "k", "v", ["ts"]).count() == 0
    # a key with nine tenths of the rows lies in most parts, and no part has much more than its share
    sizes = [r[1] for r in scan.dealt(df.where("k = 7"), ["k"], ["ts", "id"], 8).groupBy(scan.PART).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)


def test_blocks_do_not_depend_on_the_chunk(spark):
    rng = random.Random(4)
    rows = [(d, 3, p, rng.choice(["a", "b", " "]), rng.choice([-1.0, 50.0]), rng.choice([None, 0, 3, 9, 30])) for d in range(4) for p in range(60 * (d + 1))]
    words = spark.createDataFrame(rows, "doc_id long, psm int, pos int, text string, conf double, top int")
    whole = sorted(map(tuple, ocr.blocks(words).collect()))
    assert len(whole) > 60
    for chunk in (1, 7, 64):
        assert sorted(map(tuple, ocr.blocks(words, chunk).collect())) == whole
    assert ocr.blocks(words.limit(0)).count() == 0


def walk(rows, gap, inclusive):
    last, out = {}, []
    for k, i, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        wait = (t - last[k]).total_seconds() if k in last else None
        if wait is None or wait > gap or inclusive and wait == gap:
            last[k] = t
            out.append(i)
    return sorted(out)


def test_links_pass_what_a_walk_passes(spark):
    rows, df = events(spark)
    for gap, inclusive in ((2.0, False), (2.0, True), (0.0, False), (0.0, True), (37.0, True), (10_000.0, False)):
        assert sorted(r.id for r in links.spaced(df, "k", gap, inclusive, "ts", ["id"]).collect()) == walk(rows, gap, inclusive), (gap, inclusive)
    odd = df.withColumn("ts", F.when(F.col("id") % 7 > 0, F.col("ts"))).withColumn("__i", F.lit("mine"))
    kept = throttle.throttled(odd, "k", 3.0, order="id")
    assert kept.columns == odd.columns and sorted(r.id for r in kept.collect()) == walk([r for r in rows if r[1] % 7], 3.0, False)
    assert throttle.debounced(df.limit(0), "k").count() == 0


def test_one_key_of_many_rows_is_split(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.col("id") / 10).alias("ts"))
    assert links.spaced(df, "k", 1.0, True, "ts", ["id"]).agg(F.count("*"), F.sum("id")).first()[:] == (20_000, sum(range(0, 200_000, 10)))


def test_asof_at_equal_late_and_missing_times(spark):
    rng = random.Random(6)
    at = lambda s: DAY + dt.timedelta(seconds=s)
    left = [(rng.choice([1, 2, None]), i, None if i % 41 == 0 else at(rng.randrange(300))) for i in range(400)]
    right = [(rng.choice([1, 1, 3, None]), i, at(rng.randrange(300)), None if i % 5 == 0 else f"d{i}") for i in range(90)] + [(1, 500, None, "no time")]
    lf, rt = spark.createDataFrame(left, "k long, id long, ts timestamp"), spark.createDataFrame(right, "k long, id int, ts timestamp, said string")
    seen = {}
    for k, i, t, said in sorted((r for r in right if r[2] is not None), key=lambda r: (r[2], r[1])):
        seen.setdefault(k, []).append((t, said))
    for within in (None, 20.0):
        want = []
        for k, i, t in left:
            n = bisect.bisect_right([x for x, _ in seen.get(k, [])], t) if t is not None else 0
            hit = seen[k][n - 1] if n else (None, None)
            if within is not None and hit[0] is not None and (t - hit[0]).total_seconds() > within:
                hit = (None, None)
            want.append((i, *hit))
        for parts in (1, 9):
            got = scan.asof(lf, rt, "k", "ts", ["said"], "id", "id", within, parts)
            assert got.columns == ["k", "id", "ts", "found_ts", "said"]
            assert sorted(((r.id, r.found_ts, r.said) for r in got.collect()), key=lambda r: r[0]) == want
