"""Hand-written cases for the semantics that the queries' tables don't reach."""

import hashlib
import json
import os
import random
import subprocess
import sys
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyspark
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clickloom.__main__ import main
from clickloom.functions import json_field, random_prefix, ratio, remove_random_prefix
from clickloom.operators import ads, bloom, pages, products, sessions, skew
from clickloom.params import Params
from clickloom.plans import jobs
from clickloom.sources import database, layout, readers, views
from clickloom.sources.readers import read_jdbc
from clickloom.sources.sinks import ChangeLog, GrowingSet, KeyedTable
from clickloom.streaming import ads as stream
from clickloom.streaming import state
from clickloom.tasks import Task, TaskNotFound, TaskStore, run_task

VISIT = readers.USER_VISIT_ACTION + ", event_id long"


def visit(i, session="s", user=1, page=1, time="2024-01-01 00:00:00", keyword=None, category=None, order=None, pay=None):
    return ("2024-01-01", user, session, page, time, keyword, category, None if category is None else 1, order, None, pay, None, 1, i)


def test_tokens_are_distinct_whole(spark):
    rows = [visit(1, category=10), visit(2, category=1), visit(3, category=11), visit(4, category=1), visit(5)]
    s = sessions.summarise(spark.createDataFrame(rows, VISIT)).first()
    assert (s.click_category_ids, s.search_keywords, s.step_length) == ("1,10,11", "", 5)
    clicks = spark.createDataFrame([(1, "X", "A", 7), (11, "X", "A", 7), (1, "X", "A", 7)], "city_id long, city_name string, area string, product_id long")
    r = products.area_counts(clicks).first()
    assert (r.click_count, r.city_infos) == (3, "11:X,1:X")


def test_filters(spark):
    s = spark.createDataFrame([(20, "p", "c", "male", "a,b", ""), (None, None, None, None, "", "1")], "age int, professional string, city string, sex string, search_keywords string, click_category_ids string")
    count = lambda **p: sessions.keep_sessions(s, Params(**p)).count()
    assert count() == 2
    assert count(start_age=30) == 2  # one bound alone does not filter
    assert count(start_age=10, end_age=20) == 1
    assert count(keywords=("b",)) == 1 and count(category_ids=("1", "2")) == 1 and count(category_ids=("11",)) == 0
    assert count(sex="male", professionals=("p",), cities=("c",)) == 1


@pytest.mark.parametrize("seconds,bucket", [(0, None), (3, "1s_3s"), (4, "4s_6s"), (9, "7s_9s"), (10, "10s_30s"), (30, "10s_30s"), (31, "30s_60s"), (60, "30s_60s"), (61, "1m_3m"), (180, "1m_3m"), (181, "3m_10m"), (600, "3m_10m"), (601, "10m_30m"), (1800, "10m_30m"), (1801, "30m")])
def test_length_buckets(spark, seconds, bucket):
    row = sessions.bucket_counts(spark.createDataFrame([(seconds, 65)], "visit_length long, step_length long")).first()
    assert row.session_count == 1 and row["60"] == 1
    assert [n for n, _, _ in sessions.LENGTHS if row[n]] == ([bucket] if bucket else [])


def test_payments_count_their_own_column(spark):
    rows = [visit(1, pay="3,4"), visit(2, order="4")]
    got = {r.category_id: (r.click_count, r.order_count, r.pay_count) for r in sessions.category_counts(spark.createDataFrame(rows, VISIT)).collect()}
    assert got == {3: (0, 0, 1), 4: (0, 1, 1)}


def test_category_order_beyond_int(spark):
    rows = [(1, 5, 1, 1), (2, 5, 1, 2), (3, 5, 2, 0), (4, 2**33, 0, 0), (5, 5, 1, 2)]
    top = sessions.top_categories(spark.createDataFrame(rows, "category_id long, click_count long, order_count long, pay_count long"))
    assert [r.category_id for r in top.collect()] == [4, 3, 2, 5, 1]


def test_funnel(spark):
    rows = [visit(i, page=p, time=f"2024-01-01 0:00:0{i}") for i, p in enumerate((1, 2, 1, 2, 3))]
    df = spark.createDataFrame(rows, VISIT)
    rates = [(r.step, r.slice, r.pv, r.rate) for r in pages.convert_rates(df, (1, 2, 1, 2, 9, 4)).orderBy("step").collect()]
    assert rates == [(1, "1_2", 2, 1.0), (2, "2_1", 1, 0.5), (3, "1_2", 2, 2.0), (4, "2_9", 0, 0.0), (5, "9_4", 0, None)]
    assert pages.convert_rates(df, (8, 9)).first().rate is None
    assert pages.flow_text(pages.convert_rates(df, (1, 2, 3))).first().rate == "1_2=1.0|2_3=0.5"
    assert pages.convert_rates(df, (1,)).count() == 0


def test_functions(spark):
    df = spark.createDataFrame([('{"product_status": 0}', 29, 200, "3_a_b"), ("{bad", 1, 0, "1_")], "j string, a long, b long, p string")
    got = df.select(json_field(F.col("j"), "product_status"), ratio(F.col("a"), F.col("b")), remove_random_prefix(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("0", 0.15, "a_b"), (None, None, "")]
    levels = spark.createDataFrame([("China East",), ("West South",), ("x",), (None,)], "a string").select(products.area_level(F.col("a")))
    assert [r[0] for r in levels.collect()] == ["A Level", "C Level", "D Level", "D Level"]


def test_sample_within_quota(spark):
    rows = [(f"s{i}", f"2024-01-0{1 + i % 2} 0{i % 3}:00:00", "", "") for i in range(60)]
    s = spark.createDataFrame(rows, "session_id string, start_time string, search_keywords string, click_category_ids string")
    got = sessions.sample(s, 20)
    assert got.count() == 18 and got.exceptAll(s.select(*got.columns)).isEmpty()
    assert got.exceptAll(sessions.sample(s.repartition(7), 20)).isEmpty()


def test_days_rank_apart(spark):
    rows = [(d, "P", "C", a, 10 * a if d == "2024-01-01" else a) for d in ("2024-01-01", "2024-01-02") for a in range(5)]
    top = ads.province_top(spark.createDataFrame(rows, stream.STATS))
    assert {(r.date, r.ad_id) for r in top.collect()} == {(d, a) for d in ("2024-01-01", "2024-01-02") for a in (2, 3, 4)}


def test_bad_lines_are_dropped(spark):
    lines = spark.createDataFrame([("1704067200000 P C 1 2",), ("x P C 1 2",), ("1 P",), (None,), ("",)], "value string")
    assert [(r.date, r.user_id) for r in ads.parse(lines).collect()] == [("2024-01-01", 1)]


def test_blacklist_over_batches(spark, tmp_path):
    kept = stream.tables(spark, f"file://{tmp_path}/t")
    batch = lambda *users: ads.parse(spark.createDataFrame([(f"1704067200000 P C {u} 1",) for u in users], "value string"))
    stream.blacklist_step(batch(1, 1, 2), kept, 0, 3)
    assert kept["blacklist"].read().count() == 0
    for _ in range(2):  # a replayed batch changes nothing
        stream.blacklist_step(batch(1, 2), kept, 1, 3)
        assert [r.user_id for r in kept["blacklist"].read().collect()] == [1]
    stream.blacklist_step(batch(1, 1, 2), kept, 2, 3)
    assert {(r.user_id, r.click_count) for r in kept["user_counts"].read().collect()} == {(1, 3), (2, 3)}
    assert {r.user_id for r in kept["blacklist"].read().collect()} == {1, 2}


def test_hot_sessions_are_dealt_out(spark):
    """A session of many views, one of them null, ties in time, and views without a session."""
    rnd = random.Random(4)
    rows = [("hot", rnd.choice([None, *range(6)]), f"2024-01-01 00:{rnd.randrange(60):02d}:00", i) for i in range(20_000)]
    rows += [(None, rnd.randrange(6), "2024-01-01 00:00:00", i) for i in range(20_000, 21_500)]
    rows += [(f"s{rnd.randrange(50)}", rnd.randrange(6), f"2024-01-01 00:00:{rnd.randrange(60):02d}", i) for i in range(30_000, 31_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, page_id long, action_time string, event_id long").repartition(4)
    want, before = Counter(), {}
    for s, page, _, _ in sorted(rows, key=lambda r: r[2:]):
        want[s, before.get(s), page] += 1
        before[s] = page
    got = pages.consecutive(df, most=1000)
    assert Counter((r.session_id, r.from_page, r.to_page) for r in got.collect()) == want
    assert Counter((r.session_id, r.from_page, r.to_page) for r in pages.consecutive(df).collect()) == want
    flow = (1, 2, 3, 1)
    assert pages.convert_rates(df, flow, most=1000).collect() == pages.convert_rates(df, flow).collect()
    assert pages.consecutive(df.limit(0), most=1000).count() == 0


def test_visits_by_session_need_no_exchange(spark, tmp_path):
    """What goes by session runs on the stored buckets; another session can open them."""
    rows = [visit(i, session=f"s{i % 40}", user=i % 7, page=i % 5, time=f"2024-01-01 00:{i % 60:02d}:00", keyword="kw" if i % 3 else None, category=i % 4) for i in range(800)]
    plain = spark.createDataFrame(rows, VISIT).union(spark.createDataFrame([("2024-01-02", *visit(900 + i, session=f"s{i}")[1:]) for i in range(40)], VISIT))
    stored = layout.store_by_session(plain, "visits_by_session", f"file://{tmp_path}/v", 8)
    assert stored.columns == plain.columns and sorted(stored.collect(), key=repr) == sorted(plain.collect(), key=repr)
    spark.createDataFrame([(u, "n", "n", 20 + u, "p", "c", "male") for u in range(5)], readers.USER_INFO).write.parquet(f"{tmp_path}/users")
    users = spark.read.parquet(f"{tmp_path}/users")  # of a known small size: Spark broadcasts it

    def results(v):
        kept = sessions.keep_sessions(sessions.enrich(sessions.summarise(v), users), Params(start_age=1, end_age=22))
        return [sessions.summarise(v), pages.slices(v), sessions.detail(v, kept), sessions.summarise(v).join(v, "session_id").select("session_id", "event_id", "step_length")]

    for a, b in zip(results(stored), results(plain), strict=True):
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
        exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(session_id")
        assert exchanges(a) == 0 and exchanges(b) > 0
    assert layout.open_by_session(spark, "visits_again", f"file://{tmp_path}/v", VISIT, 8).count() == 840
    assert exchanges(sessions.summarise(spark.table("visits_again"))) == 0


def test_only_heavy_keys_are_salted(spark):
    """One city with 90 % of the clicks: spread over tasks, and the same rows as a plain join."""
    clicks = [(1 if i % 10 else 2 + i % 400, i % 7) for i in range(6000)] + [(None, 1)] * 50
    df = spark.createDataFrame(clicks, "city_id long, product_id long").repartition(3)
    cities = spark.createDataFrame([(i, f"c{i}", "China East") for i in range(1, 300)] + [(1, "again", "China South"), (None, "none", "x")], "city_id long, city_name string, area string")
    assert skew.heavy_keys(df, "city_id") == ["1"] and skew.heavy_keys(df.limit(0), "city_id") == []
    assert set(skew.heavy_keys(df.select((F.col("product_id") * 10).alias("k")), "k", 0.1)) == {str(10 * i) for i in range(7)}
    plain = sorted(products.with_cities(df, cities).collect())
    assert sorted(products.with_cities_salted(df, cities).collect()) == plain and len(plain) > 10_000
    assert sorted(products.with_cities_salted(df.where("city_id > 1"), cities, 0.9).collect()) == sorted(products.with_cities(df.where("city_id > 1"), cities).collect())
    salted = skew.salted_join(df, cities, "city_id", salts=8)
    assert salted.columns == ["city_id", "product_id", "city_name", "area"] and salted.where("city_id is null").count() == 0
    spread = df.where("city_id = 1").select(random_prefix(F.col("city_id").cast("string"), 8, 1).alias("k")).groupBy("k").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 5400 / 4


def test_results_in_a_database(spark):
    """A task that fails at any point and is repeated leaves one set of rows; others' rows stay."""
    url = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": "name VARCHAR(20)"}
    rows = lambda n, name: spark.range(n).select(F.col("id").alias("k"), F.lit(name).alias("name")).repartition(3)
    kept = lambda: sorted((r.task_id, r.k, r.name) for r in database.read_parts(spark, url, "result", "k", 3, driver=options["driver"]).collect())
    database.replace_rows(rows(4, "a"), url, "result", 1, **options)
    database.replace_rows(rows(2, "b"), url, "result", 2, **options)
    broken = rows(4, "c").withColumn("name", F.when(F.col("k") < 3, F.col("name")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception):  # noqa: B017  fails while it writes
        database.replace_rows(broken, url, "result", 1, **options)
    assert kept() == [(1, k, "a") for k in range(4)] + [(2, k, "b") for k in range(2)]
    with pytest.raises(Exception):  # noqa: B017  fails after it has deleted, before it inserts
        database.statements(spark, url, 'DELETE FROM result WHERE "task_id" = 1', "INSERT INTO missing SELECT * FROM result")
    assert len(kept()) == 6
    for _ in range(2):
        database.replace_rows(rows(3, "d"), url, "result", 1, **options)
    assert kept() == [(1, k, "d") for k in range(3)] + [(2, k, "b") for k in range(2)]
    parts = database.read_parts(spark, url, "result", "k", 3, driver=options["driver"])
    assert parts.rdd.getNumPartitions() == 3 and database.read_parts(spark, url, "result", "task_id", 1, driver=options["driver"]).count() == 5
    for batch in (0, 1, 1):  # a stream's changes, the last batch twice
        database.upsert_rows(spark.createDataFrame([(batch, "x"), (9, f"b{batch}")], "k long, name string"), url, "latest", ["k"], batch, **options)
    assert sorted(map(tuple, read_jdbc(spark, url, "latest", driver=options["driver"]).collect())) == [(0, "x"), (1, "x"), (9, "b1")]


def test_rows_come_and_go_in_files(spark, tmp_path):
    """Odd values survive the files that a database imports and exports; a repeated task leaves one set."""
    url, options = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    texts = [None, "", "a", " a ", 'q"q', '"', '""', "a,b", "a\nb", "a\rb", "a\r\nb", "a\\b", "ü漢", "null", "NULL", " ", "\t", "'", "\\N"]
    df = spark.createDataFrame([(i - 5 if i != 3 else None, t, i / 3 if i % 2 else None, i % 2 == 0) for i, t in enumerate(texts)], "k long, name string, x double, f boolean")
    df = df.withColumn("d", F.lit("2024-01-05").cast("date")).withColumn("t", F.lit("2024-01-05 01:02:03.456789").cast("timestamp")).repartition(3)
    made = {"createTableColumnTypes": "name VARCHAR(40)", **options}
    folder = lambda n: f"file://{tmp_path}/it's {n}"
    for n, rows in enumerate((df.limit(4), df, df.limit(0), df)):  # the last ones in place of the first
        database.replace_rows(rows, url, "odd", 7, folder(n), **made)
    database.replace_rows(df.limit(1), url, "odd", 8, folder("other"), **made)
    want = Counter((*r, 7) for r in df.collect())
    for parts in (1, 4, 50):
        got = database.read_parts(spark, url, "odd", "k", parts, folder(f"out{parts}"), **options)
        assert Counter(tuple(r) for r in got.where("task_id = 7").collect()) == want and got.count() == len(texts) + 1
    ends = sorted((tmp_path / "it's out4").glob("*.csv"))
    assert len(ends) == 4 and all(f.stat().st_size for f in ends)
    database.statements(spark, url, "DELETE FROM odd")
    assert database.read_parts(spark, url, "odd", "k", 3, folder("empty"), **options).count() == 0
    for batch in (0, 1, 1):
        database.upsert_rows(spark.createDataFrame([(batch, "x"), (9, f"b{batch}")], "k long, name string"), url, "latest", ["k"], batch, folder(f"up{batch}{random.random()}"), **made)
    assert sorted(map(tuple, read_jdbc(spark, url, "latest", **options).collect())) == [(0, "x"), (1, "x"), (9, "b1")]
    with pytest.raises(ValueError):
        database.load_rows(spark.range(1).select(F.array("id").alias("a")), url, "bad", folder("bad"), **options)


ON_EXECUTORS = """
import sys
from clickloom.plans.queries import QUERIES
from clickloom.session import get_session
spark = get_session("executors", "local-cluster[2,1,1024]", **{"spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1"})
for name in sys.argv[3:]:
    QUERIES[name](spark, sys.argv[2]).write.parquet("file://" + sys.argv[1] + "/" + name)
spark.stop()
"""


def test_database_in_the_driver(spark, tmp_path):
    """Executors of their own do not reach the driver's database."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors work there
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    names = ["jdbc_city_roundtrip", "jdbc_ad_stats"]
    subprocess.run([sys.executable, "-c", ON_EXECUTORS, str(tmp_path), DATA, *names], env=env, cwd=tmp_path, check=True, timeout=300, capture_output=True)
    for name, want in zip(names, (views.city_info(spark, DATA), ads.stats(ads.parse(views.ad_log(spark, DATA)))), strict=True):
        got = spark.read.parquet(f"file://{tmp_path}/{name}").select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) != Counter()


def test_counters_in_passing(spark, tmp_path):
    """Counted while sessions are written, also with a task that fails once; in one pass over the input."""
    rows = [(f"s{i}", i % 200, i % 70) for i in range(3000)]
    df = spark.createDataFrame(rows, "session_id string, visit_length long, step_length long").repartition(5)
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "string")
    got = sessions.write_counted(df.withColumn("session_id", count("session_id")), f"file://{tmp_path}/w")
    assert got.collect() == sessions.bucket_counts(df).collect() and seen.value == 3000
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 3000
    assert sessions.write_counted(df.limit(0), f"file://{tmp_path}/e").first().session_count == 0


def test_sample_of_a_hot_hour(spark):
    """The quota's lowest digests of every hour, with most sessions in one; only a slice is ranked."""
    rnd = random.Random(9)
    hours = ["2024-01-01 10"] * 4000 + ["2024-01-01 11"] * 30 + ["2024-01-02 00"] * 3 + ["2024-01-02 01"] * 2
    rows = [(f"s{rnd.randrange(10**9)}", f"{h}:00:00", "", "") for h in hours] + [("same", "2024-01-02 02:00:00", "", "")] * 3
    df = spark.createDataFrame(rows, "session_id string, start_time string, search_keywords string, click_category_ids string")
    quotas = {(r.date, r.hour): r.quota for r in sessions.hour_quotas(sessions.hour_counts(df), 60).collect()}
    want = []
    for (date, hour), n in quotas.items():
        order = sorted((r for r in rows if r[1].startswith(f"{date} {hour}")), key=lambda r: (hashlib.md5((r[0] + "42").encode()).hexdigest(), r[0]))
        want += order[:n]
    got = sessions.sample(df, 60)
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(quotas.values()) > 20
    assert sessions.sample(df.limit(0), 60).count() == 0
    # The hot hour's sessions are not sorted: what is ranked is bounded by digests first.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("_slice") and sessions.SLICE_DIGITS == 3


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_bloom_filters(spark, monkeypatch, bits):
    """No key that is in is ruled out; a full filter drops nobody who is not listed."""
    monkeypatch.setattr(bloom, "BITS", bits)
    listed, rows = spark.range(0, 60_000, 3).select(F.col("id").alias("user_id")), spark.range(60_000).select(F.col("id").alias("user_id"), F.lit(1).alias("bucket"))
    some = bloom.build(listed.where("user_id < 30000"))
    filtered = bloom.merge(some, bloom.build(listed.where("user_id >= 30000")))
    assert filtered.count() <= bits // bloom.ROW and filtered.agg(F.max(F.octet_length("bitmap"))).first()[0] == 4096
    maybe = {r.user_id for r in bloom.flag(rows, ["user_id"], filtered).where("_maybe").collect()}
    assert maybe >= set(range(0, 60_000, 3)) and (len(maybe) < 20_100 if bits > 1 << 20 else len(maybe) > 30_000)
    left = bloom.without(rows, listed, ["user_id"], filtered)
    assert left.columns == rows.columns and sorted(r.user_id for r in left.collect()) == [i for i in range(60_000) if i % 3]
    assert bloom.without(rows, listed.limit(0), ["user_id"], bloom.build(listed.limit(0))).count() == 60_000
    assert bloom.narrowed_join(rows, listed, ["user_id"]).count() == 20_000
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [user_id" not in plan


def test_trend_last_hour(spark):
    rows = [("2024-01-01", "10", "00", 1, 5), ("2024-01-01", "10", "01", 1, 5), ("2024-01-01", "11", "00", 1, 5)]
    assert stream.last_hour(spark.createDataFrame(rows, state.TREND)).count() == 2


def test_tasks(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/tasks")
    with pytest.raises(TaskNotFound):
        store.get(1)
    store.save(Task(1, "n", "count", json.dumps({"startAge": "3", "keywords": "a,b", "sex": " "}), {"k": "v"}))
    assert store.get(1).params == Params(start_age=3, keywords=("a", "b")) and Params.from_json(Params(page_flow=(1, 2)).to_json()).page_flow == (1, 2)
    done = run_task(store, {"count": lambda s, p: {"out": s.range(p.start_age)}}, 1, f"file://{tmp_path}/out")
    assert done.task_status == "finished" and store.get(1).finish_time and spark.read.parquet(f"{tmp_path}/out/out").count() == 3
    store.save(Task(2, "n", "none"))
    with pytest.raises(ValueError):
        run_task(store, {}, 2, f"file://{tmp_path}/out")
    assert store.get(2).task_status == "failed" and store.all().count() == 2


def log_lines(spark, folder, clicks):
    """One more file of log lines: (seconds after 2024-01-01, user, ad)."""
    spark.createDataFrame([(f"{1704067200000 + int(1000 * t)} P C {u} {a}",) for t, u, a in clicks], "value string").coalesce(1).write.mode("append").text(f"{folder}/lines")


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Totals by day and by user, after every restart; what a batch writes does not grow with the day."""
    folder = f"file://{tmp_path}/s"
    runs = [[(k % 1000, k % 400, k % 20) for k in range(4000)], [(5, 1, 1)], [(90_000, 1, 1), (6, 2, 1)], [(7, 2, 1)]]
    seen = []
    for clicks in runs:
        log_lines(spark, folder, clicks)
        seen += clicks
        for start, name, key in ((state.start_stats, "stats", lambda c: c[2]), (state.start_user_counts, "user_counts", lambda c: c[1:])):
            start(readers.file_lines(spark, f"{folder}/lines"), folder, late="2 days", every=None).awaitTermination()
            got = Counter()
            for r in state.tables(spark, folder)[name].read().collect():
                got[r.date, r.ad_id if name == "stats" else (r.user_id, r.ad_id)] += r.click_count
            assert got == Counter((f"2024-01-0{1 + t // 86_400}", key((t, u, a))) for t, u, a in seen)
    sizes = {v: written(tmp_path / f"s/user_counts/v={v}") for v in state.tables(spark, folder)["user_counts"].table.versions()}
    first, *rest = [n for _, n in sorted(sizes.items()) if n]
    assert len(rest) == 3 and all(n < first / 2 for n in rest)
    assert (tmp_path / "s/checkpoints/stats/state").exists() and list((tmp_path / "s/checkpoints/stats/state").rglob("*.changelog"))


def test_days_leave_the_state(spark, tmp_path):
    """A click for a day that the watermark has passed is dropped, and the total written before stays."""
    folder = f"file://{tmp_path}/d"
    for clicks in ([(0, 1, 1), (1, 1, 1)], [(3 * 86_400, 1, 1)], [(2, 1, 1), (3 * 86_400 + 1, 1, 1)]):
        log_lines(spark, folder, clicks)
        query = state.start_stats(readers.file_lines(spark, f"{folder}/lines"), folder, late="1 day", every=None)
        query.awaitTermination()
    assert {(r.date, r.click_count) for r in state.tables(spark, folder)["stats"].read().collect()} == {("2024-01-01", 2), ("2024-01-04", 2)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    log = state.tables(spark, folder)["stats"]
    log.drop("2024-01-04")
    assert [r.date for r in log.read().collect()] == ["2024-01-04"]


def test_change_log_takes_a_batch_again(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/c", "k string, n long", ["k"])
    frame = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert log.read().count() == 0
    log.write(frame(("a", 1), ("b", 1)), 0)
    for _ in range(2):
        log.write(frame(("a", 2), (None, 5)), 1)
    assert {(r.k, r.n) for r in log.read().collect()} == {("a", 2), ("b", 1), (None, 5)}
    assert {(r.k, r.n) for r in log.read(1).collect()} == {("a", 1), ("b", 1)} and {r.k for r in log.of(1).collect()} == {"a", None}
    assert {(r.k, r.n) for r in log.read(parts=["b"]).collect()} == {("b", 1)} and log.read(0).count() == 0


def brute_hours(clicks, newest):
    """(step end, minute, ad): clicks, and ads' totals, in the hour that ends with each step that has clicks."""
    steps = {int(t // 10) for t, _, _ in clicks if (t // 10 + 1) * 10 <= newest}
    minutes, totals = Counter(), Counter()
    for s in steps:
        for t, _, a in clicks:
            if s - 360 < t // 10 <= s:
                minutes[s * 10 + 10, int(t // 60), a] += 1
                totals[s * 10 + 10, a] += 1
    return {(e, m, a, n, totals[e, a]) for (e, m, a), n in minutes.items()}


def test_sliding_hours(spark, tmp_path):
    """Minutes within the hour at every step of 10 seconds; clicks of 61 minutes ago are out."""
    rnd = random.Random(5)
    clicks = [(0, 1, 1), (9.99, 1, 1), (10, 1, 2), (3599, 1, 1), (3600, 1, 1), (3609.9, 1, 2), (3610, 1, 1), (3660, 1, 2), (3670, 1, 1), (20_000, 1, 1)]
    clicks += [(rnd.randrange(4000, 12_000), 1, rnd.randrange(3)) for _ in range(300)]
    clicks.sort()
    newest, day = max(t for t, _, _ in clicks), 1704067200
    want = {(e + day, m, a, n, k) for e, m, a, n, k in brute_hours(clicks, newest)}
    minute = lambda r: (int(r.date[8:]) - 1) * 1440 + int(r.hour) * 60 + int(r.minute)
    rows = lambda df: {(r.step_end, minute(r), r.ad_id, r.click_count, r.ad_total) for r in df.collect()}
    lines = spark.createDataFrame([(f"{day * 1000 + int(1000 * t)} P C {u} {a}",) for t, u, a in clicks], "value string")
    panes = state.pane_counts(ads.parse(lines)).where((F.col("step") + 1) * 10 <= day + newest)
    assert rows(state.last_hours(panes)) == want and state.last_hours(panes.limit(0)).count() == 0
    at = {r[0] - day for r in want}
    assert 3670 in at and not any(e == 3670 and m == 0 for e, m, *_ in {(r[0] - day, *r[1:]) for r in want})
    folder = f"file://{tmp_path}/h"
    for part in (clicks[:5], clicks[5:100], clicks[100:]):  # restarted after each
        log_lines(spark, folder, part)
        state.start_last_hour(readers.file_lines(spark, f"{folder}/lines"), folder, late="0 seconds", every=None).awaitTermination()
    assert rows(state.tables(spark, folder)["last_hour"].read()) == want


def test_hours_of_a_long_batch(spark, tmp_path):
    """A batch of many hours writes a file of panes for each, and its windows are read without a shuffle."""
    rnd = random.Random(6)
    clicks = sorted((rnd.randrange(60 * 3600), 1, rnd.randrange(3)) for _ in range(900))
    folder = f"file://{tmp_path}/h"
    for part in (clicks[:450], clicks[450:]):
        log_lines(spark, folder, part)
        state.start_last_hour(readers.file_lines(spark, f"{folder}/lines"), folder, late="0 seconds", every=None).awaitTermination()
    kept = state.tables(spark, folder)
    for v in kept["panes"].table.versions():
        hours = [p for p in (tmp_path / f"h/panes/v={v}").iterdir() if p.name.startswith("_part=")]
        assert all(len(list(p.glob("*.parquet"))) == 1 for p in hours)
    rows = kept["last_hour"].read()
    assert "Exchange" not in rows._jdf.queryExecution().toString() and kept["last_hour"].read(0).count() == 0
    got = [(r.step_end - 1704067200, (int(r.date[8:]) - 1) * 1440 + int(r.hour) * 60 + int(r.minute), r.ad_id, r.click_count, r.ad_total) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hours(clicks, clicks[-1][0])


def test_keyed_table_rewrites_only_touched_parts(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/k", "date string, k string, n long", ["date", "k"], keep=3)
    frame = lambda *rows: spark.createDataFrame(rows, t.schema)
    t.add(frame(("d1", "a", 1), ("d2", "a", 1)), 0, "n")
    changed = t.add(frame(("d2", "a", 2), ("d3", "b", 5)), 1, "n")
    assert {(r.date, r.n) for r in changed.collect()} == {("d2", 3), ("d3", 5)}
    assert not (tmp_path / "k/v=1/_part=d1").exists()
    t.add(frame(("d2", "a", 2), ("d3", "b", 5)), 1, "n")  # replayed
    assert {(r.date, r.k, r.n) for r in t.read().collect()} == {("d1", "a", 1), ("d2", "a", 3), ("d3", "b", 5)}
    assert {(r.date, r.n) for r in t.read(1).collect()} == {("d1", 1), ("d2", 1)}
    for v in range(2, 5):
        t.add(frame(("d4", "a", 1)), v, "n")
    assert {r.date for r in t.read().collect()} == {"d2", "d3", "d4"} and not (tmp_path / "k/v=0/_part=d1").exists()
    assert not (tmp_path / "k/v=2/_part=d4").exists() and (tmp_path / "k/v=3/_part=d4").exists()
    assert t.versions() == [0, 1, 3, 4] and not (tmp_path / "k/v=2").exists()
    t.replace(frame((None, "x", 1)), 6)
    assert t.read().where("date is null").count() == 1


def test_growing_set(spark, tmp_path):
    s = GrowingSet(spark, f"file://{tmp_path}/g", "user_id long")
    for batch, users in ((0, (1, 2)), (1, (2, 3)), (1, (2, 3))):
        s.include(spark.createDataFrame([(u,) for u in users], "user_id long"), batch)
    assert sorted(r.user_id for r in s.read().collect()) == [1, 2, 3] and sorted(r.user_id for r in s.read(1).collect()) == [1, 2]


def test_filtered_totals_in_one_query(spark, tmp_path):
    """Clicks after a user's listing do not count; a restart goes on from what was kept."""
    folder = f"file://{tmp_path}/f"
    for users in ((1, 1, 1, 2), (1, 2), (1, 2)):
        spark.createDataFrame([(f"1704067200000 P C {u} 1",) for u in users], "value string").coalesce(1).write.mode("append").text(f"{folder}/lines")
        stream.start_filtered_stats(readers.file_lines(spark, f"{folder}/lines"), folder, threshold=3, every=None).awaitTermination()
    t = stream.tables(spark, folder)
    # User 1 is listed by the first batch, user 2 by the third.
    assert [r.click_count for r in t["stats"].read().collect()] == [6]
    assert {(r.user_id, r.click_count) for r in t["user_counts"].read().collect()} == {(1, 3), (2, 3)}
    assert {r.user_id for r in t["blacklist"].read().collect()} == {1, 2}


def test_failed_task_runs_again_without_duplicates(spark, tmp_path):
    store = TaskStore(spark, f"file://{tmp_path}/tasks")
    store.save(Task(1, "n", "two"))
    out = f"file://{tmp_path}/out"
    broken = {"two": lambda s, p: {"first": s.range(3), "second": s.range(1).select(F.raise_error(F.lit("no")).alias("x"))}}
    with pytest.raises(Exception):  # noqa: B017
        run_task(store, broken, 1, out)
    assert store.get(1).task_status == "failed"
    run_task(store, {"two": lambda s, p: {"first": s.range(3), "second": s.range(2)}}, 1, out)
    assert spark.read.parquet(f"{out}/first").count() == 3 and {r.task_id for r in spark.read.parquet(f"{out}/second").collect()} == {1}
    # Writers that begin at the same time get numbers of their own, and none loses a row.
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: TaskStore(spark, f"file://{tmp_path}/tasks").save(Task(k, "n", "two")), range(10, 16)))
        numbers = list(pool.map(lambda _: store.table.claim(), range(12)))
    assert {r.id for r in store.all().collect()} == {1, *range(10, 16)} and len(set(numbers)) == 12
    store.save(Task(10, "again", "two"))
    assert store.get(10).task_name == "again" and store.get(11).task_name == "n"


def test_jobs_by_command_line(spark, tmp_path, capsys):
    d = f"file://{tmp_path}"
    rows = [visit(i, session=f"s{i % 4}", user=i % 2, page=i % 5, time=f"2024-01-01 00:00:{i:02d}", category=i % 3 if i % 2 else None, keyword="kw", order="1,2" if i % 4 == 0 else None) for i in range(40)]
    inputs = {
        "user_visit_action": spark.createDataFrame(rows, VISIT),
        "user_info": spark.createDataFrame([(u, "n", "n", 20 + u, "p", "c", "male") for u in range(2)], readers.USER_INFO),
        "city_info": spark.createDataFrame([(1, "X", "China East")], readers.CITY_INFO),
        "product_info": spark.createDataFrame([(1, "p1", '{"product_status": 1}')], readers.PRODUCT_INFO),
    }
    for name, df in inputs.items():
        df.write.parquet(f"{d}/{name}")
    tables = [x for n in inputs for x in ("--table", f"{n}={d}/{n}")]
    for i, (kind, param) in enumerate((("session", {"startAge": "10", "endAge": "50"}), ("page", {"targetPageFlow": "0,1,2"}), ("product", {"startDate": "2024-01-01", "endDate": "2024-01-01"}))):
        main(["tasks", "add", "--store", f"{d}/tasks", "--id", str(i), "--name", kind, "--type", kind, "--param", json.dumps(param)])
        main(["tasks", "run", "--store", f"{d}/tasks", "--id", str(i), "--output", f"{d}/out", *tables])
    main(["tasks", "list", "--store", f"{d}/tasks"])
    assert "finished" in capsys.readouterr().out
    read = lambda n: spark.read.parquet(f"{d}/out/{n}")
    stat = read("session_aggr_stat").first()
    assert stat.session_count == 4 and json.loads(stat.result)["7_9"] == 0.0 and json.loads(stat.result)["10_30"] == 1.0 and stat.task_id == 0
    assert read("top_category").count() == 3 and read("session_random_extract").count() <= 4
    assert read("session_detail").count() == 10 * read("session_random_extract").count()
    assert read("top_session").count() > 0 and read("top_session_detail").count() > 0
    assert read("page_slice_rate").first().rate.startswith("0_1=")
    top = read("area_top_product").first()
    assert (top.area_level, top.product_id, top.product_status, top.click_count) == ("A Level", 1, "Third Party", 20)


def test_catalog_and_bound_sql(spark):
    jobs.register_views(spark, user_visit_action=spark.createDataFrame([visit(1), visit(2)], VISIT))
    assert readers.Catalog(spark).table("user_visit_action").count() == 2
    run = lambda a, b: jobs.run_sql(spark, jobs.VISITS_BETWEEN, start=a, end=b).count()
    assert run("2024-01-01", "2024-01-01") == 2 and run("2024-01-02", "2024-01-03") == 0
    assert run("x' or '1'='1", "9") == 0


def test_kafka_records_become_lines(spark):
    got = readers.kafka_options("a:1,b:2", "t1,t2", startingOffsets="earliest")
    assert got == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "t1,t2", "startingOffsets": "earliest"}
    records = spark.createDataFrame([(None, bytearray(b"1704067200000 P C 1 2"), "t", 0, 5)], "key binary, value binary, topic string, partition int, offset long")
    assert ads.parse(readers.kafka_values(records)).first().user_id == 1
