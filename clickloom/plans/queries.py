"""Every query by name, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import basic_date, iso_date, kv_map, random_prefix, remove_random_prefix
from clickloom.operators import ads, pages, products, sessions
from clickloom.params import Params
from clickloom.plans import jobs
from clickloom.sources import database, layout, readers, views
from clickloom.sources.sinks import cut, scratch
from clickloom.streaming import ads as stream
from clickloom.streaming import state

PARAMS = Params(start_date="2024-01-04", end_date="2024-01-25")
FILTERS = Params(
    start_age=10, end_age=50, professionals=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"), cities=("NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5", "NATION_6", "NATION_7", "NATION_8", "NATION_9", "NATION_10", "NATION_11", "NATION_12", "NATION_13", "NATION_14", "NATION_15", "NATION_16", "NATION_17", "NATION_18", "NATION_19"), sex="male", keywords=("kw1", "kw2", "kw3", "kw4", "kw5"), category_ids=tuple(map(str, range(0, 100, 2)))
)
FLOW = (1, 2, 3, 4, 5)
SAMPLE_TOTAL, SEED = 200, "42"
DAILY_CLICKS = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The inputs as SQL, for the other engine.
VIEWS = {
    "e0": "select *, cast(json_extract_string(props, '$.k') as bigint) as k, (day(ts) - 1) // 3 as b, timestamp '2024-01-01' + to_days(cast(3 * ((day(ts) - 1) // 3) as integer)) as d0, cast(epoch_us(ts) // 1000000 as bigint) as s from events",
    "visits": """select strftime(d0, '%Y-%m-%d') as date, user_id, user_id || '_' || b as session_id, k % 10 as page_id,
  strftime(d0 + to_seconds((user_id % 24) * 3600 + (s - epoch_us(d0) // 1000000) // (case user_id % 4 when 0 then 72 when 1 then 720 when 2 then 7200 else 28800 end)), '%Y-%m-%d %H:%M:%S') as action_time,
  case when event_type = 'view' then 'kw' || (k % 10) end as search_keyword,
  case when event_type = 'click' then k end as click_category_id,
  case when event_type = 'click' then event_id % 100 end as click_product_id,
  case when event_type = 'signup' then k || ',' || ((k + 1) % 100) end as order_category_ids,
  case when event_type = 'signup' then '' || (event_id % 100) end as order_product_ids,
  case when event_type = 'purchase' then k || ',' || ((k + 7) % 100) end as pay_category_ids,
  case when event_type = 'purchase' then '' || (event_id % 100) end as pay_product_ids,
  event_id % 25 as city_id, event_id from e0""",
    "user_info": "select cast(c_custkey as bigint) as user_id, 'user' || c_custkey as username, c_name as name, cast(c_custkey % 60 as integer) as age, c_mktsegment as professional, n_name as city, case when c_custkey % 2 = 0 then 'male' else 'female' end as sex from customer join nation on c_nationkey = n_nationkey",
    "product_info": """select cast(p_partkey as bigint) as product_id, p_name as product_name, '{"product_status": ' || (p_size % 2) || '}' as extend_info from part""",
    "city_info": "select cast(n_nationkey as bigint) as city_id, n_name as city_name, ["
    + ", ".join(f"'{a}'" for a in views.AREAS)
    + f"][n_nationkey % {len(views.AREAS)} + 1] as area from nation",
    "ranged": "select * from visits where date between '2024-01-04' and '2024-01-25'",
    "clicked": "select city_id, click_product_id as product_id from ranged where click_product_id is not null",
    "clicked_city": "select c.city_id, city_name, area, product_id from clicked c join city_info i on c.city_id = i.city_id",
    "area_counts": "select area, product_id, count(*) as click_count, string_agg(distinct city_id || ':' || city_name, ',' order by city_id || ':' || city_name) as city_infos from clicked_city group by area, product_id",
    "area_full": "select area, c.product_id, click_count, city_infos, product_name, case when json_extract_string(extend_info, '$.product_status') = '0' then 'Self' else 'Third Party' end as product_status from area_counts c join product_info p on c.product_id = p.product_id",
    "slices": "select session_id, from_page || '_' || to_page as slice, from_page, to_page from (select session_id, lag(page_id) over (partition by session_id order by action_time, event_id) as from_page, page_id as to_page from ranged) where from_page is not null",
    "slice_pv": "select slice, count(*) as pv from slices where slice in ('1_2', '2_3', '3_4', '4_5') group by slice",
    "summary": """select session_id, min(user_id) as user_id,
  coalesce(array_to_string(list_sort(list_distinct(list(search_keyword) filter (search_keyword is not null))), ','), '') as search_keywords,
  coalesce(array_to_string(list_sort(list_distinct(list(click_category_id) filter (click_category_id is not null))), ','), '') as click_category_ids,
  cast(epoch_us(cast(max(action_time) as timestamp)) // 1000000 - epoch_us(cast(min(action_time) as timestamp)) // 1000000 as bigint) as visit_length,
  count(*) as step_length, min(action_time) as start_time from ranged group by session_id""",
    "enriched": "select s.*, age, professional, city, sex from summary s join user_info u on s.user_id = u.user_id",
    "filtered": "select * from enriched where age between 10 and 50 and professional in ("
    + ", ".join(f"'{x}'" for x in FILTERS.professionals)
    + ") and city in ("
    + ", ".join(f"'{x}'" for x in FILTERS.cities)
    + ") and sex = 'male' and list_has_any(string_split(search_keywords, ','), ["
    + ", ".join(f"'{x}'" for x in FILTERS.keywords)
    + "]) and list_has_any(string_split(click_category_ids, ','), ["
    + ", ".join(f"'{x}'" for x in FILTERS.category_ids)
    + "])",
    "kept": "select * from enriched where age between 10 and 50 and sex = 'male'",
    "details": f"select {', '.join(sessions.DETAIL)} from ranged where session_id in (select session_id from kept)",
    "counts": "select count(*) as session_count, "
    + ", ".join(f"count(*) filter ({c} >= {a}" + (f" and {c} <= {b}" if b else "") + f') as "{n}"' for rows, c in ((sessions.LENGTHS, "visit_length"), (sessions.STEPS, "step_length")) for n, a, b in rows)
    + " from kept",
    "hours": "select substr(start_time, 1, 10) as date, substr(start_time, 12, 2) as hour, count(*) as sessions from kept group by 1, 2",
    "quotas": f"select date, hour, sessions, cast(least(sessions * ({SAMPLE_TOTAL} // (select count(distinct date) from hours)) // sum(sessions) over (partition by date), sessions) as bigint) as quota from hours",
    "sampled": f"select session_id, start_time, search_keywords, click_category_ids from (select *, row_number() over (partition by substr(start_time, 1, 13) order by md5(session_id || '{SEED}'), session_id) as t from kept) k join quotas q on q.date = substr(start_time, 1, 10) and q.hour = substr(start_time, 12, 2) where t <= quota",
    "ids": "select 'click' as kind, click_category_id as category_id from details where click_category_id is not null union all select 'order', cast(unnest(string_split(order_category_ids, ',')) as bigint) from details where order_category_ids is not null union all select 'pay', cast(unnest(string_split(pay_category_ids, ',')) as bigint) from details where pay_category_ids is not null",
    "categories": "select category_id, count(*) filter (kind = 'click') as click_count, count(*) filter (kind = 'order') as order_count, count(*) filter (kind = 'pay') as pay_count from ids group by category_id",
    "top_categories": "select * from categories order by click_count desc, order_count desc, pay_count desc, category_id limit 10",
    "by_session": "select click_category_id as category_id, session_id, count(*) as click_count from details where click_category_id is not null group by 1, 2",
    "top_sessions": "select category_id, session_id, click_count from (select *, row_number() over (partition by category_id order by click_count desc, session_id) as t from by_session where category_id in (select category_id from top_categories)) where t <= 10",
    "ad_clicks": "select epoch_us(ts) // 1000 as millis, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H') as hour, strftime(ts, '%M') as minute, 'P' || n_regionkey as province, 'C' || n_nationkey as city, user_id, cast(json_extract_string(props, '$.k') as bigint) % 10 as ad_id from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey",
    "daily": "select date, user_id, ad_id, count(*) as click_count from ad_clicks group by 1, 2, 3",
    "offenders": f"select distinct user_id from daily where click_count >= {DAILY_CLICKS}",
    "ad_stats": "select date, province, city, ad_id, count(*) as click_count from ad_clicks group by 1, 2, 3, 4",
    "ad_top": "select date, province, ad_id, click_count from (select *, row_number() over (partition by date, province order by click_count desc, ad_id) as t from (select date, province, ad_id, cast(sum(click_count) as bigint) as click_count from ad_stats group by 1, 2, 3)) where t <= 3",
    "panes": "select * from (select millis // 10000 as step, ad_id, millis // 60000 as m, count(*) as n from ad_clicks group by 1, 2, 3) where (step + 1) * 10000 <= (select max(millis) from ad_clicks)",
    "steps": "select distinct step from panes",
    "ad_trend": "select date, hour, minute, ad_id, count(*) as click_count from ad_clicks group by 1, 2, 3, 4",
}


RATIOS = " union all ".join(f"""select '{n}' as bucket, "{n}" as sessions, case when session_count <> 0 then ((200 * "{n}" + session_count) // (2 * session_count)) / 100.0 end as ratio from counts""" for n, _, _ in (*sessions.LENGTHS, *sessions.STEPS))


RATES = """select step, slice, pv, case when b <> 0 then ((200 * pv + b) // (2 * b)) / 100.0 end as rate from (select step, slice, pv, coalesce(lag(pv) over (order by step), (select count(*) from ranged where page_id = 1)) as b
from (select step, s.slice, coalesce(pv, 0) as pv from (values (1, '1_2'), (2, '2_3'), (3, '3_4'), (4, '4_5')) s(step, slice) left join slice_pv p on p.slice = s.slice))"""


def _sql(body: str) -> str:
    """body behind those views that it needs."""
    import re

    needed: list[str] = []

    def want(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                want(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    want(body)
    order = [n for n in VIEWS if n in needed]
    return ("with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + "\n" if order else "") + body


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _sql(sql)
        return f

    return add


def _ranged(spark: SparkSession, d: str) -> DataFrame:
    return sessions.in_dates(views.visits(spark, d), PARAMS)


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return sessions.enrich(sessions.summarise(_ranged(spark, d)), views.user_info(spark, d))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return sessions.keep_sessions(_enriched(spark, d), Params(start_age=10, end_age=50, sex="male"))


def _details(spark: SparkSession, d: str) -> DataFrame:
    return sessions.detail(_ranged(spark, d), _kept(spark, d))


def _clicked(spark: SparkSession, d: str) -> DataFrame:
    return products.with_cities(products.clicks(views.visits(spark, d), PARAMS), views.city_info(spark, d))


def _full(spark: SparkSession, d: str) -> DataFrame:
    return products.with_products(products.area_counts(_clicked(spark, d)), views.product_info(spark, d))


def _ads(spark: SparkSession, d: str) -> DataFrame:
    return ads.parse(views.ad_log(spark, d))


@query("select date, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id, event_id from ranged")
def visit_scan_date_range(spark, d):
    return _ranged(spark, d)


@query("select city_id, product_id from clicked")
def click_scan(spark, d):
    return products.clicks(views.visits(spark, d), PARAMS)


@query("select * from clicked_city")
def click_city_join(spark, d):
    return _clicked(spark, d)


@query("select * from area_counts")
def area_product_click_count(spark, d):
    return products.area_counts(_clicked(spark, d))


@query("select * from area_counts")
def area_product_click_count_salted(spark, d):
    """The same where every city with a hundredth of the clicks is salted."""
    return products.area_counts(products.with_cities_salted(products.clicks(views.visits(spark, d), PARAMS), views.city_info(spark, d), share=0.01))


@query("select * from area_full")
def area_full_product(spark, d):
    return _full(spark, d)


@query("select area, case when area in ('China North', 'China East') then 'A Level' when area in ('China South', 'China Middle') then 'B Level' when area in ('West North', 'West South') then 'C Level' else 'D Level' end as area_level, product_id, click_count, city_infos, product_name, product_status from (select *, row_number() over (partition by area order by click_count desc, product_id) as t from area_full) where t <= 3")
def area_top3_product(spark, d):
    return products.top_products(_full(spark, d))


@query("select * from slices")
def page_slices(spark, d):
    return pages.slices(_ranged(spark, d))


@query("select * from slices")
def page_slices_split(spark, d):
    """The same with every session of more than 20 views dealt out by time."""
    return pages.slices(_ranged(spark, d), most=20)


@query("select * from slice_pv")
def page_slice_counts(spark, d):
    return pages.slice_counts(pages.slices(_ranged(spark, d)), FLOW)


@query("select count(*) as pv from ranged where page_id = 1")
def page_start_pv(spark, d):
    return pages.start_views(_ranged(spark, d), FLOW)


@query(RATES)
def page_convert_rate(spark, d):
    return pages.convert_rates(_ranged(spark, d), FLOW)


@query("select string_agg(slice || '=' || coalesce(cast(rate as varchar), 'null'), '|' order by step) as rate from (" + RATES + ")")
def page_flow_text(spark, d):
    """As the page job stores them: one text."""
    return pages.flow_text(pages.convert_rates(_ranged(spark, d), FLOW))


@query("select date, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id, event_id from ranged")
def visit_scan_sql(spark, d):
    """The same rows as visit_scan_date_range by SQL text with bound values over a registered view."""
    jobs.register_views(spark, user_visit_action=views.visits(spark, d))
    return jobs.run_sql(spark, jobs.VISITS_BETWEEN, start=PARAMS.start_date, end=PARAMS.end_date)


@query("select * from summary")
def session_summary(spark, d):
    return sessions.summarise(_ranged(spark, d))


@query("select * from enriched")
def session_enriched(spark, d):
    return _enriched(spark, d)


@query("select * from filtered")
def session_filtered(spark, d):
    return sessions.keep_sessions(_enriched(spark, d), FILTERS)


@query("select * from enriched")
def session_unfiltered(spark, d):
    return sessions.keep_sessions(_enriched(spark, d), Params())


@query("select * from details")
def session_detail(spark, d):
    return _details(spark, d)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    name = scratch(spark, "visits")
    return sessions.in_dates(layout.store_by_session(views.visits(spark, d), name.rsplit("/", 1)[1].replace("-", "_"), name, 16), PARAMS)


@query("select * from summary")
def stored_session_summary(spark, d):
    """Over visits that lie by session: no exchange."""
    return sessions.summarise(_stored(spark, d))


@query("select * from slices")
def stored_page_slices(spark, d):
    """Over visits that lie by session: no exchange."""
    rows = _stored(spark, d)
    return pages.slices(rows)


@query("select * from details")
def stored_session_detail(spark, d):
    """Over visits that lie by session: sessions are made, filtered and joined back without an exchange by session."""
    rows = _stored(spark, d)
    kept = sessions.keep_sessions(sessions.enrich(sessions.summarise(rows), views.user_info(spark, d)), Params(start_age=10, end_age=50, sex="male"))
    return sessions.detail(rows, kept)


@query("select * from counts")
def session_buckets(spark, d):
    return sessions.bucket_counts(_kept(spark, d))


@query("select * from counts")
def session_buckets_in_passing(spark, d):
    """Counted while the sessions are written."""
    return sessions.write_counted(_kept(spark, d), scratch(spark, "counted"))


@query(RATIOS)
def session_bucket_ratio(spark, d):
    return sessions.bucket_ratios(sessions.bucket_counts(_kept(spark, d)))


@query("""select (select session_count from counts) as session_count, '{' || string_agg('"' || bucket || '":' || ratio, ',' order by bucket) || '}' as result from (""" + RATIOS + ")")
def session_statistics(spark, d):
    """As the session job stores them: the count beside the ratios as JSON."""
    return sessions.statistics_row(sessions.bucket_counts(_kept(spark, d)))


@query("select * from hours")
def session_hour_counts(spark, d):
    return sessions.hour_counts(_kept(spark, d))


@query("select * from quotas")
def session_hour_quota(spark, d):
    return sessions.hour_quotas(sessions.hour_counts(_kept(spark, d)), SAMPLE_TOTAL)


@query("select * from sampled")
def session_sample(spark, d):
    return sessions.sample(cut(_kept(spark, d), "sessions"), SAMPLE_TOTAL, SEED)


@query("select * from details where session_id in (select session_id from sampled)")
def session_sample_detail(spark, d):
    kept = cut(_kept(spark, d), "sessions")
    return sessions.detail(sessions.detail(_ranged(spark, d), kept), sessions.sample(kept, SAMPLE_TOTAL, SEED))


@query("select distinct category_id from ids")
def category_ids(spark, d):
    return sessions.category_ids(_details(spark, d))


@query("select category_id, count(*) as click_count from ids where kind = 'click' group by 1")
def category_click(spark, d):
    return sessions.category_count(_details(spark, d), "click")


@query("select category_id, count(*) as order_count from ids where kind = 'order' group by 1")
def category_order(spark, d):
    return sessions.category_count(_details(spark, d), "order")


@query("select category_id, count(*) as pay_count from ids where kind = 'pay' group by 1")
def category_pay(spark, d):
    return sessions.category_count(_details(spark, d), "pay")


@query("select * from categories")
def category_counts(spark, d):
    return sessions.category_counts(_details(spark, d))


@query("select * from top_categories")
def top10_category(spark, d):
    return sessions.top_categories(sessions.category_counts(_details(spark, d)))


@query("select * from by_session")
def category_session_counts(spark, d):
    return sessions.category_session_counts(_details(spark, d))


def _top_sessions(details: DataFrame) -> DataFrame:
    return sessions.top_sessions(sessions.category_session_counts(details), sessions.top_categories(sessions.category_counts(details)))


@query("select * from top_sessions")
def top10_session(spark, d):
    return _top_sessions(cut(_details(spark, d), "details"))


@query(f"select t.category_id, {', '.join('x.' + c for c in sessions.DETAIL)} from details x join top_sessions t on x.session_id = t.session_id")
def top10_session_detail(spark, d):
    details = cut(_details(spark, d), "details")
    return sessions.top_session_detail(details, _top_sessions(details))


@query("select millis, date, province, city, user_id, ad_id from ad_clicks")
def ad_parse(spark, d):
    return _ads(spark, d).drop("ts")


@query("select millis, date, province, city, user_id, ad_id from ad_clicks where user_id not in (select user_id from offenders)")
def ad_blacklist_filter(spark, d):
    clicks = cut(_ads(spark, d), "clicks")
    return ads.not_blacklisted(clicks, ads.offenders(ads.user_daily_counts(clicks), DAILY_CLICKS)).drop("ts").select("millis", "date", "province", "city", "user_id", "ad_id")


@query("select * from daily")
def ad_user_daily_count(spark, d):
    return ads.user_daily_counts(_ads(spark, d))


@query("select * from offenders")
def ad_blacklist_users(spark, d):
    return ads.offenders(ads.user_daily_counts(_ads(spark, d)), DAILY_CLICKS)


@query("select * from ad_stats")
def ad_stat(spark, d):
    return ads.stats(_ads(spark, d))


@query("select * from ad_top")
def ad_province_top3(spark, d):
    return ads.province_top(ads.stats(_ads(spark, d)))


@query("select * from ad_trend")
def ad_click_trend(spark, d):
    return ads.trend(_ads(spark, d))


def _replayed(spark: SparkSession, d: str, start, name: str, slices: int = 3, before=None, tables=state.tables, **options):
    """The table that a stream leaves after the log's lines, in time order, as a few files."""
    folder = scratch(spark, name)
    if before:
        before(folder)
    lines = views.ad_log(spark, d)
    # Equal ranges of time give the batches; a file each, written in turn, so that one batch takes one.
    millis = F.split("value", " ")[0].cast("long")
    lines = cut(lines.select("value", millis.alias("_t")), "log")
    ends = lines.agg(F.min("_t").alias("a"), F.max("_t").alias("b")).first()
    for i in range(slices if ends.a is not None else 0):
        low, high = (ends.a + (ends.b + 1 - ends.a) * k // slices for k in (i, i + 1))
        lines.where((F.col("_t") >= low) & (F.col("_t") < high)).coalesce(1).sortWithinPartitions("_t").select("value").write.mode("append").text(f"{folder}/lines")
    start(readers.file_lines(spark, f"{folder}/lines", maxFilesPerTrigger="1"), folder, every=None, **options).awaitTermination()
    return tables(spark, folder)[name]


@query("select * from ad_stats")
def ad_stat_stream(spark, d):
    # Files may come in any order: the watermark lies as far back as the log is long.
    return _replayed(spark, d, state.start_stats, "stats", late="40 days").read()


@query("select * from ad_top")
def ad_province_top3_stream(spark, d):
    return state.top_rows(_replayed(spark, d, state.start_province_top, "top", late="40 days"))


@query("select * from ad_trend")
def ad_click_trend_stream(spark, d):
    return _replayed(spark, d, state.start_trend, "trend", late="40 days").read()


@query("select * from offenders")
def ad_blacklist_stream(spark, d):
    return _replayed(spark, d, stream.start_blacklist, "blacklist", tables=stream.tables, threshold=DAILY_CLICKS).read()


@query("select date, user_id, ad_id, click_count from daily")
def ad_user_daily_count_stream(spark, d):
    return _replayed(spark, d, state.start_user_counts, "user_counts", late="40 days").read()


@query("select date, province, city, ad_id, count(*) as click_count from ad_clicks where user_id not in (select user_id from offenders) group by 1, 2, 3, 4")
def ad_stat_filtered_stream(spark, d):
    """Totals without the users that an earlier run has put on the blacklist; nobody else gets there."""
    listed = _replayed(spark, d, stream.start_blacklist, "blacklist", tables=stream.tables, threshold=DAILY_CLICKS).read()
    return _replayed(spark, d, stream.start_filtered_stats, "stats", tables=stream.tables, before=lambda folder: stream.blacklist(stream.tables(spark, folder), listed, -1), threshold=DAILY_CLICKS).read()


@query("select t.* from ad_trend t where cast(date || ' ' || hour || ':' || minute || ':00' as timestamp) > (select max(cast(date || ' ' || hour || ':' || minute || ':00' as timestamp)) from ad_trend) - interval 60 minute")
def ad_trend_last_hour_stream(spark, d):
    return stream.last_hour(_replayed(spark, d, state.start_trend, "trend", late="40 days").read())


# Windows of an hour that end with a pane of 10 seconds. The stream closes panes that end before its newest click.
HOURS = """select s.step_end, strftime(make_timestamp(p.m * 60000000), '%Y-%m-%d') as date, strftime(make_timestamp(p.m * 60000000), '%H') as hour, strftime(make_timestamp(p.m * 60000000), '%M') as minute, p.ad_id,
  cast(sum(p.n) as bigint) as click_count, cast(any_value(s.ad_total) as bigint) as ad_total
from (select steps.step, (steps.step + 1) * 10 as step_end, ads.ad_id, any_value(t.n) as ad_total from steps cross join (select distinct ad_id from panes) ads
  join (select step, ad_id, sum(n) over (partition by ad_id order by step range between 359 preceding and current row) as n from (select st.step, a.ad_id, coalesce(p.n, 0) as n from steps st cross join (select distinct ad_id from panes) a left join panes p on p.step = st.step and p.ad_id = a.ad_id)) t
  on t.step = steps.step and t.ad_id = ads.ad_id group by 1, 2, 3) s
join panes p on p.ad_id = s.ad_id and p.step between s.step - 359 and s.step
group by s.step_end, p.m, p.ad_id"""


@query(HOURS)
def ad_last_hours_stream(spark, d):
    """For every 10 seconds with clicks: the clicks of the hour before by minute and ad, and by ad."""
    return _replayed(spark, d, state.start_last_hour, "last_hour", late="0 seconds").read()


@query(HOURS)
def ad_last_hours(spark, d):
    """The same windows over the whole log at once."""
    clicks = cut(_ads(spark, d), "clicks")
    ended = F.broadcast(clicks.agg(F.max("millis").alias("_newest")))
    panes = state.pane_counts(clicks).join(ended, (F.col("step") + 1) * state.PANE * 1000 <= F.col("_newest")).drop("_newest")
    return state.last_hours(cut(panes, "panes"))


@query("select replace(date, '-', '') as date, province, city, ad_id, click_count from ad_stats")
def ad_stat_entity_dates(spark, d):
    return ads.entity_dates(ads.stats(_ads(spark, d)))


@query("select distinct date, replace(date, '-', '') as basic, date as iso from ad_clicks")
def date_forms(spark, d):
    rows = _ads(spark, d).select("date").distinct().select("date", basic_date(F.col("date")).alias("basic"))
    return rows.withColumn("iso", iso_date(F.col("basic")))


@query("select session_id, cast(user_id as varchar) as user_id, cast(step_length as varchar) as steps from summary")
def session_record_fields(spark, d):
    """Fields of records written as k=v|k=v, read back by name."""
    text = F.concat_ws("|", *[F.concat_ws("=", F.lit(k), F.col(c).cast("string")) for k, c in (("sessionid", "session_id"), ("userid", "user_id"), ("stepLength", "step_length"))])
    m = kv_map(F.col("t"))
    return sessions.summarise(_ranged(spark, d)).select(text.alias("t")).select(m["sessionid"].alias("session_id"), m["userid"].alias("user_id"), m["stepLength"].alias("steps"))


@query("select event_type, count(*) as n from events group by 1")
def salted_count(spark, d):
    """A count in two steps, over salted keys first."""
    e = views.read(spark, d, "events").select(random_prefix(F.col("event_type"), 10, 7).alias("_k"))
    parts = e.groupBy("_k").agg(F.count("*").alias("_n"))
    return parts.groupBy(remove_random_prefix(F.col("_k")).alias("event_type")).agg(F.sum("_n").alias("n"))


@query("select date, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id from visits")
def control_a_roundtrip(spark, d):
    path = scratch(spark, "control-a")
    readers.write_control_a(views.visits(spark, d).drop("event_id"), path)
    return readers.read_control_a(spark, path, readers.USER_VISIT_ACTION)


def _derby(spark: SparkSession) -> tuple[str, dict[str, str]]:
    """Spark's embedded database, in the driver's memory. Rows come and go in files, as executors do not reach it."""
    name = scratch(spark, "derby").rsplit("-", 1)[1]
    return f"jdbc:derby:memory:{name};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query("select date, province, city, ad_id, click_count from ad_stats")
def jdbc_ad_stats(spark, d):
    """Totals written to a database twice, as a repeated task does, and read back in ranges of ads."""
    url, options = _derby(spark)
    rows = ads.stats(_ads(spark, d))
    for _ in range(2):
        database.replace_rows(rows, url, "ad_stat", 7, folder=scratch(spark, "load"), createTableColumnTypes="date VARCHAR(10), province VARCHAR(64), city VARCHAR(64)", **options)
    return database.read_parts(spark, url, "ad_stat", "ad_id", 4, folder=scratch(spark, "unload"), **options).drop("task_id")


@query("select * from city_info")
def jdbc_city_roundtrip(spark, d):
    """A table of a database, through Spark's embedded one."""
    url, options = _derby(spark)
    database.load_rows(views.city_info(spark, d), url, "city_info", scratch(spark, "load"), createTableColumnTypes="city_name VARCHAR(64), area VARCHAR(64)", **options)
    return database.read_parts(spark, url, "city_info", "city_id", 4, scratch(spark, "unload"), **options)
