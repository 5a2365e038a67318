"""Queries of the table and time-series operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.functions import terms as t
from loomflow.operators import frames
from loomflow.plans import compile
from loomflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(name: str, tables: str, make: Callable[..., DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(*[table(spark, sf_dir, n) for n in tables.split()])
    ORACLE_SQL[name] = sql


def _hour(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def _axes(events: DataFrame) -> DataFrame:
    hours = events.select("event_type", "user_id", _hour("ts").alias("hour_of"), "value")
    axes = {"x": F.col("event_type") == "click", "y": F.col("event_type") == "view", "z": F.col("event_type") == "purchase"}
    return frames.axis_merge(hours, "event_type", axes, ["user_id", "hour_of"], "value")


_q("j05_axis_merge", "events", _axes, """
WITH e AS (SELECT event_type, user_id, date_trunc('hour', ts)::TIMESTAMP AS hour_of, value FROM events)
SELECT a.user_id, a.hour_of, a.value AS x, b.value AS y, c.value AS z FROM e a JOIN e b USING (user_id, hour_of) JOIN e c USING (user_id, hour_of)
WHERE a.event_type = 'click' AND b.event_type = 'view' AND c.event_type = 'purchase'""")
_q("j06_row_index", "events", lambda e: frames.flatten_json(e.select("event_id", "props"), {"props": "k BIGINT"}).withColumnRenamed("props.k", "k"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_q("j07_lookup", "customer nation", lambda c, n: frames.lookup(c.select("c_custkey", F.col("c_nationkey").alias("key")), n.select((F.col("n_nationkey") + 5).alias("key"), "n_name"), "key", "n_name", "nation").select("c_custkey", "nation"), "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5")
_q("j_as_of", "events", lambda e: frames.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), ["user_id"], "ts", "value", "last_view").select("event_id", "last_view"), """
SELECT p.event_id, (SELECT max_by(v.value, v.ts) FROM (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v
WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS last_view FROM events p WHERE event_type = 'purchase'""")

_q("a01_mode", "events", lambda e: frames.most_frequent(e, ["user_id"], "event_type", "mode"), "SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) r FROM events GROUP BY 1, 2) WHERE r = 1")
_q("a02_last", "events", lambda e: frames.last_value(e.withColumn("some", F.when(F.col("event_id") % 3 == 0, F.col("value"))), ["user_id"], ["ts", "event_id"], ["event_type", "some"]), """
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) FILTER (event_id % 3 = 0) AS some FROM events GROUP BY 1""")
_q("a03_majority", "lineitem", lambda li: frames.most_frequent(li, ["l_suppkey"], "l_linenumber", "majority"), "SELECT l_suppkey, l_linenumber AS majority FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
_q("a04_window_features", "events", lambda e: frames.time_windows(e, ["event_type"], "ts", "6 hours", "3 hours", mean=F.round(F.avg("value"), 6), sd=F.round(F.stddev_pop("value"), 6)).select("event_type", F.col("window.start").alias("start"), "mean", "sd"), """
WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 3 HOURS, ts), time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS]) AS start FROM events)
SELECT event_type, start::TIMESTAMP AS start, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM e GROUP BY 1, 2""")
_q("a05_at_least", "events", lambda e: frames.at_least(e, ["user_id"], 12).groupBy("user_id").agg(F.count("*").alias("n")), "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 12")
_q("a06_grouped_edges", "lineitem", lambda li: li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.col("l_partkey"))), ",").alias("parts")), "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1")
_q("a08_cardinality", "orders", lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("kind")), "SELECT o_custkey, CASE count(*) WHEN 1 THEN 'one' ELSE 'many' END AS kind FROM orders GROUP BY 1")
_q("a08_all_arms", "customer orders", lambda c, o: frames.cardinality(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), "k").select("k", "kind"), "SELECT c_custkey AS k, CASE count(o_orderkey) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS kind FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_q("a10_distinct", "events", lambda e: e.select("event_type", "user_id").distinct(), "SELECT DISTINCT event_type, user_id FROM events")
_q("a11_accuracy", "labels", lambda x: frames.accuracy(x, "quality", "toxic").select(F.round("accuracy", 9).alias("accuracy")), "SELECT round(avg((quality = toxic)::INT), 9) AS accuracy FROM labels")

_q("w01_diff", "events", lambda e: e.select("event_id", frames.changed("event_type", ["user_id"], ["ts", "event_id"]).alias("changed")), "SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS changed FROM events")
_q("w02_intervals", "events", lambda e: frames.state_intervals(e, ["user_id"], "ts", "event_type", ["ts", "event_id"]), """
WITH c AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) run FROM (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 1) ch FROM events)),
g AS (SELECT user_id, run, any_value(event_type) event_type, min(ts) AS start, max(ts) AS last, count(*) n FROM c GROUP BY 1, 2)
SELECT user_id, event_type, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY run), last) AS "end", n FROM g""")
_q("w03_count_windows", "events", lambda e: frames.count_windows(e, ["event_type"], ["ts", "event_id"], "value", 64, 32).select("event_type", "start", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total")), """
WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
d AS (SELECT event_type, value, unnest(CASE WHEN i < 32 THEN [0] ELSE [(i // 32) * 32, (i // 32) * 32 - 32] END) AS start FROM i)
SELECT event_type, CAST(start AS BIGINT) AS start, round(sum(value), 4) AS total FROM d GROUP BY 1, 2 HAVING count(*) = 64""")
_q("w04_time_windows", "events", lambda e: frames.time_windows(e, ["event_type"], "ts", "1 day", None, n=F.count("*"), top=F.max("value")).select("event_type", F.col("window.start").alias("start"), "n", "top"), "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
_q("w05_chunks", "events", lambda e: frames.chunks(e, ["event_type"], "ts", "10 minutes", "'15' MINUTE"), """
WITH c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 10 MINUTES THEN 0 ELSE 1 END new FROM events))
SELECT event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM c GROUP BY event_type, g HAVING max(ts) - min(ts) >= INTERVAL 15 MINUTES""")
_q("w06_first_last", "events", lambda e: frames.first_and_last(e, ["user_id"], ["ts", "event_id"], "value"), "SELECT user_id, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last FROM events GROUP BY 1")
_q("w07_classify", "lineitem", lambda li: frames.classified(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "hit", [F.col("l_quantity") > 30, F.col("l_discount") < 0.05]).select("l_orderkey", "l_linenumber", "hit"), "SELECT l_orderkey, l_linenumber, (l_quantity > 30 AND l_discount < 0.05)::INT AS hit FROM lineitem")
_q("w08_gaussian", "events", lambda e: frames.gaussian(e.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value", "smooth", 1.0, 2.0).select("event_id", F.round("smooth", 6).alias("smooth")), """
WITH w AS (SELECT event_id, value AS c, lag(value) OVER o AS l1, lag(value, 2) OVER o AS l2, lead(value) OVER o AS r1, lead(value, 2) OVER o AS r2 FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, round((coalesce(l2 * exp(-2), 0) + coalesce(l1 * exp(-0.5), 0) + c + coalesce(r1 * exp(-0.5), 0) + coalesce(r2 * exp(-2), 0))
/ ((l2 IS NOT NULL)::INT * exp(-2) + (l1 IS NOT NULL)::INT * exp(-0.5) + 1 + (r1 IS NOT NULL)::INT * exp(-0.5) + (r2 IS NOT NULL)::INT * exp(-2)), 6) AS smooth FROM w""")


def _lowpass(e: DataFrame) -> DataFrame:
    """Every day of a kind of events is a series."""
    b, a = frames.butterworth(2, None, 4.0, 32.0)
    series = e.select("event_id", "event_type", "ts", "value", F.to_date("ts").alias("day"))
    return frames.filtered(series, ["event_type", "day"], ["ts", "event_id"], "value", "low", b, a).select("event_id", F.round("low", 6).alias("low"))


_q("w08_lowpass", "events", _lowpass, """
WITH RECURSIVE c AS (SELECT w * w / (1 + sqrt(2) * w + w * w) AS b0, 2 * (w * w - 1) / (1 + sqrt(2) * w + w * w) AS a1, (1 - sqrt(2) * w + w * w) / (1 + sqrt(2) * w + w * w) AS a2 FROM (SELECT tan(pi() * 4 / 32) AS w)),
s AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, value AS x, coalesce(lag(value) OVER o, 0) AS x1, coalesce(lag(value, 2) OVER o, 0) AS x2, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id)),
f AS (
    SELECT event_id, event_type, day, n, b0 * x AS y, CAST(0 AS DOUBLE) AS y1 FROM s, c WHERE n = 1
    UNION ALL
    SELECT s.event_id, s.event_type, s.day, s.n, b0 * (s.x + 2 * s.x1 + s.x2) - a1 * f.y - a2 * f.y1, f.y FROM f JOIN s ON s.event_type = f.event_type AND s.day = f.day AND s.n = f.n + 1, c
)
SELECT event_id, round(y, 6) AS low FROM f""")

# all events as one series, which is more than a task's work

_ALL = "row_number() OVER (ORDER BY ts, event_id) - 1"
_q("w03_one_series", "events", lambda e: frames.count_windows(e, [], ["ts", "event_id"], "value", 64, 32).select("start", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total")), f"""
WITH i AS (SELECT value, {_ALL} AS i FROM events), d AS (SELECT value, unnest(CASE WHEN i < 32 THEN [0] ELSE [(i // 32) * 32, (i // 32) * 32 - 32] END) AS start FROM i)
SELECT CAST(start AS BIGINT) AS start, round(sum(value), 4) AS total FROM d GROUP BY 1 HAVING count(*) = 64""")
_q("w05_one_series", "events", lambda e: frames.chunks(e, [], "ts", "2 minutes"), """
WITH c AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 2 MINUTES THEN 0 ELSE 1 END new FROM events))
SELECT min(ts) AS start, max(ts) AS "end", count(*) AS n FROM c GROUP BY g""")
_q("w08_gaussian_one_series", "events", lambda e: frames.gaussian(e.select("event_id", "ts", "value"), [], ["ts", "event_id"], "value", "smooth", 1.0, 2.0).select("event_id", F.round("smooth", 6).alias("smooth")), """
WITH w AS (SELECT event_id, value AS c, lag(value) OVER o AS l1, lag(value, 2) OVER o AS l2, lead(value) OVER o AS r1, lead(value, 2) OVER o AS r2 FROM events WINDOW o AS (ORDER BY ts, event_id))
SELECT event_id, round((coalesce(l2 * exp(-2), 0) + coalesce(l1 * exp(-0.5), 0) + c + coalesce(r1 * exp(-0.5), 0) + coalesce(r2 * exp(-2), 0))
/ ((l2 IS NOT NULL)::INT * exp(-2) + (l1 IS NOT NULL)::INT * exp(-0.5) + 1 + (r1 IS NOT NULL)::INT * exp(-0.5) + (r2 IS NOT NULL)::INT * exp(-2)), 6) AS smooth FROM w""")
# a first-order low-pass has y = 0.5 x + 0.5 y of the row before; after forty rows a value weighs less than a double can tell
_q("w08_lowpass_one_series", "events", lambda e: frames.filtered(e.select("event_id", "ts", "value"), [], ["ts", "event_id"], "value", "low", [0.5], [1.0, -0.5]).select("event_id", F.round("low", 6).alias("low")), f"""
WITH s AS (SELECT event_id, value, {_ALL} AS n FROM events)
SELECT t.event_id, round(sum(s.value * power(0.5, t.n - s.n + 1)), 6) AS low FROM s JOIN (SELECT event_id, n, unnest(range(greatest(n - 60, 0), n + 1)) AS m FROM s) t ON s.n = t.m GROUP BY 1""")

_q("s01_sort_uri", "nation", lambda n: n.join(frames.placed(n.select("n_name").distinct(), ["n_name"], "place"), "n_name").select("n_name", (F.col("place") + 1).alias("place")), "SELECT n_name, dense_rank() OVER (ORDER BY n_name) AS place FROM nation")
_q("s03_sort_time", "events", lambda e: frames.placed(e.select("event_id", "ts"), ["ts", "event_id"], "place").select("event_id", "place"), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
_q("s02_sort_index", "lineitem", lambda li: li.groupBy("l_orderkey").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))).alias("parts")), "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
_q("s04_head", "orders", lambda o: frames.head(o.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
_q("s04_tail", "orders", lambda o: frames.tail(o.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5")
_q("s06_nrows", "customer", lambda c: frames.head(c.select("c_custkey"), ["c_custkey"], 7), "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 7")
_q("u03_difference", "customer orders", lambda c, o: c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti"), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_q("u04_union_minus", "customer supplier", lambda c, s: c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct().where("k <> 3"), "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT 3")

_q("sc01_split", "part", lambda p: p.select("p_partkey", t.local_name(F.col("p_brand")).alias("last"), t.prefix_of(F.col("p_brand")).alias("rest")), "SELECT p_partkey, split_part(p_brand, '#', -1) AS last, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) || '#' ELSE '' END AS rest FROM part")
_q("sc02_strip", "nation", lambda n: n.select("n_nationkey", t.strip_underscores(F.concat(F.lit("__"), "n_name", F.lit("_"))).alias("x"), t.strip_dashes(F.concat(F.lit("--"), "n_name")).alias("y")), "SELECT n_nationkey, trim('__' || n_name || '_', '_') AS x, ltrim('--' || n_name, '-') AS y FROM nation")
_q("sc04_paths", "part", lambda p: p.select("p_partkey", *[c.alias(n) for n, c in (lambda path: (("module", t.module_name(path)), ("base", t.base_name(path)), ("dir", t.dir_name(path)), ("ext", t.extension(path)), ("moved", t.moved(path, F.lit("/src"), F.lit("/app"))), ("plain", t.file_path(F.concat(F.lit("file://"), path)))))(F.concat(F.lit("/src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/happy.py")))]), """
SELECT p_partkey, 'happy' AS module, 'happy.py' AS base, '/src/' || replace(p_type, ' ', '_') AS dir, '.py' AS ext, '/app/' || replace(p_type, ' ', '_') || '/happy.py' AS moved, '/src/' || replace(p_type, ' ', '_') || '/happy.py' AS plain FROM part""")
_q("sc05_affixes", "part", lambda p: p.select("p_partkey", compile.column(p, "def f(s):\n    return s.removeprefix('Brand#').removesuffix('1')\n", "p_brand").alias("out")), "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '^Brand#', ''), '1$', '') AS out FROM part")
_q("sc08_digest", "part", lambda p: p.select("p_partkey", t.digest(F.col("p_name"), F.col("p_brand")).alias("digest"), t.minted(F.col("p_name"), F.col("p_type"), F.lit(None).cast("string")).alias("uri")), "SELECT p_partkey, left(sha256(p_name || p_brand), 8) AS digest, 'http://www.example.com/python#' || p_name || left(sha256(p_type), 8) AS uri FROM part")
_q("sc09_contains", "documents", lambda d: d.select("doc_id", F.rlike("text", F.lit(r"\bthe\b.*\bof\b")).alias("hit"), (~F.rlike("text", F.lit("[0-9]{3}"))).alias("plain")), r"SELECT doc_id, regexp_matches(text, '\bthe\b.*\bof\b') AS hit, NOT regexp_matches(text, '[0-9]{3}') AS plain FROM documents")
_q("sc10_parse_time", "events", lambda e: e.select("event_id", frames.parse_time(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("at")), "SELECT event_id, strptime('1900-01-01 ' || strftime(ts, '%H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events")
_q("sc11_epoch_ms", "events", lambda e: e.select("event_id", frames.epoch_ms(F.col("ts")).alias("ms")), "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
_q("sc12_to_numeric", "events", lambda e: e.select("event_id", F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.col("event_type")).try_cast("double").alias("number")), "SELECT event_id, try_cast(CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) ELSE event_type END AS DOUBLE) AS number FROM events")
_q("sc14_scale", "events", lambda e: e.select("event_id", F.round(F.col("value") / 9.81, 8).alias("g")), "SELECT event_id, round(value / 9.81, 8) AS g FROM events")
_q("sc15_dropna", "customer orders", lambda c, o: frames.drop_null_columns(c.join(o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")), "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
_q("sc16_drop_rename", "supplier", lambda s: s.drop("s_acctbal").withColumnRenamed("s_name", "name").withColumnRenamed("s_suppkey", "id"), "SELECT s_suppkey AS id, s_name AS name, s_nationkey FROM supplier")
_q("sc17_json", "events", lambda e: frames.flatten_json(e.select("event_id", "props"), {"props": "k BIGINT, z STRING"}).select("event_id", F.col("`props.k`").alias("k"), F.col("`props.z`").alias("z")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.z') AS z FROM events")
_q("sc18_column_slice", "nation", lambda n: n.select(*n.columns[:-1]), "SELECT n_nationkey, n_name FROM nation")
_q("sc19_filter_text", "orders", lambda o: o.where("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
_q("sc20_invert", "region", lambda r: frames.inverted_rows(r, "r_regionkey", "r_name").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), "SELECT r_name AS name, r_regionkey AS key FROM region")
_q("sc20_invert_ties", "customer", lambda c: frames.inverted_rows(c, "c_custkey", "c_mktsegment").select("c_mktsegment", "c_custkey"), "SELECT c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
_q("sc21_stack", "lineitem", lambda li: li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("a"), F.array_sort(F.collect_list("l_suppkey")).alias("b")).select("l_orderkey", F.aggregate(frames.stacked("a", "b"), F.lit(0).cast("long"), lambda s, x: s + x["a"] * x["b"]).alias("dot")), """
WITH r AS (SELECT l_orderkey, list_sort(list(l_partkey)) a, list_sort(list(l_suppkey)) b FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) AS BIGINT) AS dot FROM r""")
_q("sc22_label_encode", "orders", lambda o: frames.label_codes(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code"), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
_q("sc23_typed_literals", "orders", lambda o: o.select("o_orderkey", F.col("o_totalprice").cast("string").cast("double").alias("price"), F.col("o_orderkey").cast("string").cast("long").alias("key")), "SELECT o_orderkey, o_totalprice AS price, o_orderkey AS key FROM orders")
