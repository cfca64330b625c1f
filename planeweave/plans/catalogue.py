"""The queries by name, each with the SQL that gives the same result.

Operators are generic in their columns; here they meet the tables at hand: events are pages and triggers, line items
are pixels of orders, embeddings are small images, conversations are split acquisitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeweave.functions import parse
from planeweave.operators import calibrate, events, files, pixels, qc, sweep, timeline

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = " ".join(sql.split("\n")).strip()
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970; the session's time zone plays no part."""
    return F.expr(f"CAST(CAST(CAST({c} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18,6)) * 1000000 AS BIGINT)")


def clock(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Events as pages: page_index, ts_us and the columns named."""
    return table(spark, d, "events").select(F.col("event_id").alias("page_index"), micros("ts").alias("ts_us"), *more)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- layout and timeline ------------------------------------------------------------------------------------


@query("""
SELECT event_id AS page_index, CAST(event_id // 14 AS BIGINT) AS volume_index, CAST((event_id % 14) % 2 AS SMALLINT) AS channel,
 CAST(CASE WHEN (event_id % 14) // 2 >= 6 THEN -1 ELSE ((event_id % 14) // 2) // 2 END AS SMALLINT) AS slice_index,
 CAST(CASE WHEN (event_id % 14) // 2 >= 6 THEN -1 ELSE ((event_id % 14) // 2) % 2 END AS SMALLINT) AS frame_repeat_index,
 (event_id % 14) // 2 >= 6 AS is_flyback FROM events
""")
def page_map(spark, d):
    return sweep.with_page_map(clock(spark, d).select("page_index"), "page_index", 2, 6, 2, 7)


@query("SELECT event_id, event_type, value FROM events WHERE event_id >= 100 AND event_id < 350")
def page_slice(spark, d):
    return sweep.page_window(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id", 100, 350)


@query("SELECT event_id, value FROM events WHERE event_id BETWEEN 20 AND 59")
def page_window(spark, d):
    return sweep.page_window(table(spark, d, "events").select("event_id", "value"), "event_id", 20, 60)


@query("SELECT event_id AS page_index, CAST(event_id // 4 AS BIGINT) AS volume_index, CAST(event_id % 4 AS SMALLINT) AS slice_index FROM events WHERE event_id % 4 < 3")
def flyback_excluded(spark, d):
    rows = sweep.with_page_map(clock(spark, d).select("page_index"), "page_index", 1, 3, 1, 4)
    return rows.where(~F.col("is_flyback")).select("page_index", "volume_index", "slice_index")


@query("""
SELECT event_id AS page_index, CAST(event_id // 4 AS BIGINT) AS volume_index,
 first_value(epoch_us(ts)) OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS volume_ts_us FROM events
""")
def volume_timestamps(spark, d):
    rows = sweep.with_page_map(clock(spark, d), "page_index", 1, 3, 1, 4)
    return sweep.with_volume_time(rows, ["volume_index"], "page_index", "ts_us", "volume_ts_us").select("page_index", "volume_index", "volume_ts_us")


@query("""
WITH f AS (SELECT event_id AS page_index, event_type, epoch_us(ts) AS ts_us, CAST(event_id // 4 AS BIGINT) AS volume_index,
 CAST(CASE WHEN event_id % 4 >= 3 THEN -1 ELSE event_id % 4 END AS SMALLINT) AS slice_index,
 first_value(epoch_us(ts)) OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS v FROM events)
SELECT page_index, event_type, volume_index, slice_index, ts_us + 333 AS time_us, CAST(333 AS BIGINT) AS offset_in_frame_us,
 ts_us + 333 - v AS offset_in_volume_us FROM f
""")
def event_context(spark, d):
    frames = sweep.with_volume_time(sweep.with_page_map(clock(spark, d), "page_index", 1, 3, 1, 4), ["volume_index"], "page_index", "ts_us", "v")
    triggers = clock(spark, d, "event_type").select("page_index", "event_type", (F.col("ts_us") + 333).alias("time_us"))
    rows = sweep.place_events(triggers.join(frames, "page_index"), "time_us", "ts_us", "v")
    return rows.select("page_index", "event_type", "volume_index", "slice_index", "time_us", F.col("offset_in_frame_s").alias("offset_in_frame_us"), F.col("offset_in_volume_s").alias("offset_in_volume_us"))


@query("""
WITH m AS (SELECT event_type, min(user_id % 3) AS c FROM events GROUP BY 1)
SELECT event_id AS page_index, e.event_type, CAST(user_id % 3 AS INTEGER) AS channel FROM events e JOIN m ON e.event_type = m.event_type AND e.user_id % 3 = m.c
""")
def channel_mask(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("page_index"), "event_type", (F.col("user_id") % 3).cast("int").alias("channel"))
    return sweep.first_channel(rows, "channel", ["event_type"])


@query("""
WITH f AS (SELECT event_type, epoch_us(ts) AS t, epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS o FROM events),
 g AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS i FROM f)
SELECT event_type, count(*) AS n_events, CAST(count(*) FILTER (t IS NULL) AS BIGINT) AS n_nonfinite, CAST(count(*) FILTER (t < 0) AS BIGINT) AS n_negative,
 min(t) AS first_time, max(t) AS last_time, median(i) AS median_interval, min(i) AS min_interval, max(i) AS max_interval, max(o) AS max_offset_in_volume FROM g GROUP BY 1
""")
def aux_summary(spark, d):
    """The flagship: triggers on the volume timeline, summed up per line."""
    rows = sweep.with_page_map(clock(spark, d, "event_type"), "page_index", 1, 3, 1, 4)
    rows = sweep.with_volume_time(rows, ["volume_index"], "page_index", "ts_us", "v").withColumn("o", F.col("ts_us") - F.col("v"))
    most = rows.groupBy("event_type").agg(F.max("o").alias("max_offset_in_volume"))
    return events.summarize(rows, ["event_type"], "ts_us").join(most, "event_type")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def sentinel_filter(spark, d):
    return events.valid_events(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("SELECT event_id AS page_index, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id) AS interval_us FROM events")
def frame_intervals(spark, d):
    return timeline.dense_intervals(clock(spark, d), [], "page_index", "ts_us", "interval_us").select("page_index", "interval_us")


@query("""
WITH i AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 m AS (SELECT user_id, median(i) AS m FROM i WHERE i IS NOT NULL GROUP BY 1)
SELECT i.user_id, m AS median_interval, round(sqrt(avg((i / m - 1) * (i / m - 1))), 6) AS rms_jitter, round(max(abs(i / m - 1)), 6) AS max_deviation
FROM i JOIN m ON i.user_id = m.user_id WHERE i IS NOT NULL GROUP BY 1, 2
""")
def interval_jitter(spark, d):
    rows = events.intervals(clock(spark, d, "user_id"), ["user_id"], "page_index", "ts_us")
    return pixels.jitter(rows, ["user_id"], "interval").withColumns({"rms_jitter": F.round("rms_jitter", 6), "max_deviation": F.round("max_deviation", 6)})


@query("""
WITH n AS (SELECT count(*) // 4 AS n FROM events), v AS (SELECT event_id // 4 AS v, epoch_us(ts) AS t FROM events, n WHERE event_id % 4 = 0 AND event_id < n * 4),
 i AS (SELECT t - lag(t) OVER (ORDER BY v) AS i FROM v), m AS (SELECT median(i) AS m FROM i)
SELECT m AS median_interval, round(sqrt(avg((i / m - 1) * (i / m - 1))), 6) AS rms_jitter, round(max(abs(i / m - 1)), 6) AS max_deviation FROM i, m WHERE i IS NOT NULL GROUP BY m
""")
def volume_timing(spark, d):
    n = table(spark, d, "events").agg(F.expr("count(*) div 4 * 4").alias("n"))
    starts = clock(spark, d).where("page_index % 4 = 0").crossJoin(F.broadcast(n)).where("page_index < n")  # one row
    starts = starts.select(F.lit(0).alias("recording"), F.expr("page_index div 4").alias("volume"), "ts_us")
    rows = timeline.dense_intervals(starts, ["recording"], "volume", "ts_us")
    return pixels.jitter(rows, ["recording"], "interval").select("median_interval", F.round("rms_jitter", 6).alias("rms_jitter"), F.round("max_deviation", 6).alias("max_deviation"))


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS n FROM lineitem), g AS (SELECT n AS before, lead(n) OVER (ORDER BY n) AS after FROM o)
SELECT before, after, after - before - 1 AS n_missing FROM g WHERE after - before > 1
""")
def frame_gaps(spark, d):
    return timeline.gaps(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1")
def frame_repeats(spark, d):
    return timeline.repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)
SELECT user_id, CAST(count(*) FILTER (d <= 0) AS BIGINT) AS n_not_rising, CAST(count(*) FILTER (d < 0) AS BIGINT) AS n_falling, coalesce(bool_or(d < 0), false) AS any_falling FROM d GROUP BY 1
""")
def monotonic_check(spark, d):
    return timeline.order_checks(table(spark, d, "events"), ["user_id"], "event_id", "value")


@query("""
SELECT count(*) AS n_pages, CAST(7 AS BIGINT) AS pages_per_volume, CAST(count(*) // 7 AS BIGINT) AS n_volumes, CAST(count(*) % 7 AS BIGINT) AS n_left, count(*) % 7 <> 0 AS partial FROM events
""")
def partial_volume(spark, d):
    n = F.count("*")
    rows = table(spark, d, "events").agg(n.alias("n_pages"))
    return rows.select("n_pages", long(F.lit(7)).alias("pages_per_volume"), F.expr("n_pages div 7").alias("n_volumes"), (F.col("n_pages") % 7).alias("n_left"), (F.col("n_pages") % 7 != 0).alias("partial"))


@query("SELECT event_id, value FROM events, (SELECT count(*) // 6 AS n FROM events) WHERE event_id < n * 6")
def complete_volumes(spark, d):
    rows = table(spark, d, "events").select("event_id", "value")
    return sweep.complete_volumes(rows, "event_id", 6, rows.count())


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def cumulative_events(spark, d):
    rows = clock(spark, d, "event_type").withColumnRenamed("page_index", "event_id")
    return timeline.running_count(rows, ["event_type"], ["ts_us", "event_id"]).select("event_type", "event_id", "n")


@query("""
WITH t AS (SELECT epoch_us(ts) AS t FROM events), r AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
 b AS (SELECT CASE WHEN t = hi THEN 599 ELSE (t - lo) * 600 // (hi - lo) END AS bin FROM t, r), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(600)) AS bin) g LEFT JOIN c ON g.bin = c.bin
""")
def event_rate_hist(spark, d):
    t = clock(spark, d).select("ts_us")
    rows = t.crossJoin(F.broadcast(t.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))))  # one row
    found = events.histogram(rows, F.col("ts_us"), F.col("lo"), F.col("hi"), 600)
    return spark.range(600).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH f AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch_us(ts) END AS t FROM events)
SELECT event_id AS page_index, t - lag(t) OVER (ORDER BY event_id) AS interval_us FROM f WHERE t IS NOT NULL
""")
def finite_intervals(spark, d):
    """Times that cannot be read go before the difference, so intervals bridge them; the numbering that is left is dense again by blocks."""
    rows = clock(spark, d).withColumn("t", F.when(F.col("page_index") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("ts_us").cast("double")))
    rows = rows.where(parse.is_finite(F.col("t"))).select("page_index", "ts_us")
    return timeline.bridged_intervals(rows, "page_index", "ts_us", "interval_us")


@query("SELECT user_id, CASE WHEN count(*) >= 2 THEN max(epoch_us(ts)) - min(epoch_us(ts)) END AS duration FROM events GROUP BY 1")
def duration(spark, d):
    return timeline.span(clock(spark, d, "user_id"), ["user_id"], "ts_us")


@query("SELECT event_type, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS interval_us FROM events")
def sorted_intervals(spark, d):
    return events.intervals(clock(spark, d, "event_type"), ["event_type"], ["ts_us", "page_index"], "ts_us", "interval_us").select("event_type", F.col("page_index").alias("event_id"), "interval_us")


@query("""
WITH i AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
 p AS (SELECT event_type, quantile_cont(i::DOUBLE, 0.005) AS lo, quantile_cont(i::DOUBLE, 0.995) AS hi, median(i) AS m FROM i WHERE i IS NOT NULL GROUP BY 1)
SELECT event_type, round(lo - greatest(hi - lo, 0.02 * m, 1e-6), 3) AS clip_low, round(hi + greatest(hi - lo, 0.02 * m, 1e-6), 3) AS clip_high FROM p
""")
def interval_clip(spark, d):
    rows = events.intervals(clock(spark, d, "event_type"), ["event_type"], "page_index", "ts_us").where("interval IS NOT NULL")
    p = rows.groupBy("event_type").agg(F.percentile("interval", 0.005).alias("lo"), F.percentile("interval", 0.995).alias("hi"), F.median("interval").alias("m"))
    by = F.greatest(F.col("hi") - F.col("lo"), 0.02 * F.col("m"), F.lit(1e-6))
    return p.select("event_type", F.round(F.col("lo") - by, 3).alias("clip_low"), F.round(F.col("hi") + by, 3).alias("clip_high"))


# --- split acquisitions -------------------------------------------------------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as acquisitions: a turn is a file with as many pages as its text has characters."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_pages"))


@query("""
SELECT conv_id, turn, coalesce(length(text), 0) AS n_pages, CAST(coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM conversations
""")
def file_offsets(spark, d):
    return files.page_offsets(turns(spark, d), ["conv_id"], "turn", "n_pages").select("conv_id", "turn", "n_pages", "page_start")


@query("""
WITH o AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, coalesce(length(text), 0) AS n FROM conversations),
 p AS (SELECT DISTINCT conv_id, unnest([0, 300, 900]) AS page_index FROM conversations)
SELECT p.conv_id, CAST(page_index AS BIGINT) AS page_index, turn, page_index - s AS file_page FROM p JOIN o ON p.conv_id = o.conv_id AND s <= page_index AND page_index < s + n
""")
def locate_page(spark, d):
    offsets = files.page_offsets(turns(spark, d), ["conv_id"], "turn", "n_pages")
    asked = turns(spark, d).select("conv_id").distinct().select("conv_id", F.explode(F.array(*(long(F.lit(p)) for p in (0, 300, 900)))).alias("page_index"))
    return files.locate(asked, offsets, ["conv_id"], "page_index").select("conv_id", "page_index", "turn", "file_page")


@query("SELECT event_id AS page_index, CAST(CASE WHEN event_id < 400 THEN 0 ELSE 1 END AS SMALLINT) AS file_index, value FROM events")
def merge_union(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("page_index"), "value")
    return files.merge([rows.where("page_index < 400"), rows.where("page_index >= 400").withColumn("page_index", F.col("page_index") - 400)])


@query("""
WITH s AS (SELECT conv_id % 10 AS recording, conv_id, arg_min(length(text), turn) AS time FROM conversations GROUP BY 1, 2)
SELECT recording, conv_id, time FROM s WHERE conv_id > (SELECT min(conv_id) FROM s z WHERE z.recording = s.recording)
""")
def file_boundaries(spark, d):
    rows = turns(spark, d).withColumn("recording", F.col("conv_id") % 10)
    return files.boundaries(rows, ["recording"], "conv_id", "turn", "n_pages").select("recording", "conv_id", "time")


@query("""
WITH f AS (SELECT n_name, 'r' || n_regionkey AS base, n_nationkey // 10 AS acq, n_nationkey AS idx, CASE WHEN n_nationkey = 7 THEN 'odd' ELSE 'even' END AS h FROM nation),
 m AS (SELECT base, acq, arg_min(h, idx) AS first FROM f GROUP BY 1, 2)
SELECT n_name, f.base, CAST(f.acq AS INTEGER) AS acquisition, CAST(idx AS INTEGER) AS file_index, h = first AS belongs FROM f JOIN m ON f.base = m.base AND f.acq = m.acq
""")
def sibling_discovery(spark, d):
    n = table(spark, d, "nation")
    path = F.concat(F.lit("/data/r"), "n_regionkey", F.lit("_"), F.expr("n_nationkey div 10"), F.lit("_"), "n_nationkey", F.lit(".tif"))
    header = F.create_map(F.lit("SI.mode"), F.when(F.col("n_nationkey") == 7, "odd").otherwise("even"), F.lit(files.PER_FILE_KEYS[0]), F.col("n_nationkey").cast("string"))
    return files.siblings(n.select("n_name", path.alias("path"), header.alias("header")), "path", "header").select("n_name", "base", "acquisition", "file_index", "belongs")


@query("""
SELECT n_name, regexp_extract(n_name || '__' || n_regionkey || '_' || n_nationkey, '^(.*?)_(\\d+)_(\\d+)$', 1) AS base, n_regionkey AS acquisition, n_nationkey AS file_index FROM nation
""")
def filename_parse(spark, d):
    p = parse.filename_parts(F.concat("n_name", F.lit("__"), "n_regionkey", F.lit("_"), "n_nationkey", F.lit(".tif")))
    return table(spark, d, "nation").select("n_name", p.alias("p")).select("n_name", "p.base", "p.acquisition", "p.file_index")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part")
def natural_sort(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", parse.natural_key(F.concat(F.lit("File"), "p_partkey", F.lit("_a"))).alias("key"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("key"))
    return rows.select("p_partkey", long(place).alias("place"))


@query("""
SELECT p_partkey, CAST(p_size || '.' || (p_partkey % 10) AS DOUBLE) AS zoom, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis, CAST(p_partkey % 7 AS INTEGER) AS idx FROM part
""")
def grid_filename(spark, d):
    name = F.concat(F.lit("/g/Zoom"), "p_size", F.lit("_"), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 2 == 0, "_Horizontal_").otherwise("_vertical_"), F.col("p_partkey") % 7, F.lit(".tif"))
    return table(spark, d, "part").select("p_partkey", parse.grid_filename(name).alias("g")).select("p_partkey", "g.zoom", "g.axis", F.col("g.index").alias("idx"))


# --- header texts -------------------------------------------------------------------------------------------


def headers(spark: SparkSession, d: str, cut: bool = False, extra: bool = False) -> DataFrame:
    """Events as page headers of four keys; with ``cut`` some break off early, with ``extra`` some hold a key more."""
    n = F.when(F.col("user_id") % 5 == 0, F.col("user_id") % 3 + 1).otherwise(5) if cut else F.lit(5)
    lines = [F.concat(F.lit("frameNumbers = "), "page_index"), F.concat(F.lit("frameTimestamps_sec= "), "ts_us"), F.lit("auxTrigger0 =[]"), F.lit("I2CData = {}"), F.concat(F.lit(" endOfAcquisition =  "), F.col("user_id") % 2)]
    more = F.when(F.col("user_id") % 4 == 1, F.array(F.concat(F.lit("gain"), F.col("user_id") % 3, F.lit(" = "), "page_index", F.lit("=x")))).otherwise(F.array().cast("array<string>"))
    parts = F.slice(F.array(*lines), F.lit(1), n.cast("int"))
    parts = F.concat(parts, more) if extra else parts
    return clock(spark, d, "user_id").withColumn("text", F.concat(F.array_join(parts, "\n"), F.lit("\nno pair here\n"), F.repeat(F.lit("\0"), F.lit(3))))


CUT = "CASE WHEN user_id % 5 = 0 THEN user_id % 3 + 1 ELSE 5 END"
NAMES = "['frameNumbers','frameTimestamps_sec','auxTrigger0','I2CData','endOfAcquisition']"


@query("""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '='))) AS INTEGER) AS n_pairs FROM documents
""")
def header_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", parse.LINES)).alias("n_lines"), F.size(parse.description(F.col("text"))).alias("n_pairs"))


@query(f"SELECT array_to_string({NAMES}[1:{CUT}], ',') AS signature, count(*) AS n_pages, min(event_id) AS first_page FROM events GROUP BY 1")
def key_signature(spark, d):
    found = sweep.signature_counts(sweep.signatures(headers(spark, d, cut=True), "text", "page_index"), "page_index")
    return found.select(F.array_join("signature", ",").alias("signature"), "n_pages", "first_page")


@query(f"""
WITH s AS (SELECT array_to_string({NAMES}[1:{CUT}], ',') AS signature, min(event_id) AS p FROM events GROUP BY 1)
SELECT signature, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS signature_id FROM s
""")
def signature_ids(spark, d):
    found = sweep.signature_counts(sweep.signatures(headers(spark, d, cut=True), "text", "page_index"), "page_index")
    return found.select(F.array_join("signature", ",").alias("signature"), "signature_id")


@query(f"""
WITH s AS (SELECT {CUT} AS n, count(*) AS n_pages, min(event_id) AS first_page FROM events GROUP BY 1)
SELECT array_to_string({NAMES}[1:n], ',') AS signature, n_pages, first_page, array_to_string({NAMES}[n + 1:], ',') AS lost FROM s WHERE n < 5
""")
def truncated_headers(spark, d):
    counts = sweep.signature_counts(sweep.signatures(headers(spark, d, cut=True), "text", "page_index"), "page_index")
    return sweep.truncated(counts).select(F.array_join("signature", ",").alias("signature"), "n_pages", "first_page", F.array_join("lost", ",").alias("lost"))


@query(f"""
WITH s AS (SELECT DISTINCT {CUT} AS n FROM events)
SELECT CAST(n AS BIGINT) AS n_keys, array_to_string(list_filter({NAMES}[n + 1:], lambda x: x IN ('auxTrigger0', 'I2CData')), ',') AS lost_events FROM s WHERE n < 5
""")
def lost_keys(spark, d):
    counts = sweep.signature_counts(sweep.signatures(headers(spark, d, cut=True), "text", "page_index"), "page_index")
    return sweep.truncated(counts).select(long(F.size("signature")).alias("n_keys"), F.array_join("lost_events", ",").alias("lost_events"))


@query("""
SELECT 'gain' || (user_id % 3) AS key, min(event_id) AS first_page, count(*) AS n_pages FROM events WHERE user_id % 4 = 1 GROUP BY 1
""")
def unknown_keys(spark, d):
    return sweep.unknown_keys(headers(spark, d, extra=True), "text", "page_index").select("key", "first_page", "n_pages")


@query("SELECT 'gain' || (user_id % 3) AS key, min(event_id) || '=x' AS value FROM events WHERE user_id % 4 = 1 GROUP BY 1")
def unknown_first_value(spark, d):
    return sweep.unknown_keys(headers(spark, d, extra=True), "text", "page_index").select("key", "value")


@query("SELECT event_id AS page_index, event_id AS frame_number, epoch_us(ts)::DOUBLE AS frame_timestamp_s, CAST(user_id % 2 AS TINYINT) AS end_of_acquisition, CAST(-1 AS INTEGER) AS acquisition_number, CAST(0 AS SMALLINT) AS n_aux0 FROM events")
def frames_table(spark, d):
    pages = headers(spark, d).select("page_index", F.col("text").alias("description"), F.lit(0).alias("file_index"))
    return sweep.frames(pages, 1, 1, 1, 1).select("page_index", "frame_number", "frame_timestamp_s", "end_of_acquisition", "acquisition_number", "n_aux0")


@query("""
SELECT event_id AS page_index, CAST(i AS INTEGER) AS event_pos, CASE i WHEN 0 THEN event_id + 0.5 ELSE event_id * 1000.0 END::DOUBLE AS timestamp_s FROM events, (SELECT unnest([0, 1]) AS i) WHERE user_id % 2 = 0
""")
def render_parse_aux(spark, d):
    text = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("[ "), "page_index", F.lit(".5,  "), "page_index", F.lit("e3 oops]"))).otherwise("[]")
    rows = clock(spark, d, "user_id").select("page_index", text.alias("text")).where("text <> '[]'")
    return rows.select("page_index", F.posexplode(parse.aux_trigger(F.col("text"))).alias("event_pos", "timestamp_s"))


@query("""
SELECT event_id AS page_index, CAST(i AS INTEGER) AS event_pos, CASE i WHEN 0 THEN event_id + 0.25 ELSE event_id::DOUBLE END AS timestamp_s,
 CASE i WHEN 0 THEN 'text' ELSE 'bytes' END AS payload_kind, CAST(CASE i WHEN 0 THEN length(event_type) + 3 ELSE 3 END AS INTEGER) AS payload_length
FROM events, (SELECT unnest([0, 1]) AS i)
""")
def render_parse_i2c(spark, d):
    text = F.concat(F.lit("{{"), "page_index", F.lit(".25, '"), "event_type", F.lit("_12'} {"), "page_index", F.lit(", [1 2 255]}}"))
    rows = clock(spark, d, "event_type").select("page_index", F.posexplode(parse.i2c_packets(text)).alias("event_pos", "p"))
    return rows.select("page_index", "event_pos", "p.timestamp_s", "p.payload_kind", parse.payload_length(F.col("p")).alias("payload_length"))


@query("SELECT user_id, CAST(count(*) FILTER (user_id % 2 = 0) * 2 AS BIGINT) AS n_triggers FROM events GROUP BY 1")
def page_counts(spark, d):
    text = F.when(F.col("user_id") % 2 == 0, F.lit("[0.5 1.5]")).otherwise("[]")
    rows = clock(spark, d, "user_id").select("user_id", F.when(text == "[]", 0).otherwise(F.size(parse.aux_trigger(text))).alias("n"))
    return rows.groupBy("user_id").agg(F.sum("n").alias("n_triggers"))


@query("SELECT event_id, event_type AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 997 = 0)")
def key_value_decode(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 997 == 0, "no number").otherwise(F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k")))
    rows = e.select("event_id", "user_id", F.lit("text").alias("payload_kind"), text.alias("text"))
    found, _ = events.key_values(rows, "payload_kind", "text", ["user_id"])
    return found.select("event_id", "key", "value")


@query("SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def payload_text(spark, d):
    return table(spark, d, "documents").select("doc_id", long(F.char_length("text")).alias("n_chars"), long(F.octet_length("text")).alias("n_bytes"))


@query("""
SELECT event_type, count(*) AS n_packets, CASE WHEN count(*) FILTER (event_id % 2 = 0 OR event_type = 'click') = count(*) THEN 'text'
 WHEN count(*) FILTER (event_id % 2 = 0 OR event_type = 'click') = 0 THEN 'bytes' ELSE 'mixed' END AS payload_kind FROM events GROUP BY 1
""")
def payload_kind(spark, d):
    rows = table(spark, d, "events").withColumn("payload_kind", F.when((F.col("event_id") % 2 == 0) | (F.col("event_type") == "click"), "text").otherwise("bytes"))
    return events.payload_kinds(rows, ["event_type"])


@query("""
WITH r AS (SELECT conv_id, turn, strlen(role) AS n, role FROM conversations), w AS (SELECT max(n) AS w FROM r)
SELECT conv_id, turn, CAST(w AS INTEGER) AS width, hex(role) || repeat('00', (w - n)::INTEGER) AS padded FROM r, w
""")
def payload_matrix(spark, d):
    raw = F.transform(F.sequence(F.lit(1), F.octet_length("role")), lambda i: F.conv(F.substring(F.hex("role"), i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    rows = events.payload_matrix(table(spark, d, "conversations").where("role IS NOT NULL").select("conv_id", "turn", raw.alias("data")), "data")
    return rows.select("conv_id", "turn", F.size("padded").alias("width"), F.array_join(F.transform("padded", lambda v: F.lpad(F.hex(v), 2, "0")), "").alias("padded"))


@query("SELECT doc_id, text, length(text) > 0 AS decoded FROM documents WHERE text IS NOT NULL")
def payload_decode(spark, d):
    raw = F.transform(F.regexp_extract_all(F.hex("text"), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit("bytes").alias("payload_kind"), F.lit(None).cast("string").alias("text"), raw.alias("data"))
    return events.decode_payloads(rows).select("doc_id", "text", "decoded")


@query("""
SELECT event_id, user_id % 5 <> 0 AS valid, CASE WHEN user_id % 5 = 0 THEN -epoch_us(ts) ELSE epoch_us(ts) END::DOUBLE AS timestamp_s, CAST(length(event_type) AS INTEGER) AS payload_length FROM events
""")
def valid_packets(spark, d):
    t = F.when(F.col("user_id") % 5 == 0, -F.col("ts_us")).otherwise(F.col("ts_us")).cast("double")
    rows = clock(spark, d, "user_id", "event_type").select(F.col("page_index").alias("event_id"), t.alias("timestamp_s"), F.char_length("event_type").alias("payload_length"))
    return rows.withColumn("valid", parse.is_valid_time(F.col("timestamp_s")))


@query("SELECT event_type, CAST(count(*) FILTER (user_id % 5 <> 0) AS BIGINT) AS n_valid FROM events GROUP BY 1")
def manifest_counts(spark, d):
    t = F.when(F.col("user_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("ts_us").cast("double"))
    return clock(spark, d, "user_id", "event_type").groupBy("event_type").agg(F.count_if(parse.is_valid_time(t)).alias("n_valid"))


@query("""
SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)
""")
def empty_lines(spark, d):
    e = table(spark, d, "events")
    return events.missing_lines(e, ["user_id"], "event_type", e.select("event_type").distinct())


@query("""
WITH a AS (SELECT event_type, list(event_id ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT event_type, array_to_string(l[1:10], ',') AS first_pages FROM a
""")
def first_affected(spark, d):
    return qc.first_pages(table(spark, d, "events"), ["event_type"], "event_id").select("event_type", F.array_join("first_pages", ",").alias("first_pages"))


# --- scalars ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality = 1 AS good, toxic = 1 AS bad FROM labels")
def bool_parse(spark, d):
    text = F.when(F.col("quality") == 1, " Yes").when(F.col("quality") == 0, "FALSE")
    return table(spark, d, "labels").select("doc_id", parse.bool_of(text).alias("good"), parse.bool_of(F.col("toxic").cast("string")).alias("bad"))


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate) + INTERVAL 1 MINUTE + INTERVAL 125 MILLISECOND AS epoch FROM orders")
def epoch_parse(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    text = F.concat(F.lit("["), f("yyyy"), F.lit("  "), f("M"), F.lit(" "), f("d"), F.lit(", "), f("H"), F.lit(" "), f("m"), F.lit(" 60.125]"))
    return table(spark, d, "orders").select("o_orderkey", parse.epoch(text).alias("epoch"))


@query("""
SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN -1 ELSE -1 END AS BIGINT) AS as_int,
 CASE p_size % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.75 WHEN 2 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS as_float FROM part
""")
def scalar_casts(spark, d):
    k = F.col("p_size") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), "p_size")).when(k == 1, F.concat("p_size", F.lit(".75"))).when(k == 2, "Inf").otherwise(F.concat("p_size", F.lit("d")))
    return table(spark, d, "part").select("p_partkey", parse.to_int(text, -1).alias("as_int"), parse.to_float(text).alias("as_float"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'si ' || n_name ELSE 'none' END AS value, CASE WHEN n_nationkey % 2 = 0 THEN '2022.1' ELSE '2022' END AS version FROM nation")
def header_get(spark, d):
    key = F.when(F.col("n_nationkey") % 3 == 0, "name").when(F.col("n_nationkey") % 3 == 1, "SI.name").otherwise("other")
    value = F.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("si "), "n_name")).otherwise(F.col("n_name"))
    h = F.create_map(key, value, F.lit("SI.VERSION_MAJOR"), F.lit("2022"), F.when(F.col("n_nationkey") % 2 == 0, "SI.VERSION_MINOR").otherwise("unused"), F.lit("1"))
    return table(spark, d, "nation").select("n_nationkey", h.alias("h")).select("n_nationkey", parse.header_get(F.col("h"), "name", "none").alias("value"), parse.si_version(F.col("h")).alias("version"))


@query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '"Infinity"' WHEN 1 THEN '"-Infinity"' WHEN 2 THEN '"NaN"' ELSE CAST(c_nationkey AS VARCHAR) || '.0' END AS json FROM customer
""")
def nonfinite_json(spark, d):
    k, inf = F.col("c_custkey") % 7, float("inf")
    v = F.when(k == 0, F.lit(inf)).when(k == 1, F.lit(-inf)).when(k == 2, F.lit(float("nan"))).otherwise(F.col("c_nationkey").cast("double"))
    return table(spark, d, "customer").select("c_custkey", parse.json_number(v).alias("json"))


@query("SELECT p_partkey, regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS key FROM part")
def safe_key(spark, d):
    return table(spark, d, "part").select("p_partkey", parse.safe_key(F.concat("p_type", F.lit("/"), "p_brand")).alias("key"))


@query("""
WITH k AS (SELECT r_name AS key FROM region UNION ALL SELECT r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT key, CASE WHEN EXISTS (SELECT 1 FROM k z WHERE starts_with(z.key, k.key || '.')) THEN key || '._value' ELSE key END AS path FROM k
""")
def nested_keys(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    keys = r.select(F.col("r_name").alias("key")).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("."), "n_name").alias("key")))
    return files.nested_paths(keys, "key").select("key", "path")


@query("SELECT n_nationkey, 'zs = ' || n_nationkey || chr(10) || 'rate = 7.5' || chr(10) || n_name AS text FROM nation")
def header_override(spark, d):
    lines = F.array(F.concat(F.lit("zs = "), "n_nationkey"), F.lit("rate = 30"), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(files.overridden(lines, {"rate": "7.5", "absent": "1"}), "\n").alias("text"))


@query("""
WITH h AS (SELECT n_nationkey, n_nationkey % 4 <> 0 AS enabled, NULLIF(n_nationkey % 5, 4) AS slices, NULLIF(n_regionkey % 3, 2) AS fps, n_nationkey * 7 AS n_pages, 1 + n_nationkey % 2 AS nch FROM nation),
 k AS (SELECT *, slices AS kept, CASE WHEN n_nationkey % 3 <> 0 THEN slices + n_nationkey % 7 - 1 END AS given FROM h),
 f AS (SELECT *, CASE WHEN given IS NULL OR given = 0 THEN kept ELSE given END AS disk, greatest(coalesce(fps, 1), 1) AS each FROM k),
 w AS (SELECT *, CASE WHEN NOT enabled THEN CASE WHEN n_pages > 0 AND nch > n_pages THEN 'too long' END WHEN coalesce(slices, 0) = 0 OR coalesce(kept, 0) = 0 THEN 'missing'
  WHEN kept < 1 OR kept > disk THEN 'inconsistent frames' WHEN slices * each <> kept THEN 'inconsistent slices' WHEN n_pages > 0 AND disk * nch > n_pages THEN 'too long' END AS warning FROM f),
 g AS (SELECT *, enabled AND warning IS NULL AS v FROM w)
SELECT n_nationkey, v AS volumetric, warning, CAST(CASE WHEN v THEN slices ELSE 1 END AS BIGINT) AS n_slices, CAST((CASE WHEN v THEN disk ELSE 1 END) * nch AS BIGINT) AS pages_per_volume,
 CAST((CASE WHEN v THEN disk - kept ELSE 0 END) AS BIGINT) AS flyback_frames, CAST(n_pages // ((CASE WHEN v THEN disk ELSE 1 END) * nch) AS BIGINT) AS n_volumes FROM g
""")
def geometry_plan(spark, d):
    """Stacks with counts missing one by one, and such as contradict each other."""
    k = F.col("n_nationkey")
    s = F.nullif(k % 5, F.lit(4))
    disk, fps = F.when(k % 3 != 0, s + k % 7 - 1), F.nullif(F.col("n_regionkey") % 3, F.lit(2))
    rows = table(spark, d, "nation").select("n_nationkey", (k % 4 != 0).alias("enabled"), s.alias("slices"), s.alias("kept"), disk.alias("disk"), fps.alias("fps"), (1 + k % 2).alias("nch"), (k * 7).alias("n_pages"))
    return files.plan_layout(rows, "enabled", "slices", "kept", "disk", "fps", "nch", "n_pages").select("n_nationkey", "volumetric", "warning", "n_slices", "pages_per_volume", "flyback_frames", "n_volumes")


# --- pixels -------------------------------------------------------------------------------------------------


def planes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, avg(l_quantity) AS mean FROM lineitem GROUP BY 1")
def project_mean(spark, d):
    return pixels.project(planes(spark, d), ["l_orderkey"], "l_quantity", ["mean"])


@query("SELECT l_orderkey, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def project_max(spark, d):
    return pixels.project(planes(spark, d), ["l_orderkey"], "l_extendedprice", ["max"])


@query("SELECT l_orderkey, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def project_std(spark, d):
    return pixels.project(planes(spark, d), ["l_orderkey"], "l_quantity", ["std"]).withColumn("std", F.round("std", 6))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, round(avg(q), 6) AS mean, round(max(q), 6) AS max FROM p GROUP BY 1
""")
def project_repeats_average(spark, d):
    rows = pixels.project(planes(spark, d), ["l_orderkey"], "l_quantity", ["mean", "max"], ["l_linenumber"], average_repeats=True)
    return rows.select("l_orderkey", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query("""
WITH x AS (SELECT vec_id // 4 AS volume, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id % 4 < 3)
SELECT CAST(volume AS BIGINT) AS volume, CAST(pos AS INTEGER) AS pos, round(avg(v::DOUBLE), 6) AS mean, max(v::DOUBLE) AS max FROM x GROUP BY 1, 2
""")
def project_image(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id % 4 < 3").select(F.expr("vec_id div 4").alias("volume"), F.col("embedding").cast("array<double>").alias("p"))
    found = pixels.project(pixels.exploded(rows, ["volume"], "p"), ["volume", "pos"], "value", ["mean", "max"])
    return found.select("volume", "pos", F.round("mean", 6).alias("mean"), "max")


@query("""
WITH x AS (SELECT vec_id // 4 AS volume, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id % 4 < 3)
SELECT CAST(volume AS BIGINT) AS volume, CAST(pos AS INTEGER) AS pos, round(avg(v::DOUBLE), 6) AS mean, round(stddev_pop(v::DOUBLE), 6) AS std FROM x GROUP BY 1, 2
""")
def project_image_arrays(spark, d):
    """As ``project_image``, by whole arrays with sums in each task: the way for large images."""
    rows = table(spark, d, "embeddings").where("vec_id % 4 < 3").select(F.expr("vec_id div 4").alias("volume"), F.col("embedding"))
    found = pixels.project_images(rows, ["volume"], "embedding", ["mean", "std"])
    return found.select("volume", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "x")).select("volume", "pos", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(greatest(-32768, least(32767, round_even(l_extendedprice, 0))) AS SMALLINT) AS pixel FROM lineitem")
def project_cast_int16(spark, d):
    return planes(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", parse.cast_pixels(F.col("l_extendedprice"), "int16").alias("pixel"))


@query("""
WITH x AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT CAST(pos AS INTEGER) AS pos, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY 1
""")
def average_projection(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("p"))
    return pixels.project(pixels.exploded(rows, [], "p"), ["pos"], "value", ["mean"]).select("pos", F.round("mean", 6).alias("mean"))


@query("""
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, CAST(pos % 8 AS INTEGER) AS x, min(v::DOUBLE) AS value FROM x WHERE pos >= 16 AND pos < 48 GROUP BY 1, 2
""")
def band_min_profile(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return pixels.band_profile(rows, ["vec_id"], "p", 8, 8)


@query("""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
 p AS (SELECT vec_id, round(quantile_cont(v, 0.005), 6) AS lo, round(quantile_cont(v, 0.995), 6) AS hi FROM x GROUP BY 1)
SELECT x.vec_id, CAST(pos AS INTEGER) AS pos, CAST(floor(greatest(0, least(1, (v - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo))) * 255) AS INTEGER) AS pixel FROM x JOIN p ON x.vec_id = p.vec_id
""")
def contrast_stretch(spark, d):
    rows = pixels.exploded(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p")), ["vec_id"], "p")
    p = rows.groupBy("vec_id").agg(F.round(F.percentile("value", 0.005), 6).alias("lo"), F.round(F.percentile("value", 0.995), 6).alias("hi"))
    return rows.join(p, "vec_id").select("vec_id", "pos", pixels.stretch(F.col("value"), F.col("lo"), F.col("hi")).alias("pixel"))


@query("""
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), a AS (SELECT e.event_type, m, median(abs(value - m)) AS mad FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1, 2)
SELECT event_id, e.event_type, value FROM events e JOIN a ON e.event_type = a.event_type WHERE mad = 0 OR abs(0.6745 * (value - m) / mad) <= 3.5
""")
def mad_outliers(spark, d):
    return pixels.keep_inliers(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 3)")
def plane_selection(spark, d):
    return planes(spark, d).where(F.col("l_linenumber").isin(sorted({3, 1, 3}))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, max(l_quantity) AS max FROM lineitem WHERE l_orderkey < 250 GROUP BY 1")
def limit_volumes(spark, d):
    """The limit is a filter on the volume, so it reaches the scan."""
    return pixels.project(planes(spark, d).where("l_orderkey < 250"), ["l_orderkey"], "l_quantity", ["max"])


# --- calibration --------------------------------------------------------------------------------------------

GRID = "SELECT p_size AS zoom, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis, p_retailprice AS um, p_partkey % 9 + 5 AS peaks, 256 * (1 + p_partkey % 3) AS res FROM part"


def grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_size").alias("zoom"), F.when(k % 2 == 0, "x").otherwise("y").alias("axis"), F.col("p_retailprice").alias("um"), (k % 9 + 5).alias("peaks"), (256 * (1 + k % 3)).alias("res"))


@query(f"""
WITH g AS ({GRID}) SELECT zoom, round(avg(um) FILTER (axis = 'x'), 6) AS px_to_micron_x, round(avg(um) FILTER (axis = 'y'), 6) AS px_to_micron_y, round(1 / avg(um) FILTER (axis = 'x'), 9) AS micron_to_px_x,
 CAST(round_even(avg(peaks) FILTER (axis = 'x'), 0) AS INTEGER) AS n_peaks_x, CAST(round_even(avg(peaks) FILTER (axis = 'y'), 0) AS INTEGER) AS n_peaks_y FROM g GROUP BY 1
""")
def calibration_table(spark, d):
    rows = calibrate.calibration_table(grid(spark, d), "zoom", "axis", "um", "peaks", "res")
    return rows.select("zoom", F.round("px_to_micron_x", 6).alias("px_to_micron_x"), F.round("px_to_micron_y", 6).alias("px_to_micron_y"), F.round("micron_to_px_x", 9).alias("micron_to_px_x"), "n_peaks_x", "n_peaks_y")


@query(f"""
WITH g AS ({GRID}) SELECT zoom, CAST(round_even(avg(DISTINCT res) FILTER (axis = 'x'), 0) AS INTEGER) AS resolution_px_x, CAST(round_even(avg(DISTINCT res) FILTER (axis = 'y'), 0) AS INTEGER) AS resolution_px_y FROM g GROUP BY 1 ORDER BY 1
""")
def calibration_sorted(spark, d):
    return calibrate.calibration_table(grid(spark, d), "zoom", "axis", "um", "peaks", "res").select("zoom", "resolution_px_x", "resolution_px_y").orderBy("zoom")


@query("""
WITH k AS (SELECT p_size::DOUBLE AS z, min(p_retailprice) AS v FROM part GROUP BY 1), s AS (SELECT z, v, lead(z) OVER (ORDER BY z) AS z1, lead(v) OVER (ORDER BY z) AS v1 FROM k), t AS (SELECT unnest(range(0, 56)) + 0.5::DOUBLE AS zoom)
SELECT t.zoom, round(CASE WHEN t.zoom = z THEN v ELSE v + (v1 - v) * (t.zoom - z) / (z1 - z) END, 6) AS value FROM t LEFT JOIN s ON t.zoom >= z AND (t.zoom < z1 OR (z1 IS NULL AND t.zoom = z))
""")
def calibration_interp(spark, d):
    knots = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("z")).agg(F.min("p_retailprice").alias("v"))
    targets = spark.range(56).select((F.col("id") + 0.5).cast("double").alias("zoom"))
    return calibrate.interpolate(targets, knots, "zoom", "z", "v").select("zoom", F.round("value", 6).alias("value"))


@query("SELECT p_partkey, CAST(greatest(1, round_even(50 / (p_retailprice / 100), 0)) AS BIGINT) AS bar_px FROM part")
def scale_bar_px(spark, d):
    return table(spark, d, "part").select("p_partkey", parse.bar_length_px(F.lit(50.0), F.col("p_retailprice") / 100).alias("bar_px"))


# --- quality control ----------------------------------------------------------------------------------------


@query("""
WITH i AS (SELECT user_id, event_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dv FROM events),
 m AS (SELECT user_id, median(d) AS m FROM i WHERE d IS NOT NULL GROUP BY 1), j AS (SELECT i.user_id, max(abs(d / m - 1)) AS w FROM i JOIN m ON i.user_id = m.user_id WHERE m > 0 AND d IS NOT NULL GROUP BY 1)
SELECT user_id, 'error' AS level, 'frame_number_gaps' AS code, CAST(sum(g - 1) FILTER (g > 1) AS BIGINT) AS n FROM i GROUP BY 1 HAVING count(*) FILTER (g > 1) > 0
UNION ALL SELECT user_id, 'warning', 'aux_not_monotonic', CAST(count(*) FILTER (dv < 0) AS BIGINT) FROM i GROUP BY 1 HAVING count(*) FILTER (dv < 0) > 0
UNION ALL SELECT user_id, CASE WHEN w >= 0.1 THEN 'error' ELSE 'warning' END, 'timestamp_jitter', CAST(1 AS BIGINT) FROM j WHERE w >= 0.01
UNION ALL SELECT user_id, 'warning', 'partial_volume', CAST(count(*) % 7 AS BIGINT) FROM events GROUP BY 1 HAVING count(*) % 7 <> 0
""")
def qc_report(spark, d):
    rows = clock(spark, d, "user_id", "value").withColumn("recording_id", F.col("user_id"))
    found = [
        qc.frame_number_gaps(rows, ["recording_id"], "page_index"),
        qc.aux_not_monotonic(rows, ["recording_id"], "page_index", "value"),
        qc.timestamp_jitter(rows, ["recording_id"], "page_index", "ts_us"),
        qc.partial_volume(rows, ["recording_id"], 7),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("recording_id").alias("user_id"), "level", "code", "n")


def _findings(found: DataFrame) -> DataFrame:
    return found.select(F.col("recording_id").alias("user_id"), "level", "code", "n")


def _recordings(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return clock(spark, d, "user_id", "value", *more).withColumn("recording_id", F.col("user_id"))


@query("SELECT user_id, 'warning' AS level, 'frame_number_missing' AS code, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def qc_frame_number_missing(spark, d):
    rows = _recordings(spark, d).withColumn("number", F.when(F.col("page_index") % 3 == 0, -1).otherwise(F.col("page_index")))
    return _findings(qc.frame_number_missing(rows, ["recording_id"], "number"))


@query("""
WITH k AS (SELECT user_id, event_id // 7 AS number, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, 'warning' AS level, 'frame_number_repeats' AS code, count(*) AS n FROM k WHERE c <> 2 GROUP BY 1
""")
def qc_frame_number_repeats(spark, d):
    rows = _recordings(spark, d).withColumn("number", F.expr("page_index div 7"))
    return _findings(qc.frame_number_repeats(rows, ["recording_id"], "number", 2))


@query("SELECT user_id, 'warning' AS level, 'timestamp_unreadable' AS code, count(*) AS n FROM events WHERE event_id % 50 = 0 GROUP BY 1")
def qc_timestamp_unreadable(spark, d):
    rows = _recordings(spark, d).withColumn("t", F.when(F.col("page_index") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("ts_us").cast("double")))
    return _findings(qc.timestamp_unreadable(rows, ["recording_id"], "t"))


@query("SELECT user_id, 'error' AS level, 'timestamp_negative' AS code, count(*) AS n FROM events WHERE event_id % 40 = 1 GROUP BY 1")
def qc_timestamp_negative(spark, d):
    rows = _recordings(spark, d).withColumn("t", F.when(F.col("page_index") % 40 == 1, F.lit(-1.0)).otherwise(F.col("ts_us").cast("double")))
    return _findings(qc.timestamp_negative(rows, ["recording_id"], "t"))


@query("""
WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
SELECT user_id, 'error' AS level, 'timestamp_not_monotonic' AS code, count(*) AS n FROM s WHERE s <= 0 GROUP BY 1
""")
def qc_timestamp_not_monotonic(spark, d):
    return _findings(qc.timestamp_not_monotonic(_recordings(spark, d), ["recording_id"], "page_index", "value"))


@query("SELECT user_id, 'info' AS level, 'no_end_of_acquisition' AS code, CAST(0 AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 11 = 0) = 0")
def qc_no_end_of_acquisition(spark, d):
    rows = _recordings(spark, d).withColumn("end", F.when(F.col("page_index") % 11 == 0, 1).otherwise(0))
    return _findings(qc.no_end_of_acquisition(rows, ["recording_id"], "end"))


@query("SELECT user_id, 'warning' AS level, 'dc_over_voltage' AS code, count(*) AS n FROM events WHERE event_id % 13 = 0 GROUP BY 1")
def qc_dc_over_voltage(spark, d):
    rows = _recordings(spark, d).withColumn("over", F.when(F.col("page_index") % 13 == 0, 1).otherwise(0))
    return _findings(qc.dc_over_voltage(rows, ["recording_id"], "over"))


@query("SELECT user_id, 'warning' AS level, 'aux_negative_timestamp' AS code, count(*) AS n FROM events WHERE value < 20 GROUP BY 1")
def qc_aux_negative_timestamp(spark, d):
    return _findings(qc.aux_negative_timestamp(_recordings(spark, d).withColumn("t", F.col("value") - 20), ["recording_id"], "t"))


@query("SELECT user_id, 'warning' AS level, 'i2c_invalid_timestamp' AS code, count(*) AS n FROM events WHERE event_id % 9 < 2 GROUP BY 1")
def qc_i2c_invalid_timestamp(spark, d):
    k = F.col("page_index") % 9
    rows = _recordings(spark, d).withColumn("t", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(-1.0)).otherwise(F.col("ts_us").cast("double")))
    return _findings(qc.i2c_invalid_timestamp(rows, ["recording_id"], "t"))


@query(f"""
WITH s AS (SELECT user_id % 7 AS g, {CUT} AS n, count(*) AS c FROM events GROUP BY 1, 2), m AS (SELECT g, max(n) AS m FROM s GROUP BY 1)
SELECT s.g AS user_id, CASE WHEN max(len(list_filter({NAMES}[n + 1:m], lambda x: x IN ('auxTrigger0', 'I2CData')))) > 0 THEN 'error' ELSE 'warning' END AS level, 'truncated_page_header' AS code, CAST(sum(c) AS BIGINT) AS n
FROM s JOIN m ON s.g = m.g WHERE n < m GROUP BY 1
""")
def qc_truncated_page_header(spark, d):
    rows = headers(spark, d, cut=True).withColumn("recording_id", F.col("user_id") % 7)
    counts = sweep.signature_counts(sweep.signatures(rows, "text", "page_index", ["recording_id"]), "page_index", ["recording_id"])
    return _findings(qc.truncated_page_header(counts, ["recording_id"]))


@query("""
SELECT user_id % 7 AS user_id, 'warning' AS level, 'page_header_drift' AS code, count(DISTINCT user_id % 3) AS n FROM events WHERE user_id % 4 = 1 GROUP BY 1 HAVING count(DISTINCT user_id % 3) > 1
""")
def qc_page_header_drift(spark, d):
    """Sets of keys that differ in a key at their ends; the plain one is a beginning of the first of them."""
    rows = headers(spark, d, extra=True).withColumn("recording_id", F.col("user_id") % 7)
    counts = sweep.signature_counts(sweep.signatures(rows, "text", "page_index", ["recording_id"]), "page_index", ["recording_id"])
    return _findings(qc.page_header_drift(counts, ["recording_id"]))


@query("SELECT user_id % 7 AS user_id, 'info' AS level, 'unknown_page_keys' AS code, count(DISTINCT user_id % 3) AS n FROM events WHERE user_id % 4 = 1 GROUP BY 1")
def qc_unknown_page_keys(spark, d):
    rows = headers(spark, d, extra=True).withColumn("recording_id", F.col("user_id") % 7)
    return _findings(qc.unknown_page_keys(sweep.unknown_keys(rows, "text", "page_index", ["recording_id"]), ["recording_id"]))
