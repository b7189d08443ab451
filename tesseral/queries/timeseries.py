"""Patterns for data quality and time: calendars, islands, sessions, cohorts, funnels, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesseral.operators import patterns
from tesseral.queries.base import Book
from tesseral.session import scratch
from tesseral.sources.readers import table

B = Book()
QUERIES, ORACLE = B.queries, B.oracle


@B.df("zero_fill_days", "WITH n AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM n) LEFT JOIN n USING (day)")
def zero_fill_days(spark, d):
    counts = table(spark, d, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return patterns.fill_days(counts, "day")


B.sql(
    "missing_days",
    "WITH s AS (SELECT event_id, explode(sequence(min(snapshot_date), max(snapshot_date))) AS day FROM seat_inventory WHERE event_id IS NOT NULL GROUP BY event_id) SELECT s.event_id, s.day FROM s LEFT ANTI JOIN seat_inventory i ON i.event_id = s.event_id AND i.snapshot_date = s.day",
    "WITH s AS (SELECT event_id, unnest(generate_series(min(snapshot_date), max(snapshot_date), INTERVAL 1 DAY))::DATE AS day FROM seat_inventory WHERE event_id IS NOT NULL GROUP BY event_id) SELECT event_id, day FROM s WHERE NOT EXISTS (SELECT 1 FROM seat_inventory i WHERE i.event_id = s.event_id AND i.snapshot_date = s.day)",
)


@B.df("islands", "WITH x AS (SELECT DISTINCT event_id, snapshot_date AS d FROM seat_inventory WHERE snapshot_date IS NOT NULL), y AS (SELECT *, d - (row_number() OVER (PARTITION BY event_id ORDER BY d))::INT AS g FROM x) SELECT event_id, min(d) AS start_day, max(d) AS end_day, count(*) AS n_days FROM y GROUP BY event_id, g")
def islands(spark, d):
    return patterns.islands(table(spark, d, "seat_inventory"), ["event_id"], "snapshot_date")


@B.df("sessionize", "WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) SELECT user_id, s::BIGINT AS session_no, count(*) AS n, max(value) AS top FROM y GROUP BY ALL")
def sessionize(spark, d):
    rows = patterns.sessions(table(spark, d, "events"), "user_id", "ts", ["event_id"], 6 * 3600)
    return rows.groupBy("user_id", F.col("session_no").cast("long").alias("session_no")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@B.df("cohort_conversion", "WITH c AS (SELECT customer_id, min(signup_date) AS j FROM customers WHERE signup_date IS NOT NULL GROUP BY 1), h AS (SELECT DISTINCT customer_id FROM c JOIN ticket_orders USING (customer_id) WHERE order_ts::DATE - j BETWEEN 0 AND 365) SELECT strftime(j, '%Y-%m') AS cohort, count(*) AS members, count(h.customer_id) AS converted FROM c LEFT JOIN h USING (customer_id) GROUP BY 1")
def cohort_conversion(spark, d):
    first = table(spark, d, "customers").where("signup_date is not null").groupBy("customer_id").agg(F.min("signup_date").alias("joined"))
    acts = table(spark, d, "ticket_orders").select("customer_id", F.to_date("order_ts").alias("acted"))
    return patterns.cohorts(first, acts, "customer_id", "joined", "acted", 365)


@B.df("duplicates", "SELECT order_id, line_no, count(*) AS n_rows FROM order_items GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return patterns.duplicates(table(spark, d, "order_items"), ["order_id", "line_no"])


@B.df("above_watermark", "SELECT order_id, order_ts::DATE AS day FROM ticket_orders WHERE order_ts > (SELECT max(refund_ts) FROM refunds WHERE refund_ts < TIMESTAMP '2026-01-01')")
def above_watermark(spark, d):
    loaded = table(spark, d, "refunds").where("refund_ts < timestamp'2026-01-01'").select(F.col("refund_ts").alias("order_ts"))
    return patterns.above_watermark(table(spark, d, "ticket_orders").select("order_id", "order_ts"), loaded, "order_ts").select("order_id", F.to_date("order_ts").alias("day"))


B.sql("orphans", "SELECT r.refund_id, r.order_id FROM refunds r LEFT ANTI JOIN ticket_orders o ON o.order_id = r.order_id", "SELECT refund_id, order_id FROM refunds r WHERE NOT EXISTS (SELECT 1 FROM ticket_orders o WHERE o.order_id = r.order_id)")
B.sql(
    "sla_report",
    "SELECT method, count(*) AS n, count_if(paid_ts <= o.order_ts + INTERVAL 1 DAY) AS in_time, round(avg((unix_timestamp(paid_ts) - unix_timestamp(o.order_ts)) / 3600), 3) AS hours FROM payments p JOIN (SELECT order_id, min(order_ts) AS order_ts FROM ticket_orders GROUP BY order_id) o ON o.order_id = p.order_id WHERE paid_ts > TIMESTAMP'1970-01-02 00:00:00' GROUP BY method",
    "SELECT method, count(*) AS n, count_if(paid_ts <= o.order_ts + INTERVAL 1 DAY)::BIGINT AS in_time, round(avg((floor(epoch_us(paid_ts) / 1e6) - floor(epoch_us(o.order_ts) / 1e6)) / 3600), 3) AS hours FROM payments p JOIN (SELECT order_id, min(order_ts) AS order_ts FROM ticket_orders GROUP BY order_id) o ON o.order_id = p.order_id WHERE paid_ts > TIMESTAMP '1970-01-02' GROUP BY method",
)
B.sql("weekday_pattern", "SELECT date_format(order_ts, 'EEEE') AS weekday, weekday(order_ts) AS k, count(*) AS n FROM ticket_orders WHERE order_ts IS NOT NULL GROUP BY 1, 2", "SELECT dayname(order_ts) AS weekday, (isodow(order_ts) - 1)::INT AS k, count(*) AS n FROM ticket_orders WHERE order_ts IS NOT NULL GROUP BY 1, 2")
B.sql("funnel", "WITH stages AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase')) AS t(step, kind)), u AS (SELECT event_type AS kind, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT step, kind, coalesce(users, 0) AS users, round(try_divide(coalesce(users, 0), lag(coalesce(users, 0)) OVER (ORDER BY step)), 4) AS ratio FROM stages LEFT JOIN u USING (kind)", "WITH stages AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase')) AS t(step, kind)), u AS (SELECT event_type AS kind, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT step, kind, coalesce(users, 0) AS users, round(coalesce(users, 0)::DOUBLE / nullif(lag(coalesce(users, 0)) OVER (ORDER BY step), 0), 4) AS ratio FROM stages LEFT JOIN u USING (kind)")
B.sql("month_growth", "SELECT q, CAST(pieces AS BIGINT) AS pieces, round(pieces / lag(pieces, 4) OVER (ORDER BY q), 6) AS on_year FROM (SELECT trunc(l_shipdate, 'QUARTER') AS q, sum(l_quantity) AS pieces FROM lineitem GROUP BY ALL)", "SELECT q, pieces::BIGINT AS pieces, round(pieces / lag(pieces, 4) OVER (ORDER BY q), 6) AS on_year FROM (SELECT date_trunc('quarter', l_shipdate)::DATE AS q, sum(l_quantity) AS pieces FROM lineitem GROUP BY 1)")
B.sql("gap_between_rows", "SELECT o_custkey, round(avg(gap), 4) AS mean_gap FROM (SELECT o_custkey, datediff(o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS gap FROM orders) GROUP BY o_custkey HAVING count(gap) >= 3", "SELECT o_custkey, round(avg(gap), 4) AS mean_gap FROM (SELECT o_custkey, o_orderdate::DATE - (lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DATE AS gap FROM orders) GROUP BY o_custkey HAVING count(gap) >= 3")
B.sql("value_changes", "SELECT order_id, n FROM (SELECT order_id, count_if(quantity IS DISTINCT FROM before AND k > 1) AS n FROM (SELECT order_id, quantity, lag(quantity) OVER (PARTITION BY order_id ORDER BY line_no) AS before, row_number() OVER (PARTITION BY order_id ORDER BY line_no) AS k FROM (SELECT DISTINCT order_id, line_no, quantity FROM order_items)) GROUP BY order_id) WHERE n > 0", "SELECT order_id, n::BIGINT AS n FROM (SELECT order_id, count_if(quantity IS DISTINCT FROM before AND k > 1) AS n FROM (SELECT order_id, quantity, lag(quantity) OVER (PARTITION BY order_id ORDER BY line_no) AS before, row_number() OVER (PARTITION BY order_id ORDER BY line_no) AS k FROM (SELECT DISTINCT order_id, line_no, quantity FROM order_items)) GROUP BY order_id) WHERE n > 0")
B.sql(
    "clean_contacts",
    r"SELECT host, count(*) AS mails, count(DISTINCT box) AS boxes, count_if(NOT ok) AS bad FROM (SELECT split_part(lower(btrim(email)), '@', -1) AS host, split_part(lower(btrim(email)), '@', 1) AS box, lower(btrim(email)) RLIKE '^[^@\\s]+@[^@\\s]+[.][a-z]{2,}$' AS ok FROM customers WHERE email IS NOT NULL) GROUP BY host",
    r"SELECT host, count(*) AS mails, count(DISTINCT box) AS boxes, count_if(NOT ok)::BIGINT AS bad FROM (SELECT split_part(e, '@', -1) AS host, split_part(e, '@', 1) AS box, regexp_matches(e, '^[^@\s]+@[^@\s]+[.][a-z]{2,}$') AS ok FROM (SELECT lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS e FROM customers WHERE email IS NOT NULL)) GROUP BY host",
)
B.sql("parse_dates", "SELECT doc_id, CAST(coalesce(try_to_timestamp(said, 'yyyyMMdd'), try_to_timestamp(said, 'dd.MM.yyyy'), try_to_timestamp(regexp_extract(said, '[A-Z][a-z]{2} (.*)', 1), 'd MMM yyyy')) AS DATE) AS day FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN date_format(created_ts, 'yyyyMMdd') WHEN 1 THEN date_format(created_ts, 'dd.MM.yyyy') WHEN 2 THEN date_format(created_ts, 'EEE d MMM yyyy') ELSE concat('week ', doc_id) END AS said FROM documents)", "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN created_ts::DATE END AS day FROM documents")
B.sql("referral_timing", "SELECT a.customer_id, b.customer_id AS referrer FROM (SELECT DISTINCT customer_id, referred_by, signup_date FROM customers) a JOIN (SELECT DISTINCT customer_id, signup_date FROM customers) b ON a.referred_by = b.customer_id AND a.signup_date < b.signup_date")
B.sql("net_amounts", "WITH p AS (SELECT order_id, amount FROM payments WHERE order_id IS NOT NULL AND amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id, round(amount, 2) ORDER BY payment_id) = 1), a AS (SELECT order_id, sum(CAST(round(amount, 2) AS DECIMAL(18,2))) AS paid FROM p GROUP BY 1), r AS (SELECT order_id, sum(CAST(round(amount, 2) AS DECIMAL(18,2))) AS back FROM (SELECT DISTINCT refund_id, order_id, amount FROM refunds WHERE order_id IS NOT NULL) GROUP BY 1) SELECT coalesce(a.order_id, r.order_id) AS order_id, CAST(coalesce(paid, 0) - coalesce(back, 0) AS DOUBLE) AS net FROM a FULL OUTER JOIN r ON a.order_id = r.order_id")
B.sql("kpi_capstone", "WITH i AS (SELECT order_id, sum(quantity) AS q FROM (SELECT DISTINCT order_id, line_no, quantity FROM order_items) GROUP BY 1), o AS (SELECT order_id, max(status) AS status, min(order_ts) AS ts, min(channel) AS channel FROM ticket_orders GROUP BY 1) SELECT date_format(ts, 'yyyy-MM') AS month, count(*) AS orders, count_if(status = 'PAID') AS paid, sum(q) FILTER (WHERE status = 'PAID') AS tickets, round(avg(q), 4) AS mean_q FROM o LEFT JOIN i USING (order_id) WHERE ts IS NOT NULL GROUP BY 1", "WITH i AS (SELECT order_id, sum(quantity) AS q FROM (SELECT DISTINCT order_id, line_no, quantity FROM order_items) GROUP BY 1), o AS (SELECT order_id, max(status) AS status, min(order_ts) AS ts, min(channel) AS channel FROM ticket_orders GROUP BY 1) SELECT strftime(ts, '%Y-%m') AS month, count(*) AS orders, count_if(status = 'PAID')::BIGINT AS paid, (sum(q) FILTER (WHERE status = 'PAID'))::BIGINT AS tickets, round(avg(q), 4) AS mean_q FROM o LEFT JOIN i USING (order_id) WHERE ts IS NOT NULL GROUP BY 1")
B.sql("ratio_grain", "SELECT channel, round(avg(t), 6) AS mean_order FROM (SELECT o.channel, o.order_id, sum(i.quantity) AS t FROM (SELECT order_id, min(channel) AS channel FROM ticket_orders GROUP BY 1) o JOIN (SELECT DISTINCT order_id, line_no, quantity FROM order_items) i USING (order_id) GROUP BY 1, 2) GROUP BY channel")


# --- the streaming counterparts, run to the end over what is there

@B.df("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The watermark here is longer than the data, so that no row is late."""
    from tesseral.streaming.pipelines import windowed_counts

    out = windowed_counts(_stream(spark, d, "events"), "ts", ["event_type"], "1 day", late="100000 days")
    return _drained(out, "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@B.df("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    from tesseral.streaming.pipelines import first_seen

    return _drained(first_seen(_stream(spark, d, "events"), "ts", ["user_id", "event_type"], "100000 days").select("user_id", "event_type"), "append")


@B.df("stream_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM y GROUP BY user_id, s")
def stream_sessions(spark, d):
    from tesseral.streaming.pipelines import session_counts

    out = _drained(session_counts(_stream(spark, d, "events"), "ts", "user_id", "6 hours", "100000 days"), "complete")
    return out.select("user_id", *[F.date_format(f"session_{a}", "yyyy-MM-dd HH:mm:ss").alias(b) for a, b in (("start", "started"), ("end", "ended"))], "n")


@B.df("stream_late_rows", "WITH mark AS (SELECT max(ts) - INTERVAL 5 DAY AS m FROM events WHERE event_id % 4 = 1) SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, mark WHERE event_id % 4 <> 0 OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > m GROUP BY 1, 2")
def stream_late_rows(spark, d):
    """A quarter of the events comes in a third batch; those whose window closed 5 days before the first batch's last event are too late.

    A batch drops rows by the watermark that the batch before it started with.

    The windows that each batch changes are merged into a stored table.
    """
    from tesseral.sources.versioned import Store
    from tesseral.streaming.pipelines import upsert_batches, windowed_counts

    folder = scratch(spark, "stream")
    turn = F.col("event_id") % 4
    for part, rows in enumerate((turn == 1, turn > 1, turn == 0)):
        table(spark, d, "events").where(rows).coalesce(1).write.mode("append").parquet(f"{folder}/in/{part}")
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    counts = windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day", late="5 days")
    store = Store(spark, f"{folder}/tables")
    store.write("days", None, counts.schema)
    run = upsert_batches(spark, store, "days", ["window_start", "event_type"], [F.desc("n")])
    q = counts.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read("days").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    # a stream reads folders; a single file is named by a pattern
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()
    rows = spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(path if folder else path[:-1] + "[t]")
    # event time must carry a zone; the session's is UTC
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(out, mode):
    folder = scratch(out.sparkSession, "stream")
    if mode == "append":
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    else:
        q = out.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
