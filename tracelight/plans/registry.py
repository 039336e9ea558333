"""Registry of queries over the supplied tables, each with SQL for an independent check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.schema import HTTP_EVENT, conform

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql, covers)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ROWS_PER_TASK:
        return df
    # a table in one small file is one task, and splits of narrow rows grow with the table: the tasks follow its rows
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK[name]))  # counted from the files' footers
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


# tables whose rows are turned into log lines or file content, which costs far more than moving them
ROWS_PER_TASK = {"events": 250_000, "documents": 20_000, "pages": 20_000, "part": 50_000, "supplier": 50_000, "customer": 250_000, "orders": 250_000}


def event_micros(ts: str = "ts") -> Column:
    """Microseconds of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


# Events are sparse (one per user and day), so their clock runs 600 times faster in the derived logs.
SPEED = 600

# The `web` view: one access-log request per event. Spark and SQL state the same derivation.
WEB_SQL = f"""
ev AS (SELECT *, epoch_us(ts) // {SPEED} AS us, (epoch_us(ts) // {SPEED}) // 1000000 AS sec FROM events),
web AS (
  SELECT event_id, user_id, event_type, value, props, us, sec,
    strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp,
    '203.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS ip,
    CASE WHEN event_type IN ('error', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE event_type WHEN 'click' THEN '/item/' || (event_id % 20)
      WHEN 'view' THEN CASE WHEN event_id % 25 = 3 THEN '/static/../../etc/passwd' ELSE '/docs/page.html' END
      WHEN 'purchase' THEN '/cart/checkout' WHEN 'signup' THEN '/account/signin' ELSE '/account/login' END AS path,
    CASE WHEN event_type = 'click' AND event_id % 40 IN (7, 28) THEN 'q=1+UNION+SELECT+2'
      WHEN event_type = 'click' THEN 'ref=' || (event_id % 7) END AS query,
    CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END
      WHEN 'purchase' THEN 302 WHEN 'signup' THEN 403 ELSE 401 END AS status,
    CASE WHEN user_id % 17 = 0 THEN 'sqlmap/1.7' ELSE 'Mozilla/5.0' END AS agent,
    CAST(floor(value * 100) AS BIGINT) AS bytes,
    'web-' || (event_id % 4) || '.log' AS file
  FROM ev)"""


def web_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the SQL ``web`` view."""
    c = F.col
    text = lambda v: v.cast("string")
    ev = table(spark, sf_dir, "events").withColumn("_us", event_micros()).withColumn("us", F.expr(f"_us div {SPEED}"))
    ev = ev.withColumn("sec", F.expr("us div 1000000"))
    kind = c("event_type")
    return ev.select(
        "event_id", "user_id", "event_type", "value", "props", "us", "sec",
        F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
        F.concat(F.lit("203.0."), F.expr("cast((user_id div 256) % 256 as string)"), F.lit("."), text(c("user_id") % 256)).alias("ip"),
        F.when(kind.isin("error", "signup"), "POST").otherwise("GET").alias("method"),
        F.when(kind == "click", F.concat(F.lit("/item/"), text(c("event_id") % 20)))
        .when(kind == "view", F.when(c("event_id") % 25 == 3, "/static/../../etc/passwd").otherwise("/docs/page.html"))
        .when(kind == "purchase", "/cart/checkout").when(kind == "signup", "/account/signin").otherwise("/account/login").alias("path"),
        F.when((kind == "click") & (c("event_id") % 40).isin(7, 28), "q=1+UNION+SELECT+2")
        .when(kind == "click", F.concat(F.lit("ref="), text(c("event_id") % 7))).alias("query"),
        F.when(kind == "click", 200).when(kind == "view", F.when(c("event_id") % 5 == 0, 404).otherwise(200))
        .when(kind == "purchase", 302).when(kind == "signup", 403).otherwise(401).alias("status"),
        F.when(c("user_id") % 17 == 0, "sqlmap/1.7").otherwise("Mozilla/5.0").alias("agent"),
        F.floor(c("value") * 100).cast("bigint").alias("bytes"),
        F.concat(F.lit("web-"), text(c("event_id") % 4), F.lit(".log")).alias("file"),
    )


def http_events(web: DataFrame) -> DataFrame:
    """The view as typed access-log events; the event id is the line number."""
    c = F.col
    return conform(web.select(
        c("stamp").alias("timestamp"), c("file").alias("source_file"), c("event_id").alias("line_number"), c("ip").alias("remote_ip"),
        "method", c("path").alias("uri_path"), c("query").alias("uri_query"), "status", c("bytes").alias("bytes_sent"),
        c("agent").alias("user_agent"), F.sha2(c("event_id").cast("string"), 256).alias("raw_hash"),
        F.lit("derived").alias("parser_name"), F.lit(1.0).alias("parse_confidence"),
    ), HTTP_EVENT)


def clf_line() -> Column:
    """The view rendered as combined log lines."""
    when = F.date_format(F.timestamp_seconds("sec"), "dd/MMM/yyyy:HH:mm:ss")
    uri = F.concat("path", F.when(F.col("query").isNotNull(), F.concat(F.lit("?"), F.col("query"))).otherwise(""))
    return F.format_string(
        '%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "-" "%s"', "ip", when, "method", uri, "status", "bytes", "agent"
    )
