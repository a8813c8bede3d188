"""Reply-stream queries: a user's events are the chunks of one reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steerframe.catalog.common import mod, rounded, table
from steerframe.operators.running import running_sum
from steerframe.session import scratch_path
from steerframe.streaming import keyed, replies as rp

STOP = "error"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered per user by event id; some views are incomplete pieces."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    numbered = running_sum(
        events, ["user_id"], "event_id", F.lit(1), "seq", exclusive=True
    )
    incomplete = (F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)
    return numbered.select(
        F.col("user_id").alias("key"),
        F.col("seq").cast("long").alias("seq"),
        "ts",
        F.when(incomplete, F.concat(F.lit("v"), F.lit(rp.INCOMPLETE)))
        .otherwise(F.col("event_type"))
        .alias("text"),
    )


def accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.accumulate_batch(chunks(spark, sf_dir), STOP)


def accumulate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomplete pieces are not held back."""
    return rp.accumulate_batch(chunks(spark, sf_dir), STOP, hold_incomplete=False)


def _sql_accumulate(hold: bool) -> str:
    held = "AND NOT contains(text, chr(65533))" if hold else ""
    return f"""
WITH c AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
    CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'v' || chr(65533)
         ELSE event_type END AS text
  FROM events
),
s AS (SELECT key, min(seq) AS stop FROM c WHERE text = 'error' GROUP BY 1),
r AS (
  SELECT c.key, c.seq, c.text,
    string_agg(c.text, '') OVER (PARTITION BY c.key ORDER BY c.seq) AS reply
  FROM c LEFT JOIN s USING (key)
  WHERE s.stop IS NULL OR c.seq < s.stop
)
SELECT key, seq, reply FROM r WHERE true {held}"""


def hot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all events are the chunks of one reply."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    key = F.when(mod("event_id", 3) > 0, F.col("user_id")).otherwise(-1)
    numbered = running_sum(
        events.withColumn("key", key), ["key"], "event_id", F.lit(1), "seq", exclusive=True
    )
    return numbered.select(
        "key", F.col("seq").cast("long").alias("seq"), "ts",
        F.substring("event_type", 1, 1).alias("text"),
    )


def accumulate_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every emission and a hash of its text: the texts are quadratic in size."""
    out = rp.accumulate_batch(hot_chunks(spark, sf_dir), "no stop", block=64, length="n")
    return out.select("key", "seq", "n", F.md5("reply").alias("md5"))


SQL_ACCUMULATE_HOT = """
WITH c AS (
  SELECT CASE WHEN event_id % 3 > 0 THEN user_id ELSE -1 END AS key, event_id, event_type
  FROM events
),
n AS (
  SELECT key, row_number() OVER w - 1 AS seq, left(event_type, 1) AS text
  FROM c WINDOW w AS (PARTITION BY key ORDER BY event_id)
),
whole AS (SELECT key, string_agg(text, '' ORDER BY seq) AS reply FROM n GROUP BY 1)
SELECT key, seq, seq + 1 AS n, md5(left(reply, seq + 1)) AS md5
FROM n JOIN whole USING (key)"""


# fixed value: a character of four bytes, which chunks cut in all its places
CUT = "\U0001F600"


def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character follows each event; the first ``event_id % 5`` bytes of it (all four, if
    that is 4) are in the event's chunk, the rest in the next. Every seventh chunk comes a
    second time, later and with another text."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    numbered = running_sum(events, ["user_id"], "event_id", F.lit(1), "seq", exclusive=True)
    character = F.lit(CUT).cast("binary")
    # the chunk before was cut where its number says
    before, here = (F.col("seq") - 1) % 5, F.col("seq") % 5
    tail = F.when(
        F.col("seq") > 0, F.substring(character, (before + 1).cast("int"), F.lit(4))
    ).otherwise(F.lit("").cast("binary"))
    text = F.concat(
        tail, F.col("event_type").cast("binary"),
        F.substring(character, F.lit(1), here.cast("int")),
    )
    first = numbered.select(
        F.col("user_id").alias("key"), F.col("seq").cast("long").alias("seq"), "ts",
        F.when(F.col("event_type") == STOP, F.lit(STOP).cast("binary")).otherwise(text).alias("text"),
    )
    again = first.filter(mod("seq", 7) == 0).select(
        "key", "seq", (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"),
        F.lit("later copy").cast("binary").alias("text"),
    )
    return first.unionByName(again)


def accumulate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.accumulate_batch(byte_chunks(spark, sf_dir), STOP)


# a chunk ends inside a character if one to three bytes of it are in the chunk
SQL_ACCUMULATE_BYTES = f"""
WITH c AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
         event_type
  FROM events
),
s AS (SELECT key, min(seq) AS stop FROM c WHERE event_type = 'error' GROUP BY 1)
SELECT c.key, c.seq,
       string_agg(event_type, '{CUT}') OVER (PARTITION BY c.key ORDER BY c.seq)
       || CASE WHEN seq % 5 = 4 THEN '{CUT}' ELSE '' END AS reply
FROM c LEFT JOIN s USING (key)
WHERE stop IS NULL OR seq < stop
QUALIFY seq % 5 IN (0, 4)"""


def accumulate_bytes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: copies arrive before or after the chunks they repeat."""
    stream = _written(spark, byte_chunks(spark, sf_dir), "text")
    return _run_replies(spark, rp.accumulate_stream(stream, STOP, late="60 days"))


def _written(spark: SparkSession, rows: DataFrame, dealt_by: str) -> DataFrame:
    """Rows as a stream over files, several files to a trigger."""
    path = scratch_path(spark, "chunks")
    rows.repartition(8, dealt_by).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def run_keyed(spark: SparkSession, stream: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Run a stream over all that is there; the last row of each key."""
    out = scratch_path(spark, "stream-out")
    query = (
        keyed.write_keyed(stream, out, mode)
        .option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return keyed.read_keyed(spark, out, stream.schema, keys)


def _run_replies(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return run_keyed(spark, stream, ["key", "seq"], "append").filter("reply IS NOT NULL")


def run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, and read what it wrote."""
    out = scratch_path(spark, "stream-out")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def accumulate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _written(spark, chunks(spark, sf_dir), "key")
    return _run_replies(spark, rp.accumulate_stream(stream, STOP, late="60 days"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("size", F.length("props"))
    out = rp.throughput(events, ["user_id"], "size")
    return out.select(
        "user_id",
        rounded(F.col("seconds")).alias("seconds"),
        "items",
        rounded(F.col("items_per_second"), 9).alias("items_per_second"),
        F.col("prior_size").cast("long").alias("prior_size"),
    )


SQL_RATES = """
WITH e AS (
  SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds,
         count(*) AS items, max(length(props)) AS prior_size
  FROM events GROUP BY 1
)
SELECT user_id, round(seconds, 6) + 0.0 AS seconds, items,
       CASE WHEN seconds > 0 THEN round(items / seconds, 9) END AS items_per_second, prior_size
FROM e"""


def rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and event type; the last days are open when the stream ends, and reported."""
    schema = table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    daily = rp.throughput_stream(stream, ["event_type"], "1 day", "1 hour")
    out = run_keyed(spark, daily, ["window", "event_type"], "update")
    return out.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"),
        "event_type",
        rounded(F.col("seconds")).alias("seconds"),
        "items",
    )


SQL_RATES_STREAM = """
WITH e AS (
  SELECT date_trunc('day', ts) AS day, event_type,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds, count(*) AS items
  FROM events GROUP BY ALL
)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, round(seconds, 6) + 0.0 AS seconds, items
FROM e"""


QUERIES = {
    "accumulate_reply": accumulate,
    "accumulate_reply_unheld": accumulate_all,
    "accumulate_reply_stream": accumulate_stream,
    "accumulate_reply_hot_key": accumulate_hot,
    "accumulate_reply_bytes": accumulate_bytes,
    "accumulate_reply_bytes_stream": accumulate_bytes_stream,
    "throughput": rates,
    "throughput_stream": rates_stream,
}

ORACLES = {
    "accumulate_reply": _sql_accumulate(True),
    "accumulate_reply_unheld": _sql_accumulate(False),
    "accumulate_reply_stream": _sql_accumulate(True),
    "accumulate_reply_hot_key": SQL_ACCUMULATE_HOT,
    "accumulate_reply_bytes": SQL_ACCUMULATE_BYTES,
    "accumulate_reply_bytes_stream": SQL_ACCUMULATE_BYTES,
    "throughput": SQL_RATES,
    "throughput_stream": SQL_RATES_STREAM,
}
