"""Queries of decoding, validation, routing and provenance. Events stand for messages: their JSON is built from columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.contracts import ORDER_CONTRACTS
from tidemark.functions.validation import judge_messages
from tidemark.plans.sql import oracle
from tidemark.sources import adapters
from tidemark.streaming.ingest import new_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_created messages, some of them broken by the number in props: a wrong currency, no customer, a time without
    zone, an unknown field, too many digits, no JSON, a tombstone."""
    rows = adapters.events(spark, sf_dir, "signup")
    k = F.col("k")
    parts = [
        F.concat(F.lit('"order_id": "'), "user_id", F.lit('"')),
        F.when(k % 11 != 1, F.concat(F.lit('"customer_id": "'), "user_id", F.lit('"'))),
        F.when(k % 11 == 2, F.lit('"amount": 12345678901.5')).otherwise(F.concat(F.lit('"amount": '), F.col("event_id") % 1000, F.lit(".5"))),
        F.when(k % 11 == 3, F.lit('"currency": "BTC"')).otherwise(F.lit('"currency": "RUB"')),
        F.concat(F.lit('"created_at": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 11 == 4, "").otherwise("Z"), F.lit('"')),
        F.when(k % 11 == 5, F.lit('"unexpected": 1')),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.when(k % 11 == 6, "").otherwise("}"))
    return rows.select(F.lit("ecommerce.order_created.v1").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.when(k % 11 != 7, F.encode(text, "UTF-8")).alias("value"))


_PROBLEM = """CASE k % 11 WHEN 1 THEN 'Field ''customer_id'' is required' WHEN 2 THEN 'Field ''amount'' exceeds 10 integer digits' WHEN 3 THEN 'Field ''currency'' has value ''BTC''. Allowed values: [''RUB'', ''USD'', ''EUR'']'
  WHEN 4 THEN 'Field ''created_at'' must include a timezone' WHEN 5 THEN 'Unexpected field ''unexpected''' WHEN 6 THEN 'Message is not valid JSON' WHEN 7 THEN 'Message payload must not be null' END"""


def _short(error):
    """The cause of a broken message differs between JSON libraries; only the kind is compared."""
    return F.when(error.startswith("Message is not valid JSON"), "Message is not valid JSON").otherwise(error)


@query(oracle(f"SELECT CASE WHEN {_PROBLEM} IS NULL THEN 'raw' ELSE 'dead_letter' END AS sink, count(*) AS messages_cnt FROM ev WHERE event_type = 'signup' GROUP BY 1", "ev"))
def validate_router_counts(spark, sf_dir):
    judged = judge_messages(messages(spark, sf_dir), ORDER_CONTRACTS)
    return judged.groupBy(F.when(F.col("error_message").isNull(), "raw").otherwise("dead_letter").alias("sink")).agg(F.count("*").alias("messages_cnt"))


@query(oracle(f"SELECT event_id AS kafka_offset, {_PROBLEM} AS error_message FROM ev WHERE event_type = 'signup' AND {_PROBLEM} IS NOT NULL", "ev"))
def validate_error_messages(spark, sf_dir):
    judged = judge_messages(messages(spark, sf_dir), ORDER_CONTRACTS)
    return judged.where("error_message IS NOT NULL").select(F.col("offset").alias("kafka_offset"), _short(F.col("error_message")).alias("error_message"))


@query("SELECT key, count(*) AS events_cnt FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def decode_json_keys(spark, sf_dir):
    props = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.json_object_keys("props")).alias("key"))
    return props.groupBy("key").agg(F.count("*").alias("events_cnt"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_field_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(oracle("SELECT kafka_topic, kafka_partition, kafka_offset FROM dead WHERE kafka_offset % 3 <> 0", "dead"))
def ingest_dedup_coordinates(spark, sf_dir):
    """A batch that is replayed twice, into a sink that has a third of it."""
    dead = adapters.dead_letters(spark, sf_dir)
    return new_rows(dead.union(dead), dead.where("kafka_offset % 3 = 0")).select("kafka_topic", "kafka_partition", "kafka_offset")


@query(oracle("SELECT kafka_topic, nullif(regexp_extract(kafka_topic, '\\.v([0-9]+)$', 1), '')::INTEGER AS contract_version, nullif(regexp_extract(kafka_topic, '([a-z_]+)\\.v[0-9]+$', 1), '') AS contract_name, count(*) AS messages_cnt FROM dead GROUP BY ALL", "dead"))
def topic_version_extract(spark, sf_dir):
    topic = F.col("kafka_topic")
    version = F.nullif(F.regexp_extract(topic, r"\.v([0-9]+)$", 1), F.lit("")).cast("int")
    name = F.nullif(F.regexp_extract(topic, r"([a-z_]+)\.v[0-9]+$", 1), F.lit(""))
    return adapters.dead_letters(spark, sf_dir).groupBy("kafka_topic", version.alias("contract_version"), name.alias("contract_name")).agg(F.count("*").alias("messages_cnt"))


@query(oracle("SELECT raw_id, '{\"order_id\":\"' || order_id || '\",\"customer_id\":\"' || customer_id || '\",\"currency\":\"' || currency || '\"' || CASE WHEN source_channel = 'web' THEN ',\"source_channel\":\"web\"' ELSE '' END || '}' AS original_payload FROM created", "created"))
def payload_rebuild(spark, sf_dir):
    """Payloads of rows without provenance, null fields left out."""
    channel = F.when(F.col("source_channel") == "web", F.col("source_channel")).alias("source_channel")
    return adapters.raw_created(spark, sf_dir).select("raw_id", F.to_json(F.struct("order_id", "customer_id", "currency", channel)).alias("original_payload"))


@query(oracle("SELECT raw_id, order_id || '|' || payment_id AS message_key FROM paid", "paid"))
def message_key(spark, sf_dir):
    return adapters.raw_paid(spark, sf_dir).select("raw_id", F.concat_ws("|", "order_id", "payment_id").alias("message_key"))


_TOPICS = {"topics": ("SELECT kafka_topic FROM created UNION ALL SELECT kafka_topic FROM paid UNION ALL SELECT kafka_topic FROM cancelled UNION ALL SELECT kafka_topic FROM dead", ("created", "paid", "cancelled", "dead"))}


@query(oracle("SELECT name, max(version) AS version, arg_max(kafka_topic, version) AS topic, sum(n)::BIGINT AS messages_cnt FROM (SELECT kafka_topic, count(*) AS n, regexp_extract(kafka_topic, '([a-z_]+)\\.v[0-9]+$', 1) AS name, regexp_extract(kafka_topic, '\\.v([0-9]+)$', 1)::INTEGER AS version FROM topics GROUP BY kafka_topic) GROUP BY name", **_TOPICS))
def latest_version_per_name(spark, sf_dir):
    """Of the topics that messages came by, the latest version of each name."""
    tables = [*adapters.raw_tables(spark, sf_dir), adapters.dead_letters(spark, sf_dir)]
    seen = reduce(DataFrame.union, [t.select("kafka_topic") for t in tables]).groupBy("kafka_topic").agg(F.count("*").alias("n"))
    name, version = F.regexp_extract("kafka_topic", r"([a-z_]+)\.v[0-9]+$", 1), F.regexp_extract("kafka_topic", r"\.v([0-9]+)$", 1).cast("int")
    found = seen.groupBy(name.alias("name")).agg(F.max(F.struct(version.alias("version"), F.col("kafka_topic").alias("topic"))).alias("v"), F.sum("n").alias("messages_cnt"))
    return found.select("name", "v.version", "v.topic", "messages_cnt")
