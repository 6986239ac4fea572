"""Declared record schemas (section 1.2 of the survey); streams never infer."""

from pyspark.sql import types as T

RAW_ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("feed_id", T.LongType()),
    T.StructField("feed_title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("raw_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

MENTION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
])

PAIR = T.StructType([
    T.StructField("entity_1", T.StringType()),
    T.StructField("entity_2", T.StringType()),
    T.StructField("count", T.IntegerType()),
])

ENRICHED = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("entities", T.ArrayType(MENTION)),
    T.StructField("co_occurrence_pairs", T.ArrayType(PAIR)),
    T.StructField("processing_metadata", T.StructType([
        T.StructField("processing_time_ms", T.LongType()),
        T.StructField("model_versions", T.MapType(T.StringType(), T.StringType()))])),
])

DLQ = T.StructType([
    T.StructField("failed_at", T.LongType()),
    T.StructField("source_topic", T.StringType()),
    T.StructField("source_partition", T.IntegerType()),
    T.StructField("source_offset", T.LongType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("stack_trace", T.StringType()),
    T.StructField("raw_value", T.StringType()),
])

CHANGE_EVENT = (
    "schema_version int, timestamp long, article_id string, "
    "entity_changes array<struct<id:string,old_mentions:long,new_mentions:long,delta_mentions:long,old_sentiment:double,new_sentiment:double,"
    "delta_sentiment:double,old_centrality:double,new_centrality:double,delta_centrality:double>>, "
    "relationship_changes array<struct<source:string,target:string,old_strength:double,new_strength:double,delta_strength:double,"
    "old_joint_sentiment:double,new_joint_sentiment:double,delta_joint_sentiment:double>>, node_count long, edge_count long")
