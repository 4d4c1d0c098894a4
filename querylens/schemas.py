"""Column layouts of the tables that cross module boundaries."""

from pyspark.sql import types as T

SOURCE_REFERENCE = T.StructType(
    [
        T.StructField("source_kind", T.StringType()),
        T.StructField("record_index", T.LongType()),
    ]
)

QUERY_FAMILY = T.StructType(
    [
        T.StructField("query_family_id", T.StringType()),
        T.StructField("normalized_sql", T.StringType()),
        T.StructField("queryid", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("application_name", T.StringType()),
    ]
)

FINDING_METRICS = T.StructType(
    [
        T.StructField("execution_count", T.LongType()),
        T.StructField("total_duration_ms", T.DoubleType()),
        T.StructField("avg_duration_ms", T.DoubleType()),
        T.StructField("max_duration_ms", T.DoubleType()),
        T.StructField("correlated_execution_count", T.LongType()),
        T.StructField("uncorrelated_execution_count", T.LongType()),
    ]
)

WINDOW_METRICS = T.StructType(
    [
        T.StructField("execution_count", T.LongType()),
        T.StructField("total_duration_ms", T.DoubleType()),
        T.StructField("avg_duration_ms", T.DoubleType()),
        T.StructField("p95_duration_ms", T.DoubleType()),
        T.StructField("max_duration_ms", T.DoubleType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("query_family", QUERY_FAMILY),
        T.StructField("metrics", FINDING_METRICS),
        T.StructField("baseline", WINDOW_METRICS),
        T.StructField("target", WINDOW_METRICS),
        T.StructField("delta", WINDOW_METRICS),
        T.StructField("evidence", T.ArrayType(SOURCE_REFERENCE)),
        T.StructField("confidence", T.StringType()),
        T.StructField("next_sql", T.ArrayType(T.StringType())),
    ]
)

CLOUDWATCH_RESPONSE = T.StructType(
    [
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("timestamp", T.LongType()),
                        T.StructField("message", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("nextToken", T.StringType()),
    ]
)
