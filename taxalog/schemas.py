"""Row schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

RAW_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("summary", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("raw", T.StringType()),
    T.StructField("count", T.IntegerType()),
])

EVENT_FIELDS = EVENT.fieldNames()

CORPUS = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("expected_type", T.StringType()),
    T.StructField("expected_category", T.StringType()),
    T.StructField("expected_severity", T.StringType()),
    T.StructField("description", T.StringType()),
])

# Landed provider pages, one JSON document per page.
VERCEL_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("proxy", T.StructType([
            T.StructField("statusCode", T.IntegerType()),
            T.StructField("path", T.StringType()),
            T.StructField("method", T.StringType()),
            T.StructField("host", T.StringType()),
        ])),
    ]))),
    T.StructField("pagination", T.StructType([T.StructField("next", T.StringType())])),
])

FLYIO_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("attributes", T.StructType([
            T.StructField("timestamp", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("level", T.StringType()),
            T.StructField("instance", T.StringType()),
            T.StructField("region", T.StringType()),
            T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        ])),
    ]))),
    T.StructField("meta", T.StructType([T.StructField("next_token", T.StringType())])),
])

# Rows of one table; the columns differ from table to table.
SUPABASE_PAGE = T.StructType([
    T.StructField("result", T.ArrayType(T.MapType(T.StringType(), T.VariantType()))),
])
