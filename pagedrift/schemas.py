"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS = ("title", "perk", "dates", "price")

PROMO = T.StructType([T.StructField(n, T.StringType()) for n in ("id", *FIELDS)])
PROMO_DDL = "struct<id:string,title:string,perk:string,dates:string,price:string>"

TARGET = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("selector", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

CRAWL = T.StructType(
    [
        T.StructField("fetch_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("status_text", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("promos", T.ArrayType(PROMO)),
    ]
)

STATE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("promos", T.ArrayType(PROMO)),
        T.StructField("last_seen", T.TimestampType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("hash", T.StringType()),
        T.StructField("promos", T.ArrayType(PROMO)),
    ]
)
