"""Point ids and lenient coercion of payload values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NAMESPACE_FACTOR = 10**12

POST = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("post_id", T.LongType()),
        T.StructField("tags", T.StringType()),
        T.StructField("thumbnail_url", T.StringType()),
        T.StructField("direct_image_url", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("rating", T.StringType()),
        T.StructField("canonical_post_url", T.StringType()),
    ]
)


def encode_point_id(namespace: Column, post_id: Column) -> Column:
    """namespace * 10^12 + post_id; null where post_id isn't in [0, 10^12), which would reach into another namespace."""
    return F.when((post_id >= 0) & (post_id < NAMESPACE_FACTOR), namespace * F.lit(NAMESPACE_FACTOR) + post_id)


def decode_namespace(point_id: Column) -> Column:
    return ((point_id - decode_post_id(point_id)) / F.lit(NAMESPACE_FACTOR)).cast("long")  # exact below 2^53 namespaces


def decode_post_id(point_id: Column) -> Column:
    return point_id % F.lit(NAMESPACE_FACTOR)


def payload_string(value: Column) -> Column:
    """A payload value of any scalar kind, given as JSON text, as a string: whole doubles without '.0', null as ''."""
    text = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1"))
    return F.when(value.isNull() | (value == "null") | value.rlike(r"^[\[{]"), "").otherwise(F.coalesce(text, F.lit("")))


def _bare(value: Column) -> Column:
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def payload_u32(value: Column) -> Column:
    """As an unsigned 32-bit number: whole numbers in range, doubles cut, strings of digits; else 0."""
    text = _bare(value)
    whole = F.when(text.rlike(r"^\+?\d{1,19}$"), text.try_cast("bigint"))
    number = F.when(value.rlike(r"^-?\d"), value.try_cast("double"))
    cut = F.when((number >= 0) & (number <= 4294967295), F.floor(number))
    found = F.when(value.startswith('"'), whole).otherwise(cut)
    return F.coalesce(F.when((found >= 0) & (found <= 4294967295), found), F.lit(0)).cast("long")


def payload_i64(value: Column) -> Column:
    """As a signed 64-bit number: whole numbers, doubles cut toward 0 and held at the limits, strings of digits; else 0."""
    text = _bare(value)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    plain = F.when(value.rlike(r"^-?\d+$"), value.try_cast("bigint"))
    number = F.when(value.rlike(r"^-?\d"), value.try_cast("double"))
    held = F.when(number >= 9.2233720368547758e18, F.lit(9223372036854775807)).when(number <= -9.2233720368547758e18, F.lit(-9223372036854775807) - 1).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.coalesce(F.when(value.startswith('"'), whole).otherwise(F.coalesce(plain, held)), F.lit(0)).cast("long")
