"""Tolerant values: numbers, booleans and counts as people and files write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of yes and no in review sheets.
YES = ("1", "true", "yes", "y", "pass", "ok", "是", "已确认", "已发布", "通过")
NO = ("0", "false", "no", "n", "fail", "否", "未确认", "未发布", "不通过")
INCLUDED = ("1", "true", "yes", "y", "include", "included", "pass", "ok", "是", "纳入", "采纳", "通过")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_int(x: Column | str, least: int | None = None) -> Column:
    """A whole number; what can't be read is 0."""
    value = F.coalesce(_col(x).try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    return value if least is None else F.greatest(value, F.lit(least).cast("long"))


def as_float(x: Column | str) -> Column:
    value = _col(x).try_cast("double")
    return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(0.0))


def review_bool(x: Column | str) -> Column:
    """True, false, or null for anything else."""
    value = F.lower(F.trim(_col(x).cast("string")))
    return F.when(value.isin(*YES), True).when(value.isin(*NO), False)


def included(x: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(x).cast("string"))).isin(*INCLUDED), F.lit(False))


def tags(x: Column | str) -> Column:
    """Tags parted by commas, semicolons or bars."""
    return F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), "[;,，；|]"), lambda t: F.trim(t)), lambda t: t != "")


def review_counts(x: Column | str) -> Column:
    """`kind:3; other:1` as an array of key and value; the last colon parts them."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p.rlike("^.+:.*$"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.+):([^:]*)$", 1)).alias("key"), as_int(F.regexp_extract(p, r"^(.+):([^:]*)$", 2)).alias("value")))


def rate(numerator: Column | str, denominator: Column | str) -> Column:
    """A quotient, 0 where the denominator is; not rounded."""
    return F.coalesce(F.try_divide(_col(numerator).cast("double"), F.nullif(_col(denominator).cast("double"), F.lit(0.0))), F.lit(0.0))


def box_area(box: Column) -> Column:
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))


def box_overlap(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def box_coverage(inner: Column, outer: Column) -> Column:
    """The share of inner that lies in outer."""
    return rate(box_overlap(inner, outer), box_area(inner))


def http_error(status: Column | str) -> Column:
    """Code and whether a retry may help, for an HTTP status."""
    s = _col(status)
    code = F.when(s == 429, "HTTP_RATE_LIMIT").when(s.isin(401, 403), "HTTP_AUTH_ERROR").when(s == 408, "HTTP_TIMEOUT").when(s >= 500, "HTTP_SERVER_ERROR").when(s >= 400, "HTTP_CLIENT_ERROR").otherwise("HTTP_NETWORK_ERROR")
    return F.struct(code.alias("code"), (~code.isin("HTTP_AUTH_ERROR", "HTTP_CLIENT_ERROR")).alias("retryable"))
