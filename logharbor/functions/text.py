"""Names, paths, labels and other short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers stored in place of a request body, and yes/no labels.
BODY_LIMIT = 1024
UPLOAD_MARK = "[文件]"
TOO_LONG_MARK = "[超出记录长度]"
YES_LABEL = "是"
NO_LABEL = "否"


def guard_body(body: Column, content_type: Column, limit: int = BODY_LIMIT) -> Column:
    """The body to store: a marker for uploads, a marker for oversize, else the body itself."""
    return (
        F.when(F.contains(content_type, F.lit("multipart/form-data")), F.lit(UPLOAD_MARK))
        .when(F.octet_length(body) > limit, F.lit(TOO_LONG_MARK))
        .otherwise(F.coalesce(body, F.lit("")))
    )


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def first_lower(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def camel_to_snake(text: Column) -> Column:
    """orderItemId -> order_item_id; a capital in first place gets no underscore."""
    return F.lower(F.regexp_replace(text, r"(?<!^)([A-Z])", "_$1"))


def camel_to_column(text: Column) -> Column:
    """Like camel_to_snake with an underscore before a leading capital; ID stays ID."""
    return F.when(text == "ID", text).otherwise(F.lower(F.regexp_replace(text, r"([A-Z])", "_$1")))


def snake_to_camel(text: Column) -> Column:
    """order_item_id -> orderItemId."""
    pieces = F.regexp_extract_all(text, F.lit(r"(_[A-Za-z0-9_]|[^_]+|_)"), 1)
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                F.startswith(p, F.lit("_")) & (F.length(p) == 2), F.upper(F.substring(p, 2, 1))
            ).otherwise(p),
        ),
        "",
    )


def kebab_to_camel(text: Column) -> Column:
    """order-item-id -> orderItemId; every word inside a later part starts upper case."""

    def title(part: Column) -> Column:
        words = F.regexp_extract_all(part, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
        return F.array_join(F.transform(words, first_upper), "")

    return F.array_join(F.transform(F.split(text, "-"), lambda p, i: F.when(i > 0, title(p)).otherwise(p)), "")


def comma_joined(items: Column) -> Column:
    """Array as text with commas."""
    return F.array_join(items, ",")


def first_segment(path: Column) -> Column:
    """The text between the first and the second slash; NULL when there is no slash."""
    return F.get(F.split(path, "/"), F.lit(1))


def file_tag(name: Column) -> Column:
    """The text behind the last dot; the whole name when there is none."""
    return F.substring_index(name, ".", -1)


def with_host(url: Column, host: str) -> Column:
    """Prefix host unless the text begins with http."""
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(host), url))


def with_host_each(urls: Column, host: str) -> Column:
    """with_host on every element."""
    return F.transform(urls, lambda u: with_host(u, host))


def strip_prefix(path: Column, prefix: str) -> Column:
    """Drop a fixed prefix when the path begins with it."""
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    ).otherwise(path)


def bool_label(flag: Column, yes: str = YES_LABEL, no: str = NO_LABEL) -> Column:
    """Yes/no label; NULL shows as the empty text."""
    return F.when(flag.isNull(), F.lit("")).when(flag, F.lit(yes)).otherwise(F.lit(no))


def quarter_label(ts: Column) -> Column:
    """Year and quarter, such as 1998-3."""
    return F.concat_ws("-", F.year(ts), F.quarter(ts))


def column_letters(ordinal: Column) -> Column:
    """Spreadsheet letters of a 1-based column number; NULL below 1. Fourteen letters hold every bigint."""
    n = ordinal.cast("bigint")

    def step(state: Column, _) -> Column:
        left = state["n"] - 1
        letter = F.char(F.lit(65) + F.pmod(left, F.lit(26)))
        return F.when(
            state["n"] > 0,
            F.struct(F.call_function("div", left, F.lit(26)).alias("n"), F.concat(letter, state["t"]).alias("t")),
        ).otherwise(state)

    start = F.struct(n.alias("n"), F.lit("").alias("t"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["t"])


def plain_number(number: Column) -> Column:
    """Double as text without exponent between 1e-4 and 1e21, and without a trailing .0."""
    size = F.abs(number)
    as_is = F.regexp_replace(number.cast("string"), r"\.0$", "")
    fixed = F.regexp_replace(number.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    plain = ((size >= 1e7) & (size < 1e21)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(plain, fixed).otherwise(as_is)
