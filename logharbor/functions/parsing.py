"""Parsing of slow-log lines and thread dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logharbor.functions.jsontext import is_json, let, may_begin_json

# The formats of the two vendors' text records.
LINE_HEADER = r"\[([^\]]+)\]\s+\[([^\]]+)\]\s+\[([^\]]+)\]\[(\d+)\]"
TOOK_MILLIS = r"took_millis\[(\d+)\]"
TOTAL_HITS = r"total_hits\[(\d+) hits\]"
SEARCH_TYPE = r"search_type\[([^\]]+)\]"
TOTAL_SHARDS = r"total_shards\[(\d+)\]"
SOURCE_MARK = "source["
USAGE = r"([\d.]+)%\s*\([\d.]+(ms|s|m)\s+out of\s+[\d.]+(ms|s|m)\)\s*(cpu|block|wait)\s+usage by thread"

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_MAX_LONG = 9223372036854775807


def lenient_double(text: Column) -> Column:
    """Number text to double; anything else, NULL included, reads as 0."""
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))
        .when(F.rlike(text, F.lit(_INFINITE)), sign)
        .when(F.lower(text).isin("nan", "+nan", "-nan"), F.lit(float("nan")))
        .otherwise(F.lit(0.0))
    )


def lenient_long(text: Column) -> Column:
    """Integer text to bigint; other text reads as 0 and too large values stop at the type's ends."""
    edge = F.when(F.startswith(text, F.lit("-")), F.lit(-_MAX_LONG - 1)).otherwise(F.lit(_MAX_LONG))
    whole = F.rlike(text, F.lit(_INTEGER))
    return F.when(whole, F.coalesce(text.try_cast("bigint"), edge)).otherwise(F.lit(0).cast("bigint"))


def line_header(line: Column) -> dict[str, Column]:
    """Node, index and shard of a ``[time] [node] [index][shard]`` header; '' and 0 when absent."""
    return {
        "nodeName": F.trim(F.regexp_extract(line, LINE_HEADER, 2)),
        "indexName": F.trim(F.regexp_extract(line, LINE_HEADER, 3)),
        "shardId": lenient_long(F.regexp_extract(line, LINE_HEADER, 4)),
    }


def bracket_fields(line: Column) -> dict[str, Column]:
    """The keyed ``name[value]`` fields of a slow-log line; missing ones are 0 or ''."""
    return {
        "durationMs": lenient_double(F.regexp_extract(line, TOOK_MILLIS, 1)),
        "searchHits": lenient_long(F.regexp_extract(line, TOTAL_HITS, 1)),
        "searchType": F.regexp_extract(line, SEARCH_TYPE, 1),
        "shardTotal": lenient_long(F.regexp_extract(line, TOTAL_SHARDS, 1)),
    }


# Strings whole, each bracket alone, and the runs in between; a stray quote stands alone.
_TOKENS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|[^"{}\[\]]++|")'


def extract_source(line: Column) -> Column:
    """The JSON object behind the first ``source[``; NULL when there is none.

    A JSON object is no prefix of another one, so when the text up to its last
    closing brace, or up to the last one before a closing bracket, is valid JSON
    that is the object. Otherwise, if the text begins with an object at all, it is
    cut into strings, brackets and runs, and the object ends at the first token
    where the bracket depth is back at zero.
    """

    def step(state: Column, token: Column) -> Column:
        depth = (
            state["depth"]
            + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        )
        seen = state["seen"] + 1
        closes = (state["stop"] == 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            seen.alias("seen"),
            F.when(closes, seen).otherwise(state["stop"]).alias("stop"),
        )

    def balanced(tokens: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("stop"))
        stop = F.aggregate(tokens, start, step)["stop"]
        return let(F.array_join(F.slice(tokens, 1, stop), ""), lambda body: F.when(is_json(body), body))

    def first_value(rest: Column) -> Column:
        def up_to(end: str) -> Column:
            behind = F.length(F.substring_index(rest, end, -1)) + (len(end) - 1)
            return F.substring(rest, F.lit(1), F.length(rest) - behind)

        folded = let(F.regexp_extract_all(rest, F.lit(_TOKENS), 1), balanced)
        searched = F.when(may_begin_json(rest), folded)
        closed = F.when(F.contains(rest, F.lit("}]")), let(up_to("}]"), lambda u: F.when(is_json(u), u)))
        # The mark of the line's next field is looked at first, as most lines have it.
        whole = F.coalesce(closed, let(up_to("}"), lambda u: F.when(is_json(u), u)), searched)
        return F.when(F.startswith(rest, F.lit("{")), whole).when(F.startswith(rest, F.lit("null")), F.lit("null"))

    found = F.instr(line, SOURCE_MARK)
    rest = F.regexp_replace(F.substring(line, found + len(SOURCE_MARK), F.length(line)), r"^[ \t\r\n]+", "")
    return let(F.when(found > 0, rest), first_value)


def usage_percentages(dump: Column) -> Column:
    """Every thread usage percentage in a dump, in order, as array<double>."""
    return F.transform(F.regexp_extract_all(dump, F.lit(USAGE), 1), lenient_prefix)


def lenient_prefix(text: Column) -> Column:
    """The number a text of digits and dots begins with; 0 when it begins with none."""
    return lenient_double(F.regexp_extract(text, r"^([0-9]*\.?[0-9]*)", 1))
