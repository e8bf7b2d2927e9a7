"""JSON text as columns: strict validity, keys, maps and query strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The tokens of JSON texts.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_TOKEN = rf"({_STRING}|{_NUMBER}|true|false|null|[^ \t\n\r])"
# The parser refuses texts that are larger or nested deeper than its limits; from here on they are read again.
_LARGE, _DEEP = 8_000_000, 400


def _reads_as_json(text: Column) -> Column:
    """Validity of any JSON text by a fold over its tokens with a stack of open brackets.

    The mode says what may come next: V a value, A a value or the end of an array, K a key or the end of
    an object, k a key, C a colon, E what follows a value, X nothing any more.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), 1)

    def step(state: Column, token: Column) -> Column:
        first, mode, stack = F.substring(token, 1, 1), state["mode"], state["stack"]
        rest = F.substring(stack, F.lit(2), F.length(stack))
        value = mode.isin("V", "A")
        scalar = (F.length(token) > 1) | first.rlike("[0-9]")
        text_token = (first == '"') & (F.length(token) > 1)

        def to(stack: Column, mode: str) -> Column:
            return F.struct(stack.alias("stack"), F.lit(mode).alias("mode"))

        closes_array = (first == "]") & ((mode == "A") | ((mode == "E") & F.startswith(stack, F.lit("["))))
        closes_object = (first == "}") & ((mode == "K") | ((mode == "E") & F.startswith(stack, F.lit("{"))))
        return (
            F.when(value & (first == "["), to(F.concat(F.lit("["), stack), "A"))
            .when(value & (first == "{"), to(F.concat(F.lit("{"), stack), "K"))
            .when(value & scalar, to(stack, "E"))
            .when(mode.isin("K", "k") & text_token, to(stack, "C"))
            .when((mode == "C") & (first == ":"), to(stack, "V"))
            .when(closes_array | closes_object, to(rest, "E"))
            .when((mode == "E") & (first == ",") & F.startswith(stack, F.lit("[")), to(stack, "V"))
            .when((mode == "E") & (first == ",") & F.startswith(stack, F.lit("{")), to(stack, "k"))
            .otherwise(to(stack, "X"))
        )

    start = F.struct(F.lit("").alias("stack"), F.lit("V").alias("mode"))
    return F.aggregate(tokens, start, step, lambda s: (s["mode"] == "E") & (s["stack"] == ""))


def is_json(text: Column) -> Column:
    """True when the whole text is one valid JSON value, of any size and depth; NULL counts as false.

    The variant parser stops at the end of the first value and ignores what
    follows. Wrapping the text as the first element of a two-element array makes
    it read to the end. The second element is the MD5 of the text, which the
    text itself cannot contain, so nothing in the text can forge the ending.
    """
    digest = F.md5(text)
    wrapped = F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]'))
    ending = F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "string")
    parsed = F.coalesce(ending == digest, F.lit(False))
    return F.when(parsed, True).when(_beyond(text), _reads_as_json(text)).otherwise(False)


def _beyond(text: Column) -> Column:
    """Whether the parser may refuse a text for its size or depth."""
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    return (F.octet_length(text) >= _LARGE) | (opened >= _DEEP)


def may_begin_json(text: Column) -> Column:
    """False when no JSON value stands at the beginning of the text. What follows the first value is not looked at."""
    return F.try_parse_json(text).isNotNull() | _beyond(text)


def json_keys(text: Column) -> Column:
    """Top-level keys of a JSON object in document order; NULL when not an object."""
    return F.json_object_keys(text)


def json_map(text: Column) -> Column:
    """JSON object to map<string,string>; NULL reads as the empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def query_string_map(query: Column) -> Column:
    """Decode a URL query string to a map; only k=v pairs count and the last one wins.

    A text that cannot be decoded yields the empty map.
    """
    decoded = F.coalesce(F.try_url_decode(query), F.lit(""))
    pairs = F.filter(
        F.transform(F.split(decoded, "&"), lambda p: F.split(p, "=")),
        lambda p: F.size(p) == 2,
    )
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.get(p, F.lit(0)))))
    values = F.transform(
        keys,
        lambda k: F.get(F.element_at(F.filter(pairs, lambda p: F.get(p, F.lit(0)) == k), -1), F.lit(1)),
    )
    return F.map_from_arrays(keys, values)


def query_string_json(query: Column) -> Column:
    """The map of query_string_map as JSON text with sorted keys."""
    return escape_markup(F.to_json(query_string_map(query)))


def escape_markup(text: Column) -> Column:
    """Write the characters JSON encoders for the web escape: < > & and the two line separators."""
    for raw, escaped in (
        ("<", "\\u003c"),
        (">", "\\u003e"),
        ("&", "\\u0026"),
        ("\u2028", "\\u2028"),
        ("\u2029", "\\u2029"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text
