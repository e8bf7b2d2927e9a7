"""Masking of literals in query text, and fingerprints of the masked template."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.functions.jsontext import escape_markup, is_json, let

# Python workers get this module's functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A JSON string. Possessive quantifiers: linear time and no backtracking into keys.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# A string that the end of the text cut off.
_CUT_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+\\?\z'
# Stands for a masked scalar between passes. Valid JSON cannot hold it raw.
_MARK = "\u0001"


def _collapse(text: Column) -> Column:
    """All-scalar arrays shrink to one element and marks become "?"."""
    text = F.regexp_replace(text, rf"\[{_MARK}(?:,{_MARK})*+\]", '["?"]')
    return F.replace(text, F.lit(_MARK), F.lit('"?"'))


def _canonical_keys(masked: Column) -> Column:
    """Re-encode key text that holds escapes, so that equal keys are spelled alike."""
    strings = F.regexp_extract_all(masked, F.lit(f"({_STRING})"), 1)
    between = F.split(masked, _STRING, -1)
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    encoded = F.transform(decoded, lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1))
    joined = F.zip_with(between, encoded, lambda gap, key: F.concat(gap, F.coalesce(key, F.lit(""))))
    return F.array_join(joined, "")


def mask_json(text: Column) -> Column:
    """Mask a valid JSON text: scalars become "?", keys and key order stay."""
    # Every token leaves a mark and keys leave themselves in front of it; then the marks of keys go.
    text = F.regexp_replace(
        text, rf"({_STRING})\s*+(:)|{_STRING}|-?[0-9][0-9.eE+-]*+|true|false|null", f"$1$2{_MARK}"
    )
    text = F.regexp_replace(text, rf"({_STRING}:){_MARK}|\s++", "$1")
    # Only keys hold free text now, and few hold anything to re-encode.
    return let(
        _collapse(text),
        lambda m: F.when(F.rlike(m, F.lit("[\\\\<>&\u2028\u2029]")), escape_markup(_canonical_keys(m))).otherwise(m),
    )


def mask_cut_strict(text: Column) -> Column:
    """Mask a text that is not valid JSON, leaving no string or bare value behind.

    A string followed by a colon is a key and stays; every other string, whole
    or cut, and every bare word becomes a masked value.
    """
    text = F.replace(text, F.lit(_MARK), F.lit(" "))
    text = F.regexp_replace(
        text, rf'(?s)({_STRING})\s*+(:)|{_STRING}|{_CUT_STRING}|[^\s"{{}}\[\],:]++', f"$1$2{_MARK}"
    )
    text = F.regexp_replace(text, rf"(?s)({_STRING}:){_MARK}|\s++", "$1")
    return _collapse(text)


_COPY_RUN = re.compile(r'[^":,{}\[\]]+')
_BARE_VALUE = re.compile(r'[^":,{}\[\] \n\t][^,{}\[\] \n\t]*')
_BLANKS = re.compile(r"[ \n\t]+")
_BRACKET = re.compile(r"[\[\]{}]")


def _scalar_array_ends(text: str) -> dict[int, int]:
    """Position behind each array by where it opens, or -1 when it holds an object; one pass over the brackets."""
    ends: dict[int, int] = {}
    still: list[int] = []
    for hit in _BRACKET.finditer(text):
        if hit[0] == "[":
            still.append(hit.start())
        elif hit[0] == "{":
            ends.update(dict.fromkeys(still, -1))
            still.clear()
        elif still:
            ends[still.pop()] = hit.end()
    return ends | dict.fromkeys(still, len(text))


def mask_cut_text(text: str) -> str:
    """Compatible masking of one text that is not valid JSON.

    Bare values behind a colon become ?, arrays behind a colon that hold no
    object become [?], quoted strings stay. Quotes toggle even when escaped,
    and a colon counts inside strings too.
    """
    out: list[str] = []
    ends = _scalar_array_ends(text)
    at, quoted, expect = 0, False, False
    while at < len(text):
        ch = text[at]
        if ch == "[" and expect:
            end = ends[at]
            if end >= 0:
                out.append("[?]")
                at, expect = end, False
                continue
        if ch in '":,{}[]':
            out.append(ch)
            quoted ^= ch == '"'
            expect = ch == ":" or (expect and ch != ",")
            at += 1
        elif expect and not quoted:
            run = _BLANKS.match(text, at)
            if run:
                out.append(run[0])
            else:
                run = _BARE_VALUE.match(text, at)
                out.append("?")
                expect = False
            at = run.end()
        else:
            run = _COPY_RUN.match(text, at)
            out.append(run[0])
            at = run.end()
    return "".join(out)


@F.arrow_udf(T.StringType())
def _mask_cut_compat(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else mask_cut_text(t) for t in texts.to_pylist()), pa.string())


def mask_truncated(text: Column, mode: str = "strict") -> Column:
    """Mask text that is not valid JSON. ``compat`` keeps quoted strings, ``strict`` masks them."""
    if mode == "strict":
        return mask_cut_strict(text)
    if mode == "compat":
        return _mask_cut_compat(text)
    raise ValueError(f"unknown masking mode {mode!r}")


def mask_dsl(text: Column, mode: str = "strict", valid: Column | None = None) -> Column:
    """Template of a query text. Valid JSON and, by default, the rest are masked natively.

    Mode ``compat`` keeps quoted strings of texts that are not valid, so it is not for anything published; valid rows reach the Python function of ``compat`` as NULL. ``valid`` is
    is_json(text) where the caller already has it.
    """
    valid = is_json(text) if valid is None else valid
    cut = mask_truncated(F.when(~valid, text), mode)
    return F.when(valid, mask_json(text)).otherwise(cut)


def dsl_format(valid: Column) -> Column:
    """Which masking applied, from is_json: json or non-json."""
    return F.when(valid, F.lit("json")).otherwise(F.lit("non-json"))


def fingerprint(text: Column) -> Column:
    """MD5 hex of a text."""
    return F.md5(text)
