"""Path-pattern policies: which policy rows allow a request.

A pattern is a path whose segments are literal, ``:name`` (one non-empty
segment) or a closing ``*`` (everything behind the slash).

Testing every request against every pattern of its role would be a nested loop
inside each role. Instead a pattern is described by its shape (which segments
are literal) and the text of its literal segments. A request is looked up once
per shape that fits its length, by equality on role, method, shape and literals.

A pattern whose only special characters are dots stands for texts of its own length that are equal to it everywhere else, as a dot is
one character, a slash as well. A request is looked up once per set of dots that patterns of its length have.

Other patterns with regular-expression characters in a literal segment or with an inner wildcard are irregular. What they say before
the first and behind the last irregular segment still has to stand there, so these are looked up by the shape and literals of
both ends; those of wildcards only whose ends say nothing go by their longest inner segment. The regular expression is
tested on what is found. Only patterns whose ends prove nothing (alternatives, escapes, inline flags) are compared within
their role and method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_regex(pattern: Column) -> Column:
    """Anchored regular expression of a path pattern."""
    body = F.replace(pattern, F.lit("/*"), F.lit("/.*"))
    return F.concat(F.lit("^"), F.regexp_replace(body, r":[^/]+", "[^/]+"), F.lit(r"\z"))


def path_matches(path: Column, pattern: Column) -> Column:
    """True when the whole path matches the pattern."""
    return F.rlike(path, pattern_regex(pattern))


_PLAIN = r"^[^:*.+?^$()\[\]{}|\\]*$"
_DOTTED = r"^[^:*+?^$()\[\]{}|\\]*$"
_PARAM = r"^:[^/]+$"


def _shape(segments: Column) -> Column:
    return F.transform(
        segments, lambda s: F.when(F.rlike(s, F.lit(_PARAM)), F.lit(":")).when(s == "*", F.lit("*")).otherwise("=")
    )


def _literals(segments: Column, shape: Column) -> Column:
    """The segments at the literal places of a shape, joined."""
    return F.array_join(
        F.filter(F.transform(shape, lambda kind, i: F.when(kind == "=", F.get(segments, i))), lambda s: s.isNotNull()),
        "/",
    )


def _indexed(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns that shapes describe, the others)."""
    rows = policies.dropDuplicates(["role", "path", "method"]).withColumn("_seg", F.split("path", "/"))
    last = F.size("_seg") - 1
    tidy = F.forall(
        F.transform(
            "_seg",
            lambda s, i: F.rlike(s, F.lit(_PLAIN)) | F.rlike(s, F.lit(_PARAM)) | ((s == "*") & (i == last) & (i > 0)),
        ),
        lambda ok: ok,
    )
    rows = rows.withColumn("_tidy", tidy)
    regular = rows.filter("_tidy").select(
        "role", "method", F.col("path").alias("pattern"),
        F.array_join(_shape(F.col("_seg")), "").alias("_shape"),
        _literals(F.col("_seg"), _shape(F.col("_seg"))).alias("_key"),
    )
    return regular, rows.filter("NOT _tidy").select("role", "method", F.col("path").alias("pattern"), "_seg")


def _plain(segment: Column) -> Column:
    return F.rlike(segment, F.lit(_PLAIN)) | F.rlike(segment, F.lit(_PARAM))


def _ends_key(head: Column, head_shape: Column, tail: Column, tail_shape: Column) -> Column:
    return F.concat_ws("//", _literals(head, head_shape), _literals(tail, tail_shape))


def _by_ends(irregular: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Irregular patterns (by the shape of their ends, by an inner segment, the rest)."""
    odd = F.transform("_seg", lambda s: ~_plain(s))
    rows = irregular.withColumn("_first", F.array_position(odd, True) - 1)
    rows = rows.withColumn("_last", F.size("_seg") - F.array_position(F.reverse(odd), True))
    length = (F.col("_last") - F.col("_first") + 1).cast("int")
    rows = rows.withColumn("_middle", F.slice("_seg", F.greatest(F.col("_first") + 1, F.lit(1)).cast("int"), length))
    # Alternatives, escapes and flags reach beyond their segment.
    loose = F.exists("_middle", lambda s: F.rlike(s, F.lit(r"[|\\]|\(\?")))
    # A quantifier at the beginning of a segment belongs to the slash before it, and so to the segment before that.
    quantified = F.rlike(F.element_at("_middle", 1), F.lit(r"^[?+{]"))
    held = F.when(quantified, F.greatest(F.col("_first") - 1, F.lit(0))).otherwise(F.col("_first")).cast("int")
    rows = rows.withColumns({"_loose": loose, "_head": F.slice("_seg", F.lit(1), held)})
    rows = rows.withColumn("_tail", F.slice("_seg", (F.col("_last") + 2).cast("int"), F.size("_seg")))
    said = F.filter(F.concat("_head", "_tail"), lambda s: (s != "") & ~F.rlike(s, F.lit(_PARAM)))
    stars = F.forall("_middle", lambda s: (s == "*") | _plain(s))
    inner = F.filter("_middle", lambda s: (s != "") & F.rlike(s, F.lit(_PLAIN)))
    longest = F.array_max(F.transform(inner, lambda s: F.struct(F.length(s), s.alias("s"))))["s"]
    rows = rows.withColumn("_inner", F.when(~F.col("_loose") & (F.size(said) == 0) & stars, longest))
    heads, tails = _shape(F.col("_head")), _shape(F.col("_tail"))
    ends = rows.filter("NOT _loose AND _inner IS NULL").select(
        "role", "method", "pattern",
        F.concat_ws("|", F.array_join(heads, ""), F.array_join(tails, "")).alias("_shape"),
        _ends_key(F.col("_head"), heads, F.col("_tail"), tails).alias("_key"),
    )
    columns = ["role", "method", "pattern"]
    return ends, rows.filter("_inner IS NOT NULL").select(*columns, "_inner"), rows.filter("_loose").select(*columns)


def _found_by_ends(segmented: DataFrame, ends: DataFrame) -> DataFrame:
    """Requests (role, path, method, _seg) with the patterns that have their ends."""
    kinds = [F.filter(F.split(F.split("_shape", r"\|")[i], ""), lambda k: k != "") for i in (0, 1)]
    shapes = ends.select("_shape").distinct().select("_shape", kinds[0].alias("_h"), kinds[1].alias("_t"))
    shapes = shapes.withColumn("_size", F.size("_h") + F.size("_t"))
    sizes = segmented.withColumn("_size", F.explode(F.sequence(F.lit(0), F.size("_seg"))))
    head = F.slice("_seg", F.lit(1), F.size("_h"))
    # Also where Spark looks at it for rows that do not count.
    tail = F.slice("_seg", F.greatest(F.size("_seg") - F.size("_t") + 1, F.lit(1)), F.size("_t"))
    keyed = sizes.join(shapes, "_size").withColumn("_key", _ends_key(head, F.col("_h"), tail, F.col("_t")))
    return keyed.join(ends, ["role", "method", "_shape", "_key"])


def _dots(pattern: Column) -> Column:
    """The places of a pattern's dots, from 1; joined, so that Spark can group by them."""
    places = F.transform(F.split(pattern, ""), lambda c, i: F.when(c == ".", i + 1))
    return F.array_join(F.filter(places, lambda i: i.isNotNull()).cast("array<string>"), ",")


def _masked(path: Column, dots: Column) -> Column:
    """The path with dots at these places."""
    at = F.transform(F.split(dots, ","), lambda i: i.cast("int"))
    return F.aggregate(at, path, lambda text, i: F.overlay(text, F.lit("."), i, F.lit(1)))


def _found_by_length(requests: DataFrame, dotted: DataFrame) -> DataFrame:
    """Requests (role, path, method) with the dotted patterns (role, method, pattern) that differ from them in dots only."""
    placed = dotted.withColumns({"_dots": _dots(F.col("pattern")), "_size": F.length("pattern")})
    sets = placed.select("role", "method", "_size", "_dots").distinct()
    keyed = requests.withColumn("_size", F.length("path")).join(sets, ["role", "method", "_size"])
    return keyed.withColumn("pattern", _masked(F.col("path"), F.col("_dots"))).join(dotted, ["role", "method", "pattern"])


def match_policies(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every (request, pattern) pair that matches.

    ``requests`` needs role, path and method; ``policies`` the same with path as
    the pattern.
    """
    regular, irregular = _indexed(policies)
    open_ended = F.endswith("_shape", F.lit("*"))
    shapes = regular.select("_shape").distinct().withColumn(
        "_size", F.when(open_ended, F.length("_shape") - 1).otherwise(F.length("_shape"))
    ).withColumn("_open", open_ended)

    segmented = requests.withColumn("_seg", F.split("path", "/"))
    # A request of n segments fits closed shapes of n places and open ones with fewer.
    sizes = segmented.withColumn("_size", F.explode(F.sequence(F.lit(1), F.size("_seg"))))
    fitting = sizes.join(shapes, "_size").filter(F.col("_open") == (F.col("_size") < F.size("_seg")))
    keyed = fitting.withColumn("_key", _literals(F.col("_seg"), F.split("_shape", "")))
    found = (
        keyed.join(regular, ["role", "method", "_shape", "_key"])
        .filter(path_matches(F.col("path"), F.col("pattern")))
        .select(*requests.columns, "pattern")
    )
    only_dots = F.rlike("pattern", F.lit(_DOTTED))
    ends, inner, rest = _by_ends(irregular.filter(~only_dots))
    parts = segmented.withColumn("_inner", F.explode(F.array_distinct("_seg")))
    for met in (
        _found_by_length(requests, irregular.filter(only_dots).select("role", "method", "pattern")),
        _found_by_ends(segmented, ends),
        parts.join(inner, ["role", "method", "_inner"]),
        requests.join(rest, ["role", "method"]),
    ):
        fits = met.filter(path_matches(F.col("path"), F.col("pattern")))
        found = found.unionByName(fits.select(*requests.columns, "pattern"))
    return found


def allowed(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """The requests with a boolean column ``allowed``.

    Distinct (role, path, method) triples are decided once and joined back.
    """
    triple = ["role", "path", "method"]
    decided = match_policies(requests.select(*triple).distinct(), policies).select(*triple).distinct()
    return requests.join(decided.withColumn("allowed", F.lit(True)), triple, "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False))
    )
