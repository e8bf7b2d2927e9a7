"""Personal data: fixed forms, and further identifiers by bootstrapped contexts.

Emails, IP addresses, card and phone numbers of the fixed forms are found in every text; they are the seeds. Other
tokens that look like identifiers (an @, or four digits and more) are candidates. Seeds and candidates are instances;
the words around an occurrence are its patterns: two words before, and one before with one after. Patterns and
instances form a bipartite graph that Spark scores in rounds:

* a pattern's confidence for a kind is the confidence of its distinct instances of that kind, over that of its
  instances of any kind, UNKNOWN for each part of an instance that is of no kind yet, and DOUBT; so seeds of other kinds
  speak against a pattern and unseen candidates hardly do. It counts only if it has met MIN_SUPPORT distinct confident
  instances of the kind;
* a candidate's confidence for a kind is the noisy-or of its accepted patterns; seeds keep theirs.

Occurrences of candidates in accepted patterns become spans of that kind. Rounds only read the table of occurrences,
never the texts again, and everything per pattern or instance is a partial aggregate.

Results: null and empty texts have no spans; a kind's fixed spans never overlap each other, and further spans overlap
no fixed one; equal texts have equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import cut, small_slices

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, CONFIDENT, LIKELY = 5, 0.8, 0.5
#: A pattern that occurs with very few distinct instances says little; this is added to each denominator.
DOUBT = 1.0
#: What a candidate of no known kind weighs against a pattern: it is what the method is to find, so little, but not
#: nothing, since a context of numbers of all sorts should not be taken for one of phones.
UNKNOWN = 0.05

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Digits before a run of digits would be part of it, so these start at the first digit only and never rescan a run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
DIGIT = re.compile(r"[0-9]")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|=`~^/\\"

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Spans of the email form, found from each @ so that long runs of letters are read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def fixed_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the four fixed forms, each leftmost and without overlaps; matches that fail their test are dropped."""
    if not HINT.search(text):
        return {kind: [] for kind in KINDS}
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": cards,
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


def _word(text: str) -> str:
    word = text.strip(EDGES).lower()
    return word if len(word) <= 40 else xxhash.xxh64_hexdigest(word.encode())


def occurrences(text: str, fixed: dict[str, list[Span]]) -> list[tuple[int, int, str, str, list[str]]]:
    """(start, end, kind or "", instance, patterns) of every seed and candidate of a text, by position."""
    if not HINT.search(text):
        return []
    seeds = sorted((a, b, kind) for kind in KINDS for a, b in fixed[kind])
    tokens = [m.span() for m in TOKEN.finditer(text)]
    found, k, covered = [(a, b, kind) for a, b, kind in seeds], 0, 0
    for a, b in tokens:
        while k < len(seeds) and seeds[k][0] < b:
            covered = max(covered, seeds[k][1])
            k += 1
        if a < covered:
            continue
        raw = text[a:b]
        core = raw.strip(EDGES)
        if len(core) >= 5 and ("@" in core[1:-1] or len(DIGIT.findall(core)) >= 4):
            at = a + raw.index(core)
            found.append((at, at + len(core), ""))
    found.sort()
    out, left = [], 0
    for a, b, kind in found:
        while left < len(tokens) and tokens[left][1] <= a:
            left += 1
        right = left
        while right < len(tokens) and tokens[right][0] < b:
            right += 1
        before = [_word(text[x:y]) for x, y in tokens[max(0, left - 2) : left]]
        before = ["^"] * (2 - len(before)) + before
        after = _word(text[slice(*tokens[right])]) if right < len(tokens) else "$"
        patterns = [f"{before[0]} {before[1]} _", f"{before[1]} _ {after}"]
        out.append((a, b, kind, xxhash.xxh64_hexdigest(text[a:b].encode()), patterns))
    return out


FOUND = (
    "key bigint, counts array<bigint>, base array<struct<kind:string,start:bigint,end:bigint>>,"
    " seen array<struct<start:bigint,end:bigint,kind:string,instance:string,patterns:array<string>>>"
)
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SEEN = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("kind", pa.string()),
            ("instance", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)


def text_key():
    """A hash of the text: equal texts have equal spans."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), the fixed spans and the occurrences of every row."""

    def run(batches):
        for batch in small_slices(batches):
            counts, base, seen = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                fixed = fixed_spans(text)
                counts.append([len(fixed[k]) for k in KINDS])
                base.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in fixed[k]])
                names = ("start", "end", "kind", "instance", "patterns")
                seen.append([dict(zip(names, x, strict=True)) for x in occurrences(text, fixed)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(counts, pa.list_(pa.int64())),
                    pa.array(base, SPAN),
                    pa.array(seen, SEEN),
                ],
                names=["doc_id", "key", "counts", "base", "seen"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key().alias("key"))
    return rows.mapInArrow(run, f"doc_id bigint, {FOUND}")


def bootstrap(found: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of the accepted patterns. Rounds over the graph go on until no further pattern is accepted; a
    pattern once accepted stays, so there are no more rounds than patterns, and commonly two."""
    each = found.select(F.explode("seen").alias("o")).select("o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")).drop("n"))
    if edges.filter("kind = ''").isEmpty():
        return edges.select("kind", "pattern", F.lit(1.0).alias("confidence")).limit(0)
    # Distinct instances of a pattern, of any kind or none.
    totals = edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.filter("kind <> ''").select("kind", "instance").distinct().withColumn("confidence", F.lit(1.0))
    known, accepted = seeds, None
    plain = cut(edges.select("pattern", "instance").distinct().join(totals, "pattern"))
    while True:
        any_kind = known.groupBy("instance").agg(F.max("confidence").alias("settled"))
        settled = plain.join(any_kind, "instance").groupBy("pattern").agg(F.sum("settled").alias("settled"))
        met = plain.join(known, "instance").groupBy("kind", "pattern").agg(
            F.sum("confidence").alias("sum"),
            F.count(F.when(F.col("confidence") >= LIKELY, 1)).alias("support"),
            F.first("total").alias("total"),
        )
        against = F.col("settled") + UNKNOWN * (F.col("total") - F.col("settled")) + DOUBT
        fresh = (
            met.join(settled, "pattern")
            .withColumn("confidence", F.col("sum") / against)
            .filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= CONFIDENT))
            .select("kind", "pattern", "confidence")
        )
        if accepted is None:
            accepted = cut(fresh)
            more = not accepted.isEmpty()
        else:
            before, fresh = accepted, cut(fresh)
            accepted = cut(fresh.unionByName(before.join(fresh, ["kind", "pattern"], "left_anti")))
            more = not fresh.join(before, ["kind", "pattern"], "left_anti").isEmpty()
        if not more:
            return accepted
        # Noisy-or over a candidate's accepted patterns; instances that are seeds stay as they are.
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        new = (
            plain.join(accepted, "pattern")
            .groupBy("kind", "instance")
            .agg((1 - F.exp(doubt)).alias("confidence"))
            .join(seeds.select("instance").distinct(), "instance", "left_anti")
        )
        known = cut(seeds.unionByName(new.select(*seeds.columns)))


def further_spans(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(key, further): spans of candidates in accepted patterns, for the texts that have any.

    A candidate that patterns of several kinds accept gets the kind of the most confident one.
    """
    each = found.select("key", F.explode("seen").alias("o")).filter("o.kind = ''")
    each = each.select("key", "o.start", "o.end", F.explode("o.patterns").alias("pattern")).distinct()
    best = F.max(F.struct("confidence", "kind"))["kind"].alias("kind")
    hits = each.join(accepted, "pattern").groupBy("key", "start", "end").agg(best)
    # One row per text, however many copies it has; a text's own spans are all that meets here.
    return hits.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__pii_spans"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, key, counts (of the fixed spans, by KINDS), base and spans (all) of every row of docs."""
    found = cut(scan(docs))
    # Written out, so that the join below has plain exchanges and a text of very many copies is split.
    further = cut(further_spans(found, bootstrap(found)))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = found.drop("seen").join(further, "key", "left")
    return joined.withColumn("spans", F.concat("base", F.coalesce("__pii_spans", none))).drop("__pii_spans")


def spelled(spans):
    """kind:start:end of spans, by kind as listed and then by start, joined by commas."""
    rank = {k: i for i, k in enumerate(KINDS)}
    number = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(number[s["kind"]].alias("k"), s["start"], s["end"], s["kind"]))
    each = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(each, ",")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets, and n_chars to match, if there is one.

    Overlapping spans are replaced together, under the kind of the one that starts first. Null texts stay null.
    """
    found = cut(scan(docs))
    further = cut(further_spans(found, bootstrap(found)))
    names = docs.columns
    rest = docs.withColumn("__pii_key", text_key())
    joined = rest.join(further.select(F.col("key").alias("__pii_key"), "__pii_spans"), "__pii_key", "left")

    def run(batches):
        for batch in small_slices(batches):
            out = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("__pii_spans").to_pylist(), strict=True):
                out.append(text if not text else masked(text, more or []))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = joined.select(*names, "__pii_spans").mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def masked(text: str, further: list[dict]) -> str:
    fixed = fixed_spans(text)
    spans = sorted([(a, b, k) for k in KINDS for a, b in fixed[k]] + [(s["start"], s["end"], s["kind"]) for s in further])
    out, at, end, kind = [], 0, -1, ""
    for a, b, k in [*spans, (len(text) + 1, 0, "")]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"<{kind.upper()}>")
            at = end
        if a <= len(text):
            out.append(text[at:a])
            end, kind = b, k
    return "".join([*out, text[at:]])
