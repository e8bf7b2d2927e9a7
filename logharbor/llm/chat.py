"""Conversations as training text that reads back exactly, in DataFrame functions only.

The grammar is deterministic: a conversation is turns one after another, a turn is

    <|im_start|> role NEWLINE text <|im_end|> NEWLINE

so a reader cuts at every <|im_end|> NEWLINE, and a turn's role ends at its first line break. Texts that hold control strings would
be read as something else. Therefore every turn is rendered as it is and reparsed; what does not come back identical is escaped and
rendered again; a turn that still differs stops the job:

* In a control string (CONTROLS) of a role or text a backslash goes behind its first character, which makes <\\|im_end|> of
  <|im_end|>. Backslashes that stand there already get one more, and the reader takes one off, so this is undone exactly.
* In a role a line break becomes \\n and a backslash \\\\.

No control string begins inside another and none holds a backslash, so the second round always comes back identical. Texts
without conflicts stay as they are. Text under the loss mask is that of the roles in TRAINED.

Results for odd rows: a null role or text reads as empty; rows of equal turn (null first) are ordered by what they are rendered to;
repeated rows are turns of their own; rows without a conv_id are one conversation without an id; an empty table gives no rows; extra columns
are left behind. A conversation is one text, so it has to fit the 2 GB of a string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
# Strings that tokenizers of chat models read as control tokens, those of this grammar first.
CONTROLS = (
    START,
    END,
    "<|endoftext|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<s>",
    "</s>",
    "<<SYS>>",
    "<</SYS>>",
    "[INST]",
    "[/INST]",
)
TRAINED = ("assistant",)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_<>/" else f"\\{c}" for c in text)


def _sites(form: str) -> str:
    """The regular expression ``form`` for each first character of a control string: FIRST is that, REST what may follow it."""
    firsts = sorted({c[0] for c in CONTROLS})
    rests = ["|".join(_quoted(c[1:]) for c in CONTROLS if c[0] == first) for first in firsts]
    return "|".join(form.replace("FIRST", _quoted(f)).replace("REST", f"(?:{r})") for f, r in zip(firsts, rests, strict=True))


BARE = _sites("FIRSTREST")
SITE = _sites(r"FIRST(?=\\*REST)")
ESCAPED = _sites(r"(FIRST)\\(?=\\*REST)")


def _may_hold_sites(text: Column) -> Column:
    """False for texts without the first character of any control string; these need no regular expression."""
    firsts = sorted({c[0] for c in CONTROLS})
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in firsts])


def escape(text: Column) -> Column:
    """A backslash behind the first character of every control string, before those that stand there."""
    return F.when(_may_hold_sites(text), F.regexp_replace(text, F.lit(SITE), F.lit("$0" + r"\\"))).otherwise(text)


def unescape(text: Column) -> Column:
    firsts = "".join(f"${i + 1}" for i in range(len({c[0] for c in CONTROLS})))
    return F.when(_may_hold_sites(text), F.regexp_replace(text, F.lit(ESCAPED), F.lit(firsts))).otherwise(text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(LINE), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Pairs are read from the left; doubled backslashes are split off first, so that no other pair is taken apart."""
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit(LINE))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(LINE), text, F.lit(END + LINE))


def _body(inner: Column) -> Column:
    """(role, text) as they stand between the marks of a turn; null if a control string stands there."""
    cut_at = F.instr(inner, LINE)
    role, text = F.substring(inner, F.lit(1), cut_at - 1), F.substring(inner, cut_at + 1, F.char_length(inner))
    bare = _may_hold_sites(inner) & F.rlike(inner, F.lit(BARE))
    return F.when((cut_at > 0) & ~bare, F.struct(role.alias("role"), text.alias("text")))


def parse(formatted: Column) -> Column:
    """The turns (role, text, skip, take, rest) of a formatted conversation; null if it isn't one.

    role and text are unescaped. skip, take and rest are the characters of the turn before, in and behind its text as
    formatted; take is 0 and all is rest for roles that aren't trained on, so the three add up to the loss mask.
    """

    def turn(piece: Column) -> Column:
        whole = F.startswith(piece, F.lit(START))
        inner = F.when(whole, F.substring(piece, F.lit(len(START) + 1), F.char_length(piece)))
        return F.element_at(F.transform(F.array(_body(inner)), read), 1)

    def read(b: Column) -> Column:
        role = unescape_role(b["role"])
        before = F.char_length(b["role"]) + F.lit(len(START) + len(LINE))
        own = F.when(role.isin(*TRAINED), F.char_length(b["text"])).otherwise(F.lit(0))
        rest = F.char_length(b["text"]) - own + F.lit(len(END) + len(LINE))
        found = F.struct(
            role.alias("role"), unescape(b["text"]).alias("text"), before.alias("skip"), own.alias("take"), rest.alias("rest")
        )
        return F.when(b.isNotNull(), found)

    pieces = F.split(formatted, _quoted(END) + "\n", -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    good = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(good, turns)


def render_turn(role: Column, text: Column) -> Column:
    """A turn that reads back as (role, text): as it is if it can be, else with what conflicts escaped."""

    def same(rendered: Column, want: Column) -> Column:
        got = F.transform(parse(rendered), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.coalesce(got == F.array(want), F.lit(False))

    want = F.struct(role.alias("role"), text.alias("text"))
    plain = render(role, text)
    safe = render(escape_role(role), escape(text))
    wrong = F.raise_error(F.lit("a turn does not read back")).cast("string")
    return F.when(same(plain, want), plain).when(same(safe, want), safe).otherwise(wrong)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the text of every conversation and the turns that ``parse`` reads from it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").alias("_turn"), role.alias("role"), text.alias("text"))
    rendered = rows.select(
        "conv_id", "_turn", render_turn(F.col("role"), F.col("text")).alias("_text"), F.xxhash64("role", "text").alias("_source")
    )
    # Structs are sorted field by field, nulls first.
    turns = F.sort_array(F.collect_list(F.struct("_turn", "_text", "_source")))
    grouped = rendered.groupBy("conv_id").agg(turns.alias("_turns"))
    whole = grouped.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_text"]), "").alias("formatted"),
        F.transform("_turns", lambda t: t["_source"]).alias("_source"),
    ).withColumn("turns", parse(F.col("formatted")))
    read = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    wrong = F.raise_error(F.lit("a conversation does not read back")).cast(whole.schema["turns"].dataType)
    same = F.coalesce(read == F.col("_source"), F.lit(False))
    return whole.select("conv_id", "formatted", F.when(same, F.col("turns")).otherwise(wrong).alias("turns"))
