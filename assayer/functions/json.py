"""Objects in text that only mostly is JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fence(text: Column) -> Column:
    """Trimmed text, without the code fence around it if it has one."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^```[a-zA-Z]*\n?", ""), "\n?```$", ""), r"^\s+|\s+$", "")
    return F.when(body.startswith("```"), bare).otherwise(body)


def outermost(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without both."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def balanced(text: Column) -> Column:
    """The first brace and all up to the one that closes it, braces in strings apart; null if none does.

    One pass over the characters: depth, inside a string, behind a backslash, and where the object ended.
    """
    rest = F.substring(text, F.locate("{", text), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        plain, quote = ~s["quoted"], (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        after = F.struct(depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), (s["seen"] + 1).alias("seen"), F.when(depth == 0, s["seen"] + 1).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(after)

    # Only quotes, backslashes and braces change the state, so that all runs between them are one step each.
    pieces = F.split(rest, r"(?<=[{}\"\\])|(?=[{}\"\\])")
    done = F.aggregate(pieces, start, step)
    size = F.length(F.array_join(F.slice(pieces, 1, done["end"]), ""))
    return F.when((F.locate("{", text) > 0) & (done["end"] > 0), F.substring(rest, F.lit(1), size))


def object_text(text: Column) -> Column:
    """The part of a model's answer that is a JSON object, null if there is none.

    Tried in turn: the text without its code fence, what lies between its outermost
    braces, and the first object whose braces balance. Values that are no objects don't count.
    """
    body = without_fence(text)
    is_object = lambda x: F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT")
    return F.coalesce(*(F.when(is_object(x), x) for x in (body, outermost(body), balanced(body))))


def object_in_text(text: Column) -> Column:
    """``object_text`` as a VARIANT."""
    return F.try_parse_json(object_text(text))
