"""Line-level expressions over model texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two template calls a model names its inputs with. Either kind of quote, closed by
# the same; white space control at the braces; ``ref`` may name a package before the
# model and a version after it.
_OPEN, _CLOSE = r"\{\{[-+]?\s*", r"\s*[-+]?\}\}"
_VERSION = r"(?:\s*,\s*v(?:ersion)?\s*=\s*\w+)?"
REF_CALL = _OPEN + r"ref\s*\((?:\s*(['\"])[^'\"{}]+\1\s*,)?\s*(['\"])([^'\"{}]+)\2" + _VERSION + r"\s*\)" + _CLOSE
SOURCE_CALL = _OPEN + r"source\s*\(\s*(['\"])([^'\"{}]+)\1\s*,\s*(['\"])([^'\"{}]+)\3\s*\)" + _CLOSE
# The groups that hold the names.
REF_MODEL, SOURCE_SCHEMA, SOURCE_TABLE = 3, 2, 4
_SOURCE_NAME = f'"${SOURCE_SCHEMA}"."${SOURCE_TABLE}"'


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r"))


def is_comment(line: Column) -> Column:
    return F.startswith(strip(line), F.lit("--"))


def word(column: Column, ignore_case: bool = False) -> Column:
    """A pattern that matches the value of ``column`` as a whole word."""
    flags = "(?i)" if ignore_case else ""
    return F.concat(F.lit(flags + r"\b\Q"), F.replace(column, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def matching_lines(text: Column, label: Column, pattern: Column, searched: Column | None = None) -> Column:
    """``label:number: line`` for each line that matches and is not a comment.

    ``searched`` may be another form of the text with the same lines to look for the pattern in.
    """
    both = F.arrays_zip(lines(text).alias("line"), lines(text if searched is None else searched).alias("searched"))
    numbered = F.transform(
        both, lambda x, i: F.struct(x["line"].alias("line"), x["searched"].alias("searched"), (i + 1).alias("number"))
    )
    hits = F.filter(numbered, lambda x: ~is_comment(x["line"]) & F.rlike(x["searched"], pattern))
    return F.transform(
        hits, lambda x: F.concat(label, F.lit(":"), x["number"].cast("string"), F.lit(": "), strip(x["line"]))
    )


def blank_comments(text: Column) -> Column:
    """The text with its comments emptied and every line where it was; literals stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)'[^']*'|/\*.*?\*/|--[^\n]*|[^'/-]+|."), 0)
    blank = F.transform(
        pieces,
        lambda p: F.when(F.startswith(p, F.lit("--")), "")
        .when(F.startswith(p, F.lit("/*")), F.regexp_replace(p, r"[^\n]", ""))
        .otherwise(p),
    )
    return F.array_join(blank, "")


def without_comments(text: Column) -> Column:
    """Block comments and the rest of a line after ``--`` removed, but not inside a literal.

    A literal or comment is matched at once by whichever begins first. No group is
    repeated, so the length of a comment costs no stack.
    """
    def marked(sql: Column, *marks: str) -> Column:
        found = F.contains(sql, F.lit(marks[0]))
        return found if len(marks) == 1 else found | marked(sql, *marks[1:])

    def blocks_cut(sql: Column) -> Column:
        cut = F.regexp_replace(sql, r"(?s)('[^']*')|/\*.*?\*/", "$1 ")
        return F.when(marked(sql, "'", "/*"), cut).otherwise(sql)

    # A text without the marks that an expression looks for is not searched by it.
    lines_cut = F.regexp_replace(text, r"(?s)('[^']*'|/\*.*?\*/)|--[^\n]*", "$1")
    return once(F.when(marked(text, "--"), lines_cut).otherwise(text), blocks_cut)


def resolve_template(text: Column) -> Column:
    """``ref('x')`` as ``"x"`` and ``source('a', 'b')`` as ``"a"."b"``."""
    resolved = F.regexp_replace(text, SOURCE_CALL, F.lit(_SOURCE_NAME))
    return F.regexp_replace(resolved, REF_CALL, F.lit(f'"${REF_MODEL}"'))


def compile_template(text: Column, schema: str) -> Column:
    """Like :func:`resolve_template`, with models qualified by the schema they are built in."""
    resolved = F.regexp_replace(text, SOURCE_CALL, F.lit(_SOURCE_NAME))
    return F.regexp_replace(resolved, REF_CALL, F.lit(f'"{schema}"."${REF_MODEL}"'))
