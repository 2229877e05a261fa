"""What stands in which clause of a query text, by one fold over its tokens.

The fold keeps one letter per open parenthesis for the clause it is in, so that a comma, a
FROM or a star counts for the clause it stands in and for no other. It is no parser: texts
it cannot follow yield fewer names, never an error.

Most texts are plain: one select list without nested parentheses, from one table. A few
regular expressions find in those what the fold finds; all others go through the fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import once

_TOKEN = r"""'[^']*'|"[^"]*"|`[^`]*`|[\p{L}_][\p{L}\p{N}_$]*|[0-9][\p{L}\p{N}_]*|\S"""
# Clauses: nothing yet, select list, FROM with its joins, later ones, WITH list, DISTINCT ON list.
_NONE, _SELECT, _FROM, _LATER, _WITH, _ON = "nsflco"
_BETWEEN = "\u0001"
_NAME = r"""^(?:["`\p{L}_])"""
_FOUND = "array<string>"


def tokens(sql: Column) -> Column:
    """Words, quoted names, literals and single marks, with an end mark behind the last."""
    return F.concat(F.regexp_extract_all(sql, F.lit(_TOKEN), 0), F.array(F.lit(";")))


def _bare(token: Column) -> Column:
    return F.btrim(token, F.lit('"`'))


def _with_top(stack: Column, clause: str) -> Column:
    return F.concat(F.substring(stack, F.lit(1), F.length(stack) - 1), F.lit(clause))


def _step(state: Column, token: Column) -> Column:
    stack, expects, name = state["stack"], state["expects"], state["name"]
    before, refs, own, stars = state["before"], state["refs"], state["own"], state["stars"]
    word, top = F.lower(token), F.right(stack, F.lit(1))
    is_name = F.rlike(token, F.lit(_NAME))
    opens, closes, comma, dot = token == "(", token == ")", token == ",", token == "."
    in_from, in_with, in_select = top == _FROM, top == _WITH, top == _SELECT

    # A name goes on behind a dot; whatever else follows ends it, and "(" makes it a function.
    goes_on = (name != "") & (dot | F.endswith(name, F.lit(_BETWEEN)))
    ended = (name != "") & ~goes_on
    names_table = expects & in_from & is_name & ~word.isin("lateral", "only", "table", "select", "with")
    names_query = expects & in_with & is_name & (word != "recursive")
    reads = (word == "from") & (before != "distinct") & (in_select | ((top == _NONE) & (F.length(stack) == 1)))
    begins_with = (word == "with") & before.isin("", "(", ";", "as")

    next_stack = (
        F.when(opens, F.concat(stack, F.when(expects & in_from, _FROM)
                               .when((before == "on") & in_select, _ON).otherwise(_NONE)))
        .when(closes & (F.length(stack) > 1), F.substring(stack, F.lit(1), F.length(stack) - 1))
        .when(token == ";", _NONE)
        .when(word == "select", _with_top(stack, _SELECT))
        .when(begins_with, _with_top(stack, _WITH))
        .when(reads, _with_top(stack, _FROM))
        .when(in_from & word.isin("where", "group", "having", "order", "qualify", "union", "intersect", "except"),
              _with_top(stack, _LATER))
        .otherwise(stack)
    )
    next_expects = (
        (opens & expects & in_from) | begins_with | reads
        | (in_from & (comma | (word == "join")))
        | (in_with & comma)
        | (expects & in_from & word.isin("lateral", "only", "table"))
        | (expects & in_with & (word == "recursive"))
    )
    next_name = (
        F.when(goes_on, F.concat(name, F.when(dot, F.lit(_BETWEEN)).otherwise(F.lower(_bare(token)))))
        .when(names_table, F.lower(_bare(token)))
        .otherwise("")
    )
    bare_star = (token == "*") & in_select & before.isin("select", "distinct", "all", ",")
    alias_star = (token == "*") & in_select & (before == ".")
    return F.struct(
        next_stack.alias("stack"),
        next_expects.alias("expects"),
        next_name.alias("name"),
        # A star may follow DISTINCT ON (...) as it follows DISTINCT.
        F.when(closes & (top == _ON), "distinct").otherwise(word).alias("before"),
        F.when(dot, state["last"]).otherwise(token).alias("last"),
        F.when(ended & ~opens, F.array_append(refs, name)).otherwise(refs).alias("refs"),
        F.when(names_query, F.array_append(own, F.lower(_bare(token)))).otherwise(own).alias("own"),
        F.when(bare_star, F.array_append(stars, F.lit("")))
        .when(alias_star, F.array_append(stars, _bare(state["last"])))
        .otherwise(stars).alias("stars"),
    )


# A plain text: its select list, the name behind FROM and an alias. ASCII words alone, so a run of
# word characters is one token; no group is repeated without bound, so long texts cost no stack.
_WORD = "[A-Za-z_][A-Za-z0-9_]*+"
_SEGMENT = '(?:"[^"`\u0001\u0002]++"|' + _WORD + ")"
_DOTTED = _SEGMENT + r"(?:\s*\.\s*" + _SEGMENT + "){0,5}"
_PLAIN = (
    r"^\s*+(?i:select)(?=[\s*])([A-Za-z0-9_.*,\s()]*)\s(?i:from)\s+(" + _DOTTED + r")(?:\s+(?:(?i:as)\s+)?(" + _WORD + r"))?+\s*+$"
)
_CUT = "\u0002"
# Words that change the clause, in the list or behind FROM, quoted or not; such texts are not plain.
_TURNS = (
    r"(?i)(?<![A-Za-z0-9_])(?:select|with|from|distinct|all|on|lateral|only|table|recursive|join|where|group|having|order"
    r"|qualify|union|intersect|except)(?![A-Za-z0-9_])"
)
_CALL = r"\([A-Za-z0-9_.*,\s]*+\)"
_STAR = r"(?:(?:^|,)\s*+|([A-Za-z0-9_]++)\.\s*+)\*"


def _plain(parts: Column) -> tuple[Column, Column]:
    """Whether a text is plain, and what :func:`scan` finds if it is.

    ``parts`` are those of a text that ``_PLAIN`` matches: select list, name, alias and nothing.
    """
    listed, read, alias = (F.get(parts, F.lit(k)) for k in range(3))
    # What stands in the parentheses of a call is no star of the list.
    outside = F.when(F.contains(listed, F.lit("(")), F.regexp_replace(listed, _CALL, ")")).otherwise(listed)
    even = F.regexp_count(listed, F.lit(r"\(")) == F.regexp_count(listed, F.lit(r"\)"))
    plain = (
        (F.size(parts) == 4)
        & ~F.rlike(F.concat(listed, F.lit(" "), read, F.lit(" "), alias), F.lit(_TURNS))
        & ~F.contains(outside, F.lit("("))
        & ~F.rlike(outside, F.lit(r"\.(?<![A-Za-z0-9_]\.)"))
        & (~F.contains(listed, F.lit(")")) | even)
    )
    segments = F.regexp_extract_all(read, F.lit(_SEGMENT), 0)
    name = F.array_join(F.transform(segments, lambda t: F.lower(_bare(t))), _BETWEEN)
    none = F.array().cast(_FOUND)
    stars = F.when(F.contains(listed, F.lit("*")), F.regexp_extract_all(outside, F.lit(_STAR), 1)).otherwise(none)
    return plain, F.struct(F.array(name).alias("refs"), none.alias("own"), stars.alias("stars"))


def fold(sql: Column) -> Column:
    """What :func:`scan` finds, for any text."""
    none = F.array().cast(_FOUND)
    start = F.struct(
        F.lit(_NONE).alias("stack"), F.lit(False).alias("expects"), F.lit("").alias("name"),
        F.lit("").alias("before"), F.lit("").alias("last"), none.alias("refs"), none.alias("own"), none.alias("stars"),
    )
    kept = lambda state: F.struct(*[state[k].alias(k) for k in ("refs", "own", "stars")])
    return F.aggregate(tokens(sql), start, _step, kept)


def scan(sql: Column) -> Column:
    """``refs`` (lower-case names read, segments joined by U+0001), ``own`` (names a WITH
    defines) and ``stars`` (per star of a select list its alias, "" for a bare one).

    ``sql`` has no comments left. A null text gives null.
    """
    # Matched once: the text is replaced by its parts, and left whole where it is not plain.
    def matched(whole: Column) -> Column:
        cut = F.regexp_replace(whole, _PLAIN, f"$1{_CUT}$2{_CUT}$3{_CUT}")
        return F.struct(whole.alias("whole"), F.when(~F.contains(whole, F.lit(_CUT)), F.split(cut, _CUT)).alias("parts"))

    def found(text: Column) -> Column:
        plain, plainly = _plain(text["parts"])
        return F.when(plain, plainly).otherwise(fold(text["whole"]))

    return once(once(sql, matched), found)


def segment(name: Column, from_end: int) -> Column:
    """A segment of a name that :func:`scan` found, counted from the end; null if absent."""
    parts = F.split(name, _BETWEEN)
    return F.get(parts, F.size(parts) - from_end)
