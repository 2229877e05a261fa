"""How a change reaches an asset: read references, stars, evidence, break mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import clauses, text

# The statuses and modes of an assessment row.
ORIGIN, CASCADE, NOT_IMPACTED = "ORIGIN_HARD_BREAK", "CASCADE_HARD_BREAK", "NOT_IMPACTED"
HARD_BREAK, SILENT_CORRUPTION, UNAFFECTED = "HARD_BREAK", "SILENT_CORRUPTION", "UNAFFECTED"
# Named by the specification without a rule, so no row is ever given it.
DEGRADED = "DEGRADED"


def table_refs(compiled: DataFrame) -> DataFrame:
    """(path, schema_name, table_name) of each table a compiled model reads.

    Names in FROM clauses, lists and joins included, at any depth; names defined by the
    model's own WITH are not tables, nor are functions. Unqualified tables have an empty
    schema.
    """
    texts = compiled.select("path", F.lit(None).cast("string").alias("source_text"), "compiled_text")
    # An outer explode: the inner one would repeat the fold in a pushed-down filter.
    reads = model_facts(texts).select("path", F.explode_outer("reads").alias("_read")).filter(F.col("_read").isNotNull())
    return reads.select("path", F.col("_read.schema_name").alias("schema_name"), F.col("_read.table_name").alias("table_name")).distinct()


def _stars(sql: Column) -> Column:
    """Array of aliases, one per star; an empty string stands for a bare star."""
    return clauses.scan(sql)["stars"]


def star_aliases(compiled: DataFrame) -> DataFrame:
    """One row per star expansion: the alias of ``a.*``, null for a bare ``*``."""
    sql = text.without_comments(F.col("compiled_text"))
    stars = compiled.select("path", F.posexplode_outer(_stars(sql)).alias("position", "alias"))
    return stars.filter(F.col("position").isNotNull()).select("path", "position", F.nullif("alias", F.lit("")).alias("alias"))


# A bare star at the start of a select item, and not the sign of a product.
_BARE_STAR = (
    r"(?i)(?:^\s*|,\s*|\b(?:select|distinct|all)\s+|\bon\s*\([^)]*\)\s*)\*\s*(?:$|,|(?:from|except|exclude|replace)\b)"
)


def _star_evidence(source: Column, path: Column, aliases: Column) -> Column:
    """Source lines that hold one of the stars outside comments, each once."""
    patterns = F.transform(
        F.array_distinct(aliases),
        lambda a: F.when(a == "", F.lit(_BARE_STAR)).otherwise(
            F.concat(F.lit(r"\b\Q"), F.replace(a, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r'\E["`]?\s*\.\s*\*'))
        ),
    )
    found = F.flatten(F.transform(patterns, lambda p: text.matching_lines(source, path, p, text.blank_comments(source))))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def model_facts(corpus: DataFrame) -> DataFrame:
    """What each model's texts say, by one scan: path, is_readable, select_star_exposure,
    star_evidence (source lines) and reads, the tables in its FROM clauses.

    ``corpus`` is ``path, source_text, compiled_text``. A model without compiled
    text is reported as not readable and not exposed, with a note on that.
    """
    rows = corpus.select("*", clauses.scan(text.without_comments(F.col("compiled_text"))).alias("_found"))
    stars = F.col("_found.stars")
    exposed = F.coalesce(F.size(stars) > 0, F.lit(False))
    note = F.array(F.concat("path", F.lit(": no readable compiled text, stars could not be checked")))
    named = F.transform(
        F.array_distinct("_found.refs"),
        lambda n: F.struct(F.coalesce(clauses.segment(n, 2), F.lit("")).alias("schema_name"), clauses.segment(n, 1).alias("table_name")),
    )
    own = F.col("_found.own")
    return rows.select(
        "path",
        F.col("compiled_text").isNotNull().alias("is_readable"),
        exposed.alias("select_star_exposure"),
        F.when(F.col("compiled_text").isNull(), note)
        .when(exposed, _star_evidence(F.col("source_text"), F.col("path"), stars))
        .otherwise(F.array().cast("array<string>"))
        .alias("star_evidence"),
        F.filter(named, lambda n: (n["schema_name"] != "") | ~F.array_contains(own, n["table_name"])).alias("reads"),
    )


def star_exposure(corpus: DataFrame) -> DataFrame:
    """Whether each model expands a star, with the source lines that show it."""
    return model_facts(corpus).drop("reads")


def line_evidence(corpus: DataFrame, column: Column, ignore_case: bool = True) -> DataFrame:
    """One row per source line that names the column, comment lines left out."""
    pattern = text.word(column, ignore_case)
    lines = text.matching_lines(F.col("source_text"), F.col("path"), pattern)
    return corpus.select("path", F.explode_outer(lines).alias("evidence")).filter(F.col("evidence").isNotNull())


def compile_status(in_column_scope: Column, path: Column, is_readable: Column, reads_changed_table: Column) -> Column:
    """The rule ladder for one (change, asset)."""
    return (
        F.when(~in_column_scope, NOT_IMPACTED)
        .when(path.isNotNull() & is_readable & reads_changed_table, ORIGIN)
        .otherwise(CASCADE)
    )


def compile_evidence(
    status: Column, path: Column, is_readable: Column, table: Column, origin_lines: Column
) -> Column:
    """Why the row got its status, as an array of strings."""
    return (
        F.when(status == NOT_IMPACTED, F.array().cast("array<string>"))
        .when(path.isNull(), F.array(F.lit("no model file known, in scope by column lineage alone")))
        .when(~is_readable, F.array(F.concat(path, F.lit(": compiled text not readable, origin not confirmed"))))
        .when(status == ORIGIN, F.coalesce(origin_lines, F.array().cast("array<string>")))
        .otherwise(F.array(F.concat(path, F.lit(": reads "), table, F.lit(" only through an upstream model"))))
    )


def break_mode(status: Column, star: Column) -> Column:
    return (
        F.when(status.isin(ORIGIN, CASCADE), HARD_BREAK)
        .when(star, SILENT_CORRUPTION)
        .otherwise(UNAFFECTED)
    )


def affected(assessment: DataFrame) -> DataFrame:
    return assessment.filter(F.col("break_mode") != UNAFFECTED)
