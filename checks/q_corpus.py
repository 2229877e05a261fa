"""Scans, rewrites and checks of model texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import estate as e
from checks.registry import query
from faultline.functions import text
from faultline.operators import classify, patch, verify
from faultline.sources import files

OLD, NEW = "cust_id", "customer_id"

# Comments removed the way the operators do it, in the other engine's words.
CLEAN = r"regexp_replace(regexp_replace({t}, '/\*[^*]*\*+([^/*][^*]*\*+)*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"
COMPILED = {
    "compiled": f"SELECT model, path, source_text, CASE WHEN NOT contains(source_text, 'of red ') "
                f"THEN {e.COMPILED.format(t='source_text')} END AS compiled_text FROM fx_corpus",
}
SOURCE_LINES = {"source_lines": f"SELECT path, {e.LINES.format(t='source_text')} FROM fx_corpus"}


def corpus(i):
    return e.part_corpus(i)


@query("model_corpus", "SELECT path, sha256(source_text) AS source_hash, sha256(compiled_text) AS compiled_hash FROM compiled", COMPILED)
def model_corpus(i):
    rows = corpus(i)
    both = files.model_corpus(i.corpus, rows.filter(F.col("compiled_text").isNotNull()))
    return both.select(
        "path", F.sha2("source_text", 256).alias("source_hash"), F.sha2("compiled_text", 256).alias("compiled_hash"))


@query("template_resolve", r"""SELECT path, regexp_replace(regexp_replace(source_text,
    '\{\{\s*source\(''([^'']+)'', ''([^'']+)''\)\s*\}\}', '"\1"."\2"', 'g'), '\{\{\s*ref\(''([^'']+)''\)\s*\}\}', '"\1"', 'g') AS resolved FROM fx_corpus""")
def template_resolve(i):
    return i.corpus.select("path", text.resolve_template(F.col("source_text")).alias("resolved"))


# What the texts of the parts read and expand, as the parts themselves say; red parts are not compiled,
# and parts of size 33 leave a parenthesis open before their FROM, so only what a WITH reads is found.
READ = """
SELECT path, schema_name, table_name FROM (
    SELECT 'models/parts/part_' || p_partkey || '.sql' AS path, p_size, p_brand, unnest(['raw', 'public']) AS schema_name,
           unnest(['raw_parts_' || p_size, 'part_' || (p_partkey + p_size)]) AS table_name
    FROM part WHERE NOT starts_with(p_name, 'red ')) r
WHERE p_size <> 33 OR (p_brand = 'Brand#8' AND schema_name = 'public')"""
STARS = """
SELECT path, unnest(found) AS alias FROM (
    SELECT 'models/parts/part_' || p_partkey || '.sql' AS path,
           CASE WHEN p_size = 50 THEN [CAST(NULL AS VARCHAR)] ELSE list_concat(CASE WHEN p_size <= 10 THEN ['p'] ELSE [] END,
                CASE WHEN p_brand = 'Brand#5' THEN [CAST(NULL AS VARCHAR)] ELSE [] END) END AS found
    FROM part WHERE NOT starts_with(p_name, 'red ')) f"""


@query("table_refs", READ)
def table_refs(i):
    return classify.table_refs(corpus(i).filter(F.col("compiled_text").isNotNull()))


@query("star_aliases", STARS)
def star_aliases(i):
    return classify.star_aliases(corpus(i).filter(F.col("compiled_text").isNotNull())).select("path", "alias")


@query("star_exposure", f"""
SELECT c.path, compiled_text IS NOT NULL AS is_readable, compiled_text IS NOT NULL AND s.path IS NOT NULL AS select_star_exposure,
       CASE WHEN compiled_text IS NULL THEN c.path || ': no readable compiled text, stars could not be checked'
            WHEN s.path IS NULL THEN '' ELSE l.lines END AS star_evidence
FROM compiled c LEFT JOIN (SELECT DISTINCT path FROM ({STARS}) a) s ON s.path = c.path
LEFT JOIN (SELECT path, string_agg(path || ':' || number || ': ' || trim(line), '; ' ORDER BY number) AS lines FROM source_lines
           WHERE (line = '    p.*,' AND path IN (SELECT path FROM ({STARS}) a WHERE alias = 'p'))
              OR (line IN ('select *', '    s.part_id as other, *,') AND path IN (SELECT path FROM ({STARS}) a WHERE alias IS NULL))
           GROUP BY path) l ON l.path = c.path""", {**COMPILED, **SOURCE_LINES})
def star_exposure(i):
    return classify.star_exposure(corpus(i))


@query("line_evidence", rf"""
SELECT path, path || ':' || number || ': ' || trim(line) AS evidence FROM source_lines
WHERE NOT starts_with(trim(line), '--') AND regexp_matches(line, '(?i)\b{OLD}\b')""", SOURCE_LINES)
def line_evidence(i):
    return classify.line_evidence(i.corpus, F.lit(OLD))


ANCHORS = {
    **SOURCE_LINES,
    "anchors": rf"""
        SELECT path, min(number) AS line_number, arg_min(line, number) AS line FROM source_lines
        WHERE NOT starts_with(trim(line), '--') AND regexp_matches(line, '\b{OLD}\b') GROUP BY path""",
    "patched": rf"""
        SELECT c.model, c.path, c.source_text, a.line_number, a.line,
               CASE WHEN a.path IS NULL THEN 'NO_ANCHOR'
                    WHEN regexp_matches(a.line, '^\s*([a-z]+\.)?{OLD}( as [a-z_]+)?,?$') THEN 'PATCHED' ELSE 'NEEDS_HUMAN' END AS patch_status
        FROM fx_corpus c LEFT JOIN anchors a ON a.path = c.path""",
    "rewritten": rf"""
        SELECT *, CASE WHEN patch_status = 'PATCHED' THEN replace(source_text, chr(10) || line || chr(10), chr(10)
            || regexp_replace(CASE WHEN contains(line, ' as ') THEN line ELSE regexp_replace(line, '{OLD}', '{OLD} as {OLD}') END,
                              '{OLD}', '{NEW}') || chr(10)) ELSE source_text END AS patched_text
        FROM patched""",
}


@query("anchor_line", "SELECT c.path, line_number, line FROM fx_corpus c LEFT JOIN anchors a ON a.path = c.path "
       "WHERE line_number IS NOT NULL", ANCHORS)
def anchor_line(i):
    return patch.anchor_line(i.corpus, F.lit(OLD)).filter(F.col("line_number").isNotNull())


def patched(i):
    return patch.rename_patch(i.corpus, F.lit(OLD), F.lit(NEW))


@query("rename_patch", "SELECT path, patch_status, patched_text FROM rewritten", ANCHORS)
def rename_patch(i):
    return patched(i).select("path", "patch_status", "patched_text")


@query("patch_diff", f"""
SELECT b.path, b.number AS line_number, b.line AS before, a.line AS after
FROM source_lines b JOIN (SELECT path, {e.LINES.format(t='patched_text')} FROM rewritten) a ON a.path = b.path AND a.number = b.number
WHERE a.line <> b.line""", ANCHORS)
def patch_diff(i):
    return patch.patch_diff(patched(i))


CHECKED = {
    "static": f"""
        SELECT path, model, p_brand, CASE WHEN contains(source_text, 'config(') THEN 'unresolved template call'
             WHEN contains(source_text, 'coalesce(') THEN 'unbalanced parentheses: ' ||
                  (length({CLEAN.format(t='source_text')}) - length(replace({CLEAN.format(t='source_text')}, '(', '')) - calls) || ' opened, ' ||
                  (length({CLEAN.format(t='source_text')}) - length(replace({CLEAN.format(t='source_text')}, ')', '')) - calls) || ' closed' END AS raw_error
        FROM (SELECT *, CASE WHEN p_brand = 'Brand#8' THEN 3 ELSE 2 END AS calls
              FROM fx_corpus JOIN part ON model = 'part_' || CAST(p_partkey AS STRING)) c""",
    "uses": f"""
        SELECT path, 'part_' || CAST(p_partkey + p_size AS STRING) AS name, '' AS source_name FROM static JOIN part ON model = 'part_' || CAST(p_partkey AS STRING)
        UNION ALL
        SELECT path, 'raw_parts_' || CAST(p_size AS STRING), 'raw' FROM static JOIN part ON model = 'part_' || CAST(p_partkey AS STRING)""",
    "missing": """
        SELECT u.path, u.source_name, u.name FROM uses u
        WHERE NOT EXISTS (SELECT 1 FROM fx_corpus c WHERE u.source_name = '' AND c.model = u.name)
          AND NOT EXISTS (SELECT 1 FROM fx_declared_sources s WHERE s.source_name = u.source_name AND s.table_name = u.name)""",
}


@query("check_static", "SELECT path, raw_error IS NULL AS passed, raw_error FROM static", CHECKED)
def check_static(i):
    return verify.check_static(i.corpus)


@query("check_refs", "SELECT path, source_name, name FROM missing", CHECKED)
def check_refs(i):
    return verify.check_refs(i.corpus, i.corpus, i.declared_sources)


def verified(i):
    return verify.verification_report(i.corpus, i.corpus, i.declared_sources)


@query("verification_report", """
SELECT s.path, s.raw_error IS NULL AND m.names IS NULL AS passed, CASE WHEN s.raw_error IS NULL THEN 2 ELSE 1 END AS n_outcomes,
       CASE WHEN s.raw_error IS NOT NULL THEN 'V1_STATIC' WHEN m.names IS NOT NULL THEN 'V2_COMPILE' END AS failed_level,
       CASE WHEN s.raw_error IS NOT NULL THEN s.raw_error WHEN m.names IS NOT NULL THEN 'not found: ' || m.names END AS raw_error
FROM static s LEFT JOIN (SELECT path, string_agg(full_name, ', ' ORDER BY full_name) AS names
    FROM (SELECT path, CASE WHEN source_name = '' THEN name ELSE source_name || '.' || name END AS full_name FROM missing) f GROUP BY path) m ON m.path = s.path""", CHECKED)
def verification_report(i):
    return verified(i).select(
        "path", "passed", F.size("outcomes").alias("n_outcomes"), F.col("first_failure.level").alias("failed_level"),
        F.col("first_failure.raw_error").alias("raw_error"))


WITHOUT_ALIAS = rf"regexp_replace(patched_text, '(?i)\bas\s+{OLD}\b', 'as _', 'g')"


@query("residue_scan", rf"""
SELECT path, path || ':' || number || ': ' || trim(line) AS evidence
FROM (SELECT path, {e.LINES.format(t=WITHOUT_ALIAS)} FROM rewritten) l
WHERE NOT starts_with(trim(line), '--') AND regexp_matches(line, '(?i)\b{OLD}\b')""", ANCHORS)
def residue_scan(i):
    return verify.residue_scan(patched(i), F.lit(OLD))
