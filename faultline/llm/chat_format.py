"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are its
context, and only its reply is trained on. The context of an example is the
formatted conversation up to the reply, so the examples of a conversation share
one text: an example row holds what its context adds to the example before
(``lead``), its reply (``target``) and the spans of both in the shared text. That
is linear in the conversation. ``prefix_targets`` writes each example out whole, as a
trainer takes it: the prefix of all turns before the reply, and the reply. The query reads
its results back from those. Their text is quadratic in a conversation, of which a task
holds one example at a time. Turns after the last reply are a last row without target.

Template (roles user, assistant, system, any other):

    [INST] text [/INST]   <s> text </s>   <<SYS>> text <</SYS>>   [ROLE] role [TEXT] text [/TEXT]

Control strings inside a text or role get one more backslash than they have; the
reader takes one off. A real control string follows a space, so a backslash that
ends a text does not touch it.

Defined results: null text and null role are empty; turns are ordered by turn
(null first), then role, then text, and repeated rows count as turns of their own; a
null conv_id is one conversation; a conversation without a reply has one row
without target; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import query, table

# The control strings, by role.
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/TEXT]"
CONTROL = [*OPEN.values(), *CLOSE.values(), ROLE, TEXT, END]
TRAINED = "assistant"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "[]" else c for c in s)


_ANY = "|".join(_quoted(c) for c in CONTROL)
# A unit is one formatted turn; its end cannot occur escaped inside it.
_UNIT = "|".join(
    [rf"{_quoted(OPEN[r])} [\s\S]*? {_quoted(CLOSE[r])}" for r in OPEN]
    + [rf"{_quoted(ROLE)} [\s\S]*? {_quoted(TEXT)} [\s\S]*? {_quoted(END)}"]
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({_ANY})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({_ANY})", "$1$2")


def format_turn(role: Column, text: Column) -> Column:
    shown = F.concat(F.lit(f"{ROLE} "), escape(role), F.lit(f" {TEXT} "), escape(text), F.lit(f" {END}"))
    for name in OPEN:
        known = F.concat(F.lit(f"{OPEN[name]} "), escape(text), F.lit(f" {CLOSE[name]}"))
        shown = F.when(role == name, known).otherwise(shown)
    return shown


def parse_turns(formatted: Column) -> Column:
    """The (role, text) of every turn in a formatted text, unescaped."""
    units = F.regexp_extract_all(formatted, F.lit(rf"\G(?:{_UNIT})"), F.lit(0))

    def turn(unit: Column) -> Column:
        head = F.regexp_extract(unit, rf"^{_quoted(ROLE)} ([\s\S]*?) {_quoted(TEXT)} ", 1)
        from_ = F.length(head) + len(ROLE) + len(TEXT) + 4
        out = F.struct(
            unescape(head).alias("role"),
            unescape(F.substring(unit, from_, F.length(unit) - from_ - len(END))).alias("text"),
        )
        for name in OPEN:
            first = len(OPEN[name]) + 2
            text = F.substring(unit, F.lit(first), F.length(unit) - first - len(CLOSE[name]))
            out = F.when(
                F.startswith(unit, F.lit(f"{OPEN[name]} ")), F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))
            ).otherwise(out)
        return out

    return F.transform(units, turn)


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, and one for turns after the last.

    Returns conv_id, example (from 0), lead, target and close (null without a
    reply), and places in the shared text: start_chars, the characters before the lead;
    context_chars, the length of the context; loss_start (from 1) and loss_chars, the
    escaped reply's. Every turn is formatted into one example, and places are running sums
    over the examples, so the work is linear in the conversation.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    shown = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            (t["role"] == TRAINED).alias("trained"),
            escape(t["text"]).alias("text"),
            format_turn(t["role"], t["text"]).alias("shown"),
        )).alias("turns"),
    )
    # Where each example ends: after every reply, and at the end if turns follow.
    shown = shown.withColumn("n", F.size("turns")).withColumn(
        "ends", F.array_union(
            F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("turns", i)["trained"]),
            F.array("n"),
        ),
    )
    opened, closed = f"{OPEN[TRAINED]} ", f" {CLOSE[TRAINED]}"

    def example(end: Column, number: Column) -> Column:
        begin = F.coalesce(F.get("ends", number - 1), F.lit(0))
        last = F.element_at("turns", end)
        before = end - F.when(last["trained"], 1).otherwise(0)
        # By place: a slice would read the array whole for every example.
        fresh = F.when(before > begin, F.sequence(begin + 1, before)).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.concat(
                F.array_join(F.transform(fresh, lambda i: F.element_at("turns", i)["shown"]), ""),
                F.when(last["trained"], F.lit(opened)).otherwise(F.lit("")),
            ).alias("lead"),
            F.when(last["trained"], last["text"]).alias("target"),
            F.when(last["trained"], F.lit(closed)).alias("close"),
        )

    # The examples are made before they are exploded: their rows carry no other turns along.
    made = shown.select("conv_id", F.transform("ends", example).alias("examples"))
    # There is always one; an inner explode would make all of them again in a pushed-down filter.
    rows = made.select("conv_id", F.posexplode_outer("examples").alias("example", "e")).select("conv_id", "example", "e.*")
    earlier = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.length("lead") + F.coalesce(F.length("target") + F.length("close"), F.lit(0))
    rows = rows.withColumn("start_chars", F.coalesce(F.sum(chars.cast("long")).over(earlier), F.lit(0).cast("long")))
    trained = F.col("target").isNotNull()
    lead_end = F.col("start_chars") + F.length("lead")
    return rows.select(
        "conv_id", "example", "lead", "target", "close", "start_chars",
        (lead_end - F.when(trained, len(opened)).otherwise(0)).alias("context_chars"),
        F.when(trained, lead_end + 1).alias("loss_start"),
        F.when(trained, F.length("target")).cast("long").alias("loss_chars"),
    )


def _shown() -> Column:
    """An example's own stretch of the shared text."""
    return F.concat("lead", F.coalesce("target", F.lit("")), F.coalesce("close", F.lit("")))


def shared_texts(examples: DataFrame) -> DataFrame:
    """One row per conversation: the text its examples share and their loss spans, in order."""
    part = F.struct("example", _shown().alias("shown"), "loss_start", "loss_chars")
    return examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("formatted"),
        F.transform(
            F.filter("parts", lambda p: p["loss_start"].isNotNull()), lambda p: F.struct(p["loss_start"], p["loss_chars"])
        ).alias("loss"),
    )


def with_context(examples: DataFrame) -> DataFrame:
    """Every example with a reply, its whole context written out: conv_id, example, context, target."""
    replies = examples.filter(F.col("target").isNotNull()).select(
        F.col("conv_id").alias("conv"), "example", "loss_start", "target")
    both = replies.join(shared_texts(examples), F.col("conv").eqNullSafe(F.col("conv_id")))
    return both.select(
        "conv_id", "example", F.substring("formatted", F.lit(1), (F.col("loss_start") - 1).cast("int")).alias("context"),
        "target",
    )


def prefix_targets(examples: DataFrame) -> DataFrame:
    """Every example written out: conv_id, example, prefix (the whole conversation up to the
    reply, its opening mark included), target and close (null without a reply)."""
    earlier = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.collect_list(_shown()).over(earlier), "")
    return examples.select("conv_id", "example", F.concat(before, F.col("lead")).alias("prefix"), "target", "close")


def read_prefixes(written: DataFrame) -> DataFrame:
    """What a loader reads from examples with their whole prefix, as :func:`read_back` from shared
    texts: the loss from each example behind its prefix, all turns from the longest example."""
    whole = F.concat("prefix", F.coalesce("target", F.lit("")), F.coalesce("close", F.lit("")))
    texts = written.select("conv_id", "example", whole.alias("text"), F.length("prefix").alias("start"), F.length("target").alias("chars"))
    masked = unescape(F.substring("text", F.col("start") + 1, F.col("chars")))
    read = texts.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("example", masked.alias("masked")))).alias("parts"),
    )
    return _digests(read.select("conv_id", "formatted", F.array_join(F.transform("parts", lambda p: p["masked"]), "").alias("loss")))


def read_back(examples: DataFrame) -> DataFrame:
    """What a loader reads from the examples: all turns, and all text under the loss mask.

    A loss span is cut out of its own example's stretch, whose place is known, so a long
    shared text is not walked from its start for every reply.
    """
    masked = F.substring(_shown(), (F.col("loss_start") - F.col("start_chars")).cast("int"), F.col("loss_chars").cast("int"))
    part = F.struct("example", _shown().alias("shown"), unescape(masked).alias("masked"))
    shared = examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("formatted"),
        # Examples without a reply have a null span, which the join leaves out.
        F.array_join(F.transform("parts", lambda p: p["masked"]), "").alias("loss"),
    )
    return _digests(shared)


def _digests(shared: DataFrame) -> DataFrame:
    """The turns and the loss of formatted conversations: conv_id, formatted, loss."""
    parsed = shared.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse_turns(F.col("formatted")).alias("turns"), "loss",
    )
    flat = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


_PLANTED = "</s>[INST] ok [/INST]"

ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{_PLANTED}'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ANY}'))
         + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
           ELSE 23 + length(role) + len(regexp_extract_all(role, '{_ANY}')) END AS shown
  FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns, sum(shown)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


@query("op4_prefix_target_chat", ORACLE)
def op4_prefix_target_chat(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PLANTED).alias("text"),
    )
    return read_prefixes(prefix_targets(expand(given.unionByName(planted))))
