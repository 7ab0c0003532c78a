"""5. Chat formatting with Spark expressions only.

A conversation is ``<s>``, then a block for each run of turns of one role: ``[ROLE]role[/ROLE]``, the texts of the run
with ``[SEP]`` between them, ``</s>``. Control strings inside texts and roles (these and ``[INST]``, ``[/INST]``) get a
backslash after their opening, one more if they have some already, so no text holds a control string and reading takes
the backslash away again. ``loss_spans`` are the places (code points of the formatted text, end exclusive) of each
assistant text.

All work is linear in a conversation's length: runs of one role are slices between the places where the role changes, places
are running sums over the pieces as rows, and texts under the mask are cut from short chunks of the formatted text.

Defined cases: a null text or role is empty; turns sort by number (null first), then role, then text; repeated rows are
turns of their own; rows with a null conv_id are one conversation; an empty table gives no conversation; other
columns are ignored. A conversation is one output row, so it has to fit in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_CONTROL = r"(s>|ROLE\]|SEP\]|INST\])"
LOSS_ROLE = "assistant"
CHUNK = 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]/?)(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]/?)\\(\\*)" + _CONTROL, r"$1$2$3")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _merged(turns: Column) -> Column:
    """Runs of one role as (role, texts): the slices between the turns that change it."""

    def blocks(turns: Column, starts: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"]).alias("texts"))

        return F.transform(starts, block)

    def starts(turns: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    return _let(turns, lambda t: _let(starts(t), lambda s: blocks(t, s)))


def _pieces(blocks: Column) -> Column:
    """Each text of each block with the control strings before it and whether it counts for the loss."""

    def of_block(block: Column, k: Column) -> Column:
        head = F.concat(F.when(k == 0, "<s>").otherwise("</s>"), F.lit("[ROLE]"), escaped(block["role"]), F.lit("[/ROLE]"))
        return F.transform(block["texts"], lambda text, j: F.struct(F.when(j == 0, head).otherwise("[SEP]").alias("before"), escaped(text).alias("text"), (block["role"] == LOSS_ROLE).alias("counts")))

    return F.flatten(F.transform(blocks, of_block))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation of conv_id, turn, role, text rows."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # all that follows is by conv_id, so the rows stay where they are
    pieces = turns.select("conv_id", F.posexplode(_pieces(_merged(F.col("turns")))).alias("place", "p")).select("conv_id", "place", "p.*")
    upto = F.sum(F.length("before") + F.length("text")).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = pieces.withColumn("end", upto).withColumn("start", F.col("end") - F.length("text"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "before", "text", "start", "end", "counts"))).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit("</s>"))
    spans = F.transform(F.filter("pieces", lambda p: p["counts"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def _cut(chunks: Column, span: Column) -> Column:
    """The text of a span, from the chunks that it touches."""
    first, last = ((x - x % CHUNK) / CHUNK for x in (span["start"], span["end"] - 1))
    some = F.slice(chunks, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    return F.substring(F.array_join(some, ""), span["start"] % CHUNK + 1, span["end"] - span["start"])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and, read from the formatted text, ``turns`` (role, text) and ``loss_texts``."""
    blocks = F.split(F.expr("substring(formatted, 4)"), "</s>", -1)
    whole = _let(blocks, lambda b: F.slice(b, F.lit(1), F.size(b) - 1))

    def turns_of(block: Column) -> Column:
        parts = F.split(block, r"\[/ROLE\]", 2)
        return _let(parts, lambda p: _let(unescaped(F.substring(p[0], len("[ROLE]") + 1, 2**31 - 1)), lambda role: F.transform(F.split(p[1], r"\[SEP\]", -1), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))))

    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    loss = _let(chunks, lambda c: F.transform("loss_spans", lambda s: unescaped(_cut(c, s))))
    return formatted.select("conv_id", "formatted", "loss_spans", F.flatten(F.transform(whole, turns_of)).alias("turns"), loss.alias("loss_texts"))


#: A conversation whose texts look like markup of another template.
PLANTED = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    read = read_conversations(format_conversations(rows.unionByName(more)))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat_format": op5_chat_format}
_ESC = r"regexp_replace({}, '([<\[]/?)(\\*)(s>|ROLE\]|SEP\]|INST\])', '\1\\\2\3', 'g')"
ORACLES = {
    "op5_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
marked AS (
  SELECT *, {_ESC.format('role')} AS safe_role, {_ESC.format('text')} AS safe_text,
         lag(role) OVER w IS DISTINCT FROM role AS opens, row_number() OVER w AS place
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(safe_text) + CASE WHEN opens THEN 17 + length(safe_role) ELSE 5 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
}
