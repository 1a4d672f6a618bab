"""Chat formatting: every assistant turn as an example of its own, with all turns before it as context.

Each turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can
stand in a text, and both steps are undone when reading. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """After doubling, a ``<`` with exactly one backslash behind it comes from this function only."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_prefix_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, has_target, text, loss_start, loss_chars): the formatted examples.

    ``text`` holds all turns up to the target; the mask is the reply alone,
    ``loss_chars`` characters after the first ``loss_start``. A conversation that
    doesn't end with a reply gets one more record with all its turns and an empty
    mask, so no turn is lost. Null texts and roles count as empty; null turns come
    first; rows with the same turn are ordered by role and text; repeated rows are
    repeated turns; rows with a null conversation form one conversation. Other
    columns are dropped. A conversation is put together in one row, as its text
    must be; its examples repeat its beginning, which is what the format asks for.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(F.concat(head, body, F.lit(CLOSE)).alias("s"), F.length(head).alias("h"), F.length(body).alias("b"), (t["role"] == target_role).alias("target"))

    pieces = whole.select("conv_id", F.transform("turns", piece).alias("p"))
    # the end of each turn, from running lengths; the whole conversation is written once
    ends = F.aggregate(
        "p",
        F.array().cast("array<int>"),
        lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x["s"])),
    )
    full = pieces.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("full"), ends.alias("ends"), F.transform("p", lambda x: F.struct(x["h"].alias("h"), x["b"].alias("b"), x["target"].alias("target"))).alias("p"))
    marked = full.select(
        "conv_id",
        "full",
        F.filter(
            F.zip_with("p", "ends", lambda p, e: F.struct(e.alias("end"), p["h"].alias("h"), p["b"].alias("b"), p["target"].alias("target"))),
            lambda x: x["target"] | (x["end"] == F.element_at("ends", -1)),
        ).alias("marks"),
    )
    each = marked.select("conv_id", "full", F.posexplode("marks").alias("example", "m"))
    return each.select(
        "conv_id",
        "example",
        F.col("m.target").alias("has_target"),
        F.substring(F.col("full"), F.lit(1), F.col("m.end")).alias("text"),
        F.when(F.col("m.target"), F.col("m.end") - len(CLOSE) - F.col("m.b")).otherwise(F.col("m.end")).alias("loss_start"),
        F.when(F.col("m.target"), F.col("m.b")).otherwise(0).alias("loss_chars"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text, as ``array<struct<role, text>>``."""

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        body = F.substring(piece, cut + 1, F.length(piece) - cut - len(CLOSE))
        return F.struct(_role_in(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    pieces = F.split(text, "<\\|im_start\\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row a conversation with what its examples hold: digests of turns and of the masked text."""
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
    rows = examples.select("conv_id", "example", "text", loss.alias("loss"))
    held = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    read = held.select("conv_id", parse_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The text of the two turns of conversation -1: control strings that must stay text.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_prefix_targets(turns.unionByName(probe)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
