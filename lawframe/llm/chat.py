"""Chat formatting with DataFrame expressions only.

A conversation becomes one string of blocks

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Adjacent turns of one role share a block; `<|im_sep|>` keeps their texts apart, so every turn can be read back.
Inside roles and texts a backslash is written `\\0` and `<|` is written `\\1` (in roles also a line feed, `\\2`), so no
text can hold a control string, and decoding restores it exactly.

Edge cases: a null text or role is empty; turns with equal numbers go by role, then text; a null turn number comes
first; rows with a null conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, formatted, segments).

    `segments` cuts `formatted` into array<struct<text, loss>>; concatenated they are `formatted`, and `loss` marks the
    characters that training may learn from: the texts of `loss_role`, without any markup.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # where a block begins: the first turn, and each whose role differs from the one before
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    marked = sorted_turns.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )

    def pieces(block: Column) -> Column:
        markup = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.flatten(
            F.array(
                F.array(markup(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")))),
                F.flatten(
                    F.transform(
                        block["texts"],
                        lambda t, i: F.array(
                            markup(F.when(i > 0, F.lit(SEP)).otherwise(empty)),
                            F.struct(t.alias("text"), (block["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(markup(F.lit(END))),
            )
        )

    segments = F.filter(F.flatten(F.transform("blocks", pieces)), lambda s: s["loss"] | (s["text"] != ""))
    done = marked.withColumn("blocks", blocks).select("conv_id", segments.alias("segments"))
    return done.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, one per original row."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        header = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(header, F.lit(len(START) + 1)))
        return F.transform(
            F.split(F.substr(block, F.length(header) + 2), r"<\|im_sep\|>"),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    made = format_chat(rows.unionByName(extra))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(replace(text, '\', '\0'), '<|', '\1') as esc,
    coalesce(lag(role) over w <> role, true) as head
  from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(esc) + case when head
    then length(replace(replace(replace(role, '\', '\0'), '<|', '\1'), chr(10), '\2')) + 24 else 10 end)::bigint as formatted_chars
from e group by conv_id
"""
