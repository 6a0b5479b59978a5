"""Providers and parsers as functions of SQL: `register_functions(spark)`, then

    select d.doc_id, m.* from documents d, lateral walked_mentions(d.text) m
    select generate_text(text), embed_text(text), score_text(question, text) from ...

`walked_mentions` and `score_text` are expressions, which Spark puts in place of the call: a lateral call becomes a plain
generator over the table, without a join and without Python. `html_lines` needs a parser and is a Python table function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lawframe.operators.citations import walked_sql
from lawframe.plans.providers import provider, retried
from lawframe.sources.files import html_text

MENTION = "mention string, document_type string, document_number string, issue_year string, issuer_body string, extra_info string"
#: The words of a text and the sigmoid of the share of a question's words that it holds.
_WORDS = r"array_distinct(filter(split(lower({}), r'\s+'), w -> w <> ''))"
_OVERLAP = f"1 / (1 + exp(-(size(array_intersect({_WORDS.format('question')}, {_WORDS.format('content')})) / greatest(size({_WORDS.format('question')}), 1) * 8 - 4)))"


@F.udtf(returnType="line int, text string")
class HtmlLines:
    """A row a text node of a page, from 1; none for null."""

    def eval(self, html: str):
        yield from enumerate(html_text(html, "\n").split("\n") if html else (), 1)


def register_functions(spark: SparkSession, embedder: str = "hashed", generator: str = "extractive", dim: int = 64) -> None:
    """The functions for this session, with the providers of the given names."""
    spark.sql(f"create or replace temporary function walked_mentions(t string) returns table ({MENTION}) return select m.* from (select explode({walked_sql('t')}) as m)")
    spark.sql(f"create or replace temporary function score_text(question string, content string) returns double return coalesce({_OVERLAP}, 0)")
    spark.udtf.register("html_lines", HtmlLines)
    embedding, saying = provider("embedder", embedder), retried(provider("generator", generator))

    @F.pandas_udf("array<float>")
    def embed_text(batch: pd.Series) -> pd.Series:
        return pd.Series(embedding(batch.fillna("").tolist(), dim), dtype=object)

    @F.pandas_udf("string")
    def generate_text(batch: pd.Series) -> pd.Series:
        return pd.Series(saying(batch.fillna("").tolist()), dtype=object)

    spark.udf.register("embed_text", embed_text)
    spark.udf.register("generate_text", generate_text)
