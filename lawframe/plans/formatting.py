"""Formatting of records by a text generator: modes, translation, enrichment, loading with fallbacks, checks before and
after. Whatever a generator says is a column; the default one is deterministic, so every step can be reproduced."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.functions.language import is_english
from lawframe.operators import chunk as C
from lawframe.operators.citations import link_documents
from lawframe.plans.providers import generate

MODES = ("tagged", "json", "enrichment")
PROMPTS = {
    "tagged": "Rewrite as a tagged record with title, published_date, categories and content elements:\n\n{}",
    "json": "Rewrite as JSON of this schema:\n{schema}\n\n{}",
    "enrichment": "Name main topic, applicability, a title and categories, one labelled line each, of:\n\n{}",
    "translate": "Put this English passage into Vietnamese and answer with nothing else.\n\n{}",
    "validate": "Answer 'compliant' if this record meets the requirements:\n{requirements}\n\n{}",
}


def prompt(name: str, text: Column, **more: str) -> Column:
    """A prompt with `text` in its place."""
    before, _, after = PROMPTS[name].partition("{}")
    for key, value in more.items():
        before, after = before.replace("{" + key + "}", value), after.replace("{" + key + "}", value)
    return F.concat(F.lit(before), text, F.lit(after))


def formatted(raw: Column, mode: str, record_type: str | None = None, json_schema: dict | None = None, generator: str = "extractive") -> Column:
    """A text in the form of a mode, null where that can't be made.

    Text without a form only becomes tagged. What has the asked form stays as it is; tagged text becomes JSON if there is
    a schema, and anything with a form is enriched if its record type is known.
    """
    if mode not in MODES:
        return F.lit(None).cast("string")
    kind, said = T.text_type(raw), lambda p: F.nullif(generate(p, generator), F.lit(""))
    if mode == "tagged":
        return F.when(kind == "tagged", raw).otherwise(said(prompt("tagged", raw)))
    if mode == "json":
        made = said(prompt("json", raw, schema=json.dumps(json_schema, indent=2))) if json_schema else F.lit(None).cast("string")
        return F.when(kind == "json", raw).when(kind == "tagged", made)
    return F.when(kind != "unformatted", said(prompt("enrichment", raw))) if record_type else F.lit(None).cast("string")


def translated(records: DataFrame, generator: str = "extractive") -> DataFrame:
    """Records with English titles and contents translated; an empty answer leaves the text."""

    def into(c: str) -> Column:
        said = F.nullif(T.strip(generate(prompt("translate", F.col(c)), generator)), F.lit(""))
        return F.when(is_english(F.col(c)), F.coalesce(said, F.col(c))).otherwise(F.col(c))

    return records.withColumns({c: into(c) for c in ("title", "content")})


def compliant(record: Column, requirements: dict, generator: str = "extractive") -> Column:
    """Whether the generator answers at all when it is asked to check a record (a JSON text) against requirements."""
    said = generate(prompt("validate", record, requirements=json.dumps(requirements, sort_keys=True)), generator)
    return F.coalesce(F.length(said) > 0, F.lit(False))


def _parsed(raw: Column, prefix: str = "REC", form: str | None = None) -> Column:
    """struct<record_id, title, content> of a JSON or tagged text, null without a title and a content. With a form, json
    or tagged, a text of the other one is null."""
    made = F.from_json(raw, "record_id string, title string, content string")
    as_json = F.when(made["title"].isNotNull() & made["content"].isNotNull(), F.struct(F.coalesce(made["record_id"], T.unique_id(made["title"], made["content"], prefix)).alias("record_id"), made["title"].alias("title"), made["content"].alias("content")))
    tagged = T.tagged_record(raw)
    as_tagged = F.when(tagged.isNotNull(), F.struct(F.coalesce(tagged["record_id"], T.unique_id(tagged["title"], tagged["content"], prefix)).alias("record_id"), tagged["title"].alias("title"), tagged["content"].alias("content")))
    return {"json": as_json, "tagged": as_tagged}.get(form, F.coalesce(as_json, as_tagged))


def loaded(raw: DataFrame, is_formatted: bool = True, generator: str = "extractive") -> DataFrame:
    """(raw, record, loaded_from): JSON, else tagged text, else what the generator makes of the text; texts that are said
    to have no form go to the generator at once. `record` is null where nothing worked."""
    rows = raw.withColumn("record", _parsed(F.col("raw")) if is_formatted else F.lit(None).cast("struct<record_id:string,title:string,content:string>"))
    rows = rows.withColumn("loaded_from", F.when(F.col("record").isNotNull(), F.when(F.from_json("raw", "title string, content string")["content"].isNotNull(), "json").otherwise("tagged")))
    said = F.when(F.col("record").isNull(), generate(prompt("tagged", F.col("raw")), generator))
    rows = rows.withColumn("_said", said)
    return rows.withColumn("record", F.coalesce("record", _parsed(F.col("_said")))).withColumn("loaded_from", F.coalesce("loaded_from", F.when(F.col("record").isNotNull(), "generator"))).drop("_said")


def preprocessed(records: DataFrame, mode: str, requirements: tuple = ("mask_pii",), required: dict[str, str] | None = None, generator: str = "extractive", **more) -> DataFrame:
    """Records that pass: contents masked if asked for, required columns checked, formatted, parsed again.

    (source_id, record_id, title, content); rows that fail at any step are left out, and so are answers of another form
    than the mode asks for, such as a JSON text that a generator repeats where a tagged record is wanted.
    """
    rows = records.withColumn("content", T.mask_key(F.col("content"))) if "mask_pii" in requirements else records
    errors = T.validation_errors(required or {"record_id": "string", "title": "string", "content": "string"})
    rows = rows.filter(F.size(errors) == 0).withColumn("_made", formatted(F.col("content"), mode, generator=generator, **more))
    return rows.withColumn("_r", _parsed(F.col("_made"), form=mode)).filter("_r is not null").select(F.col("record_id").alias("source_id"), "_r.*")


def postprocessed(records: DataFrame, catalog: DataFrame, generator: str = "extractive", required: dict[str, str] | None = None) -> DataFrame:
    """Records translated, linked to the documents that they cite, with `valid`."""
    linked = link_documents(translated(records, generator), catalog)
    return linked.withColumn("valid", F.size(T.validation_errors(required or {"record_id": "string", "title": "string", "content": "string"})) == 0)


def enriched(documents: DataFrame, record_type: str = "DOC", generator: str = "extractive", required: tuple = ("main_topic", "generated_title")) -> DataFrame:
    """Chunks of catalogued documents (document_id, text, ...) with what the generator says of them; chunks of which it
    names no topic or title are left out."""
    others = [c for c in documents.columns if c not in ("document_id", "text")]
    chunks = C.split_articles(documents.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("content", "chunk_text")
    said = generate(prompt("enrichment", F.col("chunk_text")), generator) if record_type else F.lit(None).cast("string")
    rows = chunks.withColumn("_said", said).withColumn("_e", T.enrichment(F.col("_said"))).select(F.col("doc_id").alias("document_id"), "chunk_id", "chunk_text", "_e.*")
    valid = F.size(T.validation_errors({c: "string" for c in required})) == 0
    return rows.filter(valid).join(documents.select("document_id", *others), "document_id") if others else rows.filter(valid)
