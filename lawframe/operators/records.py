"""Records: built from sections and from question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.operators.structure import with_ancestors
from lawframe.scratch import stored


def section_records(found: DataFrame, appendix_level: int = 5, by: tuple = ("doc_id",)) -> DataFrame:
    """One record a section.

    Chapters and articles without a title have their content as one, and keep their own content. Clauses and points
    inherit what they lack, a clause its article's title and content, a point its clause's as that came to be. A section
    with others below it is named by its title alone, hashed twice. `by` names a document; its sections meet in windows.
    """
    rows = with_ancestors(found, "_up", "marker", "title", "content", by=by)
    rows = rows.withColumns({f"_up{i}": F.try_element_at("_up", F.lit(-i)) for i in (1, 2)})
    # what hangs below a section stands right behind it
    rows = rows.withColumn("_has", F.coalesce(F.lead("parent_ord").over(Window.partitionBy(*by).orderBy("ord")) == F.col("ord"), F.lit(False)))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    inherits = lambda c: F.col(c).isin("clause", "point")
    higher = lambda c: F.when(inherits("_up1.marker"), blank(f"_up2.{c}"))
    named = F.coalesce(blank("_up1.title"), higher("title"), F.when(inherits("_up1.marker"), blank("_up2.content")).otherwise(blank("_up1.content")))
    title = F.coalesce(blank("title"), F.when(inherits("marker") & F.col("_up1").isNotNull(), named).otherwise(blank("content")), F.lit(""))
    content = F.coalesce(blank("content"), F.when(inherits("marker"), F.coalesce(blank("_up1.content"), higher("content"))), F.lit(""))
    filled = stored(rows.select("doc_id", "section_id", "marker", "_has", title.alias("title"), content.alias("content")), "records")
    return filled.select(
        T.unique_id(F.col("title"), F.when(F.col("_has") & ~inherits("marker"), F.col("title")).otherwise(F.col("content")), "DOC").alias("record_id"),
        F.col("doc_id").alias("document_id"), "title", "content", F.col("section_id").alias("chunk_id"),
        T.hierarchy_level(F.col("marker"), F.lit(0), appendix_level).cast("int").alias("hierarchy_level"), F.lit("vi").alias("language"), F.lit(False).alias("validation_status"), F.lit("").alias("summary"),
    )


def appendix_records(appendices: DataFrame) -> DataFrame:
    """Appendices (document_id, appendix_id, doc_name, content) as records of the first level, named by their ids."""
    name = F.trim("doc_name")
    return appendices.select(
        T.unique_id(F.col("appendix_id"), name, "APPENDIX").alias("record_id"), "document_id", name.alias("title"), F.trim("content").alias("content"), F.col("appendix_id").alias("chunk_id"),
        F.lit(1).alias("hierarchy_level"), F.lit("vi").alias("language"), F.lit(False).alias("validation_status"), F.lit("").alias("summary"),
    )


def qa_records(pairs: DataFrame) -> DataFrame:
    """(question, answer, metadata JSON or null) to records; categories join the metadata's, 'QA' without any."""
    extra = F.from_json(F.coalesce("metadata", F.lit("{}")), "categories ARRAY<STRING>, relationships ARRAY<STRING>, published_date STRING, source STRING, language STRING, summary STRING")
    rows = pairs.withColumn("_x", extra).withColumn("record_id", T.unique_id(F.col("question"), F.col("answer"), "QA"))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col("_x.categories"), none)
    return rows.select(
        "record_id", F.lit("QA").alias("document_id"), F.concat(F.lit("Answer for: "), "question").alias("title"), F.col("answer").alias("content"), F.col("record_id").alias("chunk_id"),
        F.lit(1).alias("hierarchy_level"), F.when(F.size(given) > 0, F.array_distinct(given)).otherwise(F.array(F.lit("QA"))).alias("categories"), F.coalesce("_x.relationships", none).alias("relationships"),
        "_x.published_date", "_x.source", F.lit(True).alias("validation_status"), F.coalesce("_x.language", F.lit("vi")).alias("language"), F.coalesce("_x.summary", F.lit("")).alias("summary"),
    )


def refined_question(original, refined):
    """The model's wording unless it answers 'No change'."""
    return F.when(F.lower(F.trim(refined)) == "no change", original).otherwise(refined)
