"""Loading records into a vector collection: known ids and near duplicates left out, the rest embedded and added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.operators import search as S
from lawframe.operators import store as K
from lawframe.operators import vector_index as V
from lawframe.operators.records import qa_records, refined_question
from lawframe.operators.vector_index import VectorIndex
from lawframe.plans.providers import Embedder, embedded, generate
from lawframe.scratch import small, stored


def new_points(records: DataFrame, points: DataFrame, embedder: Embedder, text: str = "content", index: VectorIndex | None = None) -> DataFrame:
    """Records as points to add: embedded, those without a vector and near duplicates of stored points left out. A record
    without an id is named by its text. With an index of the points near duplicates are sought in it."""
    named = records.withColumn("record_id", F.coalesce(F.nullif("record_id", F.lit("")), F.concat(F.lit("P_"), F.md5(F.coalesce(text, F.lit(""))))))
    rows = stored(embedded(named, text, embedder).filter(F.size("embedding") > 0), "embedded")
    return S.without_near_duplicates(rows, points) if index is None else V.without_near_duplicates(rows, index)


def upload(records: DataFrame, points: DataFrame, embedder: Embedder, text: str = "content", index: VectorIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(added, counts): an incremental load of records into the points (record_id, embedding, ...) of a collection.

    Records whose id is stored stay out before anything is embedded. `counts` has total, known, near_duplicate (with
    those that got no vector) and uploaded.
    """
    fresh = K.delete(records, small(points.select("record_id")), "record_id")
    added = stored(new_points(fresh, points, embedder, text, index), "added")
    return added, K.upload_counts(records, points, added)


def upserted(points: DataFrame, added: DataFrame) -> DataFrame:
    """The collection after points are added: an added one takes the place of the stored one with its id."""
    return points.join(added.select("record_id"), "record_id", "left_anti").unionByName(added.select(*points.columns))


def reviewed(answers: DataFrame, points: DataFrame, embedder: Embedder, generator: str = "extractive") -> tuple[DataFrame, DataFrame]:
    """(uploaded, suggested) of reviewed answers (question, answer, metadata, privilege): administrators' answers become
    records with the question as the generator words it, and points; others' are suggestions. Blank answers go."""
    kept = answers.filter(F.trim("answer") != "")
    admin = F.coalesce(F.col("privilege") == "Admin", F.lit(False))
    asked = F.concat(F.lit("Reword the question so that the answer fits it, or say 'No change'.\n\nQuestion: "), "question", F.lit("\nAnswer: "), "answer")
    refined = kept.filter(admin).withColumn("question", refined_question(F.col("question"), generate(asked, generator)))
    return new_points(qa_records(refined), points, embedder), kept.filter(~admin)
