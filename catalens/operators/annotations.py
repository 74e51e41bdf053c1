"""Team annotations: merged from one document per author, validated, deduplicated, attached to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import TABLE_KEY

# fixed values: accepted types, flags and sizes
TYPES = ["note", "quality_flag", "deprecation"]
QUALITY_FLAGS = ["TRUSTED", "STALE", "INCOMPLETE", "EXPERIMENTAL"]
MAX_CONTENT = 10_000
MAX_AUTHOR = 64

DOCUMENT = (
    "tables MAP<STRING, STRUCT<annotations: ARRAY<STRUCT<id: STRING, type: STRING, content: STRING, "
    "author: STRING, created_at: STRING>>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per author file: ``file`` and its whole text; none for a path that does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(jpath):
        return spark.createDataFrame([], "file string, text string")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def flatten(documents: DataFrame) -> DataFrame:
    """One row per annotation; a document that is not valid JSON contributes nothing."""
    parsed = documents.select("file", F.from_json("text", DOCUMENT).alias("d"))
    per_table = parsed.select("file", F.explode("d.tables").alias("target", "entry"))
    return per_table.select("file", "target", F.posexplode("entry.annotations").alias("position", "a")).select(
        "file", "target", "position", "a.*"
    )


def first_by_id(annotations: DataFrame, order: list[str]) -> DataFrame:
    """One row per annotation id over all tables: the first in ``order``.

    A partial ``min_by`` keeps one candidate per id and map task, so a heavily repeated id stays small.
    """
    values = [c for c in annotations.columns if c != "id"]
    return (
        annotations.groupBy("id")
        .agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_a"))
        .select("id", *[F.col(f"_a.{v}").alias(v) for v in values])
    )


def merge(documents: DataFrame) -> DataFrame:
    """All authors' annotations; of a repeated id the one from the first file stays."""
    return first_by_id(flatten(documents), ["file", "target", "position"])


def for_target(annotations: DataFrame, target: str) -> DataFrame:
    return annotations.where(F.col("target") == target)


def problem(target: str = "target", kind: str = "type", content: str = "content") -> Column:
    """What is wrong with an annotation, null when nothing is."""
    target_, text = F.coalesce(F.col(target), F.lit("")), F.col(content)
    dots = F.length(target_) - F.length(F.replace(target_, F.lit("."), F.lit("")))
    return (
        F.when(dots != 2, "invalid target")
        .when(F.col(kind).isNull() | ~F.col(kind).isin(TYPES), "invalid type")
        .when((F.col(kind) == "quality_flag") & (text.isNull() | ~text.isin(QUALITY_FLAGS)), "invalid quality flag")
        .when(F.length(text) > MAX_CONTENT, "content too long")
    )


def validate(annotations: DataFrame) -> DataFrame:
    """Adds ``error``; split on it with ``accepted`` and ``rejected``."""
    return annotations.withColumn("error", problem())


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNull()).drop("error")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNotNull())


def sanitize_author(name: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay, the rest becomes ``_``; at most 64 characters."""
    clean = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", "_"), 1, MAX_AUTHOR)
    return F.when(clean == "", "anonymous").otherwise(clean)


def stamped(new: DataFrame, *, at: Column | None = None) -> DataFrame:
    """Valid new annotations with id, cleaned author and UTC time."""
    when = at if at is not None else F.current_timestamp()
    return accepted(validate(new)).select(
        "target", F.uuid().alias("id"), "type", "content", sanitize_author(F.col("author")).alias("author"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
    )


def append(new: DataFrame, path: str) -> None:
    """Append to the annotation table, one folder per author."""
    stamped(new).write.mode("append").partitionBy("author").parquet(path)


def attach(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """Search results with their table's annotations, one row per result and annotation.

    A result without annotations stays, with nulls. The results (a top list) are few, so the large
    annotation side is filtered by them before anything is grouped.
    """
    notes = annotations.select(
        "target", F.col("id").alias("annotation_id"), F.col("type").alias("annotation_type"), "content", "author"
    )
    keyed = results.withColumn("target", F.concat_ws(".", *TABLE_KEY))
    return keyed.join(notes, "target", "left")


def stale(annotations: DataFrame, reference: Column, *, days: int, at: str = "created_at") -> DataFrame:
    """Per target the age of the newest annotation, where it is above ``days``."""
    newest = annotations.groupBy("target").agg(F.max(at).alias("newest"), F.count("*").alias("annotations"))
    return newest.withColumn("age_days", F.datediff(reference, "newest")).where(F.col("age_days") > days)


def activity(annotations: DataFrame, *, at: str = "created_at") -> DataFrame:
    """Annotations per author and day."""
    return annotations.groupBy("author", F.to_date(at).alias("day")).agg(F.count("*").alias("annotations"))

