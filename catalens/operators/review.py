"""Review tables for people, and their answers applied to the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interpret import interpret_aggregation, interpret_filter, interpret_join, interpret_metric
from ..plans.grouped import first_per_group, matched
from ..plans.materialize import materialize

# fixed values: words of a formula that are not columns
FORMULA_KEYWORDS = [
    "case", "when", "then", "else", "end", "and", "or", "not",
    "sum", "count", "avg", "min", "max", "nullif", "cast", "as",
]


def _procedure() -> Column:
    return F.concat_ws(".", "database", "object_name").alias("procedure")


def _answers(*names: str) -> list[Column]:
    return [F.lit("").alias(n) for n in names]


def review_metrics(found: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Metric rows to review: discovered ones, then global ones whose formula is not among them.

    ``found`` and ``extra`` hold the metric fields with ``database, object_name, importance_score,
    execution_count, last_executed``; global metrics count with importance 0.
    """

    def rows(df: DataFrame, score: Column, runs: Column, last: Column) -> DataFrame:
        return df.select(
            score.alias("importance_score"), runs.alias("execution_count"), last.alias("last_executed"),
            _procedure(),
            F.coalesce(F.nullif("name", F.lit("")), F.lit("(unnamed)")).alias("metric_name"),
            F.substring(F.coalesce("formula", F.lit("")), 1, 200).alias("formula"),
            F.concat_ws(", ", F.slice("columns_used", 1, 5)).alias("columns_used"),
            F.when(F.col("is_ratio"), "Yes").otherwise("No").alias("is_ratio"),
            interpret_metric().alias("plain_english"),
            *_answers("correct_name", "notes"),
        )

    out = rows(found, F.col("importance_score"), F.col("execution_count"), F.col("last_executed"))
    if extra is not None:
        known = out.select(F.col("formula").alias("_cut")).distinct()
        cut = F.substring(F.coalesce("formula", F.lit("")), 1, 200)
        unseen = extra.withColumn("_cut", cut).join(known, "_cut", "left_anti").drop("_cut")
        # one row per new formula: the first object in name order
        first = unseen.groupBy("formula").agg(
            F.min_by(
                F.struct("database", "object_name", "name", "columns_used", "is_ratio"),
                F.struct("database", "object_name"),
            ).alias("m")
        ).select("formula", "m.*")
        types = dict(out.dtypes)
        out = out.unionByName(
            rows(
                first, F.lit(0.0), F.lit(0).cast(types["execution_count"]),
                F.lit(None).cast(types["last_executed"]),
            )
        )
    return out


def review_joins(found: DataFrame) -> DataFrame:
    """Join rows to review; column pairs are written ``a = b AND c = d``."""
    pairs = F.transform("on_columns", lambda p: F.concat(p["left_column"], F.lit(" = "), p["right_column"]))
    return found.select(
        "importance_score", _procedure(), "left_table", "right_table", "join_type",
        F.array_join(pairs, " AND ").alias("join_columns"), interpret_join().alias("business_meaning"),
        *_answers("is_correct", "notes"),
    )


def review_aggregations(found: DataFrame) -> DataFrame:
    return found.select(
        "importance_score", _procedure(), "function", "column",
        F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("context", F.lit("")).alias("context"),
        interpret_aggregation().alias("business_meaning"),
    )


def review_filters(found: DataFrame, *, shown: int = 3) -> DataFrame:
    """Filters grouped by column, operator and value, with the first objects that use them.

    Objects come in order of importance, then name; an object that repeats a filter is named again.
    """
    keys = ["column", "operator", "value_pattern"]
    counts = found.groupBy(*keys).agg(
        F.count("*").alias("frequency"), F.max("importance_score").alias("importance")
    )
    order = [F.col("importance_score").desc(), F.col("object_name"), F.col("database"), F.col("position")]
    heads = (
        first_per_group(found.select(*keys, "importance_score", "object_name", "database", "position"), keys, order, shown)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_nth", "object_name"))).alias("_heads"))
    )
    return matched(counts, heads, keys).select(
        "frequency", "importance", "column", "operator",
        F.substring(F.coalesce("value_pattern", F.lit("")), 1, 100).alias("typical_values"),
        F.array_join(F.transform("_heads", lambda h: h["object_name"]), ", ").alias("used_in"),
        interpret_filter().alias("business_meaning"),
    )


# --- answers ----------------------------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def yes_no(answer: Column) -> Column:
    """yes → true, no → false, anything else → null."""
    text = F.lower(F.trim(answer))
    return F.when(text == "yes", True).when(text == "no", False)


def metric_feedback(reviewed: DataFrame) -> DataFrame:
    """Reviewed metric rows that carry a corrected name or a note."""
    return reviewed.where(_filled("correct_name") | _filled("notes")).select(
        "procedure", F.col("metric_name").alias("found_name"),
        F.nullif("correct_name", F.lit("")).alias("corrected_name"),
        F.nullif("notes", F.lit("")).alias("notes"), "formula",
    )


def join_feedback(reviewed: DataFrame) -> DataFrame:
    """Reviewed join rows that carry an answer or a note."""
    return reviewed.where(_filled("is_correct") | _filled("notes")).select(
        "procedure", "left_table", "right_table", "join_type",
        yes_no(F.col("is_correct")).alias("is_correct"), F.nullif("notes", F.lit("")).alias("notes"),
    )


def filter_feedback(reviewed: DataFrame, answer: str = "correction") -> DataFrame:
    """Reviewed filter rows that carry the reviewer's own meaning."""
    return reviewed.where(_filled(answer)).select(
        "column", "operator", F.col("typical_values").alias("values"), F.col(answer).alias("business_meaning")
    )


def formula_names(formula: Column) -> Column:
    """Column names in a formula: last part of each dotted name, without SQL words and numbers."""
    words = F.regexp_extract_all(formula, F.lit(r"(?:[A-Za-z0-9_]+\.)?([A-Za-z0-9_]+)"), F.lit(1))
    return F.filter(
        words, lambda w: ~F.lower(w).isin(FORMULA_KEYWORDS) & ~w.rlike(r"^[0-9]+$")
    )


def apply_feedback(
    columns: DataFrame, metric_answers: DataFrame, filter_answers: DataFrame, *, order: str = "position"
) -> DataFrame:
    """Columns with ``business_terms`` and ``business_meaning`` from the answers, matched by column name.

    The last answer (by ``order``) for a name wins. ``changes`` counts what was set on the row: a term
    that the column already has, and a repeated answer, change nothing. The answers make one dictionary of names,
    written so that its size is known: Spark broadcasts it below its threshold, and rows of a frequent name stay where
    they are; a larger one is joined by a shuffle, whose frequent names AQE splits.
    """
    terms = (
        metric_answers.where(_filled("corrected_name"))
        .select(F.explode(formula_names(F.col("formula"))).alias("column_name"), "corrected_name", order)
        .groupBy("column_name")
        .agg(F.max_by("corrected_name", order).alias("_term"))
    )
    meanings = filter_answers.groupBy(F.substring_index("column", ".", -1).alias("column_name")).agg(
        F.max_by("business_meaning", order).alias("_meaning")
    )
    answers = materialize(terms.join(meanings, "column_name", "full"), "answers")
    have = F.col("business_terms") if "business_terms" in columns.columns else F.array().cast("array<string>")
    have = F.coalesce(have, F.array().cast("array<string>"))
    old = columns.withColumn("_have", have)
    new_term = F.col("_term").isNotNull() & ~F.coalesce(F.array_contains("_have", F.col("_term")), F.lit(False))
    kept = [c for c in columns.columns if c not in ("business_terms", "business_meaning")]
    before = F.col("business_meaning") if "business_meaning" in columns.columns else F.lit(None).cast("string")
    return (
        old.join(answers, "column_name", "left")
        .select(
            *kept,
            F.when(new_term, F.array_append("_have", F.col("_term"))).otherwise(F.col("_have")).alias("business_terms"),
            F.coalesce("_meaning", before).alias("business_meaning"),
            (new_term.cast("int") + F.col("_meaning").isNotNull().cast("int")).alias("changes"),
        )
    )


FEEDBACK_KINDS = ["metricCorrections", "relationshipFlags", "filterMeanings"]


def feedback_log(
    metric_answers: DataFrame, join_answers: DataFrame, filter_answers: DataFrame, *,
    reviewer: str, reviewed_at: Column, source: str
) -> DataFrame:
    """All answers as one append-only log: kind, subject, JSON record and who, when, from where."""
    subjects = ["found_name", "right_table", "column"]
    parts = [
        df.select(
            F.lit(kind).alias("kind"), F.col(subject).alias("subject"),
            F.to_json(F.struct(*df.columns)).alias("record"),
        )
        for kind, subject, df in zip(FEEDBACK_KINDS, subjects, [metric_answers, join_answers, filter_answers])
    ]
    return reduce(DataFrame.unionByName, parts).withColumns(
        {"reviewed_by": F.lit(reviewer), "reviewed_at": reviewed_at, "source_file": F.lit(source)}
    )


def feedback_summary(log: DataFrame, *, samples: int = 5) -> DataFrame:
    """Answers per kind with a few sample subjects."""
    counts = log.groupBy("kind").agg(F.count("*").alias("answers"))
    heads = (
        first_per_group(log.select("kind", "subject"), ["kind"], [F.col("subject")], samples)
        .groupBy("kind")
        .agg(F.array_join(F.sort_array(F.collect_list("subject")), ", ").alias("samples"))
    )
    return counts.join(heads, "kind")
