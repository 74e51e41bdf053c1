"""Keyword search, table lookup, join paths and catalog status."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grouped import first_per_group
from ..plans.materialize import materialize
from ..plans.schemas import COLUMN_KEY, TABLE_KEY
from .rollup import overview_counts

# fixed values: search weights
NAME_WEIGHTS = {"table_name": 3, "column_name": 2, "database": 1}
KEY_BONUSES = {"is_primary_key": 2, "is_foreign_key": 1}
RESULT_COLUMNS = [
    "database", "schema", "table_name", "column_name", "data_type", "is_primary_key", "is_foreign_key",
    "fk_references", "row_count_estimate", "relevance",
]


def normalise_keywords(text: str | list[str]) -> list[str]:
    """Lower-case keywords without blanks; empty ones are dropped."""
    words = text.split() if isinstance(text, str) else text
    return [w for w in (str(x).strip().lower() for x in words) if w]


def keyword_score(keywords: list[str], weights: dict[str, int], *, regex: bool = False) -> Column:
    """Sum of the weights of all (keyword, column) hits; keywords are literal text unless ``regex``."""
    hits = []
    for name, weight in weights.items():
        text = F.lower(F.col(name))
        for word in keywords:
            hit = text.rlike(word) if regex else text.contains(F.lit(word))
            hits.append(F.when(hit, weight).otherwise(0))
    return reduce(add, hits, F.lit(0))


def ranked_search(
    df: DataFrame,
    keywords: str | list[str],
    *,
    weights: dict[str, int],
    bonuses: dict[str, int] | None = None,
    tie_break: list[Column],
    top_n: int = 20,
    regex: bool = False,
) -> DataFrame:
    """Rows with at least one hit, best ``relevance`` (hits plus flag bonuses) first.

    Flags alone never make a row a result. One scan; ``orderBy().limit()`` keeps only the best rows of
    each partition.
    """
    words = normalise_keywords(keywords)
    if not words:
        return df.withColumn("relevance", F.lit(0)).limit(0)
    bonus = reduce(add, [F.when(F.col(c), b).otherwise(0) for c, b in (bonuses or {}).items()], F.lit(0))
    return (
        df.withColumn("_score", keyword_score(words, weights, regex=regex))
        .where(F.col("_score") > 0)
        .withColumn("relevance", F.col("_score") + bonus)
        .orderBy(F.col("relevance").desc(), *tie_break)
        .limit(top_n)
        .drop("_score")
    )


def catalog_tie_break() -> list[Column]:
    return [F.col("row_count_estimate").desc_nulls_last(), *[F.col(c) for c in COLUMN_KEY]]


def search_catalog(catalog: DataFrame, keywords: str | list[str], *, top_n: int = 20, regex: bool = False) -> DataFrame:
    """Columns whose table, column or database name contains the keywords; larger tables win ties."""
    found = ranked_search(
        catalog, keywords, weights=NAME_WEIGHTS, bonuses=KEY_BONUSES, tie_break=catalog_tie_break(),
        top_n=top_n, regex=regex,
    )
    return found.select(*RESULT_COLUMNS)


def search_batch(
    df: DataFrame,
    queries: DataFrame,
    *,
    row_key: list[str],
    weights: dict[str, int],
    bonuses: dict[str, int] | None = None,
    tie_break: list[Column] | None = None,
    top_n: int = 20,
    parts: int = 1,
) -> DataFrame:
    """Top ``top_n`` rows for every ``(query_id, text)``, all queries at once, by equality joins only.

    Every distinct name is cut into the substrings that have some keyword's length and joined to the
    keywords on equality, which is the same test as ``contains`` without pairing names with keywords.
    The hits make an inverted list, name to its queries. A row looks up the list of each of its names and adds up
    its scores itself, so no (query, row) point is grouped: what a row scores is pruned to ``top_n`` per query in the
    map task that scored it. A list holds one entry per query that hits the name; ``parts`` splits all lists by
    query, for sets of queries too large for one array. Rows are scored one by one, as a single search does, also
    where their keys are equal.
    """
    words = (
        queries.select("query_id", F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("times"))
    )
    # distinct keyword lengths: a handful of numbers, never more than the longest keyword has characters
    lengths = F.array(
        *[F.lit(r[0]) for r in words.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]
    ).cast("array<int>")
    fields = F.array(
        *[F.struct(F.lit(w).alias("weight"), F.lower(F.col(c)).alias("name")) for c, w in weights.items()]
    )
    names = df.select(F.explode(fields).alias("f")).select("f.name").where("name is not null").distinct()
    pieces = names.select(
        "name",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.filter(lengths, lambda n: n <= F.length("name")),
                        lambda n: F.transform(
                            F.sequence(F.lit(1), F.length("name") - n + 1),
                            lambda i: F.col("name").substr(i, n),
                        ),
                    )
                )
            )
        ).alias("word"),
    )
    hits = pieces.join(words, "word").groupBy("query_id", "name").agg(F.sum("times").alias("hits"))
    # written once for all fields; its size is known then, so Spark broadcasts it below its threshold and rows with
    # frequent names stay where they are
    lists = materialize(
        hits.groupBy("name", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_part"))
        .agg(F.collect_list(F.struct("query_id", "hits")).alias("found")),
        "lists",
    )
    flags = bonuses or {}
    bonus = reduce(add, [F.when(F.col(c), b).otherwise(0) for c, b in flags.items()], F.lit(0))
    extra = [c for c in ["row_count_estimate"] if c in df.columns and c not in row_key]
    rows = df.select(
        *row_key, *extra, bonus.alias("_bonus"), *[F.lower(c).alias(f"_name{i}") for i, c in enumerate(weights)],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"),
    )
    for i in range(len(weights)):
        side = lists.select(F.col("name").alias(f"_name{i}"), "_part", F.col("found").alias(f"_found{i}"))
        rows = rows.join(side, [f"_name{i}", "_part"], "left")

    def weighted(found: str, weight: int) -> Column:
        entry = lambda x: F.struct(x["query_id"].alias("query_id"), (x["hits"] * weight).alias("score"))
        return F.transform(F.coalesce(F.col(found), F.array()), entry)

    scores = [weighted(f"_found{i}", w) for i, w in enumerate(weights.values())]
    sorted_scores = F.col("_scores")

    def summed(x: Column, i: Column) -> Column:
        """The score of a query at its first place; its at most ``len(weights)`` entries lie side by side."""
        later = [F.get(sorted_scores, i + d) for d in range(1, len(weights))]
        score = reduce(
            add, [F.when(y["query_id"] == x["query_id"], y["score"]).otherwise(0) for y in later], x["score"]
        )
        first = F.coalesce(F.get(sorted_scores, i - 1)["query_id"] != x["query_id"], F.lit(True))
        return F.when(first, F.struct(x["query_id"].alias("query_id"), score.alias("score")))

    scored = (
        rows.where(F.coalesce(*[F.col(f"_found{i}") for i in range(len(weights))]).isNotNull())
        .withColumn("_scores", F.sort_array(F.concat(*scores)))
        .select(*row_key, *extra, "_bonus", F.inline(F.array_compact(F.transform(sorted_scores, summed))))
        .withColumn("relevance", F.col("score") + F.col("_bonus"))
    )
    if tie_break is None:
        tie_break = [F.col(c).desc_nulls_last() for c in extra] + [F.col(c) for c in row_key]
    reached = scored.join(_least_relevance(scored, top_n), "query_id").where(F.col("relevance") >= F.col("_least"))
    top = first_per_group(reached, ["query_id"], [F.col("relevance").desc(), *tie_break], top_n)
    return top.select("query_id", *row_key, *extra, "relevance", F.col("_nth").alias("position"))


def _least_relevance(scored: DataFrame, top_n: int) -> DataFrame:
    """Per query the relevance ``_least`` of its ``top_n``-th row, from counts per relevance; one written row a query.

    Relevance is a small whole number, so the counts are summed in the map tasks, and only rows that reach it are sorted.
    """
    counts = scored.groupBy("query_id", "relevance").agg(F.count("*").alias("rows"))
    above = Window.partitionBy("query_id").orderBy(F.col("relevance").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("rows").over(above), F.lit(0)))
    least = ahead.where(F.col("_ahead") < top_n).groupBy("query_id").agg(F.min("relevance").alias("_least"))
    return materialize(least, "least")


def table_details(catalog: DataFrame, database: str, schema: str, table_name: str) -> DataFrame:
    """All columns of one table with the table's own facts on each row; empty when there is no such table."""
    wanted = {"database": database, "schema": schema, "table_name": table_name}
    rows = catalog.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in wanted.items()]))
    return rows.select(
        *TABLE_KEY, "row_count_estimate", "column_name", "data_type", "is_nullable", "is_primary_key",
        "is_foreign_key", "fk_references",
    )


def table_summary(catalog: DataFrame, database: str, table_name: str) -> DataFrame:
    """Columns of a table named without schema: full name, types, key markers and references."""
    return catalog.where((F.col("database") == database) & (F.col("table_name") == table_name)).select(
        F.concat_ws(".", *TABLE_KEY).alias("full_name"),
        F.coalesce(F.format_number("row_count_estimate", 0), F.lit("Unknown")).alias("rows"),
        "column_name", "data_type",
        F.when(F.col("is_primary_key"), "yes").otherwise("").alias("pk"),
        F.when(F.col("is_foreign_key"), "yes").otherwise("").alias("fk"),
        F.coalesce("fk_references", F.lit("")).alias("references"),
    )


_PATH_COLUMNS = ["database", "table_name", "column_name", "fk_references"]


def join_paths_outbound(catalog: DataFrame, table_name: str) -> DataFrame:
    """Foreign keys of a table."""
    return (
        catalog.where((F.col("table_name") == table_name) & F.col("is_foreign_key"))
        .select(*_PATH_COLUMNS)
        .distinct()
    )


def referenced_table(reference: Column) -> Column:
    """Table part of ``schema.Table.Column`` or ``Table.Column``."""
    parts = F.split(reference, r"\.")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))


def join_paths_inbound(catalog: DataFrame, table_name: str, *, mode: str = "exact") -> DataFrame:
    """Foreign keys that point at a table.

    ``exact`` compares the table part of the reference; ``substring`` also finds the name inside others.
    """
    if mode == "exact":
        hit = referenced_table(F.col("fk_references")) == F.lit(table_name)
    elif mode == "substring":
        hit = F.col("fk_references").contains(table_name)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return catalog.where(hit).select(*_PATH_COLUMNS).distinct()


def catalog_status(
    catalog: DataFrame | None, last_updated: Column, reference: Column, *, spark=None, fresh_days: int = 7
) -> DataFrame:
    """One row: state, age in whole days, and numbers of targets, databases, tables and columns.

    NOT_BUILT without a catalog, UNKNOWN without a scan time, OK below ``fresh_days``, STALE from there on.
    """
    if catalog is None:
        return spark.range(1).select(
            F.lit("NOT_BUILT").alias("status"), F.lit(None).cast("long").alias("age_days"),
            *[F.lit(0).cast("long").alias(c) for c in ("targets", "databases", "tables", "columns")],
        )
    seconds = F.unix_timestamp(reference.cast("timestamp")) - F.unix_timestamp(last_updated.cast("timestamp"))
    age = F.floor(seconds / 86400)
    counts = overview_counts(catalog)
    state = F.when(age.isNull(), "UNKNOWN").when(age < fresh_days, "OK").otherwise("STALE")
    return counts.select(state.alias("status"), age.alias("age_days"), *counts.columns)


def display(results: DataFrame) -> DataFrame:
    """Search results as short texts for printing."""
    reference = F.coalesce(F.nullif("fk_references", F.lit("")), F.lit("-"))
    keys = F.concat_ws(
        ",", F.when(F.col("is_primary_key"), "PK"), F.when(F.col("is_foreign_key"), "FK")
    )
    count = F.col("row_count_estimate")
    return results.select(
        F.substring(F.concat_ws(".", "database", "table_name"), 1, 30).alias("table"),
        F.substring("column_name", 1, 20).alias("column"),
        F.substring("data_type", 1, 10).alias("type"),
        F.when(keys == "", "-").otherwise(keys).alias("keys"),
        F.when(F.length(reference) > 30, F.concat(F.substring(reference, 1, 27), F.lit("...")))
        .otherwise(reference)
        .alias("fk_reference"),
        F.when(count != 0, F.format_number(count, 0)).otherwise("-").alias("rows"),
        F.col("relevance").alias("score"),
    )
