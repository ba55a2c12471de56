"""Label enrichment: first-wins indexes and the key-then-title cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_key, normalized_title, text_list, title_candidates


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by ``order``. A min over a struct combines before the exchange, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c != key]
    kept = F.struct(*order, *(c for c in rest if c not in order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(kept, F.struct(*order)).alias("r")).select(key, "r.*")


def label_index(rows: DataFrame, *order: str) -> DataFrame:
    """Parsed label rows with their link key and title key."""
    return rows.withColumns(
        {"taco_key": link_key("url"), "title": normalized_title("name"), "tags": text_list("tags"), "skill_types": text_list("skill_types")}
    ).select("taco_key", "title", "name", "source", "difficulty", "tags", "skill_types", "time_limit", "memory_limit", "url", *order)


def cascade(rows: DataFrame, row_id: str, key: Column, titles: Column, index: DataFrame, value: list[str], *order: str) -> DataFrame:
    """Each row with the index row of its key, else of its first title that the index has.

    Adds ``taco_match`` (key, title or none) and the value columns. A row whose key is
    present never falls to its titles. Catalyst picks the join by the index's size.
    """
    packed = F.struct(*value).alias("v")
    by_key = first_wins(index.where("taco_key is not null").select(F.col("taco_key").alias("_k"), packed, *order), "_k", *order).select("_k", F.col("v").alias("_by_key"))
    by_title = first_wins(index.where("title <> ''").select(F.col("title").alias("_t"), packed, *order), "_t", *order).select("_t", F.col("v").alias("_by_title"))
    keyed = rows.withColumn("_k", key).join(by_key, "_k", "left")
    missed = keyed.where("_by_key is null").select(F.col(row_id).alias("_row"), F.posexplode(titles).alias("_pos", "_t"))
    titled = missed.join(by_title, "_t").groupBy("_row").agg(F.min_by("_by_title", "_pos").alias("_by_title"))
    both = keyed.join(titled, F.col(row_id) == F.col("_row"), "left")
    found = F.coalesce("_by_key", "_by_title")
    match = F.when(F.col("_by_key").isNotNull(), "key").when(F.col("_by_title").isNotNull(), "title").otherwise("none")
    return both.select(*rows.columns, match.alias("taco_match"), *(found[c].alias(f"taco_{c}") for c in value))


def enrich(pool: DataFrame, index: DataFrame, *order: str) -> DataFrame:
    from ..functions.text import row_key

    key = row_key("source_name", "cf_contest_id", "cf_index")
    return cascade(pool, "cc_id", key, title_candidates("name"), index, ["tags", "skill_types", "difficulty", "url"], *order)


def match_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("taco_match").agg(F.count("*").alias("n"))


def coverage(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Rows with a value before and after, as one row."""
    known = [df.select(F.lit(when).alias("stage"), F.col(column).isNotNull().alias("known")) for when, df in (("before", before), ("after", after))]
    stage = lambda when: F.count_if((F.col("stage") == when) & F.col("known")).alias(when)
    return known[0].unionByName(known[1]).agg(stage("before"), stage("after"))
