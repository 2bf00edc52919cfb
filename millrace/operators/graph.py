"""Column and table graph as vertex and edge tables.

The input is a membership table: one row per column that takes part in a task, with the names
of the things that contain it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import joined_id
from millrace.operators.joins import left_join
from millrace.operators.parts import PART_SIZE, list_parts

RELATED = "RELATED"
TABLE_RELATED = "TABLE_RELATED"


def vertices(members: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct (kind, id) rows; `kinds` gives the identifying columns of each kind."""
    keyed = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), joined_id(*columns).alias("id"))
            for kind, columns in kinds.items()
        ]
    )
    return members.select(F.inline(keyed)).distinct()


def column_vertices(members: DataFrame, keys: Sequence[str], usage: DataFrame) -> DataFrame:
    """Distinct columns with the attributes of the usage table, where it knows them."""
    return left_join(members.select(*keys).distinct(), usage, keys, keys, null_safe=True)


def related_edges(members: DataFrame, task: str, item: str, kind: str = RELATED) -> DataFrame:
    """Distinct rows (src, dst, kind): one edge from each item to each task it takes part in.

    Two items with a common task are related. A task with n items relates n * (n - 1) pairs of
    them but has n edges, whatever its size; `neighbours` gives the pairs of chosen items.
    """
    edges = members.select(F.col(item).cast("string").alias("src"), F.col(task).cast("string").alias("dst"))
    return edges.where("src is not null and dst is not null").distinct().withColumn("kind", F.lit(kind))


def merge_edges(stored: DataFrame, added: DataFrame) -> DataFrame:
    """The union of two edge (or vertex) tables; adding the same rows again changes nothing."""
    return stored.unionByName(added).distinct()


def task_members(used: DataFrame) -> DataFrame:
    """Membership rows of a task corpus, from its `columns_used`."""
    keys = ["ip", "port", "db", "table", "column"]
    return used.select(
        F.col("submission").alias("task"), joined_id(*keys).alias("id"), "db_type", *keys
    ).distinct()


def neighbours(edges: DataFrame, of: DataFrame | None = None, kind: str = RELATED) -> DataFrame:
    """Distinct (src, dst): the items that share a task with an item in `of` (column `src`).

    Without `of` the items are all there are, and the rows as many as the related pairs: each
    pair is joined and told apart in one direction, and turned round only then. Both
    sides of the join come straight from a shuffle by task, so a wide task can be split.
    """
    own = edges.where(F.col("kind") == kind).select("src", F.col("dst").alias("task"))
    if of is None:
        # the same rows on both sides, so that one shuffle serves both
        shared = own.alias("a").join(own.alias("b"), F.col("a.task") == F.col("b.task"))
        once = shared.where("a.src < b.src").select(F.col("a.src").alias("src"), F.col("b.src").alias("dst")).distinct()
        turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return once.select(F.inline(F.array(F.struct("src", "dst"), turned)))
    mine = own.join(of.select("src").distinct(), "src", "left_semi")
    others = own.select(F.col("src").alias("dst"), "task")
    shared = mine.join(others, "task").where(F.col("src") != F.col("dst"))
    return shared.select("src", "dst").distinct()


def containment_edges(
    members: DataFrame, levels: Sequence[tuple[str, Sequence[str], Sequence[str]]]
) -> DataFrame:
    """Distinct (src, dst, kind) rows; each level is (kind, container columns, content columns)."""
    keyed = F.array(
        *[
            F.struct(
                joined_id(*outer).alias("src"),
                joined_id(*inner).alias("dst"),
                F.lit(kind).alias("kind"),
            )
            for kind, outer, inner in levels
        ]
    )
    return members.select(F.inline(keyed)).distinct()


def related_lists(
    edges: DataFrame, kind: str = RELATED, limit: int = PART_SIZE, of: DataFrame | None = None
) -> DataFrame:
    """Rows (src, size, parts, part, related): the neighbours of the items in `of` (or of all) as
    bounded lists."""
    return list_parts(neighbours(edges, of, kind), ["src"], "dst", "related", limit)


def search_documents(usage: DataFrame, related: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (id, part, document): one JSON per column and part of its related list.

    A column without related columns has one document with an empty list.
    """
    lists = related.select(F.col("src").alias("id"), "part", "related")
    joined = left_join(usage, lists, ["id"], ["id"])
    document = F.struct(
        *fields, F.coalesce("related", F.array().cast("array<string>")).alias("related_columns")
    )
    return joined.select("id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(document).alias("document"))
