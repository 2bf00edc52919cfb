"""Merkle manifest of a dataset: a digest for each row, a tree per source, and a tree over the sources.

A leaf is the sha256 of its fields, each written as byte count, colon and value (a null as `-`).
Leaves of a source ascend by key; while there are several nodes, every WIDTH consecutive ones (the
last run may be shorter) become the sha256 of their hex digests. What remains is the source's
subroot, and the subroots, ordered by source, give the root in the same way.

Levels are windows: in a block of WIDTH ** LEVELS leaves, level k lives on the rows whose place is a
multiple of WIDTH ** k, so siblings stand at fixed offsets and come by `lag` and `lead`, masked by the
slot in the run and the length of the run. First-child rows hash the parent; a running `last` hands the
siblings of an ancestor to all leaves below it. A block is a window partition of bounded size, whatever
the size of its source, and all levels of a block share one shuffle and one sort. The blocks' nodes go
on to the next round, which has WIDTH ** LEVELS times fewer rows.

Places come from one range partitioning by (source, key) and counts per source and partition, so no source is
numbered in one task. Text is hashed in the scan; only keys, sources and digests are shuffled.

A null source comes first; names go bytewise. A null key comes first in its source; rows that repeat a key are
ordered by their leaf, equal rows are leaves of their own. Empty and long texts are ordinary values. An empty table has no
rows and no root. Columns that are not fields are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import stored

WIDTH = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows per source and partition that are sent to all tasks; more go by a shuffle join.
MOST_SENT = 100_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row with these fields."""

    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*map(written, fields))


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `pos`, from 0 within `grp` by `order`, and `n`, the rows of the group."""
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = rows.repartitionByRange(*by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "merkle_sorted")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("some"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(
        runs.select(
            F.col("grp").alias("_grp"),
            F.col("part").alias("_part"),
            (F.coalesce(F.sum("some").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("some").over(Window.partitionBy("grp")).alias("n"),
        ),
        "merkle_runs",
    )
    joined = placed.join(_sent(runs), (F.col("grp") == F.col("_grp")) & (part == F.col("_part")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "_grp", "_part")


def _levels(nodes: DataFrame) -> DataFrame:
    """Adds `block`, `top` (the block's node, on its first row) and `path`: what stands before and after
    the ancestor of each row in its run, level by level."""
    pos, n = F.col("pos"), F.col("n")
    out = nodes.withColumn("block", F.expr(f"pos div {WIDTH**LEVELS}")).withColumn("h0", F.col("h"))
    order = Window.partitionBy("grp", "block").orderBy("pos")
    for k in range(LEVELS):
        step = WIDTH**k
        near = range(1, WIDTH)
        out = out.select(
            "*",
            *[F.lag(f"h{k}", i * step).over(order).alias(f"lag{i}") for i in near],
            *[F.lead(f"h{k}", i * step).over(order).alias(f"lead{i}") for i in near],
        )
        index = F.expr(f"pos div {step}")
        count = F.expr(f"(n + {step - 1}) div {step}")
        slot = index % WIDTH
        run = F.least(F.lit(WIDTH), count - index + slot)
        node, several = pos % step == 0, n > step
        before = F.concat(*[F.when(slot >= i, F.col(f"lag{i}")).otherwise("") for i in reversed(near)])
        after = F.concat(*[F.when(slot + i < run, F.col(f"lead{i}")).otherwise("") for i in near])
        parent = F.when(several, digest(F.col(f"h{k}"), after)).otherwise(F.col(f"h{k}"))
        out = out.select(
            *[c for c in out.columns if not c.startswith(("lag", "lead"))],
            F.when(node & several, F.struct(before.alias("before"), after.alias("after"))).alias(f"own{k}"),
            F.when(node & (slot == 0), parent).alias(f"h{k + 1}"),
        )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"own{k}", ignorenulls=True).over(so_far) for k in range(LEVELS)]
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return out.select(*nodes.columns, "block", F.col(f"h{LEVELS}").alias("top"), path.alias("path"))


def _up(nodes: DataFrame) -> DataFrame:
    first = _levels(nodes).where(F.col("pos") % WIDTH**LEVELS == 0)
    fewer = F.expr(f"(n + {WIDTH**LEVELS - 1}) div {WIDTH**LEVELS}")
    return first.select("grp", F.col("block").alias("pos"), fewer.alias("n"), F.col("top").alias("h"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes (grp, pos, n, h): the given ones, then each block's, to one of each group."""
    rounds = [nodes]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(stored(_up(rounds[-1]), "merkle_nodes"))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with the whole `path` to the root; `above` has grp, path and other
    columns of the groups, which go to all of their nodes."""
    given = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(rounds[:-1]):
        up = above.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *given)
        joined = _levels(nodes).join(up, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_pos")))
        above = joined.select(*nodes.columns, F.concat("path", "_path").alias("path"), *given)
        if nodes is not rounds[0]:
            above = stored(above, "merkle_paths")
    return above


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS,
    other: Mapping[str, Column] | None = None,
) -> DataFrame:
    """key, source, leaf, path, subroot and root of each row; `other` columns are taken from the row too.

    path is an array of (before, after): the hex digests of the run's others at each level, up to the root.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("grp"),
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        leaf(*map(F.col, fields)).alias("h"),
        *[column.alias(f"_of_{name}") for name, column in (other or {}).items()],
    )
    rounds = climb(numbered(stored(leaves, "merkle_leaves"), ["_key", "h"]))
    sources = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h")
    tops = climb(numbered(sources, ["of"]))
    last = tops[-1].first()
    whole = tops[-1].select("grp", F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    paths = descend(tops, whole).select(F.col("of").alias("grp"), "path", F.col("h").alias("subroot"))
    found = descend(rounds, stored(paths, "merkle_paths"))
    return found.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("h").alias("leaf"),
        "path",
        "subroot",
        F.lit(last.h if last else None).cast("string").alias("root"),
        *[F.col(f"_of_{name}").alias(name) for name in other or {}],
    )


def proof(path: Column) -> Column:
    """The digest of all siblings, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf digest gives with these siblings."""
    return F.aggregate(path, start, lambda h, x: digest(x["before"], h, x["after"]))


def audit(docs: DataFrame, tampered: Column, key: str = "doc_id", source: str = "source", text: str = "text",
          fields: Sequence[str] = FIELDS) -> DataFrame:
    """The manifest, and for each row the root recomputed with `tampered` in place of its text.

    key, source, leaf, path, subroot, root, proof_sha256, folded_root and verified (it is the root).
    """
    changed = leaf(*[tampered if f == text else F.col(f) for f in fields])
    same = tampered.eqNullSafe(F.col(text))
    found = manifest(docs, key, source, fields, {"changed": F.when(~same, changed)})
    back = folded(F.col("path"), F.coalesce("changed", "leaf"))
    found = found.select(
        key, source, "leaf", "path", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
