"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target, and target / size is the rate at which its
documents repeat: floor(rate) copies, and one more with the probability of the fraction, drawn from a
hash of the document's id. The draw needs no order, no state and no shuffle, and reruns agree.

Target: `share` times all sizes, dealt by weight; no source gets more than `cap` times its size, what
is above is dealt anew to the others by weight. Sources are numbered by code point, null last.

One row per source is kept in the shared folder; ranks and targets are found by aggregates over it,
of which only sums come to the driver, so the number of sources is not bounded.

Null text and text without words have size 0 and take nothing. A null source is a source. Rows that
repeat an id share their draw; a row without id draws by its text. An empty table gives an empty
result. `copies` leaves out columns other than key
and source, `emit` returns exactly the columns it was given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import stored

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(totals: DataFrame) -> DataFrame:
    """Adds `rank` from 0 by source, null last: numbered within ranges of the order, then shifted."""
    order = F.col("source").asc_nulls_last()
    placed = stored(totals.repartitionByRange(order).withColumn("slice", F.spark_partition_id()), "sources")
    sizes = placed.groupBy("slice").agg(F.count("*").alias("n"))  # a row for each partition
    shift = sizes.select(
        F.col("slice").alias("of"), (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("shift")
    )
    within = F.row_number().over(Window.partitionBy("slice").orderBy(order)) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(shift), F.col("slice") == F.col("of"))
        .select("source", "source_size", (F.col("within") + F.col("shift")).alias("rank"))
    )


def source_targets(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """source, source_size, target; one row per source."""
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(source_ranks(totals).withColumn("weight", weight), "source_ranks")
    limit = F.lit(cap) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    over, held, free = F.lit(False), -1.0, 0
    while True:  # the sources over their limit only become more
        sums = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if sums[1] == free:
            break
        held, free = cap * sums[0], sums[1]
        if free == 0:
            break
        over = F.col("weight") * F.lit(share * total - held) / F.lit(float(free)) > limit
    dealt = F.col("weight") * F.lit(share * total - held) / F.lit(float(free)) if free else limit
    return ranked.select("source", "source_size", F.least(limit, dealt).alias("target"))


def draw(key: Column, text: Column) -> Column:
    """A number in [0, 1) from the id of a document, or from its text where there is no id."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    head = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 52))


def _counted(docs: DataFrame, key: str, source: str, text: str, **options) -> DataFrame:
    """row (all columns of the document), size, source_size, target, copies."""
    targets = source_targets(docs, source=source, text=text, **options)
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("from"),
        word_count(F.col(text)).alias("size"),
        draw(F.col(key), F.col(text)).alias("draw"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("from").eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
    taken = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    copies = F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """key, source, size, source_size, target and `copies`, how often the mix takes each document."""
    counted = _counted(docs.select(key, source, text), key, source, text, **options)
    return counted.select(f"row.{key}", f"row.{source}", "size", "source_size", "target", "copies")


def emit(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns it had."""
    mixed = _counted(docs, key, source, text, **options).where("copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.select("row", again).select("row.*")
