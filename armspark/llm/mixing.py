"""Mixing sources to target weights: weighted fair queueing, in DataFrame functions alone.

Documents of a source stand in the order of a keyed hash, and each may be served ``epochs`` times. A
copy's virtual finish time is the number of its source's words served up to and including it, divided
by the source's weight. Serving all copies by finish time and stopping at the total budget gives
every source its weighted share; a source that runs out leaves its share to the others by weight.

No source is one task: running sums are made from totals of hash buckets plus a window inside a bucket.
The global order is made of finish-time bins; only the bin at the budget is ordered row by row. The decision comes
down to the last served hash key of each source and epoch, a table of a few rows per source, so
that texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, whole_text, word_count

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
BUCKET_DIGITS = 3  # 4096 hash buckets per source
BINS = 1 << 16


def _source_key(source: str) -> Column:
    """NULL is a source of its own, apart from every text."""
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def _order_key(doc_id: Column, size: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.struct(digest.alias("digest"), doc_id.alias("doc"), size.alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS):
    """(skey, source_size, weight, target) of each source by water-filling.

    Sources are sorted by the level at which they run dry; the level of the mix is the largest share per weight
    that the source at hand does not run dry below. One row per source, so one window does.
    """
    totals = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * epochs)
    dry = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) * share - F.coalesce(
        F.sum("limit").over(dry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    level = left / F.sum("weight").over(dry.rowsBetween(0, Window.unboundedFollowing))
    fits = weighed.withColumn("own", level).withColumn(
        "level", F.max(F.when(F.col("own") <= F.col("limit") / F.col("weight"), F.col("own"))).over(everyone)
    )
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))))
    return fits.select("skey", "source_size", "weight", target.alias("target"))


def fair_queue(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    buckets: int = BUCKET_DIGITS,
    bins: int = BINS,
) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, source, skey, size, place) and the serving rules of each source.

    The rules hold skey, source_size, target and ``last``: the last served place per epoch. A row is
    served in an epoch if its place is not after it. Rows equal in id and size stand at one place and are served alike.
    """
    sized = docs.select(
        F.col("doc_id"), F.col("source"), _source_key("source").alias("skey"), word_count(whole_text()).alias("size")
    ).withColumn("place", _order_key(F.col("doc_id"), F.col("size")))
    sized = materialize(sized, "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, epochs), "mix-targets")
    budget = float((sized.agg(F.sum("size")).first()[0] or 0) * share)

    bucket = F.substring("place.digest", 1, buckets)
    placed = sized.select("skey", "size", "place", bucket.alias("bucket"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("skey", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .drop("words")
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("place")  # rows at one place share their sum
    served = placed.withColumn("upto", F.sum("size").over(inside))
    served = served.join(starts, ["skey", "bucket"]).join(targets, "skey")
    finish = [
        F.struct(
            F.lit(epoch).alias("epoch"),
            ((F.col("source_size") * epoch + F.col("start") + F.col("upto")) / F.col("weight")).alias("finish"),
        )
        for epoch in range(epochs)
    ]
    copies = served.select("skey", "size", "place", F.inline(F.array(*finish)))
    copies = materialize(copies, "mix-copies")

    longest = copies.agg(F.max("finish")).first()[0] or 1.0
    bin_of = F.floor(F.col("finish") / longest * bins)
    totals = copies.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("words"))
    running = totals.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
    at = running.where(F.col("upto") > budget).orderBy("bin").first()
    if at is None:
        taken = copies
    else:
        before = at.upto - at.words
        edge = copies.where(bin_of == at.bin).withColumn(
            "upto", F.sum("size").over(Window.orderBy("finish", "place", "epoch", "skey")) + before
        )
        stop = edge.where(F.col("upto") <= budget).agg(F.max(F.struct("finish", "place", "epoch", "skey"))).first()[0]
        taken = copies.where(bin_of < at.bin)
        if stop is not None:
            last = F.struct(
                F.lit(stop.finish).alias("finish"),
                F.struct(
                    F.lit(stop.place.digest).alias("digest"),
                    F.lit(stop.place.doc).cast(copies.schema["place"].dataType["doc"].dataType).alias("doc"),
                    F.lit(stop.place.size).cast("long").alias("size"),
                ).alias("place"),
                F.lit(stop.epoch).alias("epoch"),
                F.lit(stop.skey).alias("skey"),
            )
            taken = taken.unionByName(
                copies.where((bin_of == at.bin) & (F.struct("finish", "place", "epoch", "skey") <= last))
            )
    lasts = taken.groupBy("skey", "epoch").agg(F.max("place").alias("last"))
    rules = targets.join(lasts.groupBy("skey").agg(F.collect_list("last").alias("last")), "skey", "left")
    return sized, materialize(rules.select("skey", "source_size", "target", "last"), "mix-rules")


def served(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with skey, size, place) and their source_size, target and taken words."""
    times = F.coalesce(F.size(F.filter("last", lambda last: last >= F.col("place"))), F.lit(0))
    times = F.when(F.col("last").isNull(), 0).otherwise(times)
    return (
        rows.join(rules, "skey", "left")
        .withColumn("taken", F.col("size") * times)
        .withColumn("copies", times)
        .drop("last")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row.

    NULL text: size 0, taken 0. NULL source: a source of its own, last. NULL doc_id: ordered as the empty text.
    Rows that repeat id and size are served alike. A table without rows or words takes nothing. Other columns are ignored.
    """
    sized, rules = fair_queue(docs, **options)
    return served(sized, rules).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_target``, ``mix_taken`` (words) and ``mix_copies``.

    The text stays where it is: rules of a few rows per source decide in the scan. Where ``docs`` has a column of such a name already, the new one
    gets an underscore behind it.
    """
    _, rules = fair_queue(docs, **options)
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        _source_key("source").alias("skey"),
        word_count(whole_text()).alias("size"),
        F.col("doc_id"),
    ).withColumn("place", _order_key(F.col("doc_id"), F.col("size")))
    taken = served(named, rules).where("copies > 0")
    added = {name: free_name(f"mix_{name}", docs.columns) for name in ("target", "taken", "copies")}
    return taken.select("doc.*", *[F.col(name).alias(new) for name, new in added.items()])


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS lim,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM weighed),
targets AS (
  SELECT source, source_size, weight,
         least(lim::DOUBLE, coalesce(weight * max(CASE WHEN own <= lim / weight THEN own END) OVER (), 'inf'::DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target, t.weight,
         sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, size) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT p.*, epoch, CAST(epoch * source_size + upto AS DOUBLE) / weight AS finish
  FROM placed p, (VALUES (0), (1)) e(epoch)),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, digest, doc_id, size, epoch, source NULLS FIRST) AS words,
         1.5 * (SELECT sum(source_size) FROM targets) AS budget
  FROM copies)
SELECT doc_id, size, source_size, target,
       CAST(size * count(*) FILTER (WHERE words <= budget) / CASE WHEN count(*) > 2 THEN count(*) / 2 ELSE 1 END AS BIGINT) AS taken
FROM queue GROUP BY doc_id, size, source_size, target, source
"""
