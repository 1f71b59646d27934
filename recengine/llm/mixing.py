"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: each source gets its weight's share of all words, at most ``repeats`` times its own; what is over is shared again by
weight until no source is above. Schedule: slot t of T / ``block`` stands at the golden-ratio point of t, which falls into
one source's part of the cumulative targets; so every stretch of the schedule has all sources near their shares. A source's
documents, shuffled by digest, lie end to end on an axis that is repeated ``repeats`` times and cut into blocks of ``block``
words; its r-th slot takes its r-th block.

No source meets in one task: positions on the axis and ranks of slots come from sums per (source, bucket) and running sums
within one, with about as many buckets as rows in each, so that both levels are the square root of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recengine.llm.shared import kept

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 64
REPEATS = 3
#: 2^31 over the golden ratio, odd: multiples of it modulo 2^31 are the Kronecker sequence's points in steps of 2^-31.
GOLDEN, WHOLE = 1327217885, 1 << 31

SIZE = r"[^\x20\x09-\x0D]+"


#: Tables of sources are broadcast up to this number of rows (a few MB), and joined by shuffle beyond it.
FEW = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """Rows (source, source_size) with weight and target; as many rounds as sources reach their limit one after another."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = kept(sources.withColumn("weight", by).withColumn("most", F.lit(float(repeats)) * F.col("source_size")))
    share, before = float("inf"), None
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    while share != before:  # a share only grows, and a source once at its limit stays there
        before = share
        free = F.col("weight") * (0.0 if math.isinf(share) else share) <= F.col("most")
        x = s.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(~free, F.col("most"))), F.lit(0.0)).alias("over")).first()
        if x["w"]:
            share = (total - x["over"]) / x["w"]
        elif math.isinf(share):
            share = 0.0
    return s.withColumn("target", F.least(F.col("weight") * F.lit(share), F.col("most"))).drop("most")


def schedule(spark: SparkSession, goals: DataFrame, slots: int, total: float) -> DataFrame:
    """For each slot 0..slots-1 its source's key and its rank among that source's slots."""
    number = goals.count()
    running = F.sum("target").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grid = max(1024, number)
    parts = (
        goals.where("target > 0").withColumn("_to", running / F.lit(total)).withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("key")), F.lit(0.0)))
        .withColumn("_to", F.when(F.lead("key").over(Window.orderBy("key")).isNull(), 1.0).otherwise(F.col("_to")))
        .select("key", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") * grid), F.least(F.floor(F.col("_to") * grid), F.lit(grid - 1)))).alias("_cell"))
    )
    run = max(1, math.isqrt(slots))
    t = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", (F.col("slot") % WHOLE * GOLDEN % WHOLE) / F.lit(float(WHOLE)))
    placed = t.withColumn("_cell", F.floor(F.col("_u") * grid)).join(few(parts, 2 * grid), "_cell").where("_from <= _u AND _u < _to").select("key", "slot", F.floor(F.col("slot") / run).alias("_run"))
    return ranked(placed, "_run", ["slot"], F.lit(1)).select("key", "slot", F.col("_at").alias("rank"))


def ranked(rows: DataFrame, bucket: str, order: list[str], size: Column) -> DataFrame:
    """``rows`` with _at: the sum of ``size`` over the rows of the same key that stand before, by bucket and then ``order``."""
    whole = rows.groupBy("key", bucket).agg(F.sum(size).alias("_in"))
    before = Window.partitionBy("key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("key", bucket, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("key", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["key", bucket]).withColumn("_at", F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_start")


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target and taken (words the mix takes of a row, repeats counted).

    Null is a source, the last. A null, empty or blank text has size 0 and nothing is taken of it. Rows that agree in doc_id,
    source, size and text share what is taken of them: each gets the quotient, and as many as words remain get one more. An empty
    table stays empty. Columns of ``docs`` with a result's name give way.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    own, others = docs.columns, [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    docs = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("+")).alias("+others"))
    back = [F.col(c) if c not in others else F.col("+others").getField(c).alias(c) for c in own]
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    identity = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key": key, "size": size_of(F.col("text")), "_text": F.xxhash64("text")}
    rows = docs.withColumns(identity)
    slim = kept(rows.groupBy(*identity, "source").agg(F.count(F.lit(1)).alias("_copies")))
    sources = slim.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"))
    goals = kept(targets(sources, weights, repeats))
    x = goals.agg(F.sum("target").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, count = x["total"] or 0.0, slim.count()
    per = few(goals.select("key", "source_size", "target"), x["n"])
    if not total:
        return rows.join(per, "key").select(*back, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    slots = kept(schedule(spark, goals, math.ceil(total / block), total))
    step = max(1, (1 << 32) // max(1, math.isqrt(count)) + 1)
    digest = F.md5("_id")
    shuffled = slim.where("size > 0").select(*identity, "_copies", digest.alias("_digest"), F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / step).alias("_bucket"))
    long = F.col("size") * F.col("_copies")
    axis = ranked(shuffled, "_bucket", ["_digest", "_id", "size", "_text"], long)
    counts = slots.groupBy("key").agg(F.count(F.lit(1)).alias("_blocks"))
    start = F.col("_at") + F.col("_round") * F.col("source_size")
    pieces = (
        axis.join(few(goals.select("key", "source_size").join(counts, "key"), x["n"]), "key").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("_from", start).withColumn("_to", start + long).where(F.col("_from") < F.col("_blocks") * block)
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.least(F.floor((F.col("_to") - 1) / block), F.col("_blocks") - 1))))
        .select(*identity, "_copies", "rank", (F.least("_to", (F.col("rank") + 1) * block) - F.greatest("_from", F.col("rank") * block)).alias("_words"))
    )
    taken = pieces.join(slots.select("key", "rank"), ["key", "rank"]).groupBy(*identity).agg(F.sum("_words").alias("_all"), F.max("_copies").alias("_copies"))
    joined = rows.join(taken.withColumn("taken", F.floor(F.col("_all") / F.col("_copies"))).withColumn("_rest", F.col("_all") % F.col("_copies")), list(identity), "left")
    result = [*back, "size", "source_size", "target"]
    if not taken.where("_all % _copies > 0").isEmpty():
        joined = _spread(kept(joined.withColumn("_row", F.monotonically_increasing_id())), list(identity))
    return joined.join(per, "key").select(*result, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _spread(rows: DataFrame, identity: list[str]) -> DataFrame:
    """``rows`` (_row: a number of its own) with one more taken by the first ``_rest`` rows of each identity: places from two levels, no group in one task."""
    equal = rows.where("_rest > 0").select("_row", "_rest", F.xxhash64(*identity).alias("_a"), F.md5(F.concat_ws("|", "_id", "key", "size", "_text")).alias("_b"), F.shiftright("_row", 12).alias("_run"))
    placed = ranked(equal.select("_row", "_rest", "_run", F.concat_ws("|", "_a", "_b").alias("key")), "_run", ["_row"], F.lit(1))
    more = kept(placed.where("_at < _rest").select("_row", F.lit(1).alias("_one")))
    return rows.join(more, "_row", "left").withColumn("taken", F.col("taken") + F.coalesce("_one", F.lit(0))).drop("_one", "_row")


def written_out(mixed: DataFrame) -> DataFrame:
    """A row for each time the mix takes a document; the last is cut after as many words as are still taken."""
    rest = F.col("taken") - (F.col("_time") - 1) * F.col("size")
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " ")
    times = mixed.where("taken > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    return times.withColumn("text", F.when(rest >= F.col("size"), F.col("text")).otherwise(cut)).drop("_time")
