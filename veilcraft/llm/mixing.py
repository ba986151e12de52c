"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Every document gets a hash of 60 bits. The documents of a source that a budget pays for are those
below a threshold of that hash. The threshold is found without sorting: words are summed by source
and by the leading bits of the hash, the bucket in which the budget runs out is looked up in the
running sums of at most 1,024 buckets, and only that bucket is split by its next ten bits, until it
holds a single hash. Sums combine before the shuffle, so a source with most of the rows is no hot
key; what is exchanged are bucket sums.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, the last one; rows equal in id and text share a hash and are taken together; an empty table gives an
empty result; columns beyond the three that are named pass through and may have any name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcraft.session import materialize

HASH_BITS = 60
LEVEL_BITS = 10
#: A source's target stops at so many times its own size.
MOST_REPEATS = 3
#: How often what is left of a budget is offered to documents that still fit.
ROUNDS = 3


def words_in(text: Column) -> Column:
    """How many words: runs of anything but blank and the five control characters from tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(id_column: Column, text: Column) -> Column:
    """The leading 60 bits of the MD5 of id and text."""
    digest = F.md5(F.concat_ws(":", id_column.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target words per source from rows (source, source_size): one row per source is all that is ordered here.

    Weights 1, 2, 3 repeat over the sources in code point order. Targets share the total by weight, stop at
    ``MOST_REPEATS`` times the source, and what is cut off is shared again: each target is the smaller of its cap and
    level x weight, and the level comes from the sources in the order in which they reach their caps.
    """
    everywhere = Window.partitionBy()
    ranked = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumns({"weight": F.col("source_no") % 3 + 1, "cap": F.lit(MOST_REPEATS) * F.col("source_size")})
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    )
    leveled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = leveled.withColumn("final", F.first(fits, ignorenulls=True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    return final.select(
        "source", "source_no", "source_size", target.alias("target"), whole.alias("whole"),
        (F.round(target).cast("long") - whole * F.col("source_size")).alias("budget"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which each source's rows (source_no, hash, size) stay within its budget (source_no, budget)."""
    ends = F.lit(1 << HASH_BITS).cast("long")
    state = budgets.select("source_no", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("long").alias("cut"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        still = state.where("cut is null")
        inside = rows.join(still, "source_no").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("bucket"))
        sums = inside.groupBy("source_no", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.first("rest").alias("rest")
        )
        running = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket"))
        crossing = sums.withColumn("before", running - F.col("words")).where(F.col("before") + F.col("words") > F.col("rest"))
        found = crossing.groupBy("source_no").agg(F.min(F.struct("bucket", "before", "least", "most")).alias("at"))
        nexts = still.drop("bucket", "cut").join(found, "source_no", "left").select(
            "source_no", (F.col("rest") - F.coalesce(F.col("at.before"), F.lit(0))).alias("rest"),
            F.coalesce(F.col("at.bucket"), F.lit(0)).cast("long").alias("bucket"),
            F.when(F.col("at").isNull(), ends).when(F.col("at.least") == F.col("at.most"), F.col("at.least")).alias("cut"),
        )
        state = materialize(state.where("cut is not null").unionByName(nexts), "mix-thresholds")
        if state.where("cut is null").isEmpty():
            break
    return state.select("source_no", "cut")


def mix_plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per source: source, source_size, target, whole, and for each round the largest size and the hash threshold.

    Every document of a source is taken ``whole`` = floor(target / source_size) times; the rest of the target goes to the
    documents below a threshold, and what that leaves is offered again to documents small enough for it.
    """
    rows = docs.select(
        F.col(source_column).alias("source"), words_in(F.col(text_column)).alias("size"), hash60(F.col(id_column), F.col(text_column)).alias("hash")
    )
    rows = materialize(rows, "mix-sizes")
    plan = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    rows = rows.where("size > 0")
    for n in range(ROUNDS):
        offered = with_plan(rows, "source", plan).where((F.col("size") <= F.col("budget")) & ~picked(F.col("size"), F.col("hash"), n))
        offered = offered.select("source_no", "hash", "size")
        cuts = thresholds(offered, plan.select("source_no", "budget"))
        spent = offered.join(cuts, "source_no").where("hash < cut").groupBy("source_no").agg(F.sum("size").alias("spent"))
        plan = materialize(plan.join(cuts, "source_no").join(spent, "source_no", "left").select(
            *(c for c in plan.columns if c != "budget"), F.col("budget").alias(f"most_{n}"), F.col("cut").alias(f"cut_{n}"),
            (F.col("budget") - F.coalesce(F.col("spent"), F.lit(0))).alias("budget"),
        ), "mix-sources")
    return plan


def with_plan(rows: DataFrame, source_column: str, plan: DataFrame) -> DataFrame:
    """Rows beside the plan of their source. The plan has a row per source, so Spark broadcasts it if its size allows."""
    return rows.join(plan.withColumnRenamed("source", "__plan_source"), F.col(source_column).eqNullSafe(F.col("__plan_source"))).drop("__plan_source")


def picked(size: Column, hashed: Column, rounds: int = ROUNDS) -> Column:
    """Whether one of the first rounds takes a document once more than ``whole`` times."""
    tests = [(size <= F.col(f"most_{n}")) & (hashed < F.col(f"cut_{n}")) for n in range(rounds)]
    return (size > 0) & reduce(or_, tests, F.lit(False))


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """How often each document goes into the mix: doc_id, size, source_size, target, copies, taken (copies x size)."""
    plan = mix_plan(docs, id_column, text_column, source_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words_in(F.col(text_column)).alias("size"),
        hash60(F.col(id_column), F.col(text_column)).alias("hash"),
    )
    copies = F.col("whole") + picked(F.col("size"), F.col("hash")).cast("long")
    told = with_plan(rows, "source", plan).withColumn("copies", copies)
    return told.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself: every input column, each row as many times as the mix takes it.

    Neither a shuffle of texts nor a join of documents: a row is kept or repeated by its own hash and size.
    """
    plan = mix_plan(docs, id_column, text_column, source_column)
    plan = plan.select(*(F.col(c).alias(f"__mix_{c}") for c in plan.columns))
    keyed = docs.withColumns({"__mix_size": words_in(docs[text_column]), "__mix_hash": hash60(docs[id_column], docs[text_column])})
    joined = keyed.join(plan, keyed[source_column].eqNullSafe(plan["__mix_source"]))
    tests = [(F.col("__mix_size") <= F.col(f"__mix_most_{n}")) & (F.col("__mix_hash") < F.col(f"__mix_cut_{n}")) for n in range(ROUNDS)]
    copies = F.col("__mix_whole") + ((F.col("__mix_size") > 0) & reduce(or_, tests)).cast("long")
    repeated = joined.withColumn("__mix_copies", copies.cast("int")).where("__mix_copies > 0")
    return repeated.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
