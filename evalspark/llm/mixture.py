"""Mixing sources to target weights by systematic sampling (operator 2).

Every document of a source is expected ``target / source_size`` times in the mix. Within its source the
documents are put in order of size; the expected copies are summed along that order, one random offset of
the source (from the seed and its name) is added, and a document is taken once for each integer that its
stretch of the sum crosses. Since neighbours in the order are of like size, the words taken come near the target.

Targets: the mix holds ``share`` times all words; it is shared by weight, no source above ``most`` times its
own size, what is above is shared among the others by weight until none is above.

The running sum needs no window over a source: rows are dealt by range of (source, size, id), each range counts
its rows of each source, and the small table of counts gives the ranges' first positions.

Null text counts as empty (size 0); a null source is a source of its own, last in order; null ids come first among
equal sizes; repeated rows are documents of their own. A source without words has target 0 and gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, cut, n_partitions, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in order, repeating
RANGE_ROWS = 33  # bits of the row number inside a partition in monotonically_increasing_id


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: Column, seed: int) -> Column:
    """In [0, 1): the first 32 bits of a hash of the seed and the source's name."""
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source))))
    return F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size: a row for each source) with ``target``.

    A source stops at ``most`` times its size. In order of size by weight, the sources that stop are a prefix: source k
    stops if it would get more than its limit when all before it have stopped. One row per source, so this window is
    over a table as small as the list of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("ratio", F.col("limit") / F.col("weight")).withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    left = F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(after))  # words for a weight of 1, were it the first not to stop
    df = df.withColumn("stops", F.col("ratio") <= F.col("level"))
    df = df.withColumn("rest", F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(every)["level"])
    return df.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
         share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, text_hash``: how often the mix takes each document."""
    spark = docs.sparkSession
    # one pass over the texts; what follows reads this narrow table
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    order = ("source", "size", "doc_id", "text_hash")
    rows = cut(cut(narrow).repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", RANGE_ROWS)

    # rows of each source in each range: as many rows as ranges and sources together
    runs = cut(rows.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("at").alias("first")))
    goals = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    past = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("source", "part", "first", F.coalesce(past, F.lit(0)).alias("past"))
    runs = runs.join(goals, runs["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    runs = runs.withColumn("off", offset(F.col("source"), seed)).withColumnRenamed("source", "run_source")
    rows = rows.withColumn("run_part", part)
    df = rows.join(runs, (F.col("run_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("run_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("at") - F.col("first") + F.col("past")
    up_to = lambda k: F.floor(F.col("off") + F.col("each") * k)
    copies = F.least(up_to(F.col("place") + 1) - up_to(F.col("place")), F.lit(int(-(-most // 1)))).cast("bigint")
    df = df.withColumn("each", each).withColumn("place", place)
    return df.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "text_hash")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (of one id, source and text each several) with ``number``, from 1, among those that share the three. The rows are
    written with the task that wrote them; each task's rows are numbered by themselves, from an offset."""
    rows = cut(rows.withColumn("task", F.shiftright(F.monotonically_increasing_id(), RANGE_ROWS)))
    key = ["id", "source", "text_hash"]
    counts = rows.groupBy(*key, "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("task").alias("k_task"), before.alias("before"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    rows = rows.join(counts, same[0] & same[1] & same[2] & (F.col("task") == F.col("k_task")))
    at = F.row_number().over(Window.partitionBy(*key, "task").orderBy("id"))
    return rows.withColumn("number", F.col("before") + at)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The documents of the mix, each as often as the plan says (copies are whole rows of ``docs``).

    Rows that share their id, source and text are interchangeable in the plan; their copies are summed and dealt out
    evenly among them by a number that is their own. Texts cross one shuffle, and those of repeated rows two more.
    Each row travels as one struct, so its columns may have any names.
    """
    counts = plan(docs, id_col, text_col, source_col, **kw)
    counts = counts.groupBy(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("text_hash").alias("c_hash")).agg(
        F.sum("copies").alias("sum"), F.count("*").alias("rows")
    )
    counts = cut(counts.filter("sum > 0"))
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("c_id")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("text_hash") == F.col("c_hash"))
    df = df.join(counts.hint("shuffle_hash"), same)  # the narrow side is the hashed one: texts are not sorted
    one = df.filter("rows = 1").select("row", F.col("sum").alias("copies"))
    several = _numbered(df.filter("rows > 1").select("row", "id", "source", "text_hash", "sum", "rows"))
    share = lambda k: F.floor(F.col("sum") * k / F.col("rows"))
    several = several.select("row", (share(F.col("number")) - share(F.col("number") - 1)).alias("copies")).filter("copies > 0")
    df = one.unionByName(several)
    df = df.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return df.select(*(F.col(f"row.`{c}`") for c in docs.columns))
