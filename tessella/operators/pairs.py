"""All pairs of members of one group, made in cells of two blocks each.

A group's pairs grow with its square; no row, task or shuffle holds them. A cell is small, cells are dealt out evenly, and a pair is made
where its cell is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Members in a block, about; a cell makes the square of that.
BLOCK = 256


def blocked(members: DataFrame, apart: bool = False, size: int = BLOCK) -> DataFrame:
    """name, ids: the members (id, home) in blocks of about ``size``, each of members with equal homes; nulls go.

    An id stands in one block, however many homes it has; with ``apart`` in one for each home, and as often as there.
    """
    known = members.filter(F.col("id").isNotNull() & F.col("home").isNotNull())
    homes = known.select("id", F.array("home").alias("homes")) if apart else known.groupBy("id").agg(F.array_sort(F.collect_set("home")).alias("homes"))
    many = F.ceil(F.count("*").over(Window.partitionBy("homes")) / size)
    named = homes.withColumn("name", F.struct("homes", F.pmod(F.xxhash64("id"), many).alias("nth")))
    return named.groupBy("name").agg(F.collect_list("id").alias("ids"))


def cells(blocks: DataFrame, *more: DataFrame) -> DataFrame:
    """left, right, lefts, rights: each two blocks (and each with itself) that share a home, once, by name and with their ids; and what ``more`` has for some."""
    spark = blocks.sparkSession
    at = blocks.select("name", F.explode("name.homes").alias("home"))
    both = at.withColumnRenamed("name", "left").join(at.withColumnRenamed("name", "right"), "home").filter("left <= right").select("left", "right").distinct()
    side = lambda x: blocks.select(F.col("name").alias(x), F.col("ids").alias(f"{x}s"))
    # a number of partitions, as a cell weighs more than its bytes say
    dealt = both.join(side("left"), "left").join(side("right"), "right")
    for some in more:
        dealt = dealt.join(some, ["left", "right"], "left")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "left", "right")


def exploded(cells: DataFrame, *columns: str) -> DataFrame:
    """x, y, with x < y: the pairs of each cell, and its ``columns``."""
    wide = cells.select("left", "right", *columns, "rights", F.explode("lefts").alias("one"))
    return ordered(wide.select("left", "right", *columns, "one", F.explode("rights").alias("other")), *columns)


def ordered(pairs: DataFrame, *columns: str) -> DataFrame:
    """A cell's pairs with the smaller member first; of a block with itself each once."""
    return pairs.filter("left <> right or one < other").select(*columns, F.least("one", "other").alias("x"), F.greatest("one", "other").alias("y"))


def within(members: DataFrame) -> DataFrame:
    """x, y, with x < y: all pairs of ids that share a home, each once. ``members``: id, home."""
    return exploded(cells(blocked(members)))


def within_each(members: DataFrame) -> DataFrame:
    """home, x, y, with x < y: all pairs of each home, as often as their rows say."""
    return exploded(cells(blocked(members, apart=True)).withColumn("home", F.col("left.homes")[0]), "home").filter("x < y")
