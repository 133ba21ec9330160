"""Tables of versions, entities and decisions as numbered Parquet folders.

A write makes the next folder of its table; it counts once Spark has marked it complete. Readers take the
highest complete one, so they see the old rows or the new ones, also after a crash. Logs grow by
folders, all of which count. One writer at a time is assumed. Snapshots are never changed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each path of two readings (path, sha256): added, changed, unchanged or gone."""
    o, n = old.select("path", F.col("sha256").alias("o")), new.select("path", F.col("sha256").alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "gone").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full").select("path", state.alias("state"))


#: Columns that a write never takes away once they are set: kept where the new value is null (others too), or even where it is not (fixed values).
KEPT_ONCE_SET = {"revisions": ["label", "created_at"], "documents": ["content", "sha256"]}


def upserted(old: DataFrame, new: DataFrame, keys: list[str], first_wins: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key.

    A null in ``new`` keeps what was there; of ``first_wins`` what was there stays in any case. Columns that only
    one side has are added, null on the other.
    """
    columns = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    wide = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
    o, n = wide(old), wide(new)
    joined = n.alias("n").join(o.alias("o"), keys, "left")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in first_wins else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    merged = joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in columns])
    return o.join(n.select(*keys), keys, "left_anti").unionByName(merged)


def claim_conflicts(held: DataFrame, claims: DataFrame) -> DataFrame:
    """Forms (collection_id, form_key) that another entity already holds."""
    h = held.select("collection_id", "form_key", F.col("entity_id").alias("holder"))
    return claims.join(h, ["collection_id", "form_key"]).filter("holder <> entity_id")


def missed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (fingerprint, ...) without a recorded exchange."""
    return requests.join(recorded.select("fingerprint"), "fingerprint", "left_anti")


def nearest_recorded(requests: DataFrame, recorded: DataFrame, fields: list[str]) -> DataFrame:
    """For requests that were missed, the recorded one of their step that differs in the fewest fields, and in which."""
    a = requests.select("fingerprint", "step", *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = recorded.select(F.col("fingerprint").alias("nearest"), "step", *[F.col(f).alias(f"_b_{f}") for f in fields])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    met = a.join(b, "step").select("fingerprint", "nearest", differs.alias("differs"))
    return met.groupBy("fingerprint").agg(F.min(F.struct(F.size("differs").alias("n"), "nearest", "differs")).alias("m")).select("fingerprint", "m.nearest", "m.differs")


class Store:
    """Named tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, table: str, prefix: str) -> list[str]:
        """Complete folders of a table, in order of their number."""
        context = self.spark.sparkContext
        done = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{prefix}-*/_SUCCESS")
        found = done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or []
        return sorted(s.getPath().getParent().toString() for s in found)

    def _next(self, table: str, prefix: str) -> str:
        context = self.spark.sparkContext
        any_ = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{prefix}-*")
        found = any_.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(any_) or []
        last = max((int(s.getPath().getName().rsplit("-", 1)[1]) for s in found), default=0)
        return f"{self.root}/{table}/{prefix}-{last + 1:012d}"

    def _live(self, table: str) -> list[str]:
        """What a table is read from: its newest whole version, which took in all logs up to the number in its name, and the logs after that."""
        whole, logs = self._folders(table, "v")[-1:], self._folders(table, "log")
        upto = int(whole[0].rsplit("/v-", 1)[1].split("-")[0]) if whole else 0
        return [*whole, *(x for x in logs if int(x.rsplit("-", 1)[1]) > upto)]

    def read(self, table: str) -> DataFrame | None:
        live = self._live(table)
        return self.spark.read.option("mergeSchema", True).parquet(*live) if live else None

    def write(self, table: str, rows: DataFrame) -> None:
        """A new whole version, in place of all that was there when it began."""
        logs = self._folders(table, "log")
        upto = max([int(x.rsplit("-", 1)[1]) for x in logs], default=0)
        rows.write.parquet(self._next(table, f"v-{upto:012d}"))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        old = self.read(table)
        self.write(table, rows if old is None else upserted(old, rows, keys, KEPT_ONCE_SET.get(table, [])))

    def append(self, table: str, rows: DataFrame, order: list[str]) -> None:
        """Adds a folder to a log. ``seq`` goes on from the largest there is, rising in the given order; numbers may be left out."""
        old = self.read(table)
        last = 0 if old is None else old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = rows.orderBy(*order).withColumn("seq", F.lit(last) + 1 + F.monotonically_increasing_id())
        numbered.write.parquet(self._next(table, "log"))

    def delete_where(self, table: str, condition) -> int:
        """Takes rows out of a table; how many there were."""
        old = self.read(table)
        if old is None:
            return 0
        gone = F.coalesce(condition, F.lit(False))
        n = old.filter(gone).count()
        if n:
            self.write(table, old.filter(~gone))
        return n

    def record_replies(self, replies: DataFrame) -> None:
        """Adds exchanges (fingerprint, ...) to the record; one that is there already stays as it is."""
        old = self.read("replies")
        rows = replies.dropDuplicates(["fingerprint"])
        self.append("replies", rows if old is None else missed(rows, old), ["fingerprint"])

    def claim_forms(self, claims: DataFrame) -> None:
        """Gives forms to entities; refused as a whole where another entity holds one. An entity's old forms go."""
        held = self.read("forms")
        if held is not None:
            taken = claim_conflicts(held, claims).limit(3).collect()
            if taken:
                raise ValueError("; ".join(f"{r['form_key']} belongs to {r['holder']}" for r in taken))
            claims = held.join(claims.select("collection_id", "entity_id").distinct(), ["collection_id", "entity_id"], "left_anti").unionByName(claims)
        self.write("forms", claims)

    def insert_snapshot(self, rows: DataFrame) -> None:
        """Adds snapshots (id, sha256, ...). The same again changes nothing; another under a known id is refused."""
        old = self.read("snapshots")
        if old is not None:
            clash = rows.join(old.select("id", F.col("sha256").alias("held")), "id").filter("sha256 <> held").limit(1).collect()
            if clash:
                raise ValueError(f"snapshot {clash[0]['id']} exists with other content")
            rows = rows.join(old.select("id"), "id", "left_anti")
        self.append("snapshots", rows, ["id"])


def find_store(start: str, name: str = "store", explicit: str | None = None) -> str | None:
    """Where the store is: the given place, else the nearest folder of that name in ``start`` or above it."""
    from pathlib import Path

    if explicit:
        return explicit
    at = Path(start).resolve()
    return next((str(p / name) for p in (at, *at.parents) if (p / name).is_dir()), None)
