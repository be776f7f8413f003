"""Plans that several operators need: tables in the shared folder, and running sums over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session may lack the setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="saltmarsh-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/stash/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of `value` over all rows before in a global order."""
    return running_sums(df, order, {out: value}, parts)


def running_sums(df: DataFrame, order: list[Column], values: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds, by the name that each gets, sums of columns over all rows before in a global order.

    Rows are dealt by range and numbered by partition in a written table; each partition sums its own rows,
    and the partitions' totals (one row each) give the offsets. No task sees more than its range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    kept = stash(ranged, "ranged")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of the `parts` partitions
    before = kept.groupBy("_part").agg(*(F.sum(v).alias(f"_total_{o}") for o, v in values.items()))
    before = before.select("_part", *(F.sum(f"_total_{o}").over(earlier).alias(f"_before_{o}") for o in values))
    inside = kept.withColumns({f"_inside_{o}": F.sum(v).over(own) for o, v in values.items()})
    zero = F.lit(0).cast("decimal(38,0)")
    joined = inside.join(F.broadcast(before), "_part")
    joined = joined.withColumns({o: (F.coalesce(f"_inside_{o}", zero) + F.coalesce(f"_before_{o}", zero)).cast("decimal(38,0)") for o in values})
    return joined.drop("_part", *(f"_{k}_{o}" for k in ("inside", "before") for o in values))


def running_sums_within(df: DataFrame, keys: str | list[str], order: list[Column], values: dict[str, str], parts: int | None = None) -> DataFrame:
    """The same within each key. No task has a whole key: rows are dealt by ranges of key and order, and each range has one key at most that began in a range before it, so the sums carried on are a row for each range."""
    keys = [keys] if isinstance(keys, str) else keys
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stash(df.repartitionByRange(parts, *map(F.asc, keys), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(*keys).orderBy("_part")
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("_part", *keys).agg(*(F.sum(v).alias(f"_total_{o}") for o, v in values.items()))
    carried = totals.withColumns({"_since": F.lag("_part").over(of_key)} | {f"_before_{o}": F.sum(f"_total_{o}").over(earlier) for o in values}).filter("_since is not null")
    carried = carried.select(F.col("_part").alias("_at"), *(F.col(k).alias(f"_key_{k}") for k in keys), *(f"_before_{o}" for o in values))
    inside = kept.withColumns({f"_inside_{o}": F.sum(v).over(own) for o, v in values.items()})
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    zero = F.lit(0).cast("decimal(38,0)")
    joined = inside.join(F.broadcast(carried), same, "left")  # fewer rows than partitions
    joined = joined.withColumns({o: (F.coalesce(f"_inside_{o}", zero) + F.coalesce(f"_before_{o}", zero)).cast("decimal(38,0)") for o in values})
    return joined.drop("_part", "_at", *(f"_key_{k}" for k in keys), *(f"_{k}_{o}" for k in ("inside", "before") for o in values))


def lag_within(df: DataFrame, key: str, order: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the value of `order` in the row before within a key, by ranges; null in a key's first row."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stash(df.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id()), "ranged")
    ends = kept.groupBy("_part", key).agg(F.max(order).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_part"))).filter("_carried is not null")
    carried = carried.select(F.col("_part").alias("_at"), F.col(key).alias("_key"), "_carried")
    inside = kept.withColumn("_inside", F.lag(order).over(Window.partitionBy("_part", key).orderBy(order)))
    joined = inside.join(F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")  # fewer rows than partitions
    return joined.withColumn(out, F.coalesce("_inside", "_carried")).drop("_part", "_at", "_key", "_carried", "_inside")


def running_max(df: DataFrame, order: list[Column], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the largest `value` of a row and all before it in a global order, by ranges."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stash(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of the `parts` partitions
    before = kept.groupBy("_part").agg(F.max(value).alias("_most")).select("_part", F.max("_most").over(earlier).alias("_before"))
    return kept.withColumn("_own", F.max(value).over(own)).join(F.broadcast(before), "_part").withColumn(out, F.greatest("_own", "_before")).drop("_part", "_own", "_before")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """An equi-join for a left side of which one key may have a large share: left rows are spread over `salts` copies of the right ones."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
