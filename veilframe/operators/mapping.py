"""The mapping table: original key to subject id, kept from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.ids import permuted, unrank
from veilframe.functions.text import strip
from veilframe.operators.keep import kept


def keys(mapping: DataFrame) -> DataFrame:
    """(key, anon_id): of rows with one key the last counts; blank keys don't."""
    m = mapping.select(strip("original_key").alias("key"), strip("anon_id").alias("anon_id"), "ordinal").where("key <> ''")
    return m.groupBy("key").agg(F.max_by("anon_id", "ordinal").alias("anon_id"))


def known_fingerprints(mapping: DataFrame) -> DataFrame:
    """(key, fp, ordinal) rows of the fingerprints column."""
    rows = mapping.select(strip("original_key").alias("key"), F.explode(F.split(strip(F.coalesce("fingerprints", F.lit(""))), r"\s+")).alias("fp"), "ordinal")
    return rows.where("key <> '' AND fp <> ''")


def assign(arrivals: DataFrame, mapping: DataFrame, secret: str) -> DataFrame:
    """Per distinct key of arrivals (key, name, first_seen): s_no, key, anon_id, name, is_new.

    Known keys keep their id. New keys are numbered in order of first sight after the rows there are,
    and take ids from a keyed permutation, which can't repeat; numbers whose id is reserved are left
    out before they are dealt. Numbering is of new keys only and runs over range partitions.
    """
    asked = arrivals.select(strip("key").alias("key"), "name", "first_seen").where("key <> ''")
    asked = asked.groupBy("key").agg(F.min_by("name", F.struct("first_seen", "name")).alias("name"), F.min("first_seen").alias("first_seen"))
    asked, have = kept(asked), kept(keys(mapping))
    old = asked.join(have, "key").select(F.lit(None).cast("long").alias("s_no"), "key", "anon_id", "name", F.lit(False).alias("is_new"))
    new = numbered(asked.join(have, "key", "left_anti"), F.struct("first_seen", "key"))
    rows = mapping.count()
    need = new.count()
    reserved = mapping.select(strip("anon_id").alias("anon_id")).where("anon_id <> ''").distinct()
    # Counters from the table's rows on; as many more as ids could be taken already, and some for counters that have no id.
    taken = reserved.count()
    free = mapping.sparkSession.range(rows, rows + need + taken + 8).select(F.col("id").alias("counter"), unrank(permuted(F.col("id"), secret)).alias("anon_id"))
    free = numbered(free.where("anon_id IS NOT NULL").join(reserved, "anon_id", "left_anti"), F.col("counter")).where(F.col("n") <= need)
    fresh = new.join(free.select("n", "anon_id"), "n")
    if fresh.count() != need:
        raise RuntimeError("there are not enough free ids")
    return old.unionByName(fresh.select((F.col("n") + rows).alias("s_no"), "key", "anon_id", "name", F.lit(True).alias("is_new")))


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """rows with n, 1 and up by order, without gathering them: counts by range partition, then places within."""
    dealt = rows.select("*", order.alias("__o")).repartitionByRange(F.col("__o")).withColumn("__p", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("__o")
    dealt = kept(dealt, sure=True)  # partition ids must not be dealt anew between the two uses
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__k"))
    before = sizes.select("__p", (F.sum("__k").over(Window.orderBy("__p")) - F.col("__k")).alias("__b"))  # a row a partition
    own = Window.partitionBy("__p").orderBy("__o")
    return dealt.join(F.broadcast(before), "__p").withColumn("n", F.row_number().over(own) + F.col("__b")).drop("__o", "__p", "__b")


def describe(mapping: DataFrame) -> DataFrame:
    """Rows and distinct subject ids that aren't blank."""
    return mapping.agg(F.count("*").alias("n_rows"), F.count_distinct(F.nullif(strip("anon_id"), F.lit(""))).alias("n_subjects"))


def range_bounds(before: Column, after: Column) -> Column:
    """(first, last) serial numbers a run added; where it added none, the last there is twice."""
    return F.when(after > before, F.struct((before + 1).alias("first"), after.alias("last"))).otherwise(F.struct(before.alias("first"), before.alias("last")))


def range_name(prefix: str, before: Column, after: Column) -> Column:
    b = range_bounds(before, after)
    return F.concat_ws("_", F.lit(prefix), b["first"].cast("string"), b["last"].cast("string"))
