"""Which library versions a query is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_K = (1, 10)
#: Groups that queries for every library are dealt to.
SPREAD = 32


def clamped(k: Column, most: Column | None = None) -> Column:
    """``k`` between 1 and 10, and at most ``most``; null counts as 5."""
    low, high = map(F.lit, TOP_K)
    asked = F.coalesce(k, F.lit(5))
    return F.greatest(low, F.least(high, F.least(asked, most) if most is not None else asked))


def grouped(scopes: DataFrame, *, by: str = "profile_id", position: str = "scope_no") -> DataFrame:
    """``by, library, pos, versions``: libraries in any case are one, under the spelling that comes first; versions in
    order of first place, each once.  Scopes with a null or blank part are left out."""
    clean = scopes.select(by, position, F.trim("library").alias("library"), F.trim("version").alias("version")).where("library <> '' and version <> ''")
    first = clean.groupBy(by, F.lower("library").alias("_l"), F.lower("version").alias("_v")).agg(F.min(F.struct(position, "library", "version")).alias("_s"))
    return first.groupBy(by, "_l").agg(F.min("_s").alias("_m"), F.array_sort(F.collect_list(F.struct(f"_s.{position}", "_s.version"))).alias("_all")).select(by, F.col("_m.library").alias("library"), F.col(f"_m.{position}").cast("bigint").alias("pos"), F.transform("_all", lambda x: x["version"]).alias("versions"))


def expanded(queries: DataFrame, delivered: DataFrame, *, most: int = 3) -> DataFrame:
    """``query_id, library, version, pos`` of each query: its own version if it has one, else the ``most`` versions of
    its library that were delivered last (``delivered``: library, version, released_at); libraries in any case are one.
    Queries without a library are for every library's last version."""
    newest = Window.partitionBy(F.lower("library")).orderBy(F.col("released_at").desc_nulls_last(), "version")
    listed = delivered.withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= most).select(F.col("library").alias("_l"), F.col("version").alias("_v"), "pos")
    q = queries.select("query_id", F.when(F.trim("library") != "", F.trim("library")).alias("library"), F.when(F.trim("version") != "", F.trim("version")).alias("version"))
    own = q.where("library is not null and version is not null").select("query_id", "library", "version", F.lit(1).alias("pos"))
    open_ = q.where("library is not null and version is null").join(listed, F.lower("library") == F.lower("_l")).select("query_id", "library", F.col("_v").alias("version"), "pos")
    # Each query without a library meets every library: by a key that deals the queries to SPREAD groups.
    salted = q.where("library is null").withColumn("_s", F.pmod(F.xxhash64("query_id"), F.lit(SPREAD)))
    last = listed.where("pos = 1").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    every = salted.join(last, "_s").select("query_id", F.col("_l").alias("library"), F.col("_v").alias("version"), "pos")
    return own.unionAll(open_).unionAll(every).withColumn("pos", F.col("pos").cast("bigint"))
