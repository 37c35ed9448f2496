"""Looking back along a total order without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Quantiles that are looked up; buckets beyond that many split the ranges between them evenly.
QUANTILES = 64


def even_buckets(df: DataFrame, col: str, parts: int) -> Column:
    """About ``parts`` ranges with as many rows each, monotone in the column: ranges between quantiles, split by width.

    A far value or a busy stretch of time is no hot bucket then; only equal values cannot be told apart.  One aggregate.
    """
    n = max(1, min(parts, QUANTILES))
    split = -(-parts // n)
    x = F.col(col).cast("double")
    marks = df.agg(F.percentile_approx(x, [k / n for k in range(n + 1)], 10_000)).first()[0]
    marks = sorted(set(marks or [0.0]))
    if len(marks) < 2:
        return F.when(x.isNotNull(), F.lit(0).cast("long"))

    which = _place(x, marks, 0, len(marks) - 1)
    if split == 1:
        return F.when(x.isNotNull(), which.cast("long"))
    low, high = F.array(*map(F.lit, marks[:-1])), F.array(*map(F.lit, marks[1:]))
    share = (x - F.get(low, which)) / (F.get(high, which) - F.get(low, which))
    inner = F.least(F.greatest(F.floor(share * split), F.lit(0)), F.lit(split - 1))
    return (which * split + inner).cast("long")


def _place(x: Column, marks: list, lo: int, hi: int) -> Column:
    """The number of the range that x lies in, by halving."""
    if hi - lo == 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < marks[mid], _place(x, marks, lo, mid)).otherwise(_place(x, marks, mid, hi))


def carried(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with ``name``: the value of the nearest earlier row, in ascending ``order``, whose value is not null.

    ``bucket`` is monotone in the order.  Rows look back within their bucket; what enters a bucket from earlier ones is
    found on a table of one row per bucket.
    """
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    inner = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    enters = per.select("_bucket", F.last("_last", ignorenulls=True).over(upto).alias("_enters"))
    looked = rows.withColumn("_inner", F.last("_value", ignorenulls=True).over(inner)).join(enters, "_bucket")
    return looked.select(*df.columns, F.coalesce("_inner", "_enters").alias(name))


def next_point(rows: DataFrame, at: str, points: DataFrame, inclusive: bool, parts: int) -> DataFrame:
    """rows with ``point``: the smallest point behind ``at``, or not before it if inclusive; null behind the last.

    Points have one column, or two, of which the second is told instead (of equal points that of the smallest).
    """
    key, told = points.columns[0], points.columns[-1]
    marks = points.groupBy(F.col(key).alias(at)).agg(F.min(told).alias("_told")).withColumn("_mark", F.lit(True))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_x", -F.col(at))
    both = both.withColumn("_tie", F.col("_mark").isNull() if inclusive else F.col("_mark").isNotNull())
    found = carried(both, even_buckets(both, "_x", parts), ["_x", "_tie"], F.when(F.col("_mark"), F.col("_told")), "point")
    return found.filter("_mark IS NULL").select(*rows.columns, "point")


#: Points that are compared with each row in place; more are looked up along the order.
FEW_POINTS = 128


def numbered(points: DataFrame) -> DataFrame:
    """(at, k): distinct points, numbered in order from 0."""
    given = points.select(F.col(points.columns[0]).cast("long").alias("at")).filter("at IS NOT NULL").distinct()
    return given.withColumn("k", F.row_number().over(Window.orderBy("at")).cast("long") - 1)  # over points, which the caller chose


def at_points(rows: DataFrame, points: DataFrame, parts: int) -> DataFrame:
    """rows(seq, ...) with k: the number of the first of points(at, k) not before seq; null behind the last."""
    some = [r.at for r in points.orderBy("at").select("at").limit(FEW_POINTS + 1).collect()]
    if len(some) > FEW_POINTS:
        return next_point(rows, "seq", points, True, parts).withColumnRenamed("point", "k")
    if not some:
        return rows.withColumn("k", F.lit(None).cast("long"))
    marks = [0, *(a + 1 for a in some)]  # range j holds what lies behind point j - 1 up to point j
    return rows.withColumn("k", F.when(F.col("seq") <= some[-1], _place(F.col("seq"), marks, 0, len(some))).cast("long"))
