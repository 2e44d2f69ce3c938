"""Sums and moments over sliding windows of time, without subtraction, at a cost that doesn't grow with the rows of a window.

Time is cut into blocks as long as the window. A window then begins in one block and ends in the next: what it holds is the
first one's rows from its beginning on and the second one's rows up to its end. Both are running aggregates within a block, one
in order of time and one in the reverse order. A row that wants a window puts two marks among the values, where it begins and
where it ends; each mark takes the running aggregate there, and a row's two marks are merged, sums by adding them and variances
by the formula for two samples. Rows outside a window never touch its result, so an outlier leaves no trace once it's out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE, _BEGIN, _END = 0, 1, 2


def _marked(rows: DataFrame, by: list[str], us: str, values: dict[str, Column], aggregates: dict[str, Column], wanted: Column, low: int, high: int) -> DataFrame:
    """The wanted rows (__row) with the aggregates from the window's begin to its block's end (__s), and from the next block's
    begin to the window's end (__e); __s is null where the window is one whole block, which __e then is.

    aggregates are expressions of the columns named as in values, and skip nulls.
    """
    width = high - low + 1
    own = F.struct(*rows.columns)
    plain = rows.select(*by, F.col(us).alias("__t"), own.alias("__row"), wanted.alias("__wanted"), F.monotonically_increasing_id().alias("__id"), *(v.cast("double").alias(k) for k, v in values.items()))
    no_row = F.lit(None).cast(plain.schema["__row"].dataType)
    t = F.col("__t")

    def event(kind: int, at: Column) -> Column:
        held = [(F.col(k) if kind == _VALUE else F.lit(None).cast("double")).alias(k) for k in values]
        return F.struct(at.alias("__t"), F.floor(at / width).alias("__g"), F.lit(kind).alias("__kind"), (F.col("__row") if kind == _END else no_row).alias("__row"), *held)

    marks = F.array(event(_VALUE, t), event(_BEGIN, t + low), event(_END, t + high))
    events = plain.select(*by, "__id", F.explode(F.when(F.col("__wanted"), marks).otherwise(F.array(event(_VALUE, t)))).alias("__x")).select(*by, "__id", "__x.*")
    block = Window.partitionBy(*by, "__g")
    # at one time, values come before marks in either direction: both ends of a window belong to it
    up, down = (block.orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0) for order in (F.col("__t"), F.col("__t").desc()))
    upto, since = (F.struct(*(a.over(frame).alias(k) for k, a in aggregates.items())) for frame in (up, down))
    whole = F.col("__t") % width == 0  # the window begins with a block, so it is that block
    state = F.when(F.col("__kind") == _END, upto).when((F.col("__kind") == _BEGIN) & ~whole, since)
    taken = events.withColumn("__a", state).filter(F.col("__kind") != _VALUE)
    kind = F.col("__kind")
    return taken.groupBy(*by, "__id").agg(F.first("__row", True).alias("__row"), F.first(F.when(kind == _BEGIN, F.col("__a")), True).alias("__s"), F.first(F.when(kind == _END, F.col("__a")), True).alias("__e"))


def _both(name: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(f"__s.{name}"), F.lit(0.0)), F.coalesce(F.col(f"__e.{name}"), F.lit(0.0))


def window_sums(rows: DataFrame, by: list[str], us: str, values: dict[str, Column], wanted: Column, low: int, high: int) -> DataFrame:
    """The wanted rows with a sum of each of the values over the rows of `by` whose time us is within [low, high] of theirs.

    Null values count as zero.
    """
    held = {f"__v_{k}": v for k, v in values.items()}
    found = _marked(rows, by, us, held, {k: F.sum(k) for k in held}, wanted, low, high)
    return found.select("__row.*", *(sum(_both(f"__v_{k}")).alias(k) for k in values))


def window_moments(rows: DataFrame, by: list[str], us: str, x: Column, y: Column, wanted: Column, low: int, high: int, prefix: str = "__") -> DataFrame:
    """The wanted rows with the moments of x and y, which are both known, over the rows within [low, high] of theirs: n, mx, my,
    vx, vy and cxy (population), and msd, the mean squared difference. All but n are null in an empty window."""
    d = F.col("__x_") - F.col("__y_")
    aggregates = {"n": F.count("__x_"), "mx": F.avg("__x_"), "my": F.avg("__y_"), "vx": F.var_pop("__x_"), "vy": F.var_pop("__y_"), "cxy": F.covar_pop("__x_", "__y_"), "msd": F.avg(d * d)}
    found = _marked(rows, by, us, {"__x_": x, "__y_": y}, aggregates, wanted, low, high)
    (na, nb), (xa, xb), (ya, yb) = (_both(k) for k in ("n", "mx", "my"))
    n = F.nullif(na + nb, F.lit(0.0))
    wa, wb = na / n, nb / n

    def mean(name: str) -> Column:
        a, b = _both(name)
        return a * wa + b * wb

    apart = wa * wb  # weighs the distance of the two parts' means
    dx, dy = xb - xa, yb - ya
    merged = {
        "n": (na + nb).cast("long"), "mx": mean("mx"), "my": mean("my"), "msd": mean("msd"),
        "vx": mean("vx") + dx * dx * apart, "vy": mean("vy") + dy * dy * apart, "cxy": mean("cxy") + dx * dy * apart,
    }
    return found.select("__row.*", *(v.alias(prefix + k) for k, v in merged.items()))
