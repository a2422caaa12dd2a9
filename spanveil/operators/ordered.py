"""Look-ups along an order and walks over jumps, where one key may hold most of the rows.

Neither puts the rows of a key into one array or one task: look-ups cut a key's axis into cells, walks double their step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.tables import settled


def first_after(queries: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """queries (key, q long, ..) with v: of the targets (key, v long) of its key the least that is greater than q; null if there is none.

    A key's axis is cut into as many cells of equal width as the root of its targets' number. A query looks into its own
    cell, else at the least target of the next cell that has one. Keys are not null.
    """
    cells = targets.groupBy(key).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.count("*").alias("__n"))
    cells = settled(cells.select(key, "__lo", (F.floor((F.col("__hi") - F.col("__lo")) / F.ceil(F.sqrt("__n"))) + 1).alias("__width")))
    cell = lambda x: F.floor((F.col(x) - F.col("__lo")) / F.col("__width")).cast("long")
    cells = F.broadcast(cells)  # a row a key: by a shuffle, all rows of a key would come to one task
    asked = queries.join(cells, key, "left").withColumn("__cell", cell("q")).withColumn("__at", F.col("q"))
    there = settled(targets.join(cells, key).select(key, "v", cell("v").alias("__cell")))
    both = asked.unionByName(there.withColumn("__at", F.col("v")).withColumnRenamed("v", "__v"), allowMissingColumns=True)
    # from high to low; at one place queries come first, as an equal target isn't greater
    down = Window.partitionBy(key, "__cell").orderBy(F.desc("__at"), F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__same", F.last("__v", ignorenulls=True).over(down)).where("__v IS NULL")
    # of each cell the least target of all later ones: as many rows as cells
    lowest = there.groupBy(key, "__cell").agg(F.min("v").alias("__min"))
    asked_cells = asked.select(key, "__cell").distinct().withColumn("__asked", F.lit(True))
    later = Window.partitionBy(key).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lowest.join(asked_cells, [key, "__cell"], "full").withColumn("__later", F.last("__min", ignorenulls=True).over(later)).where("__asked").select(key, F.col("__cell"), "__later")
    return inside.join(ahead, [key, "__cell"], "left").withColumn("v", F.coalesce("__same", "__later")).drop("__cell", "__at", "__lo", "__width", "__v", "__same", "__later")


def reached(start: DataFrame, jumps: DataFrame, key: str = "key") -> DataFrame:
    """(key, at) that a walk from the start (key, at) comes to, the start included, by jumps (key, at, to).

    Each place has one jump at most, and walks don't run in circles. The n-th round joins the places reached so far with
    jumps of 2^n steps, and these with themselves: as many rounds as the logarithm of the longest walk.
    """
    at = settled(start.select(key, "at"))
    far = settled(jumps.where("to IS NOT NULL").select(key, "at", "to"))
    while not far.isEmpty():
        more = at.join(far, [key, "at"]).select(key, F.col("to").alias("at"))
        at = settled(at.unionByName(more).distinct())
        again = far.select(key, F.col("at").alias("to"), F.col("to").alias("__further"))
        far = settled(far.join(again, [key, "to"]).select(key, "at", F.col("__further").alias("to")))
    return at


CELL = 1 << 16  # rows of a key that one window holds


def before(rows: DataFrame, order: list[str], amount: Column | None = None, key: str = "key", into: str = "i", cell: int | None = None) -> DataFrame:
    """rows with the sum of a long amount over the rows before, in their key's order; the first column of the order is a long and not null.

    Without an amount that is a row's place, from 0. A key's rows are summed in cells of the order's first column, which
    hold as many rows as there are cells if they lie evenly, and a cell starts from what the cells before it hold.
    """
    spread = rows.groupBy(key).agg(F.min(order[0]).alias("__lo"), F.max(order[0]).alias("__hi"), F.count("*").alias("__n"))
    width = F.floor((F.col("__hi") - F.col("__lo")) / F.ceil(F.sqrt("__n") if cell is None else F.col("__n") / cell)) + 1
    # a row a key goes to all tasks: by a shuffle, all rows of a key would come to one
    cut = rows.join(F.broadcast(spread.select(key, "__lo", width.alias("__width"))), key).withColumn("__cell", F.floor((F.col(order[0]) - F.col("__lo")) / F.col("__width"))).drop("__lo", "__width")
    cut = settled(cut.withColumn("__amount", F.lit(1).cast("long") if amount is None else amount))
    ahead = F.coalesce(F.sum("__own").over(Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut.groupBy(key, "__cell").agg(F.sum("__amount").alias("__own")).select(key, "__cell", ahead.alias("__before"))
    inside = F.coalesce(F.sum("__amount").over(Window.partitionBy(key, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn(into, inside).join(cells, [key, "__cell"]).withColumn(into, (F.col(into) + F.col("__before")).cast("long")).drop("__cell", "__before", "__amount")


def ranked(rows: DataFrame, order: list[str], key: str = "key", into: str = "i", cell: int | None = None) -> DataFrame:
    """rows with their place (from 0) in their key's order."""
    return before(rows, order, None, key, into, cell)


def carried(rows: DataFrame, value: str, key: str = "key", at: str = "i", cell: int = CELL) -> DataFrame:
    """rows (key, at: places without gaps) with the value replaced by the last one that isn't null, up to and including the row's own."""
    cut = rows.withColumn("__cell", F.floor(F.col(at) / cell))
    last = cut.where(F.col(value).isNotNull()).groupBy(key, "__cell").agg(F.max_by(value, at).alias("__last"))
    cells = cut.select(key, "__cell").distinct().join(last, [key, "__cell"], "left")
    cells = cells.select(key, "__cell", F.last("__last", ignorenulls=True).over(Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "__cell").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(value, inside).join(cells, [key, "__cell"]).withColumn(value, F.coalesce(value, "__carry")).drop("__cell", "__carry")
