"""Trailing event-time windows by rule and key: linear in their rows, exact under tied timestamps, safe for a hot key.

A window reaches no further back than its width, so a key's rows are cut into time buckets of that width and each counted
row also joins the next bucket as context: a partition holds at most two widths of one key's rows. A window's contents
change where a row comes and where one expires, so both are events of one running sum, and rules of different widths share
one exchange. At the same time an expiry comes first, and rows stand in the total order of events: those of the same second
that come later aren't counted yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time buckets in which streaks are counted.
STREAK_BUCKET = 3600 * 1_000_000


def trailing(rows: DataFrame, span: Column, distinct: bool) -> DataFrame:
    """rows: (rule, key, counts, value, _o), where only rows that count are in windows. Each row with _n, the counted rows of
    the window that ends with it, and _m, the different values that are not empty among them (0 if not asked for)."""
    home = F.floor(F.col("_o.us") / span).cast("long")
    rows = rows.withColumns({"_span": span, "_home": home})
    here = rows.withColumn("_b", F.explode(F.when(F.col("counts"), F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    here = here.withColumn("_own", F.col("_b") == F.col("_home"))
    comes, goes = F.lit(0), F.lit(0)
    if distinct:
        # of the rows of a value only the first within a width of the one before it adds it, only the last takes it away
        same = Window.partitionBy("rule", "key", "_b", "value").orderBy("_o")
        held = F.col("counts") & F.coalesce(F.col("value") != "", F.lit(False))
        fresh = F.coalesce(F.col("_o.us") - F.lag("_o.us").over(same) > F.col("_span"), F.lit(True))
        ends = F.coalesce(F.lead("_o.us").over(same) - F.col("_o.us") > F.col("_span"), F.lit(True))
        # rows that don't count share the partition of rows without a value, which hold nothing
        here = here.withColumns({"value": F.when(held, F.col("value")), "_held": held})
        here = here.withColumns({"_comes": F.when(F.col("_held") & fresh, 1).otherwise(0), "_goes": F.when(F.col("_held") & ends, -1).otherwise(0)})
        comes, goes = F.col("_comes"), F.col("_goes")
    row = F.struct(F.col("_o.us").alias("t"), F.lit(1).alias("turn"), F.when(F.col("counts"), 1).otherwise(0).alias("n"), comes.alias("m"))
    expiry = F.struct((F.col("_o.us") + F.col("_span") + 1).alias("t"), F.lit(0).alias("turn"), F.lit(-1).alias("n"), goes.alias("m"))
    both = here.withColumn("_e", F.explode(F.when(F.col("_own"), F.array(row)).otherwise(F.array(row, expiry))))
    so_far = Window.partitionBy("rule", "key", "_b").orderBy("_e.t", "_e.turn", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_n": F.sum("_e.n").over(so_far), "_m": F.sum("_e.m").over(so_far)})
    return both.where("_own").select("rule", "key", "counts", "_span", "_o", "_n", "_m")


def streaks(rows: DataFrame) -> DataFrame:
    """Adds _streak, how many successes (rows that don't count) of the rule and key came before the row. Each bucket counts its
    own; a row a bucket carries the sums of those before it, so no key is one sort."""
    ended = F.when(F.col("counts"), 0).otherwise(1)
    rows = rows.withColumn("_b", F.floor(F.col("_o.us") / STREAK_BUCKET).cast("long"))
    before = Window.partitionBy("rule", "key", "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    carried = Window.partitionBy("rule", "key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rule", "key", "_b").agg(F.sum(ended).alias("_sum")).withColumn("_carry", F.coalesce(F.sum("_sum").over(carried), F.lit(0)))
    inside = rows.withColumn("_in", F.coalesce(F.sum(ended).over(before), F.lit(0)))
    return inside.join(sums.drop("_sum"), ["rule", "key", "_b"]).withColumn("_streak", F.col("_in") + F.col("_carry")).drop("_b", "_in", "_carry")
