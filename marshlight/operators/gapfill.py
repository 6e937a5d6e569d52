"""Gap filling of monthly gauge series by a quadratic spline over row positions.

The knots are the midpoints between known readings, the first and the last one left out, so the equation of a
reading has three unknown weights, its own and those beside it. The tridiagonal system is eliminated in one scan
forward and solved in one scan back. Both are cut into chunks: a chunk's step is a linear map of the state that
enters it, the maps of a key are chained (one small row per chunk), and then each chunk runs from its own
entry state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import gap_lengths

#: Readings of one chunk.
CHUNK = 1024

_NUMBERS = "array<double>"


def _weights(x: Column, t: Column) -> list[Column]:
    """Values at x of the three quadratic B-splines that are not 0 between the middle two of four knots."""
    t0, t1, t2, t3 = (F.get(t, k) for k in range(4))
    left, right = (t2 - t0) * (t2 - t1), (t3 - t1) * (t2 - t1)
    return [(t2 - x) * (t2 - x) / left, (x - t0) * (t2 - x) / left + (t3 - x) * (x - t1) / right, (x - t1) * (x - t1) / right]


def _step(state: Column, e: Column, k: int) -> list[Column]:
    """Elimination of one equation on the state (p, q, r), where p / q is what is left beside the diagonal and r / q the right side."""
    p, q, r = (F.get(state, 3 * k + m) for m in range(3))
    return [e["c"] * q, e["b"] * q - e["a"] * p, e["y"] * q - e["a"] * r]


def _scaled(values: list[Column]) -> Column:
    """Only ratios count; dividing by the largest keeps long products in range."""
    most = F.greatest(*[F.abs(v) for v in values])
    return F.transform(F.array(*values), lambda v: v / most)


def spline_weights(equations: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """``(keys, i, w)`` solving a_i w_(i-1) + b_i w_i + c_i w_(i+1) = y_i for ``(keys, i, a, b, c, y)``, i from 0 without gaps."""
    row = F.struct("i", "a", "b", "c", "y")
    cut = equations.groupBy(*keys, F.floor(F.col("i") / chunk).alias("_c")).agg(F.sort_array(F.collect_list(row)).alias("_e"))
    # What a chunk makes of each of the three unit states.
    unit = F.array(*[F.lit(float(m == k)) for k in range(3) for m in range(3)])
    maps = cut.withColumn("_map", F.aggregate("_e", unit, lambda s, e: _scaled([v for k in range(3) for v in _step(s, e, k)])))
    # Before the first equation: nothing beside the diagonal, right side 0.
    start = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    through = lambda s, m: _scaled([sum((F.get(s, k) * F.get(m, 3 * k + j) for k in range(3)), F.lit(0.0)) for j in range(3)])
    chain = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_map"))).alias("_all"))
    entered = F.aggregate("_all", F.array(start), lambda done, m: F.array_append(done, through(F.element_at(done, -1), m["_map"])))
    entries = chain.select(*keys, F.posexplode(F.slice(entered, F.lit(1), F.size("_all"))).alias("_k", "_s"), "_all")
    entries = entries.select(*keys, F.get("_all", F.col("_k"))["_c"].alias("_c"), "_s")

    def eliminate(done: Column, e: Column) -> Column:
        p, q, r = _step(F.element_at(done, -1), e, 0)
        return F.array_append(done, F.array(p / q, F.lit(1.0), r / q))

    down = cut.join(entries, [*keys, "_c"]).withColumn("_f", F.slice(F.aggregate("_e", F.array("_s"), eliminate), F.lit(2), F.size("_e")))
    # Back: w_i = r_i - p_i w_(i+1), for a chunk a line in the weight that follows it.
    line = F.aggregate(F.reverse("_f"), F.array(F.lit(0.0), F.lit(1.0)), lambda s, f: F.array(f[2] - f[0] * F.get(s, 0), -f[0] * F.get(s, 1)))
    down = down.withColumn("_line", line)
    chain = down.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_line")), asc=False).alias("_all"))
    followed = F.aggregate("_all", F.array(F.lit(0.0)), lambda done, m: F.array_append(done, m["_line"][0] + m["_line"][1] * F.element_at(done, -1)))
    entries = chain.select(*keys, F.posexplode(F.slice(followed, F.lit(1), F.size("_all"))).alias("_k", "_w"), "_all")
    entries = entries.select(*keys, F.get("_all", F.col("_k"))["_c"].alias("_c"), "_w")
    solve = F.aggregate(F.reverse("_f"), F.array("_w"), lambda w, f: F.concat(F.array(f[2] - f[0] * F.get(w, 0)), w))
    solved = down.join(entries, [*keys, "_c"]).withColumn("_ws", solve)
    return solved.select(*keys, F.posexplode(F.arrays_zip(F.transform("_e", lambda e: e["i"]).alias("i"), F.slice("_ws", F.lit(1), F.size("_e")).alias("w"))).alias("_k", "_p")).select(
        *keys, F.col("_p.i").alias("i"), F.col("_p.w").alias("w")
    )


def fill_gaps(spine: DataFrame, keys: list[str], value: str, max_gap: int = 2, month: str = "month", chunk: int = CHUNK) -> DataFrame:
    """Fill interior gaps of up to ``max_gap`` months; longer, leading and trailing ones stay, as do all of a key with fewer than three readings.

    Needs the full month spine, one row per month; positions are rows of it.
    """
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    marked = gap_lengths(spine.select(*keys, month, number.alias(value)), keys, value, month)
    order = Window.partitionBy(*keys).orderBy(month)
    known = F.col(value).isNotNull()
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({
        "_x": (F.row_number().over(order) - 1).cast("double"),
        "_i": F.count_if(known).over(up_to) - 1,
        "_n": F.count_if(known).over(Window.partitionBy(*keys)),
    })
    points = marked.where(known & (F.col("_n") >= 3)).select(*keys, F.col("_i").alias("i"), F.col("_n").alias("n"), F.col("_x").alias("x"), F.col(value).alias("y"))
    along = Window.partitionBy(*keys).orderBy("i")
    whole = Window.partitionBy(*keys)
    i, n, x = F.col("i"), F.col("n"), F.col("x")
    middle = lambda k: (F.lag("x", -k).over(along) + F.lag("x", -k - 1).over(along)) / 2
    # Knot i + k of the reading's own interval: the ends of the series threefold, midpoints between.
    knot = lambda k: F.when(i + k >= n, F.max("x").over(whole)).when(i + k <= 2, F.min("x").over(whole)).otherwise(middle(k - 2))
    points = points.withColumn("t", F.array(*[knot(k) for k in range(4)]))
    a, b, c = _weights(x, F.col("t"))
    end = (i == 0) | (i == n - 1)
    equations = points.select(*keys, "i", *[F.when(end, e).otherwise(v).alias(name) for name, e, v in (("a", 0.0, a), ("b", 1.0, b), ("c", 0.0, c))], "y")
    w = spline_weights(equations, keys, chunk)
    beside = [F.lag("w").over(along), F.col("w"), F.lead("w").over(along)]
    around = points.join(w, [*keys, "i"]).select(*keys, F.col("i").alias("_r"), "t", F.array(*beside).alias("_w"))
    # The reading in whose interval a gap lies; the first and last interval reach over two readings.
    next_x = F.min(F.when(known, F.col("_x"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    last_x = F.max(F.when(known, F.col("_x"))).over(up_to)
    nearer = F.when(F.col("_x") < (last_x + next_x) / 2, F.col("_i")).otherwise(F.col("_i") + 1)
    wanted = ~known & (F.col("gap_length") <= max_gap) & (F.col("_i") >= 0) & (F.col("_i") < F.col("_n") - 1) & (F.col("_n") >= 3)
    asked = marked.withColumn("_r", F.when(wanted, F.greatest(F.lit(1).cast("long"), F.least(nearer, F.col("_n") - 2))))
    met = asked.where("_r is not null").join(around, [*keys, "_r"])
    splines = _weights(F.col("_x"), F.col("t"))
    found = met.select(*keys, month, value, sum((s * F.get("_w", k) for k, s in enumerate(splines)), F.lit(0.0)).alias("filled"))
    rest = asked.where("_r is null").select(*keys, month, value, F.col(value).alias("filled"))
    return rest.unionByName(found)
