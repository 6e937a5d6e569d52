"""Domain roles played by the bundled tables: grids, class rasters, gauges, budget terms.

Every role value is a fraction with a power-of-two denominator computed from integer sums, so sums
and means of it are exact in any order and do not depend on partitioning.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as O
from ..operators import polygons as P
from ..operators import zonal as Z
from ..operators.materialise import materialise


class Tables:
    """Tables of one folder, and the role views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _cells(self, unit: str, side: int) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                F.trunc("l_shipdate", unit).alias("time"),
                (F.col("l_partkey") % side).cast("int").alias("iy"),
                (F.expr(f"l_partkey div {side}") % side).cast("int").alias("ix"),
                F.round(F.col("l_discount") * 100).cast("bigint").alias("pct"),
                "l_linenumber",
            )
            .groupBy("time", "iy", "ix")
            .agg(
                F.sum("pct").alias("s"),
                F.count(F.lit(1)).alias("n"),
                F.sum("l_linenumber").alias("codes"),
            )
            .select(
                "time", "iy", "ix",
                (F.lit(-20.25) + 0.25 * F.col("iy")).alias("lat"),
                (F.lit(21.5) + 0.25 * F.col("ix")).alias("lon"),
                (F.expr("(s * 1024) div (10 * n)") / 1024.0).alias("value"),
                (F.col("codes") % 5).cast("int").alias("cls"),
                F.year("time").alias("year"),
                F.month("time").alias("month"),
            )
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Monthly wet fraction on 12 x 12 cells, with natural gaps."""
        return self._cells("MM", 12).drop("cls", "year", "month")

    @cached_property
    def classes(self) -> DataFrame:
        """Monthly class codes 0..4 on the same cells."""
        return self._cells("MM", 12).drop("value", "lat", "lon")

    @cached_property
    def cube(self) -> DataFrame:
        """Quarterly wet fraction on 6 x 6 cells, nearly gap-free: input of the stencils."""
        return self._cells("QUARTER", 6).drop("cls", "year", "month")

    @cached_property
    def kept_grid(self) -> DataFrame:
        """The grid written once, for queries that read it several times (axes, masks, cells)."""
        return materialise(self.grid)

    @cached_property
    def kept_mask(self) -> DataFrame:
        """Region cells with their areas, written once: geometry only, without times."""
        rows, cols = Z.axes(self.kept_grid)
        mask = P.region_mask(P.row_spans(P.edges(self.basins), rows), cols)
        return materialise(O.with_cell_areas(mask, {"area_km2": "cosine", "band_km2": "band"}, axes_of=self.kept_grid))

    @cached_property
    def kept_cube(self) -> DataFrame:
        return materialise(self.cube)

    @cached_property
    def daily(self) -> DataFrame:
        """Raw gauge readings, several per station and day."""
        return self.table("lineitem").select(
            (F.col("l_suppkey") % 10).cast("int").alias("station"),
            F.to_date("l_shipdate").alias("d"),
            F.col("l_quantity").alias("q"),
        )

    @cached_property
    def station(self) -> DataFrame:
        """Monthly mean per gauge."""
        return (
            self.daily.groupBy("station", F.trunc("d", "MM").alias("month"))
            .agg(F.sum(F.col("q").cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n"))
            .select("station", "month", (F.expr("(s * 1024) div n") / 1024.0).alias("q"))
        )

    def _orders(self, keys: list, per: int) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        return (
            self.table("orders")
            .groupBy(F.trunc("o_orderdate", "MM").alias("month"), *keys)
            .agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
            .withColumn("mm", F.expr(f"(s * 1024) div ({per} * n)") / 1024.0)
            .drop("s", "n")
        )

    @cached_property
    def et(self) -> DataFrame:
        """Monthly evaporation of five products, mm."""
        return self._orders([F.col("o_orderpriority").alias("dataset")], 400000)

    @cached_property
    def rain(self) -> DataFrame:
        """Monthly rain, mm."""
        return self._orders([], 300000)

    @cached_property
    def storage(self) -> DataFrame:
        """Monthly storage anomaly, cm."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return (
            self.table("lineitem")
            .groupBy(F.trunc("l_shipdate", "MM").alias("month"))
            .agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
            .select("month", (F.expr("(s * 1024) div (100000 * n)") / 1024.0 - 50.0).alias("cm"))
        )

    @cached_property
    def flow(self) -> DataFrame:
        """Monthly mean inflow, m3/s."""
        return (
            self.table("lineitem")
            .groupBy(F.trunc("l_shipdate", "MM").alias("month"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n"))
            .select("month", (F.expr("(s * 10240) div n") / 1024.0).alias("q"))
        )

    def _rings(self, table: str, key: str) -> DataFrame:
        corner = F.posexplode(
            F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in RING_SHAPE])
        ).alias("k", "c")
        size = 0.25 + 0.125 * (F.col("key") % 4)
        return (
            self.table(table)
            .select(F.col(key).cast("bigint").alias("key"))
            .select(
                "key",
                F.explode(F.when(F.col("key") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ring"),
            )
            .select("key", "ring", corner)
            .select(
                F.col("key").alias("region"),
                F.lit(0).alias("part"),
                "ring",
                F.when(F.col("key") % 2 == 0, F.col("k")).otherwise(5 - F.col("k")).alias("seq"),
                (21.5625 + 0.25 * (F.col("key") % 11) + F.col("c.dx") * size * F.when(F.col("ring") == 0, 1.0).otherwise(0.25)).alias("lon"),
                (-20.21875 + 0.25 * (F.expr("key div 11") % 11) + F.col("c.dy") * size * F.when(F.col("ring") == 0, 1.0).otherwise(0.25)).alias("lat"),
            )
        )

    @cached_property
    def basins(self) -> DataFrame:
        """One concave polygon per nation, some with a hole, in either turning direction."""
        return self._rings("nation", "n_nationkey")

    @cached_property
    def lakes(self) -> DataFrame:
        """The same per supplier."""
        return self._rings("supplier", "s_suppkey")

    @cached_property
    def channels(self) -> DataFrame:
        """One five-point zigzag line per supplier."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("line_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"),
        ).select(
            "line_id", "seq",
            (21.59375 + 0.25 * (F.col("line_id") % 9) + 0.0625 * F.col("seq")).alias("lon"),
            (-20.15625 + 0.25 * (F.expr("line_id div 9") % 9) + 0.03125 * (F.col("seq") % 2) + 0.015625 * F.col("seq")).alias("lat"),
        )


# Corner offsets of the polygon shape, counter-clockwise, concave at the third corner.
RING_SHAPE = [(1.0, 0.0), (0.5, 0.875), (-0.25, 0.375), (-1.0, 0.5), (-0.75, -0.75), (0.375, -0.9375)]


def _rings_sql(table: str, key: str) -> str:
    corners = ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(RING_SHAPE))
    return f"""
SELECT key AS region, 0 AS part, ring, CASE WHEN key % 2 = 0 THEN k ELSE 5 - k END AS seq,
       21.5625e0 + 0.25e0 * (key % 11) + dx * (0.25e0 + 0.125e0 * (key % 4)) * scale AS lon,
       -20.21875e0 + 0.25e0 * ((key // 11) % 11) + dy * (0.25e0 + 0.125e0 * (key % 4)) * scale AS lat
FROM (SELECT CAST({key} AS BIGINT) AS key FROM {table}),
     (VALUES (0, 1e0), (1, 0.25e0)) AS rg(ring, scale), (VALUES {corners}) AS c(k, dx, dy)
WHERE ring = 0 OR key % 3 = 0"""


def _edges_sql(role: str) -> str:
    return f"""
SELECT region, part, ring, lon AS x1, lat AS y1,
       coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2,
       coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
FROM {role} WINDOW w AS (PARTITION BY region, part, ring ORDER BY seq)"""


def _cells_sql(unit: str, side: int) -> str:
    return f"""
SELECT time, iy, ix, -20.25e0 + 0.25e0 * iy AS lat, 21.5e0 + 0.25e0 * ix AS lon,
       ((s * 1024) // (10 * n)) / 1024e0 AS value,
       CAST(codes % 5 AS INTEGER) AS cls,
       CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month
FROM (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS time,
             CAST(l_partkey % {side} AS INTEGER) AS iy,
             CAST((l_partkey // {side}) % {side} AS INTEGER) AS ix,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS s,
             count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS codes
      FROM lineitem GROUP BY ALL)"""


def _orders_sql(key: str, per: int) -> str:
    return f"""
SELECT month{', dataset' if key else ''}, ((s * 1024) // ({per} * n)) / 1024e0 AS mm
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month{key},
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM orders GROUP BY ALL)"""


ROLE_SQL = {
    "r_grid": _cells_sql("month", 12),
    "r_cube": _cells_sql("quarter", 6),
    "r_daily": """
SELECT CAST(l_suppkey % 10 AS INTEGER) AS station, CAST(l_shipdate AS DATE) AS d, l_quantity AS q
FROM lineitem""",
    "r_station": """
SELECT station, month, ((s * 1024) // n) / 1024e0 AS q
FROM (SELECT station, CAST(date_trunc('month', d) AS DATE) AS month,
             CAST(sum(CAST(q AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM r_daily GROUP BY ALL)""",
    "r_et": _orders_sql(", o_orderpriority AS dataset", 400000),
    "r_rain": _orders_sql("", 300000),
    "r_storage": """
SELECT month, ((s * 1024) // (100000 * n)) / 1024e0 - 50e0 AS cm
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM lineitem GROUP BY ALL)""",
    "r_basins": _rings_sql("nation", "n_nationkey"),
    "r_lakes": _rings_sql("supplier", "s_suppkey"),
    "r_basin_edges": _edges_sql("r_basins"),
    "r_lake_edges": _edges_sql("r_lakes"),
    "r_mask": """
SELECT e.region, iy, ix, any_value(c.lat) AS lat, any_value(c.lon) AS lon
FROM (SELECT DISTINCT iy, ix, lat, lon FROM r_grid) c
JOIN r_basin_edges e ON (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon
GROUP BY e.region, iy, ix HAVING count(*) % 2 = 1""",
    "r_channels": """
SELECT s_suppkey AS line_id, seq, 21.59375e0 + 0.25e0 * (s_suppkey % 9) + 0.0625e0 * seq AS lon,
       -20.15625e0 + 0.25e0 * ((s_suppkey // 9) % 9) + 0.03125e0 * (seq % 2) + 0.015625e0 * seq AS lat
FROM supplier, (SELECT unnest(range(5)) AS seq)""",
    "r_flow": """
SELECT month, ((s * 10240) // n) / 1024e0 AS q
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM lineitem GROUP BY ALL)""",
}
