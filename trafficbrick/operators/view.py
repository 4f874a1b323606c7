"""Dashboard view of stored bricks (H1-H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BRICK_DIM

# Fixed values of the view: default intensity scale, category labels and colours.
DEFAULT_SCALE = 1_000_000
CATEGORY_COLORS = {"1": "#3a9244", "5": "#f9cc10", "10": "#b2282f"}
NO_HITTER = "No Top Hitters"


def brick_to_cells(bricks: DataFrame, dim: int = BRICK_DIM) -> DataFrame:
    """Documents -> one row per cell: ``ts, traffic, x (source bin), y (dest bin), hitters`` (H1)."""
    z = bricks.select("ts", F.posexplode(F.arrays_zip("data", "hitters")).alias("pos", "c"))
    return z.select("ts", F.col("c.data").alias("traffic"),
                    (F.col("pos") / F.lit(dim)).cast("int").alias("x"),
                    (F.col("pos") % dim).cast("int").alias("y"),
                    F.col("c.hitters").alias("hitters"))


def with_category(cells: DataFrame, scale: float = DEFAULT_SCALE) -> DataFrame:
    """Intensity class (H2): '1' below scale/2, '5' below scale, '10' otherwise; plus its colour."""
    t = F.col("traffic")
    cat = F.when(t < F.lit(scale) / 2, "1").when(t < F.lit(scale), "5").otherwise("10")
    colors = F.create_map(*[x for k, v in CATEGORY_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return cells.withColumn("category", cat).withColumn("color", colors[F.col("category")])


def with_hitter_label(cells: DataFrame) -> DataFrame:
    """Empty hitter -> 'No Top Hitters' (H3)."""
    return cells.withColumn("hitters", F.when(F.col("hitters") == "", F.lit(NO_HITTER)).otherwise(F.col("hitters")))


def cells_payload(cells: DataFrame) -> DataFrame:
    """Five parallel arrays as one JSON document per brick (H4).

    A document gathers its own dim*dim cells -- bounded by the brick size.
    """
    g = cells.groupBy("ts").agg(F.sort_array(F.collect_list(
        F.struct("x", "y", "traffic", "hitters", "category"))).alias("a"))
    return g.select("ts", F.to_json(F.struct(
        F.transform("a", lambda r: r["x"]).alias("x"),
        F.transform("a", lambda r: r["y"]).alias("y"),
        F.transform("a", lambda r: r["traffic"]).alias("traffic"),
        F.transform("a", lambda r: r["hitters"]).alias("hitters"),
        F.transform("a", lambda r: r["category"]).alias("category"))).alias("payload"))


def dashboard(bricks: DataFrame, scale: float = DEFAULT_SCALE) -> DataFrame:
    """Newest brick -> category/labels -> JSON payload (the dashboard read path)."""
    from .store import latest_brick
    return cells_payload(with_hitter_label(with_category(brick_to_cells(latest_brick(bricks)), scale)))
