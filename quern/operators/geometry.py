"""Screen geometry: boxes, point and field lookups, regions, main group, first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area() -> Column:
    return (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))


def on_screen(width: int = 1080, height: int = 2400) -> Column:
    """Visible, not degenerate, and meeting the screen; a null box meets it."""
    box = (F.col("x_min") < F.col("x_max")) & (F.col("x_min") < width) & (F.col("x_max") > 0) & (F.col("y_min") < F.col("y_max")) & (F.col("y_min") < height) & (F.col("y_max") > 0)
    return F.col("visible") & F.coalesce(box, F.lit(True))


def element_at_point(points: DataFrame, elements: DataFrame) -> DataFrame:
    """(screen, x, y, idx): the element at each point: interactive first, then least area, then index.

    An equi-join on the screen with the box test after it; one aggregate keeps the best, so no
    screen's candidates are gathered.
    """
    boxes = elements.filter(on_screen()).filter("x_min is not null")
    inside = (F.col("x") >= F.col("x_min")) & (F.col("x") <= F.col("x_max")) & (F.col("y") >= F.col("y_min")) & (F.col("y") <= F.col("y_max"))
    order = F.struct(~(F.coalesce("clickable", F.lit(False)) | F.coalesce("editable", F.lit(False))), area(), F.col("idx"))
    found = points.join(boxes, "screen").filter(inside).groupBy("screen", "x", "y").agg(F.min_by("idx", order).alias("idx"))
    return points.join(found, ["screen", "x", "y"], "left")


def best_field(elements: DataFrame) -> DataFrame:
    """(screen, idx): the best text field: focused, enabled, least area (no box last), index."""
    order = F.struct(~F.coalesce("focused", F.lit(False)), ~F.coalesce("enabled", F.lit(False)), F.coalesce(area().cast("double"), F.lit(float("inf"))), F.col("idx"))
    return elements.filter(on_screen() & F.col("editable")).groupBy("screen").agg(F.min_by("idx", order).alias("idx"))


def _axis(center: Column, span: Column, extent: Column, low: str, mid: str, high: str) -> Column:
    return F.when(span / extent >= 0.75, "full").when(center / extent < 1 / 3, low).when(center / extent > 2 / 3, high).otherwise(mid)


def regions(elements: DataFrame) -> DataFrame:
    """Adds region, one of nine fields, a full row or column, or the full screen; null without an extent."""
    w = Window.partitionBy("screen")
    return with_region(elements.withColumns({"_w": F.max("x_max").over(w), "_h": F.max("y_max").over(w)}))


def with_region(rows: DataFrame) -> DataFrame:
    """Adds region of boxes on a screen of the extent _w, _h, and drops these."""
    d = lambda c: F.col(c).cast("double")
    rows = rows.withColumns({
        "_across": _axis((d("x_min") + d("x_max")) / 2, d("x_max") - d("x_min"), F.when(F.col("_w") > 0, d("_w")), "left", "center", "right"),
        "_down": _axis((d("y_min") + d("y_max")) / 2, d("y_max") - d("y_min"), F.when(F.col("_h") > 0, d("_h")), "top", "middle", "bottom"),
    })
    across, down = F.col("_across"), F.col("_down")
    named = (
        F.when((across == "full") & (down == "full"), "full-screen")
        .when(across == "full", F.concat(down, F.lit("-full")))
        .when(down == "full", F.concat(F.lit("full-"), across))
        .otherwise(F.concat(down, F.lit("-"), across))
    )
    ok = (F.col("_w") > 0) & (F.col("_h") > 0) & (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))
    return rows.withColumn("region", F.when(ok, named)).drop("_w", "_h", "_across", "_down")


#: Packages of the system and of keyboards.
SYSTEM_PACKAGES = ("android", "com.android.packageinstaller", "com.android.permissioncontroller", "com.android.systemui", "com.google.android.permissioncontroller")
KEYBOARD_PACKAGES = ("com.google.android.inputmethod.latin",)


def package_kind(c: Column) -> Column:
    return F.when(c == "", None).when(c.isin(*KEYBOARD_PACKAGES) | c.contains("inputmethod"), "keyboard").when(c.isin(*SYSTEM_PACKAGES), "system")


def main_package(elements: DataFrame) -> DataFrame:
    """(screen, package, n): the most frequent package of its own; ties go to the lower name."""
    own = elements.filter((F.col("package") != "") & package_kind(F.col("package")).isNull())
    counts = own.groupBy("screen", "package").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("package", "n"), F.struct(-F.col("n"), F.col("package"))).alias("b")
    return counts.groupBy("screen").agg(best).select("screen", "b.package", "b.n")


def first_seen(rows: DataFrame, group: list[str], signature: list[str], order: str, forced: Column | None = None) -> DataFrame:
    """The first row of each signature in each group; forced rows stay anyway."""
    first = F.row_number().over(Window.partitionBy(*group, *signature).orderBy(order)) == 1
    return rows.withColumn("_first", first).filter(F.col("_first") if forced is None else F.col("_first") | forced).drop("_first")
