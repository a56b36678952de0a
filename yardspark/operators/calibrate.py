"""Ground-point calibration: method errors, grid search, a linear model, and matching of crops to spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.operators.boxes import METHODS, ground_point, size
from yardspark.operators.gps import nearest_in_plane

#: Features of the linear model, in the order of its weights.
FEATURES = ["bias", "center_x", "right_x", "left_x", "width", "height", "area"]


def _error(point: tuple[Column, Column]) -> Column:
    return F.sqrt(F.pow(point[0] - F.col("ex"), 2) + F.pow(point[1] - F.col("ey"), 2))


def method_errors(boxes: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Per method mean, greatest, least and population deviation of the pixel error; boxes carry the expected (ex, ey)."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), _error(ground_point(m)).alias("e")) for m in methods or METHODS])
    rows = boxes.select(F.explode(each).alias("m")).select("m.*")
    return rows.groupBy("method").agg(F.avg("e").alias("mean"), F.max("e").alias("max"), F.min("e").alias("min"), F.stddev_pop("e").alias("std"))


def grid_search_offsets(boxes: DataFrame, xs: range = range(-30, 31, 10), ys: range = range(30, 71, 10), top: int = 10) -> DataFrame:
    """The best combinations of offsets in hundredths and reference edge by mean error. The grid is fixed by its parameters."""
    cells = F.array(*[F.struct(F.lit(x).alias("x_pct"), F.lit(y).alias("y_pct"), F.lit(r).alias("reference")) for x in xs for y in ys for r in ("left_edge", "right_edge", "center")])
    w, h = size()
    base = F.when(F.col("reference") == "left_edge", F.col("x1")).when(F.col("reference") == "right_edge", F.col("x2")).otherwise((F.col("x1") + F.col("x2")) / 2)
    rows = boxes.select("x1", "y1", "x2", "y2", "ex", "ey", F.explode(cells).alias("c")).select("*", "c.*")
    rows = rows.withColumn("e", _error((base + w * (F.col("x_pct") / 100), F.col("y1") + h * (F.col("y_pct") / 100))))
    errors = rows.groupBy("x_pct", "y_pct", "reference").agg(F.avg("e").alias("mean"), F.max("e").alias("max"), F.min("e").alias("min"))
    return errors.orderBy("mean", "x_pct", "y_pct", "reference").limit(top)


def features() -> list[Column]:
    w, h = size()
    return [F.lit(1.0), (F.col("x1") + F.col("x2")) / 2, F.col("x2").cast("double"), F.col("x1").cast("double"), w.cast("double"), h.cast("double"), (w * h).cast("double")]


def fit_linear_model(boxes: DataFrame) -> dict[str, list[float]]:
    """Least-squares weights of x and y on FEATURES. The features depend on each other, so predictions are what compares.

    The 7 x 7 normal equations are summed by Spark; only they reach the driver, where they are solved with the features
    scaled to one size, as an area is far greater than a bias.
    """
    import numpy as np

    f, n = features(), len(FEATURES)
    sums = {f"a{i}_{j}": F.sum(f[i] * f[j]) for i in range(n) for j in range(i, n)} | {f"{t}{i}": F.sum(f[i] * F.col(t)) for t in ("ex", "ey") for i in range(n)}
    row = boxes.agg(*[c.alias(k) for k, c in sums.items()]).first()
    a = np.array([[float(row[f"a{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] for i in range(n)])
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a * np.outer(scale, scale), rcond=1e-13, hermitian=True)
    return {t: (scale * (inverse @ (scale * np.array([float(row[f"{t}{i}"] or 0) for i in range(n)])))).tolist() for t in ("ex", "ey")}


def _weighted(weights: list[float]) -> Column:
    return sum((F.lit(float(w)) * c for w, c in zip(weights, features(), strict=True)), F.lit(0.0))


def linear_model_error(boxes: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """(error_x, error_y, total_error): mean absolute errors of the model's points, and the root of their squares' sum."""
    x, y = (F.avg(F.abs(_weighted(weights[t]) - F.col(t))) for t in ("ex", "ey"))
    return boxes.agg(x.alias("error_x"), y.alias("error_y")).withColumn("total_error", F.sqrt(F.col("error_x") * F.col("error_x") + F.col("error_y") * F.col("error_y")))


def apply_linear_model(boxes: DataFrame, weights: dict[str, list[float]] | None, fallback: str = "adaptive_percentage") -> DataFrame:
    """boxes with the predicted (gx, gy), by the fallback method where there is no model."""
    x, y = (_weighted(weights["ex"]), _weighted(weights["ey"])) if weights else ground_point(fallback)
    return boxes.withColumns({"gx": x, "gy": y})


def lookup_or_bottom_center(boxes: DataFrame, coords: DataFrame) -> DataFrame:
    """boxes (spot) with the known pixel of their spot (spot, px, py), else the bottom centre."""
    x, y = ground_point("bottom_center")
    return boxes.join(coords, "spot", "left").withColumns({"gx": F.coalesce("px", x), "gy": F.coalesce("py", y)}).drop("px", "py")


def match_calibration(crops: DataFrame, expected: DataFrame, manual: DataFrame, limit: float = 500.0) -> DataFrame:
    """Each crop's spot: by the manual map of tracks, else the nearest expected pixel under the limit.

    expected: spot, ex, ey; of equal distances the spot that comes first counts.
    """
    gx, gy = ground_point("bottom_center")
    rows = crops.join(manual.select("track_id", F.col("spot").alias("_m")), "track_id", "left").withColumns({"_gx": gx.cast("double"), "_gy": gy.cast("double")})
    best = nearest_in_plane(rows.select(F.col("_gx").alias("x"), F.col("_gy").alias("y")), expected.select(F.col("spot").alias("ord"), F.col("spot").alias("name"), F.col("ex").alias("sx"), F.col("ey").alias("sy")))
    best = best.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("name").alias("_near"), F.col("d").alias("_d"))
    rows = rows.join(best, (F.col("_gx") == F.col("_x")) & (F.col("_gy") == F.col("_y")), "left")
    near = F.when(F.col("_d") < limit, F.col("_near"))
    return rows.withColumns({"spot": F.coalesce("_m", near), "how": F.when(F.col("_m").isNotNull(), "manual").when(near.isNotNull(), "nearest")}).filter("spot is not null").select(*crops.columns, "spot", "how")
