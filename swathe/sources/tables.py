"""CSV and JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAYPOINTS = "x double, y double, altitude double, speed double, line_id int"
TRACK = ("GridX", "GridY", "VEast", "VNorth", "Time")
STATS = (
    "Cover string, Return string, Mission string, Kernel string, ncells bigint, Q1 double, Q2 double, Q3 double, IQR double, Mean double, N bigint, CR double, CV double, Gini double, MoranI double"
)
COUNTS = "array<struct<key: struct<ret: string, cover: string, mission: string, kernel: string>, matrix: array<int>>>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema every column is a string; nothing is inferred."""
    if schema is None:
        return spark.read.option("header", True).csv(path)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_waypoints(spark: SparkSession, path: str, x: str = "x", y: str = "y", altitude: str = "altitude", speed: str = "speed", line_id: str = "line_id") -> DataFrame:
    """(seq, x, y, altitude, speed, line_id) in file order; a missing line_id is 0 (unassigned)."""
    raw = spark.read.option("header", True).csv(path)
    line = F.coalesce(F.col(line_id).cast("int"), F.lit(0)) if line_id in raw.columns else F.lit(0)
    # one file's rows are numbered in file order: its partitions are read in order
    rows = raw.select(F.monotonically_increasing_id().alias("_o"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (altitude, "altitude"), (speed, "speed"))], line.alias("line_id"))
    from pyspark.sql import Window

    return rows.withColumn("seq", F.row_number().over(Window.orderBy("_o")) - 1).drop("_o").select("seq", "x", "y", "altitude", "speed", "line_id")


def read_track(spark: SparkSession, path: str, mission: str) -> DataFrame:
    """(mission, seq, x, y, ve, vn, time) of a track file; the order is that of time and place."""
    from pyspark.sql import Window

    raw = spark.read.option("header", True).csv(path).select(*[F.col(c).cast("double") for c in TRACK], F.monotonically_increasing_id().alias("_o"))
    seq = F.row_number().over(Window.orderBy("_o")) - 1
    return raw.select(F.lit(mission).alias("mission"), seq.alias("seq"), F.col("GridX").alias("x"), F.col("GridY").alias("y"), F.col("VEast").alias("ve"), F.col("VNorth").alias("vn"), F.col("Time").alias("time"))


def read_percent_densities(spark: SparkSession, path: str) -> DataFrame:
    """A table of sections: a line of one field names the cover of the rows that follow, and each
    section repeats the header. The file is small and read whole."""
    lines = [r.value for r in spark.read.text(path, wholetext=False).collect()]
    rows, section, header = [], None, None
    for line in lines:
        cells = [c.strip() for c in line.split(",")]
        filled = [c for c in cells if c]
        if not filled:
            continue
        if len(filled) == 1:
            section = filled[0].strip("#: ")
        elif "Mission" in cells:
            header = cells
        elif header is not None:
            rows.append((section, {h: c for h, c in zip(header, cells, strict=False) if h}))
    return spark.createDataFrame(rows, "Section string, cells map<string, string>")


def read_counts_json(spark: SparkSession, path: str, nrows: int, ncols: int, *, layout: str) -> DataFrame:
    """Sparse (ret, cover, mission, kernel, row, col, n) of a file ``[{key, matrix}]``.

    ``layout`` says how a matrix is written, and has no default, as files differ: ``row_major``
    (row 0 first), ``col_major`` or ``col_major_flip`` (columns, each from the south)."""
    if layout not in ("row_major", "col_major", "col_major_flip"):
        raise ValueError(f"unknown layout: {layout}")
    rows = spark.read.option("multiLine", True).schema("key struct<ret: string, cover: string, mission: string, kernel: string>, matrix array<int>").json(path)
    wrong = rows.where(F.size("matrix") != nrows * ncols).select("key", F.size("matrix").alias("n")).first()
    if wrong is not None:
        raise ValueError(f"{wrong.key} has {wrong.n} cells, not {nrows} x {ncols}")
    cells = rows.select("key.*", F.posexplode("matrix").alias("pos", "n"))
    if layout == "row_major":
        row, col = F.floor(F.col("pos") / ncols), F.col("pos") % ncols
    else:
        down = F.col("pos") % nrows
        row, col = (down if layout == "col_major" else F.lit(nrows - 1) - down), F.floor(F.col("pos") / nrows)
    return cells.select("ret", "cover", "mission", "kernel", row.cast("int").alias("row"), col.cast("int").alias("col"), "n").where("n <> 0")


def write_counts_json(counts: DataFrame, path: str, nrows: int, ncols: int) -> None:
    """The same file, an array of one record per key, row major: readable by ``read_counts_json``."""
    key = F.struct(*[F.col(c) if c in counts.columns else F.lit("NA").alias(c) for c in ("ret", "cover", "mission", "kernel")])
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("row") * ncols + F.col("col")).alias("k"), F.col("n").cast("int").alias("n"))))
    rows = counts.where("n <> 0").groupBy(key.alias("key")).agg(cells.alias("m"))  # one grid per record
    full = F.transform(F.sequence(F.lit(0), F.lit(nrows * ncols - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0)))
    from pyspark.sql import Window

    # one line a record; the array's brackets and commas stand at the lines' ends
    w = Window.orderBy("key")
    lines = rows.select("key", F.to_json(F.struct("key", full.alias("matrix"))).alias("json"))
    begin = F.when(F.row_number().over(w) == 1, "[").otherwise("")
    end = F.when(F.lead("key").over(w).isNull(), "]").otherwise(",")
    lines = lines.select("key", F.concat(begin, "json", end).alias("value")).orderBy("key").coalesce(1)
    lines.select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), rename: dict[str, str] | None = None) -> None:
    """One CSV part with a header, in the given order."""
    out = df.orderBy(*order).coalesce(1) if order else df.coalesce(1)
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_waypoints(waypoints: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    write_csv(waypoints.select("x", "y", "altitude", "speed", "line_id", "seq").orderBy("seq").drop("seq"), path, rename=rename)


def write_xy_speed(waypoints: DataFrame, path: str) -> None:
    write_csv(waypoints.orderBy("seq").select(F.col("x").alias("GridX"), F.col("y").alias("GridY"), F.col("altitude").alias("Height"), F.col("speed").alias("Speed")), path)


def write_route(waypoints: DataFrame, path: str, lon0: float = -69.0) -> None:
    """lat, lon, AGL, speed in degrees, from transverse Mercator metres around ``lon0``."""
    from ..functions.expressions import transverse_mercator_inverse

    lat, lon = transverse_mercator_inverse(F.col("x"), F.col("y"), lon0)
    write_csv(waypoints.orderBy("seq").select(lat.alias("lat"), lon.alias("lon"), F.col("altitude").alias("AGL"), "speed"), path)


def finite_json(df: DataFrame) -> DataFrame:
    """Rows as JSON, with null for numbers that JSON cannot hold."""
    inf = F.lit(float("inf"))
    cols = [F.when(F.isnan(c) | (F.abs(c) == inf), F.lit(None)).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
