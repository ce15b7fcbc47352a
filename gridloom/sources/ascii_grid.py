"""ASCII grids: six header lines in any order, then rows of cells from the top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")


def header(spark: SparkSession, path: str) -> dict[str, float]:
    """The header of one grid; ValueError if a key is missing or there twice.  Centres are taken as corners."""
    found: dict[str, float] = {}
    for (line,) in spark.read.text(path).limit(6).collect():
        parts = line.split()
        key = parts[0].lower() if parts else ""
        if len(parts) != 2 or key not in HEADER:
            raise ValueError(f"not a header line: {line[:80]!r}")
        key = key.replace("center", "corner")
        if key in found:
            raise ValueError(f"twice in the header: {key}")
        found[key] = float(parts[1])
    if len(found) != 6:
        raise ValueError("the header is short")
    return found


def read(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """The header and the cells (r, c, v); a line is a row of the grid, cells split and exploded on the executors.

    A row's number is its place in its split of a file plus the rows of the splits before: a table of one row a split.
    """
    head = header(spark, path)
    line = F.trim(F.col("value"))
    key = F.lower(F.regexp_extract(line, r"^(\S*)", 1))
    rows = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s")).where((line != "") & ~key.isin(*HEADER))
    rows = rows.withColumn("i", F.monotonically_increasing_id())
    before = Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("f", "s").agg(F.min("i").alias("base"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rows.join(splits, ["f", "s"]).select((F.col("i") - F.col("base") + F.col("before")).alias("r"), "line")
    cells = numbered.select("r", F.posexplode(F.split("line", r"\s+")).alias("c", "v"))
    return head, cells.select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def number(v) -> str:
    """Up to eight decimals, trailing zeros cut."""
    text = f"{v:.8f}".rstrip("0").rstrip(".")
    return "0" if text in ("", "-0") else text


def lines(cells: DataFrame, width: int, height: int, minx: float, miny: float, res: float, nodata: float, value: str = "v", row: str = "out_y", col: str = "out_x", centred: bool = False, digits: int = 8) -> DataFrame:
    """(at, line): header lines, of the lower left pixel's corner or centre, then one line per row; a cell's text has trailing zeros cut."""
    spark = cells.sparkSession
    top = [("ncols", width), ("nrows", height), *[(f"{k}ll{'center' if centred else 'corner'}", f"{v + res / 2 * centred:1.8f}") for k, v in (("x", minx), ("y", miny))], ("cellsize", f"{res:1.8f}"), ("NODATA_value", number(nodata))]
    head = spark.createDataFrame([(i - 6, f"{k:<14}{v}") for i, (k, v) in enumerate(top)], "at long, line string")
    shown = F.regexp_replace(F.format_string(f"%.{digits}f", F.col(value).cast("double")), r"\.0*$|(\.\d*?)0+$", "$1")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(col).alias("x"), shown.alias("t"))))
    body = cells.groupBy(F.col(row).cast("long").alias("at")).agg(F.array_join(F.transform(ordered, lambda s: s.t), " ").alias("line"))
    return head.unionByName(body)


def write(cells: DataFrame, path: str, width: int, height: int, minx: float, miny: float, res: float, nodata: float, value: str = "v", centred: bool = False, digits: int = 8) -> None:
    """A folder of text parts in row order, with CRLF line ends; one part per range of rows."""
    out = lines(cells, width, height, minx, miny, res, nodata, value, centred=centred, digits=digits).orderBy("at").select("line")
    out.write.option("lineSep", "\r\n").text(path)
