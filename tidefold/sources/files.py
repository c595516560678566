"""Reading and writing series: format by suffix, sniffed text, column prefixes, and two index formats."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.errors import ParamError

TEXT_SUFFIXES = (".csv", ".txt", ".dat", ".tsv", "")
DELIMITERS = ",;\t| "


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of the first of a folder's files."""
    return bytes(spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, size).alias("head")).first()["head"])


def sniff(spark: SparkSession, path: str, lines: int = 10, encoding: str = "utf-8") -> tuple[str, bool]:
    """(delimiter, whether the first line is a header) of a text file, from its first lines; comma and header if unclear."""
    if encoding == "utf-8":
        sample = "\n".join(r["value"] for r in spark.read.text(path).limit(lines).collect())
    else:
        sample = "\n".join(_head(spark, path, 50_000).decode(encoding, "ignore").splitlines()[:lines])
    try:
        sniffer = csv.Sniffer()
        return sniffer.sniff(sample, DELIMITERS).delimiter, sniffer.has_header(sample)
    except csv.Error:
        return ",", True


def encoding_of(spark: SparkSession, path: str, size: int = 50_000) -> str:
    """utf-8, utf-16 or latin-1, by the mark at the beginning of a file or by trial on its first bytes."""
    head = _head(spark, path, size)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for cut in range(4 if len(head) == size else 1):  # a character may be cut at the end
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "latin-1"


def read_table(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """A table from Parquet, JSON, ORC or delimited text, by suffix. Text columns are inferred unless a schema is given, and so is the encoding of a single text file."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix in (".json", ".jsonl"):
        reader = spark.read.option("multiLine", suffix == ".json")
        return (reader.schema(schema) if schema else reader).json(path)
    if suffix not in TEXT_SUFFIXES:
        raise ParamError(f"files with suffix {suffix!r} can't be read")
    encoding = encoding or encoding_of(spark, path)
    delimiter, header = sniff(spark, path, encoding=encoding)
    reader = spark.read.option("sep", delimiter).option("header", header).option("encoding", {"latin-1": "ISO-8859-1"}.get(encoding, encoding)).option("multiLine", encoding == "utf-16")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


@dataclass(frozen=True)
class Names:
    """Columns by prefix: X (states), Y (observations), True (truths), and others."""

    x: list[str]
    y: list[str]
    true: list[str]
    others: list[str]
    x_before_y: bool


def by_prefix(columns: list[str]) -> Names:
    groups: dict[str, list[str]] = {"X": [], "Y": [], "True": [], "": []}
    for c in columns:
        groups[next((p for p in ("True", "X", "Y") if c.startswith(p)), "")].append(c)
    x, y = groups["X"], groups["Y"]
    ordered = not x or not y or max(columns.index(c) for c in x) < min(columns.index(c) for c in y)
    return Names(x, y, groups["True"], groups[""], ordered)


def series_of(df: DataFrame, dim_x: int, dim_y: int, series: Column | str | None = None, order: list[str] | None = None) -> DataFrame:
    """The wide form (X0.., Y0..) as input of filter_series; a file without X columns gives no truth.

    Without order columns rows come in the file's order, which holds for a single file.
    """
    names = by_prefix(df.columns)
    if len(names.y) != dim_y or len(names.x) not in (0, dim_x):
        raise ParamError(f"expected {dim_x} X and {dim_y} Y columns, found {len(names.x)} and {len(names.y)}")
    key = F.lit(0).cast("long") if series is None else F.col(series) if isinstance(series, str) else series
    at = [F.col(c) for c in order] if order else [F.monotonically_increasing_id()]
    truth = F.array(*[F.col(c).cast("double") for c in names.x]) if names.x else F.lit(None).cast("array<double>")
    return df.select(key.alias("series"), *[c.alias(f"ord_{i}") for i, c in enumerate(at)], truth.alias("x_true"), F.array(*[F.col(c).cast("double") for c in names.y]).alias("y"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text with a header; doubles with 15 decimals."""
    df.select(*[F.format_string("%.15f", c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]).write.mode(mode).option("header", True).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    try:
        read_table(spark, source).write.mode("overwrite").parquet(target)
    except PySparkException as e:
        raise ParamError(f"{source} can't be converted: {e}") from e


def save_steps(steps: DataFrame, path: str, model: str, method: str) -> None:
    """Filter output as Parquet, in a folder for each model and method."""
    steps.write.mode("overwrite").parquet(f"{path}/model={model}/method={method}")


def load_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def default_name(model: str, linear: bool) -> str:
    return f"data{'Linear' if linear else 'NonLinear'}_{model}.csv"


def parse_index(lines: DataFrame) -> DataFrame:
    """(year, month, value) from text lines of white-space separated fields: year, month and, ninth, the value; below -90 is missing."""
    f = F.split(F.trim(F.col("value")), r"\s+")
    rows = lines.select(F.try_to_number(F.get(f, F.lit(0)), F.lit("9999")).cast("int").alias("year"), F.try_to_number(F.get(f, F.lit(1)), F.lit("99")).cast("int").alias("month"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 8) AS double)").alias("v"), F.size(f).alias("n"))
    return rows.where("n >= 9 and year is not null and month between 1 and 12 and v is not null and v >= -90").select("year", "month", F.col("v").alias("value"))


#: A number of a month table; numbers may touch at a sign.
_NUMBER = r"([-+]?\d+\.?\d*)"


def _months(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, month, value) from (by, place, value): a year and up to twelve numbers a line; below -900 is missing, of a month that comes again the last counts."""
    rows = rows.select(*by, "place", F.regexp_extract_all("value", F.lit(_NUMBER), F.lit(1)).alias("n")).where(F.get("n", F.lit(0)).rlike(r"^[-+]?\d+$"))
    out = rows.select(*by, "place", F.expr("try_cast(n[0] AS int)").alias("year"), F.posexplode(F.slice("n", 2, 12)).alias("m", "v"))
    out = out.select(*by, "place", "year", (F.col("m") + 1).alias("month"), F.col("v").cast("double").alias("value")).where("value >= -900")
    return out.groupBy(*by, "year", "month").agg(F.max_by("value", "place").alias("value"))


def parse_monthly_block(lines: DataFrame, place: str = "place") -> DataFrame:
    """(year, month, value) from lines (place, value): only the first section that begins with YEAR.

    A line holds a year and up to twelve numbers, fewer in a year that isn't over; numbers may touch at signs; below -900
    is missing. The two first headers' places are all that is gathered.
    """
    heads = lines.where(F.trim("value").startswith("YEAR")).select(place).orderBy(place).limit(2)
    bounds = heads.agg(F.min(place).alias("_low"), F.max(place).alias("_high"), F.count("*").alias("_heads"))
    rows = lines.join(F.broadcast(bounds), how="cross").where((F.col(place) > F.col("_low")) & ((F.col("_heads") < 2) | (F.col(place) < F.col("_high"))))
    return _months(rows.select(F.col(place).alias("place"), "value"), [])


def read_monthly_block(spark: SparkSession, path: str) -> DataFrame:
    """parse_monthly_block of every file at path: file, year, month, value. Each file is one row and one task's, by Spark's own reader."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    # The lines after the first header, up to the second.
    whole = whole.withColumn("l", F.expr("filter(transform(l, (x, i) -> struct(i AS place, trim(x) AS value)), x -> x.value <> '')"))
    whole = whole.withColumn("h", F.expr("transform(filter(l, x -> startswith(x.value, 'YEAR')), x -> x.place)")).where(F.size("h") > 0)
    rows = whole.select("file", F.explode(F.expr("filter(l, x -> x.place > h[0] AND (size(h) < 2 OR x.place < h[1]))")).alias("x")).select("file", "x.place", "x.value")
    return _months(rows, ["file"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """parse_index of every file at path: year, month, value."""
    return parse_index(spark.read.text(path))


def read_bars(spark: SparkSession, path: str, needed: tuple[str, ...] = ("High", "Low", "Close")) -> DataFrame:
    """Daily bars of delimited text: day and the columns of prices, names in lower case.

    Names in any letter case; of a name made of several ('High', 'X') the first part counts; further lines of a header,
    and all else whose first field is no date, are left out. A needed column that is missing is an error.
    """
    raw = spark.read.option("header", True).csv(path)
    plain = [(c.split(",")[0].strip("('\" ") if "," in c else c.strip()).lower() for c in raw.columns]
    if missing := [c for c in needed if c.lower() not in plain[1:]]:
        raise ParamError(f"there is no column {missing[0]!r}; there are {raw.columns}")
    day = F.try_to_timestamp(F.col(f"`{raw.columns[0]}`").substr(1, 10), F.lit("yyyy-MM-dd")).cast("date")
    prices = [(c, name) for c, name in zip(raw.columns[1:], plain[1:], strict=True) if name in ("open", "high", "low", "close")]
    return raw.select(day.alias("day"), *[F.expr(f"try_cast(`{c}` AS double)").alias(name) for c, name in prices]).where("day is not null")


def read_numeric(spark: SparkSession, path: str, fallback: str = "data/datafile") -> DataFrame:
    """Columns c0, c1, .. of numbers in the file's order (_place), below one line of names; a missing path is looked for by its name in fallback."""
    tried = [path, f"{fallback}/{PurePosixPath(path).name}"]
    for at in tried:
        try:
            raw = spark.read.option("header", True).csv(at)
            break
        except PySparkException:
            continue
    else:
        raise ParamError(f"there is no file at {' or '.join(tried)}")
    columns = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(raw.columns)]
    return raw.select(F.monotonically_increasing_id().alias("_place"), *columns)


def write_split(train: DataFrame, test: DataFrame, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Writes train and test as text below path, with a manifest (part, rows, columns), which it returns.

    columns: names in the files, by default X0 and Y0 for x and y.
    """
    columns = columns or {"x": "X0", "y": "Y0"}
    spark = train.sparkSession
    for name, part in (("train", train), ("test", test)):
        write_csv(part.select(*[F.col(c).cast("double").alias(n) for c, n in columns.items()]), f"{path}/{name}.csv")
    rows = [(name, spark.read.option("header", True).csv(f"{path}/{name}.csv").count(), list(columns.values())) for name in ("train", "test")]
    spark.createDataFrame(rows, "part string, rows bigint, columns array<string>").coalesce(1).write.json(f"{path}/manifest.json")
    return spark.read.schema("part string, rows bigint, columns array<string>").json(f"{path}/manifest.json")


def text_table(df: DataFrame, latex: bool = False, digits: int = 4) -> str:
    """A small table (scores, say) as aligned text or as rows of a LaTeX tabular; null and NaN as a dash. All its rows go to the driver."""

    def shown(v) -> str:
        if v is None or v != v:
            return "--"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    rows = [df.columns, *[[shown(v) for v in r] for r in df.collect()]]
    if latex:
        safe = lambda t: "".join("\\" + c if c in "&%$#_{}" else c for c in t)
        body = [" & ".join(safe(c) for c in r) + r" \\" for r in rows]
        return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(df.columns) - 1)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))).rstrip() for r in rows)
