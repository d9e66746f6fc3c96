"""File sources and sinks for post tables (CSV as the reference reads it; parquet/JSON too)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Strings pandas' CSV reader treats as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# CSV writer options under which ``load_posts`` reads every text back as it was.
DOUBLED_QUOTES = {"escape": '"'}


def _null_na_tokens(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            c = F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_posts(spark: SparkSession, path: str | list[str], fmt: str = "csv",
               na_tokens: bool = True, **options) -> DataFrame:
    """Read a post table.

    CSV is read with a header, quoted multi-line fields and every column as a string (no schema
    inference pass over the data); pandas' default missing-value tokens become nulls. As fields may
    span lines, each CSV file is read by one task: many files of moderate size read well.
    """
    if fmt == "csv":
        reader = (spark.read.option("header", True).option("multiLine", True)
                  .option("escape", '"'))
        for k, v in options.items():
            reader = reader.option(k, v)
        df = reader.csv(path)
    elif fmt in ("parquet", "json", "orc"):
        reader = spark.read
        for k, v in options.items():
            reader = reader.option(k, v)
        df = getattr(reader, fmt)(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return _null_na_tokens(df) if na_tokens else df


@dataclass
class UnionResult:
    posts: DataFrame | None
    loaded: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def _unreadable(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Paths that cannot be listed, with the reason. Lists are halved only where one fails, so
    thousands of readable paths are a single check."""
    try:
        spark.read.text(paths)       # lists and checks the paths, reads nothing
    except AnalysisException as e:
        if len(paths) == 1:
            return {paths[0]: str(e).splitlines()[0]}
        half = len(paths) // 2
        return _unreadable(spark, paths[:half]) | _unreadable(spark, paths[half:])
    return {}


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files of ``paths``, grouped by their first line, in one job. A first line that ends
    inside a quoted name is not the whole header; such a file is a group of its own."""
    name = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))   # it is URI-encoded
    lines = spark.read.text(paths).select(
        F.url_decode(name).alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("at"),
                 F.monotonically_increasing_id().alias("row")).alias("place"))
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    open_quote = F.length(F.regexp_replace("header", '[^"]', "")) % 2 == 1
    groups = (first.groupBy("header", F.when(open_quote, F.col("file")).alias("alone"))
              .agg(F.sort_array(F.collect_list("file")).alias("files")))
    # one row per distinct header; the names of files, of which the caller gave the paths
    return [r["files"] for r in groups.orderBy(F.col("files")[0]).collect()]


def union_posts(spark: SparkSession, paths: list[str], fmt: str = "csv", **options) -> UnionResult:
    """Read several files and union them by column name (missing columns become null).

    CSV files with the same header line are read together, so any number of files is as many scans
    as there are headers; other formats and ``options`` that change how a header is read keep one
    scan a path. Unreadable files are skipped and reported in ``failed`` instead of failing the
    whole load; errors of the cluster itself are raised.
    """
    res = UnionResult(None)
    res.failed = _unreadable(spark, paths) if paths else {}
    res.loaded = [p for p in paths if p not in res.failed]
    if fmt == "csv" and not options and res.loaded:
        frames = [load_posts(spark, files) for files in _by_header(spark, res.loaded)]
    else:
        frames = []
        for p in list(res.loaded):
            try:
                frames.append(load_posts(spark, p, fmt=fmt, **options))
            except AnalysisException as e:
                res.failed[p] = str(e).splitlines()[0]
                res.loaded.remove(p)
    if frames:
        res.posts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return res


def export_posts(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 partition_by: list[str] | None = None, **options) -> None:
    """Write posts out: CSV with a header (the reference's export) or parquet.

    ``options`` go to the CSV writer. Spark's own escape sign is the default; with
    ``**DOUBLED_QUOTES`` the file is what ``load_posts`` and spreadsheet programs read.

    Writing is distributed (one file per partition); nothing passes through the driver.
    """
    if fmt == "csv":
        # CSV cannot hold arrays/structs; flatten them to JSON text.
        df = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                         if f.dataType.typeName() in ("array", "struct", "map")
                         else F.col(f"`{f.name}`") for f in df.schema.fields])
    elif fmt != "parquet":
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
        for k, v in options.items():
            w = w.option(k, v)
        w.csv(path)
    else:
        w.parquet(path)
