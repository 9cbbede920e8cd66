"""Reading tables, naming views, and moving schema-sized results."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.config import DEFAULT, LensConfig
from tablelens.functions.stats import finite
from tablelens.functions.text import ident
from tablelens.sources.csv_records import OpenQuotes, record_lines

RAW_VIEW = "raw_data"
CLEAN_VIEW = "cleaned_data"
DELIMITERS = (",", ";", "\t", "|")


class TableLoadError(Exception):
    """The input could not be read as a table."""


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row; quotes within quoted fields are doubled. Types are inferred unless a schema is given (which
    saves one scan). Without a delimiter, the one that occurs most in the header is taken.

    Line breaks within quotes are kept; such files are split like any others: their records are found in parallel and written once, as
    lines, to the shared folder. A file that ends within quotes is refused. Repeated header names come back as name, name.1, name.2, so
    that screening can recognise them.
    """
    try:
        sep = delimiter or _sniffed(spark.read.text(path))
        reader = (spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("timestampType", "TIMESTAMP_NTZ"))
        broken = record_lines(spark, path, sep) if len(sep) == 1 else None
        if broken:
            df, header = _from_records(spark, reader, *broken, sep, schema)
        else:
            header = _header_names(reader, path)
            reader = reader.option("header", True)
            df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except OpenQuotes as e:
        raise TableLoadError(f"Could not load CSV: {e} ends inside quotes") from e
    except (PySparkException, OSError) as e:
        raise TableLoadError(f"Could not load CSV: {e}") from e
    if not df.columns:
        raise TableLoadError(f"Could not load CSV: no columns in {path}")
    if len(header) == len(df.columns) and len(set(header)) < len(header):
        df = df.toDF(*number_repeats(header))
    return df


def _from_records(spark, reader, rows: DataFrame, mark: str, sep: str, schema) -> tuple[DataFrame, list[str]]:
    """The table of records that are lines with ``mark`` for their line breaks, and its header."""
    first = rows.where("first").select("line").first()
    header = next(csv.reader([first["line"].replace(mark, "\n")], delimiter=sep)) if first else []
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows.where("NOT first").select("line").write.text(folder)
    if schema is None and rows.where("NOT first").isEmpty():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(folder)
    if schema is None and len(header) == len(df.columns):
        df = df.toDF(*number_repeats(header))
    return df.select(*[F.translate(F.col(ident(f.name)), mark, "\n").alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(ident(f.name)) for f in df.schema]), header


def _sniffed(lines: DataFrame) -> str:
    """The delimiter of the header line, outside quotes; the comma if there is none."""
    first = lines.limit(1).collect()
    bare = re.sub(r'"(?:[^"]|"")*"', "", first[0][0] or "") if first else ""
    return max(DELIMITERS, key=bare.count)


def _header_names(reader, path: str) -> list[str]:
    first = reader.option("header", False).option("inferSchema", False).csv(path).limit(1).collect()
    names = [v or "" for v in first[0]] if first else []
    if not names or any(re.search(r"[\x00�]", n) for n in names):
        raise TableLoadError(f"Could not load CSV: no readable header in {path}")
    return names


def number_repeats(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        out.append(n if k == 0 else f"{n}.{k}")
        seen[n] = k + 1
    return out


def read_table(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A table from a CSV file, a Parquet dataset, a catalog name or an existing DataFrame; NaN becomes null."""
    if isinstance(source, DataFrame):
        df = source
    elif source.endswith((".csv", ".tsv", ".csv.gz")):
        df = read_csv(spark, source, **options)
    else:
        try:
            df = spark.read.parquet(source) if "/" in source else spark.table(source)
        except PySparkException as e:
            raise TableLoadError(f"Could not load table: {e}") from e
    return without_nan(df)


def without_nan(df: DataFrame) -> DataFrame:
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema):
        return df
    return df.selectExpr(*[f"{finite(ident(f.name), f.dataType)} AS {ident(f.name)}" for f in df.schema])


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "ord int, column string, type string")


def pin_small(df: DataFrame) -> DataFrame:
    """Run a schema-sized query (rows per column or chart, never data rows) once and keep its rows in the plan."""
    return df.sparkSession.createDataFrame(df.toArrow())


def broadcast_if_small(df: DataFrame, counted_rows: int, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Broadcast a keyed side only when its counted size is within the bound; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if counted_rows <= cfg.broadcast_rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for intermediate data; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablelens-")
        spark.conf.set("spark.checkpoint.dir", folder)  # one folder for the whole session
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
