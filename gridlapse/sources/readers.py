"""Readers for trace tables and exported files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlapse.functions.buckets import parse_utc
from gridlapse.functions.expressions import whole_number
from gridlapse.operators.rollup import select_power
from gridlapse.schema import (
    COLLECTION_EVENTS_SCHEMA,
    CSV_HEADER_PREFIX,
    INSTANCE_EVENTS_SCHEMA,
    INSTANCE_USAGE_SCHEMA,
    MACHINE_MAP_SCHEMA,
    POWER_TRACE_SCHEMA,
    contract_type,
)
from gridlapse.sources.versions import current


_UNFIT = "_unfit_line"


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name[name.rfind(".") :] if "." in name else ""


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix. Give a schema for large CSV input: inferring reads it twice."""
    suffix = _suffix(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    raise ValueError(f"Cannot read {suffix!r} files, only .parquet and .csv")


def _is_header(prefix: str) -> Column:
    """A line that starts with the prefix, or names its columns in another order."""
    fields = F.transform(F.split("value", ","), F.trim)
    named = F.lit(True)
    for name in prefix.split(","):
        if name.strip():
            named = named & F.array_contains(fields, name.strip())
    return F.col("value").startswith(prefix) | named


def _lines(spark: SparkSession, path: str, header_prefix: str) -> tuple[DataFrame, list[str]] | None:
    """Every filled line with its file, its file's header and whether it stands before it; and the different headers.

    A file without a header gets the only one there is. A line's place is that of its split in the file, then its place in the split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"),
    )
    found = lines.where(_is_header(header_prefix))
    first = found.groupBy(F.col("file").alias("of_file")).agg(F.min(F.struct("at", F.trim("value").alias("text"))).alias("head"))
    headers = sorted(r[0] for r in first.select("head.text").distinct().collect())
    if not headers:
        return None
    missing = F.raise_error(F.concat(F.lit("No header in "), F.col("file"), F.lit(", and files differ in theirs")))
    own = F.coalesce("head.text", F.lit(headers[0]) if len(headers) == 1 else missing.cast("string"))
    placed = lines.join(first, F.col("file") == F.col("of_file"), "left")
    return placed.where((F.trim("value") != "") & ~_is_header(header_prefix)).select(
        "value", "file", own.alias("header"), (F.col("at") < F.col("head.at")).alias("before")
    ), headers


def _parsed(lines: DataFrame, header: str) -> tuple[DataFrame, list[str]]:
    """Lines of the files with one header as text columns; ``_UNFIT`` is the line if it has not the header's number of fields."""
    names = [name.strip() for name in header.split(",")]
    text_schema = ", ".join(f"`{name}` string" for name in names) + f", {_UNFIT} string"
    row = F.from_csv("value", text_schema, {"columnNameOfCorruptRecord": _UNFIT})
    return lines.where(F.col("header") == header).select(row.alias("_row"), "file", "before").select("_row.*", "file", "before"), names


def _typed(name: str) -> Column:
    kind = contract_type(name)
    if isinstance(kind, T.TimestampType):
        return parse_utc(F.col(name))
    if isinstance(kind, T.LongType):
        return whole_number(F.trim(name))
    return F.col(name).try_cast(kind)


def _is_preamble(first: str) -> Column:
    """A line before its file's header, or in a file without one a line that isn't a row, nor begins like one."""
    unfit = F.col(_UNFIT).isNotNull()
    return F.coalesce("before", unfit & _typed(first).isNull())


def _present(value: Column, name: str) -> Column:
    damaged = F.raise_error(F.concat(F.lit(f"A data line's {name} does not parse: "), F.coalesce(F.col(name), F.lit("null"))))
    return F.when(value.isNotNull(), value).otherwise(damaged)


def read_csv_with_preamble(
    spark: SparkSession, path: str, header_prefix: str = CSV_HEADER_PREFIX
) -> DataFrame:
    """CSV whose header may come after some lines of other text, in each file after its own and with its own columns.

    What stands before a file's header is preamble. Files without one, as a split export has, are read with the only header
    there is; there, a line is preamble if it has another number of fields and doesn't begin with the
    first column's value. Any other line that is cut short, or whose window start or index does not
    parse, fails while running, so no row is lost unseen. A column that some files lack is NULL
    there. Without any header it is a plain CSV.
    """
    found = _lines(spark, path, header_prefix)
    if found is None:
        return read_frame(spark, path)
    lines, headers = found
    keys = ("window_start", "window_index")
    tables = []
    for header in headers:
        rows, names = _parsed(lines, header)
        cut = F.raise_error(F.concat(F.lit("A line has not the header's fields: "), F.col(_UNFIT), F.lit(" in "), F.col("file")))
        whole = rows.where(~_is_preamble(names[0])).withColumn(
            names[0], F.when(F.col(_UNFIT).isNull(), F.col(names[0])).otherwise(cut.cast("string"))
        )
        cells = [_present(_typed(name), name) if name in keys or name == names[0] else _typed(name) for name in names]
        tables.append(whole.select(*[c.alias(name) for c, name in zip(cells, names)]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dropped_preamble_lines(
    spark: SparkSession, path: str, header_prefix: str = CSV_HEADER_PREFIX
) -> int:
    """How many lines besides headers :func:`read_csv_with_preamble` leaves out."""
    found = _lines(spark, path, header_prefix)
    if found is None:
        return 0
    parsed = [_parsed(found[0], header) for header in found[1]]
    return sum(rows.where(_is_preamble(names[0])).count() for rows, names in parsed)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Exported task trace or flex windows: Parquet, or CSV with or without a preamble."""
    if _suffix(path) == ".csv":
        return read_csv_with_preamble(spark, path)
    return read_frame(spark, path)


def read_power_trace(
    spark: SparkSession,
    path: str,
    cells: Sequence[str] | None = None,
    pdus: Sequence[str] | None = None,
) -> DataFrame:
    """Power readings stored as Parquet partitioned by cell and pdu; the lists prune directories."""
    return select_power(spark.read.schema(POWER_TRACE_SCHEMA).parquet(path), cells, pdus)


def _read_cell_table(
    spark: SparkSession, path: str, schema: T.StructType, cells: Sequence[str] | None
) -> DataFrame:
    if cells is None:
        return spark.read.schema(schema).parquet(path)
    partitioned = T.StructType([*schema.fields, T.StructField("cell", T.StringType())])
    return spark.read.schema(partitioned).parquet(path).where(F.col("cell").isin(list(cells)))


def read_usage(spark: SparkSession, path: str, cells: Sequence[str] | None = None) -> DataFrame:
    """Instance usage. With ``cells`` the table is one dataset partitioned by cell."""
    return _read_cell_table(spark, path, INSTANCE_USAGE_SCHEMA, cells)


def read_collection_events(
    spark: SparkSession, path: str, cells: Sequence[str] | None = None
) -> DataFrame:
    return _read_cell_table(spark, path, COLLECTION_EVENTS_SCHEMA, cells)


def read_instance_events(
    spark: SparkSession, path: str, cells: Sequence[str] | None = None
) -> DataFrame:
    return _read_cell_table(spark, path, INSTANCE_EVENTS_SCHEMA, cells)


def read_machine_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MACHINE_MAP_SCHEMA).parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset version written by :func:`gridlapse.sources.writers.write_dataset`."""
    return spark.read.parquet(f"{current(spark, path)}/data")


def read_benchmark(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A benchmark written by :func:`gridlapse.sources.writers.write_benchmark`, one row per run.

    Without ``schema`` a column that is NULL in all runs is left out.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{current(spark, path)}/benchmark_json")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{current(spark, path)}/metadata")
