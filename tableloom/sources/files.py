"""CSV, Parquet and Avro files, wherever the Hadoop file system reaches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.schema import export_schema
from tableloom.operators.columns import column_sizes, rename_all
from tableloom.operators.ranking import row_slice
from tableloom.sources.first_lines import PLACES, first_lines, with_places

CORRUPT = "_corrupt_record"
# What happens to a row that does not fit the schema.
BAD_ROWS = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    header: bool = True,
    delimiter: str = ",",
    bad_rows: str = "keep",
    line_delimiter: str | None = None,
    places: bool = False,
) -> DataFrame:
    """CSV with a schema, or with types inferred by an extra pass over the data.

    A given schema always wins over inference. ``bad_rows='keep'`` nulls the cells that do
    not fit; add a ``_corrupt_record`` string to the schema to keep the raw line too. ``places``
    adds the columns that ``first_lines`` needs.
    """
    if bad_rows not in BAD_ROWS:
        raise ValueError(f"bad_rows is one of {sorted(BAD_ROWS)}")
    reader = spark.read.option("header", header).option("sep", delimiter)
    reader = reader.option("mode", BAD_ROWS[bad_rows])
    if line_delimiter:
        reader = reader.option("lineSep", line_delimiter)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    df = reader.csv(path)
    if places:
        df = with_places(df)
    if bad_rows != "keep" or CORRUPT in df.columns:
        # Cells nobody selects are not parsed and could hide a bad row; this selects them all.
        df = df.select(F.inline(F.array(F.struct("*"))))
    return df


@dataclass(frozen=True)
class CsvJob:
    """Options of a CSV read: project, rename, filter, slice, cap.

    ``filter_expression`` uses the new names. Offsets need ``order_by``, as files have no
    row order of their own; 0 and 0 mean all rows. ``max_read_lines`` keeps the first rows in
    that order, or without one as the files have them; -1 means all. Rows that do not
    fit the schema fail the job, given or inferred, unless ``ignore_and_continue``.
    ``calculate_column_size`` and ``populate_meta_schema`` ask ``run_csv_job`` for both.
    """

    path: str
    schema: T.StructType | str | None = None
    delimiter: str = ","
    has_header: bool = True
    ignore_and_continue: bool = False
    columns_to_select: Sequence[str] = field(default_factory=tuple)
    headers: Sequence[str] = field(default_factory=tuple)
    filter_expression: str = ""
    start_offset: int = 0
    end_offset: int = 0
    order_by: Sequence[str] = field(default_factory=tuple)
    max_read_lines: int = -1
    line_delimiter: str | None = None
    calculate_column_size: bool = False
    populate_meta_schema: bool = False

    @classmethod
    def from_options(
        cls, options: Mapping[str, Any], schema: T.StructType | str | None = None, order_by: Sequence[str] = ()
    ) -> "CsvJob":
        """From the options of a job file. A schema is only used with userProvidedSchema."""
        if str(options["path"]).lower().endswith(".zip"):
            raise ValueError("a file inside a zip archive cannot be read in parallel: unpack it first")
        return cls(
            path=options["path"],
            schema=schema if options.get("userProvidedSchema") else None,
            delimiter=options.get("delimiter") or ",",
            has_header=options.get("hasHeader", True),
            ignore_and_continue=options.get("ignoreAndContinue", False),
            columns_to_select=options.get("columnsToSelect") or (),
            headers=options.get("headers") or (),
            filter_expression=options.get("filterExpression") or "",
            start_offset=options.get("startOffset", 0),
            end_offset=options.get("endOffset", 0),
            order_by=order_by,
            max_read_lines=options.get("maxReadLines", -1),
            line_delimiter=options.get("lineDelimiter") or None,
            calculate_column_size=bool(options.get("calculateColumnSize", False)),
            populate_meta_schema=bool(options.get("populateMetaSchema", False)),
        )


def read_csv_job(spark: SparkSession, job: CsvJob) -> DataFrame:
    bad_rows = "drop" if job.ignore_and_continue else "fail"
    by_place = job.max_read_lines > 0 and not job.order_by
    df = read_csv(spark, job.path, job.schema, job.has_header, job.delimiter, bad_rows, job.line_delimiter, by_place)
    places = PLACES if by_place else ()
    if job.columns_to_select:
        df = df.select(*[f"`{c}`" for c in job.columns_to_select], *places)
    if job.headers:
        df = rename_all(df, [*job.headers, *places])
    if job.filter_expression.strip():
        df = df.where(F.expr(job.filter_expression))
    if job.start_offset or job.end_offset:
        if not job.order_by:
            raise ValueError("offsets need order_by: a file has no stable row order")
        df = row_slice(df, list(job.order_by), job.start_offset, job.end_offset)
    if job.max_read_lines == 0:
        return df.limit(0)
    if by_place:
        df = first_lines(df, job.max_read_lines)
    elif job.max_read_lines > 0:
        df = row_slice(df, list(job.order_by), 0, job.max_read_lines)
    return df


@dataclass(frozen=True)
class CsvResult:
    """Rows of a CSV job, how many lines it skipped, and what else it asked for."""

    rows: DataFrame
    skipped: int
    column_sizes: DataFrame | None
    meta_schema: dict[str, dict[str, Any]] | None


def run_csv_job(spark: SparkSession, job: CsvJob) -> CsvResult:
    """Read, count the skipped lines in a pass of its own, and measure what the job asks for."""
    rows = read_csv_job(spark, job)
    return CsvResult(
        rows,
        skipped_lines(spark, job) if job.ignore_and_continue else 0,
        column_sizes(rows) if job.calculate_column_size else None,
        export_schema(rows) if job.populate_meta_schema else None,
    )


def skipped_lines(spark: SparkSession, job: CsvJob) -> int:
    """How many lines do not fit the job's schema, or the inferred one."""
    schema = job.schema
    if schema is None:
        schema = read_csv(spark, job.path, None, job.has_header, job.delimiter, line_delimiter=job.line_delimiter).schema
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = read_csv(spark, job.path, marked, job.has_header, job.delimiter, line_delimiter=job.line_delimiter)
    return lines.where(F.col(CORRUPT).isNotNull()).count()


def split_text(df: DataFrame, column: str, schema: str, delimiter: str = ",", keep: Sequence[str] = ()) -> DataFrame:
    """Columns of a text of delimited cells, quotes respected; a cell that does not fit is NULL."""
    parsed = F.from_csv(F.col(f"`{column}`"), schema, {"sep": delimiter, "mode": "PERMISSIVE"})
    return df.select(*keep, parsed.alias("__cells")).select(*keep, "__cells.*")


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


KEYED_ROWS = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))]
)


def read_keyed_rows(spark: SparkSession, path: str, format: str = "avro") -> DataFrame:
    """(key, content) rows. Avro needs the spark-avro package on the class path."""
    return spark.read.format(format).schema(KEYED_ROWS).load(path)
