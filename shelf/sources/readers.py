"""Reading what the ingest landed and what later stages wrote."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions.text import strip
from shelf.schemas import LEDGER, PAGE, RAW, STAGING
from shelf.scratch import materialize

DATE_IN_PATH = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def responses(spark: SparkSession, path: str, multiline: bool = False,
              schema: T.StructType = PAGE) -> DataFrame:
    """Landed API pages; one JSON document per line, or per file with ``multiline``."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def author_list(spark: SparkSession, path: str) -> DataFrame:
    """(processing_order, author_name): stripped lines numbered from 0, blank ones kept.

    Lines count in the order of files by name and of lines within a file. The sort is by
    ranges and the numbering adds up partition sizes, so no task sees the whole list.
    """
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    ordered = lines.orderBy("file_path", "file_block_start", "line")
    # the number of the range and, in the lower 33 bits, of the line in it
    placed = materialize(ordered.select("value", F.monotonically_increasing_id().alias("at")), "lines")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND(F.lit(2**33 - 1))})
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("begin"))
    return placed.join(begins, "part").select(
        (F.col("begin") + F.col("inside")).alias("processing_order"), strip("value").alias("author_name"))


def raw_volumes(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """The raw table by path. The declared schema keeps date and hour as text."""
    raw = spark.read.schema(RAW).parquet(path)
    if start_date is not None:
        raw = raw.where(F.col("date") >= start_date)
    if end_date is not None:
        raw = raw.where(F.col("date") <= end_date)
    return raw


def create_database(spark: SparkSession, name: str, comment: str = "Catalogue data",
                    location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} COMMENT '{comment}'{place}")


def create_raw_table(spark: SparkSession, table: str, location: str) -> DataFrame:
    """Declare the raw table over ``location`` and register the partitions there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet"
        f" PARTITIONED BY (`date`, `hour`) LOCATION '{location}'"
    )
    repair_partitions(spark, table)
    return spark.table(table)


def repair_partitions(spark: SparkSession, table: str) -> None:
    """Register partitions that were written by path."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def staged_files(spark: SparkSession, path: str, start_date: str, end_date: str,
                 schema: T.StructType = STAGING) -> DataFrame:
    """Staged rows whose processing_date lies in the range, compared as text.

    Only the directories in range are read.
    """
    return spark.read.schema(schema).parquet(path).where(
        F.col("processing_date").between(start_date, end_date)
    )


def staged(spark: SparkSession, path: str, schema: T.StructType = STAGING) -> DataFrame | None:
    """The staged table by path, or None where nothing was staged yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def dated_files(spark: SparkSession, root: str, names: str = "*.parquet", date: str = DATE_IN_PATH) -> DataFrame:
    """(path, bytes, modified, date) of every file below ``root``, from the listing alone.

    The date is the last one anywhere in the path, so ``processing_date=2024-01-05/x``, ``2024/2024-01-05/x`` and
    ``export-2024-01-05.parquet`` are all found; NULL where there is none.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
        .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    )
    return found.withColumn("date", _last_date(F.col("path"), date))


def _last_date(path: Column, date: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(path, F.lit(f"({date})"), F.lit(1)), F.lit(-1))


def files_in_range(spark: SparkSession, root: str, start_date: str, end_date: str, **how: str) -> DataFrame:
    """Rows of all files below ``root`` whose path has a date in the range, whatever the layout, with ``file_date``.

    Files without rows count as files. None in the range is an error. The paths pass the driver, which lists the files of every
    scan anyway.
    """
    listed = dated_files(spark, root, **how).where(F.col("date").between(start_date, end_date))
    by_date: dict[str, list[str]] = {}
    for row in listed.select("path", "date").collect():
        by_date.setdefault(row["date"], []).append(row["path"])
    rows = _united(spark, [path for paths in by_date.values() for path in paths])
    return rows.withColumn("file_date", _last_date(F.col("__file"), how.get("date", DATE_IN_PATH))).drop("__file")


def _schema_groups(spark: SparkSession, paths: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Files in groups whose footers Spark can merge, in few reads where types change from time to time only."""
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*paths).schema, paths)]
    except (AnalysisException, Py4JJavaError) as problem:
        if "CANNOT_MERGE" not in str(problem) or len(paths) == 1:
            raise
    half = len(paths) // 2
    groups: list[tuple[T.StructType, list[str]]] = []
    for schema, files in _schema_groups(spark, paths[:half]) + _schema_groups(spark, paths[half:]):
        same = next((g for g in groups if g[0] == schema), None)
        if same:
            same[1].extend(files)
        else:
            groups.append((schema, list(files)))
    return groups


#: each holds every value of those before it (a double as near as it can)
_NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def widest(one: T.DataType, other: T.DataType) -> T.DataType:
    """The type that takes values of both: the wider number, else text; inside of arrays and structs likewise."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    if one in _NUMBERS and other in _NUMBERS:
        wider = max(one, other, key=_NUMBERS.index)
        return T.DoubleType() if wider == T.FloatType() else wider
    if {type(one), type(other)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        return T.ArrayType(widest(one.elementType, other.elementType))
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        return widest_schema([one, other])
    return T.StringType()


def widest_schema(schemas: list[T.StructType]) -> T.StructType:
    """All fields of all schemas in the order of their first appearance, each with the widest of its types."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            types[field.name] = widest(types[field.name], field.dataType) if field.name in types else field.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def _fitted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type in a wider one; a struct gets the fields it lacks as NULL."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        fields = [
            (_fitted(column[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(column, lambda x: _fitted(x, have.elementType, want.elementType))
    return column.cast(want)


def many_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet files as one frame, columns united by name; none is an error.

    A column of several types takes the widest: int, long, double, and text where nothing else holds all of them.
    """
    return _united(spark, paths).drop("__file")


def _united(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        raise ValueError("no files found in the date range")
    groups = _schema_groups(spark, sorted(paths))
    want = widest_schema([schema for schema, _ in groups])

    def fitted(schema: T.StructType, files: list[str]) -> DataFrame:
        have = {f.name: f.dataType for f in schema}
        columns = [
            _fitted(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in want
        ]
        named = [c.alias(f.name) for c, f in zip(columns, want, strict=True)]
        return spark.read.schema(schema).parquet(*files).select(*named, F.col("_metadata.file_path").alias("__file"))

    return reduce(DataFrame.union, [fitted(*g) for g in groups])


def append_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns united by name, missing ones NULL."""
    if not frames:
        raise ValueError("nothing to append")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ledger_table(spark: SparkSession, table: str = "processed_authors") -> DataFrame:
    return spark.table(table).select(*LEDGER.fieldNames())


def result_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported query result with a header line."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def vector_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The vector table, or None where there is none yet."""
    return spark.table(table) if spark.catalog.tableExists(table) else None


def file_counts(df: DataFrame) -> DataFrame:
    """(file, rows): how many rows come from which file. ``df`` must not have been shuffled."""
    return df.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
