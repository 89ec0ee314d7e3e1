"""Readers and writers for the file formats of the input and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.columns import cents, money, year_month
from larder.functions.pin import scratch_path
from larder.schemas import FILE_SCHEMAS, MONEY_COLUMNS
from larder.sources.json_arrays import array_records


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Money columns as whole cents, delimited lists as arrays."""
    for name in MONEY_COLUMNS.get(table, ()):
        if name in df.columns:
            df = df.withColumn(f"{name}_cents", cents(name)).drop(name)
    if "categories_included" in df.columns:
        df = df.withColumn("categories_included", F.split("categories_included", ","))
    return df


def file_columns(df: DataFrame, table: str) -> DataFrame:
    """The inverse of ``canonical``, in the column order of the file."""
    for name in MONEY_COLUMNS.get(table, ()):
        if f"{name}_cents" in df.columns:
            df = df.withColumn(name, money(f"{name}_cents"))
    return df.select([f.name for f in FILE_SCHEMAS[table] if f.name in df.columns])


# Spellings of booleans in the input files, in any case.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
CORRUPT = "_corrupt_record"


def as_text(schema: T.StructType) -> T.StructType:
    """Booleans are read as text, since files spell them in several ways."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BooleanType) else f.dataType) for f in schema])


def with_booleans(df: DataFrame, schema: T.StructType, strict: bool) -> DataFrame:
    """Text to booleans; another spelling is an error, or NULL if not ``strict``."""
    for f in schema:
        if isinstance(f.dataType, T.BooleanType):
            text = F.lower(F.trim(f.name))
            other = F.raise_error(F.concat(F.lit(f"{f.name} is no boolean: "), f.name)) if strict else F.lit(None)
            value = F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).when(text.isNull() | (text == ""), F.lit(None))
            df = df.withColumn(f.name, value.otherwise(other.cast("boolean")))
    return df


def _reader(spark: SparkSession, schema: T.StructType, strict: bool):
    """Fails at a malformed value; if not ``strict``, the row is kept with what could be read, and its
    text in ``_corrupt_record``, which ``corrupt_rows`` counts."""
    read = as_text(schema)
    if strict:
        return spark.read.schema(read).option("mode", "FAILFAST")
    return spark.read.schema(read.add(CORRUPT, T.StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def corrupt_rows(df: DataFrame) -> DataFrame:
    """How many rows of a table read without ``strict`` had a malformed value."""
    # Spark refuses to read the column of corrupt rows alone, so the others are read with it.
    others = F.pmod(F.hash(*(c for c in df.columns if c != CORRUPT)), F.lit(1))
    bad = F.when(F.col(CORRUPT).isNotNull(), 1 + others).otherwise(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bad), F.lit(0)).alias("corrupt_rows"))


def read_csv(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """A CSV file with header row, by the table's stated schema; header names are checked.

    ``columns`` names the columns the file holds if it lacks some.
    """
    schema = FILE_SCHEMAS[table]
    if columns:
        schema = type(schema)([schema[c] for c in columns])
    reader = _reader(spark, schema, strict).option("header", True).option("enforceSchema", not strict)
    return canonical(with_booleans(reader.csv(path), schema, strict), table)


def read_json_records(spark: SparkSession, path: str, table: str, array_file: bool = True, strict: bool = True) -> DataFrame:
    """Records from JSON arrays, or from JSON Lines with ``array_file=False``; both are read in splits."""
    schema = FILE_SCHEMAS[table]
    if not array_file:
        return canonical(with_booleans(_reader(spark, schema, strict).json(path), schema, strict), table)
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    shape = as_text(schema) if strict else as_text(schema).add(CORRUPT, T.StringType())
    records = array_records(spark, path).select(F.from_json("value", shape, options).alias("record")).select("record.*")
    return canonical(with_booleans(records, schema, strict), table)


def is_path(name: str) -> bool:
    """A path has a scheme or starts with a slash or a dot; everything else is a catalog name."""
    return "://" in name or name.startswith(("/", ".", "file:"))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a parquet folder if the name is a path."""
    return spark.read.parquet(name) if is_path(name) else spark.table(name)


def parse_dates(df: DataFrame, *columns: str) -> DataFrame:
    """ISO text (with or without a time) as dates. The whole text is read: what is no date or time is
    NULL, and ``unparsed`` counts it."""
    return df.withColumns({c: iso_date(c) for c in columns})


def iso_date(column: str) -> Column:
    text = F.trim(column)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_timestamp(text).cast("date"))


def unparsed(df: DataFrame, *columns: str) -> DataFrame:
    """How many texts of each column are no date."""
    return df.agg(*(F.count_if(F.col(c).isNotNull() & iso_date(c).isNull()).alias(c) for c in columns))


def load_files(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables by name from files; the ending of each path tells the format."""
    readers = {"csv": read_csv, "json": read_json_records}
    tables = {}
    for table, path in paths.items():
        ending = path.rsplit(".", 1)[-1]
        tables[table] = readers[ending](spark, path, table) if ending in readers else read_table(spark, path)
    return tables


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """JSON Lines: readable in parallel, unlike one array."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, name: str, by_month: str | None = None, only_months: bool = False) -> None:
    """Replaces a catalog table, or a parquet folder if the name is a path.

    The rows are written beside the old ones first: rows that can't be computed leave the old table as it was, and they
    may come from the table itself. A folder is then swapped by renaming, a catalog table is written
    from the finished rows, which are read back.

    ``by_month`` names a date column: files are then laid out by month, for pruned reads. The
    rebalance hint evens out the files: small months merge, a heavy month is split over tasks. With
    ``only_months``, months without new rows stay, and the others are replaced one by one at the commit.
    """
    if by_month:
        df = df.withColumn("sales_month", year_month(by_month)).hint("rebalance", "sales_month")
    elif only_months:
        raise ValueError("only_months needs by_month")
    spark = df.sparkSession
    path = is_path(name)
    there = _exists(spark, name) if path else spark.catalog.tableExists(name)
    if only_months and there:
        if path:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sales_month").parquet(name)
        else:
            _insert_months(df, name)
        return
    beside = f"{name.rstrip('/')}_{uuid.uuid4().hex}" if path else scratch_path(spark, name)
    parts = ["sales_month"] if by_month else []
    try:
        df.write.partitionBy(*parts).parquet(beside)
        if path:
            _swap(spark, beside, name)
        else:
            rows = spark.read.schema(df.schema).parquet(beside)
            rows.write.format("parquet").mode("overwrite").partitionBy(*parts).saveAsTable(name)
    finally:
        files, at = _file_system(spark, beside)
        files.delete(at, True)


def _insert_months(df: DataFrame, name: str) -> None:
    """Catalog tables take the mode from the session alone; its own setting comes back afterwards."""
    conf, setting = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(setting)
    conf.set(setting, "dynamic")
    try:
        df.select(*df.sparkSession.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        conf.set(setting, before)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Two renames; the old folder is deleted only when the new one has its name, and comes back if that fails."""
    files, at = _file_system(spark, path)
    _, beside = _file_system(spark, new)
    _, away = _file_system(spark, f"{new}_old")
    had = files.exists(at)
    if had and not files.rename(at, away):
        raise OSError(f"{path} could not be moved")
    if not files.rename(beside, at):
        if had:
            files.rename(away, at)
        raise OSError(f"{new} could not be moved to {path}")
    if had:
        files.delete(away, True)
