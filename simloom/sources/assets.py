"""Sources: asset files in JSON, and published datasets in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import codec
from simloom.model import ASSET_FILE
from simloom.store import Files

CODE_COLUMN = "iscc"
UNIT_COLUMNS = ("iscc_meta", "iscc_semantic", "iscc_content", "iscc_data", "iscc_instance")


def asset_files(spark: SparkSession, path: str) -> DataFrame:
    """Asset files below path (*.iscc.json; *.json if there is none), a row a file, with the file's URI.

    A file that is not JSON, or not of the schema, has its text in corrupt_ and nulls elsewhere.
    """

    def read(glob: str) -> DataFrame:
        options = {"recursiveFileLookup": True, "pathGlobFilter": glob, "multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"}
        return spark.read.schema(ASSET_FILE).options(**options).json(path).select("*", F.col("_metadata.file_path").alias("file"))

    found = read("*.iscc.json")
    return read("*.json") if found.isEmpty() else found


def entries_of_files(files: DataFrame, simprint_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, errors). An entry has iscc_id, iscc_code, units, simprints, metadata, source and twice.

    The code falls back to iscc; a name is trimmed and left out if empty; source is the file's URI
    with the .utf8 suffix; twice marks ids that several files have (they are kept).
    """
    good, bad = files.filter("corrupt_ is null"), files.filter("corrupt_ is not null")
    name = F.nullif(F.trim("name"), F.lit(""))
    entries = good.select(
        "iscc_id",
        F.coalesce("iscc_code", "iscc").alias("iscc_code"),
        "units",
        codec.simprints_of_features(F.coalesce("features", F.array().cast(files.schema["features"].dataType)), simprint_bits).alias("simprints"),
        F.when(name.isNotNull(), F.to_json(F.struct(name.alias("name")))).alias("metadata"),
        F.regexp_replace("file", r"\.iscc\.json$|\.json$", ".utf8").alias("source"),
        (F.col("iscc_id").isNotNull() & (F.count("*").over(Window.partitionBy("iscc_id")) > 1)).alias("twice"),
    )
    error = F.when(F.col("iscc_id").isNull(), "not a JSON asset file").otherwise("does not fit the schema")
    return entries, bad.select("file", error.alias("error"))


def numbered(entries: DataFrame) -> DataFrame:
    """Entries of files as an index loads them: their places as pos, in order of the files, and the source in the metadata."""
    parsed = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    metadata = F.to_json(F.map_concat(parsed, F.create_map(F.lit("source"), F.col("source"))))
    return entries.orderBy("source").withColumn("pos", F.monotonically_increasing_id()).withColumn("metadata", metadata)


def metadata_columns(schema: T.StructType) -> list[str]:
    """Scalar columns (strings, numbers, booleans) that are no code columns."""
    scalar = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)
    return [f.name for f in schema.fields if f.name not in (CODE_COLUMN, *UNIT_COLUMNS) and isinstance(f.dataType, scalar) and not isinstance(f.dataType, T.DecimalType)]


def dataset_files(spark: SparkSession, path: str, split: str | None = None) -> list[str]:
    """Parquet files below path, in order; with a split those whose path below it has the split's name, in either case."""
    files = Files(spark, path)
    root = files.qualified(path)
    return [f for f in files.files_below(path, ".parquet") if split is None or split.lower() in f.removeprefix(root).lower()]


def dataset_rows(spark: SparkSession, path: str, limit: int | None = None, split: str | None = None) -> DataFrame:
    """Parquet rows (of a split) with the code and metadata columns only; missing code columns are null."""
    files = [path] if split is None else dataset_files(spark, path, split)
    if not files:
        raise FileNotFoundError(f"no Parquet files of split {split!r} below {path}")
    frame = spark.read.parquet(*files)
    keep = [c for c in (CODE_COLUMN, *UNIT_COLUMNS) if c in frame.columns] + metadata_columns(frame.schema)
    frame = frame.select(*keep)
    for c in (CODE_COLUMN, *UNIT_COLUMNS):
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    return frame if limit is None else frame.limit(limit)


def entries_of_rows(rows: DataFrame, dataset: str) -> DataFrame:
    """(iscc_code, units, metadata): rows with a code or two units at least; empty values are left out of metadata."""
    code = F.nullif(F.col(CODE_COLUMN), F.lit(""))
    units = F.filter(F.array(*UNIT_COLUMNS), lambda u: u.isNotNull() & (u != ""))

    def kept(name: str) -> Column:
        column = F.col(name)
        return (F.nullif(column, F.lit("")) if isinstance(rows.schema[name].dataType, T.StringType) else column).alias(name)

    metadata = F.to_json(F.struct(F.lit(dataset).alias("hf_dataset"), *(kept(c) for c in metadata_columns(rows.schema))))
    own = rows.select(code.alias("iscc_code"), units.alias("units"), metadata.alias("metadata"))
    return own.filter("iscc_code is not null or size(units) >= 2").withColumn("units", F.when(F.size("units") >= 2, F.col("units")))
