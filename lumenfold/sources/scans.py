"""Tables in and out: Parquet, CSV, JSON lines, bytes; typed writes, quarantine, layer inventories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..specs import BASE, EXPECTED, SCHEMA_VERSION, ContractError

FORMATS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json", ".ndjson": "json"}


def table_format(path: str, is_directory: bool | None = None) -> str:
    """By the ending; a directory (or a path without an ending) is a Parquet data set."""
    name = path.rstrip("/").rpartition("/")[2].lower()
    for ending, kind in FORMATS.items():
        if name.endswith(ending):
            return kind
    if is_directory or "." not in name:
        return "parquet"
    raise ContractError(f"no reader for {path}")


def contract_schema() -> T.StructType:
    """The physical schema, with its version in each field's metadata."""
    kinds = {"sample_id": T.StringType(), "Class": T.ByteType(), "source_id": T.StringType(), "group_id": T.StringType(), "first_seen_at": T.TimestampType(), "label_confidence": T.FloatType()}
    spark_kinds = {"tinyint": T.ByteType(), "int": T.IntegerType(), "float": T.FloatType()}
    meta = {"feature_schema_version": SCHEMA_VERSION}
    fields = [T.StructField(n, k, False, meta) for n, k in kinds.items()]
    return T.StructType(fields + [T.StructField(f.name, spark_kinds[f.spark_type], not f.required, meta) for f in BASE])


def read(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """A table as it is: CSV columns are strings (nothing is inferred), JSON lines take the schema or strings of its own.

    Columns that are asked for reach the scan; with limit, the first rows only.
    """
    kind = table_format(path)
    if kind == "parquet":
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    else:
        df = (spark.read.schema(schema) if schema else spark.read.option("primitivesAsString", True)).json(path)
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its types; what doesn't parse is null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if dict(df.dtypes)[f.name] == "string" else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])


def count(spark: SparkSession, path: str) -> int:
    return read(spark, path).count()


def write(df: DataFrame, path: str, schema: T.StructType | None = None, compression: str = "zstd") -> None:
    """A Parquet layer that must not exist yet."""
    (cast(df, schema) if schema else df).write.mode("errorifexists").option("compression", compression).parquet(path)


def write_clean_and_quarantine(checked: DataFrame, clean: str, rejected: str, reason: str = "reason") -> None:
    """Valid rows to one layer; rejected ones, with hashed ids and reasons, to the other."""
    from ..operators.quality import quarantine

    columns = tuple(c for c in checked.columns if c != reason)
    write(checked.where(F.col(reason) == "").drop(reason), clean)
    write(quarantine(checked, columns, tuple(c for c in ("sample_id", "group_id") if c in columns), reason), rejected)


def read_bytes(spark: SparkSession, path: str, most: int = 50 * 1024 * 1024, glob: str = "*") -> DataFrame:
    """path, length, content: content is null beyond the limit and is never loaded there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = files.where(F.col("length") <= most).select("path", "length", "content")
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def from_memory(spark: SparkSession, uploads: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in uploads.items()], "path string, length long, content binary")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """part, n_rows, n_bytes, sha256 of each file of a Parquet layer."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    return files.join(rows, "part", "left").na.fill(0, ["n_rows"])


def model_matrix(df: DataFrame, features: tuple[str, ...], metadata: tuple[str, ...], path: str) -> None:
    """A layer of assembled vectors, label, metadata and the count of missing features."""
    vector = F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(float("nan")).cast("float")) for f in features])
    missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0))
    write(df.select(*metadata, vector.alias("x"), missing.alias("missing_feature_count")), path)


def load_matrix(spark: SparkSession, path: str, expected: list[dict]) -> DataFrame:
    """The layer, if its files are those of the manifest."""
    found = sorted((r.asDict() for r in inventory(spark, path).collect()), key=lambda r: r["part"])
    if found != sorted(expected, key=lambda r: r["part"]):
        raise ContractError(f"{path} isn't what its manifest says")
    return spark.read.parquet(path)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


__all__ = ["EXPECTED", "cast", "contract_schema", "count", "from_memory", "inventory", "load_matrix", "model_matrix", "read", "read_bytes", "table_format", "write", "write_clean_and_quarantine"]
