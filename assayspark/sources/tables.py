"""Reading sample tables and bringing them into one shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.functions.columns import is_numeric, nan_to_null, number
from assayspark.roles import TableRoles
from assayspark.sources import naming

_FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "json",
            ".orc": "orc", ".parquet": "parquet"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None, **options) -> DataFrame:
    """Read by extension, NaN as null; folders and globs work. Pass ``schema`` to avoid CSV inference."""
    suffix = next((f for ext, f in _FORMATS.items() if path.lower().rstrip("/*").endswith(ext)), "parquet")
    fmt = fmt or suffix
    if fmt == "csv":
        options = {"header": True, "inferSchema": schema is None, **options}
    reader = spark.read.format(fmt).options(**options)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).load(path))


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def normalize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename to normalised names; also return normalised-to-original names."""
    return df.toDF(*[naming.normal_name(c) for c in df.columns]), naming.name_map(df.columns)


def resolve_target(df: DataFrame, target: str = naming.TARGET_NAME) -> DataFrame:
    """Make sure the target exists under its canonical name, converting units if needed.

    Data is touched only by the last resort: the last column is taken when at least half of
    its values are numbers.
    """
    named = trim_columns(df)
    found = naming.find_target(named.columns, target)
    if found is not None:
        return named.withColumnRenamed(found, target)
    second = naming.find_second_unit(named.columns)
    if second is not None:
        return named.withColumn(target, number(_q(second)) * naming.SECOND_UNIT_FACTOR).drop(second)
    if named.columns:
        last = named.columns[-1]
        seen = named.agg(F.count(F.lit(1)), F.count(number(_q(last)))).first()
        if seen[1] >= max(1, int(seen[0] * 0.5)):
            return named.withColumnRenamed(last, target)
    raise ValueError(f"no column can serve as target '{target}'")


def unit_convert(df: DataFrame, target: str, second: str, factor: float = naming.SECOND_UNIT_FACTOR) -> DataFrame:
    """Fill missing targets from the second unit and drop that column."""
    filled = F.coalesce(number(_q(target)), number(_q(second)) * F.lit(factor))
    return df.withColumn(target, filled).drop(second)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def describe_schema(df: DataFrame, roles: TableRoles | None = None) -> DataFrame:
    """One row per column: name, number or text, role, and the table's row count."""
    roles = roles or TableRoles()

    def role_of(name: str) -> str:
        if name == roles.target:
            return "target"
        return "composition" if name in roles.composition else "other"

    entries = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit("number" if is_numeric(f.dataType) else "text").alias("kind"),
            F.lit(role_of(f.name)).alias("role"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*entries)), "n_rows")


def select_group(df: DataFrame, group: str, composition: Sequence[str] = naming.COMPOSITION) -> DataFrame:
    """Project the columns of one display group."""
    return df.select(*[_q(c) for c in naming.column_groups(df.columns, composition)[group]])


def attach_vectors(samples: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Samples with their vectors; samples without one are dropped."""
    return samples.join(vectors, key, "inner")


def missing_vectors(samples: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Samples for which there is no vector."""
    return samples.join(vectors.select(key), key, "left_anti")


def append_aligned(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Append the batch's common columns; columns it lacks become null."""
    common = [c for c in existing.columns if c in batch.columns]
    if not common:
        raise ValueError("the batch has no column in common with the table")
    aligned = batch.select(*[F.col(c).cast(existing.schema[c].dataType) for c in common])
    return existing.unionByName(aligned, allowMissingColumns=True)


def ingest(spark: SparkSession, path: str, out: str, target: str = naming.TARGET_NAME, **options) -> DataFrame:
    """Read a file, resolve its target, store a normalised Parquet copy and return that."""
    prepared = resolve_target(read_table(spark, path, **options), target)
    prepared.write.mode("overwrite").parquet(out)
    return spark.read.schema(prepared.schema).parquet(out)
