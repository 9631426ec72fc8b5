"""Reading the business tables from where they are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS


class SchemaMismatch(ValueError):
    """A table lacks a declared column or holds it under another type."""


def conform(df: DataFrame, schema: T.StructType, table: str = "table", cast: bool = False) -> DataFrame:
    """The declared columns of ``df``, in declared spelling and type.

    Columns are found without regard to case, and undeclared ones are left out, so
    the scan stays narrow. A missing column is an error; so is another type, unless
    ``cast`` allows a conversion.
    """
    found = {field.name.lower(): field for field in df.schema.fields}
    missing = [field.name for field in schema.fields if field.name.lower() not in found]
    if missing:
        raise SchemaMismatch(f"{table}: missing column(s) {', '.join(missing)}")
    columns = []
    for field in schema.fields:
        actual = found[field.name.lower()]
        column = F.col(f"`{actual.name}`")
        if actual.dataType != field.dataType:
            if not cast:
                raise SchemaMismatch(
                    f"{table}.{actual.name}: {actual.dataType.simpleString()} found, "
                    f"{field.dataType.simpleString()} declared"
                )
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


class Tables(Mapping[str, DataFrame]):
    """Business tables read on first use and checked against their declared schema."""

    def __init__(self, read: Callable[[str], DataFrame], cast: bool = False):
        self._read = read
        self._cast = cast
        self._loaded: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            schema = SCHEMAS[name]
            self._loaded[name] = conform(self._read(name), schema, name, self._cast)
        return self._loaded[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)


def from_folder(
    spark: SparkSession, folder: str, fmt: str = "parquet", suffix: str = "", cast: bool = False, **options: str
) -> Tables:
    """Tables kept as ``folder/<TABLE><suffix>`` in any format Spark reads.

    Text formats get the declared schema, so nothing is inferred from the data.
    """

    def read(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if fmt in ("csv", "json"):
            reader = reader.schema(SCHEMAS[name])
        return reader.load(f"{folder.rstrip('/')}/{name}{suffix}")

    return Tables(read, cast)


def from_database(spark: SparkSession, database: str | None = None, cast: bool = False) -> Tables:
    """Tables and views registered in the session catalogue."""
    prefix = f"{database}." if database else ""
    return Tables(lambda name: spark.table(f"{prefix}{name}"), cast)
