"""Row cleaning: null, duplicate and blank rows; predicates and counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

#: Texts that a CSV reader takes for null (fixed values).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: What counts as a URL in text: the scheme, and one of the signs that the pattern takes after it (fixed values).
URL = r"https?://[a-zA-Z0-9$-_@.&+!*(),]"


def na_to_null(c: Column, na_tokens: list[str] | None = None) -> Column:
    held = NA_TOKENS if na_tokens is None else na_tokens
    return F.when(~c.isin(held), c)


def drop_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset or df.columns)


def drop_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns) if columns else df.dropDuplicates()


def is_blank(c: Column) -> Column:
    return T.strip(c) == ""


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def ingest_clean(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Null rows, then duplicates, then blank texts; one shuffle."""
    return drop_blank(drop_duplicates(drop_null(df.select(*columns))), text)


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_label_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """How often each label stands beside a null text."""
    return df.where(F.col(text).isNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def info(df: DataFrame) -> DataFrame:
    """(position, name, type, non_null) of every column, from one aggregation."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"_{k}") for k, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"_{k}").alias("non_null")) for k, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each different row."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_rows(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """All but the first, by ``key``, of rows equal in ``columns``."""
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(key))
    return df.withColumn("_nth", nth).where("_nth > 1").drop("_nth")


def edge_space(c: Column) -> Column:
    return F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" "))


def remap(c: Column, mapping: dict[int, int]) -> Column:
    """Values outside the mapping become null."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(pairs, c)


def head_in_order(df: DataFrame, order: str, n: int = 25) -> DataFrame:
    """The first n rows in input order, numbered from 1; only n rows reach one task."""
    top = df.orderBy(order).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(order)))


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The last n rows, last first."""
    return df.orderBy(F.desc(order)).limit(n)


def require_rows(rows: list, what: str) -> list:
    """The guard of a request: it must hold something."""
    if not rows:
        raise ValueError(f"No {what} provided")
    return rows
