"""What the operators share: staged tables, free column names, row order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.stage import Staged, shared_dir

__all__ = ["PLACE_BITS", "Staged", "column", "doc_number", "free_name", "numbered", "place", "shared_dir", "text_of"]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


#: Bits of a word's or line's place in its document.
PLACE_BITS = 28


def doc_number(id_col: Column, text: Column) -> Column:
    """A decimal that orders documents by id, null last, and then by a hash of the text."""
    number = F.coalesce(id_col.cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)"), F.lit(Decimal(1 << 64)).cast("decimal(20,0)"))
    hashed = F.pmod(F.xxhash64(text), F.lit(1 << 32)).cast("decimal(10,0)")
    return (number * F.lit(1 << 32).cast("decimal(10,0)") + hashed).cast("decimal(38,0)")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc) with doc_number() as doc. Ids must be whole numbers."""
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    if base.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError("ids must be whole numbers")
    return base.withColumn("doc", doc_number(F.col("id"), F.col("text")))


def place(at: Column) -> Column:
    """A decimal that orders places in documents, from the column doc and a place in it."""
    return (F.col("doc") * F.lit(1 << PLACE_BITS).cast("decimal(10,0)") + at).cast("decimal(38,0)")
