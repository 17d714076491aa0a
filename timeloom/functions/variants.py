"""Fields of variants by kind: null where a field is missing or of another kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, path, "double"))


_NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def is_object(v: Column, path: str = "$") -> Column:
    """Never null. Unlike schema_of_variant it doesn't go through all that the object holds."""
    return F.try_variant_get(v, path, "struct<_:variant>").isNotNull()


def is_text(kind: Column) -> Column:
    return kind == "STRING"


def is_number(kind: Column) -> Column:
    return kind.isin(*_NUMBERS) | kind.startswith("DECIMAL")


def opened(items: Column, names: tuple[str, ...]) -> Column:
    """An array of variants to an array of structs, for each name a struct of the field: v, kind (VOID for a JSON null, null
    for nothing there), text and number (null for other kinds). One array after the other, so that nothing is read
    from a variant twice, however often it is used: a function of array elements shares no subexpressions."""
    found = F.transform(items, lambda v: F.struct(*(F.try_variant_get(v, f"$.{n}", "variant").alias(n) for n in names)))
    kinds = F.transform(found, lambda s: F.struct(*(F.struct(s[n].alias("v"), F.schema_of_variant(s[n]).alias("kind")).alias(n) for n in names)))

    def field(f):
        text = F.when(is_text(f["kind"]), F.try_variant_get(f["v"], "$", "string"))
        number = F.when(is_number(f["kind"]), F.try_variant_get(f["v"], "$", "double"))
        return F.struct(f["v"].alias("v"), f["kind"].alias("kind"), text.alias("text"), number.alias("number"))

    return F.transform(kinds, lambda s: F.struct(*(field(s[n]).alias(n) for n in names)))
