"""Untyped JSON: types and truth of a field of a VARIANT column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The JSON value, or null where the text isn't JSON."""
    return F.try_parse_json(text)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column, name: str) -> Column:
    """BIGINT, STRING, VOID, ...; null where the field is missing."""
    return F.schema_of_variant(field(value, name))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def as_text(value: Column, name: str) -> Column:
    return F.when(kind(value, name) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def quoted(text: Column) -> Column:
    """Text between quotes as messages show it: single ones unless it holds only such, backslashes and line breaks escaped."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.contains(text, F.lit("'"))
    return F.when(single & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def literal(value: Column, name: str) -> Column:
    """A field as messages show it: text quoted, True, False and None, numbers and the rest as JSON; null where it is missing."""
    of = kind(value, name)
    truth = F.when(F.try_variant_get(value, f"$.{name}", "boolean"), "True").otherwise("False")
    return F.when(of == "STRING", quoted(as_text(value, name))).when(of == "BOOLEAN", truth).when(of == "VOID", "None").otherwise(F.to_json(field(value, name)))


def falsy(value: Column, name: str) -> Column:
    """Missing, null, "", 0, false, [] and {}; a blank string is not."""
    shown = F.to_json(field(value, name))
    of = kind(value, name)
    number = F.try_variant_get(value, f"$.{name}", "double")
    numeric = of.startswith("BIGINT") | of.startswith("DECIMAL") | of.startswith("DOUBLE") | of.startswith("FLOAT")
    return of.isNull() | (of == "VOID") | shown.isin('""', "false", "[]", "{}") | F.coalesce(numeric & (number == 0), F.lit(False))
