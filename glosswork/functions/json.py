"""Model output as JSON: parsing, repair, and flattening of nested values, on the VARIANT type."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# A whole text in one fence, an object or array in a fence, and the span from the first to the last bracket.
WHOLE_FENCE = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
OBJECT_FENCE, OBJECT_SPAN = r"(?is)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{.*\})"
VALUE_FENCE, VALUE_SPAN = r"(?is)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", r"(?s)(\{.*\}|\[.*\])"


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def parse_whole(raw: Column) -> Column:
    """The object that the text is, possibly as one fenced block; null else."""
    text = F.trim(raw)
    inner = F.regexp_extract(text, WHOLE_FENCE, 1)
    value = F.try_parse_json(F.when(inner != "", inner).otherwise(text))
    return F.when(is_object(value), value)


def repair_object(raw: Column) -> Column:
    """The object in the text: as it is, in a fenced block, or from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(raw, OBJECT_FENCE, 1)
    braces = F.regexp_extract(raw, OBJECT_SPAN, 1)
    values = [F.try_parse_json(F.trim(raw)), F.try_parse_json(fenced), F.try_parse_json(braces)]
    return F.coalesce(*[F.when(is_object(v), v) for v in values])


def extract_json(raw: Column) -> Column:
    """The object or array in the text."""
    fenced = F.regexp_extract(raw, VALUE_FENCE, 1)
    span = F.regexp_extract(raw, VALUE_SPAN, 1)
    values = [F.try_parse_json(F.trim(raw)), F.try_parse_json(fenced), F.try_parse_json(span)]
    fits = lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    return F.coalesce(*[F.when(fits(v), v) for v in values])


def keys(value: Column) -> Column:
    """The keys of an object, in order of name; empty for anything else."""
    return F.coalesce(F.array_sort(F.json_object_keys(F.to_json(value))), F.array().cast("array<string>"))


def field(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def entries(value: Column) -> Column:
    """map<string, string> of the fields of an object; nested values as JSON text; empty for anything else."""
    return F.coalesce(F.from_json(F.to_json(value), "map<string,string>"), F.create_map().cast("map<string,string>"))


@F.arrow_udf(StringType())
def flat_text(value: pa.Array) -> pa.Array:
    """Leaf strings and numbers of a JSON text, joined by spaces; other text stays as it is."""

    def leaves(v) -> list[str]:
        if isinstance(v, dict):
            return [x for item in v.values() for x in leaves(item)]
        if isinstance(v, list):
            return [x for item in v for x in leaves(item)]
        if v is None or isinstance(v, bool):
            return []
        return [str(v).strip()] if str(v).strip() else []

    out = []
    for text in value.to_pylist():
        if text and text[:1] in "[{":
            try:
                text = " ".join(leaves(json.loads(text)))
            except ValueError:
                pass
        out.append(text)
    return pa.array(out, pa.string())
