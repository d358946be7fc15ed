"""Metadata of documents and chunks as VARIANT columns: typed filters, containment, attributes of a store, payloads and hits.

Values keep their JSON types: a number never equals a text or a boolean, and a
comparison of values of different kinds is false rather than an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.filters import compile_filter, number_of

#: What marks an attribute whose text is the JSON of an object or array.
NESTED = "__tessera_json_v1__:"
#: Fields of a payload that aren't metadata, and metadata that a hit shows beside its own fields.
FIXED = ("id", "document_id", "chunk_index", "text")
LIFTED = {"page_no": "long", "char_start": "long", "char_end": "long", "document_filename": "string"}
ELEMENTS = "multimodal_elements"

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def metadata_field(metadata: Column, name: str) -> Column:
    """The field of an object as VARIANT; null if it is missing or the metadata is no object."""
    return F.try_variant_get(metadata, f"$.{name}", "variant")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(value: Column) -> Column:
    return F.regexp_like(_of(value), F.lit(_NUMBER))


def equals(value: Column, wanted: Any) -> Column:
    """Whether a VARIANT is the given boolean, number or text, of the same kind; whole numbers are compared exactly."""
    if isinstance(wanted, bool):
        fits = (_of(value) == "BOOLEAN") & (_as(value, "boolean") == wanted)
    elif isinstance(wanted, int) and abs(wanted) < 2**63:
        fits = F.when(_of(value) == "BIGINT", _as(value, "long") == F.lit(wanted).cast("long")).when(_is_number(value), _as(value, "double") == float(wanted))
    elif isinstance(wanted, (int, float)):
        fits = _is_number(value) & (_as(value, "double") == float(wanted))
    elif isinstance(wanted, str):
        fits = (_of(value) == "STRING") & (_as(value, "string") == wanted)
    else:
        raise ValueError(f"not a boolean, number or text: {wanted!r}")
    return F.coalesce(fits, F.lit(False))


def _ranged(compare: Callable[[Column, Any], Column]) -> Callable[[Column, Any], Column]:
    return lambda value, bound: F.coalesce(_is_number(value) & compare(_as(value, "double"), number_of(bound)), F.lit(False))


def _one_of(value: Column, wanted: Any) -> Column:
    if not isinstance(wanted, (list, tuple)):
        raise ValueError("$in needs a list")
    return reduce(lambda a, b: a | b, (equals(value, w) for w in wanted), F.lit(False))


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": equals,
    "$ne": lambda value, wanted: ~equals(value, wanted),
    "$gt": _ranged(lambda v, b: v > b),
    "$gte": _ranged(lambda v, b: v >= b),
    "$lt": _ranged(lambda v, b: v < b),
    "$lte": _ranged(lambda v, b: v <= b),
    "$in": _one_of,
}


def metadata_filter(filters: Mapping[str, Any] | None, metadata: Column, columns: Mapping[str, Column] | None = None) -> Column:
    """A filter dictionary over a VARIANT column; true for no filters.

    ``columns`` gives fields that are columns of their own, such as ``{"id": F.col("chunk_id")}``. A missing field
    and a null pass ``$ne`` only. Raises ValueError as ``compile_filter`` does.
    """
    own = columns or {}
    found = compile_filter(filters, lambda name: own[name].cast("variant") if name in own else metadata_field(metadata, name), OPERATORS)
    return F.lit(True) if found is None else found


def matches(filters: Mapping[str, Any] | None, metadata: Column) -> Column:
    """Whether a document's metadata passes the filters; a malformed filter matches nothing."""
    try:
        return metadata_filter(filters, metadata)
    except ValueError:
        return F.lit(False)


def _held(wanted: Any) -> Callable[[Column], Column]:
    return lambda x: contains(x, wanted)


def contains(value: Column, wanted: Any) -> Column:
    """Whether a VARIANT holds all of ``wanted``: objects their keys, arrays each element somewhere, scalars the same value.

    An empty object or array asks for the kind only. Null is held by null.
    """
    if isinstance(wanted, Mapping):
        fields = _as(value, "map<string, variant>")
        fits = reduce(lambda a, b: a & b, (contains(F.try_element_at(fields, F.lit(k)), w) for k, w in wanted.items()), F.startswith(_of(value), F.lit("OBJECT")))
    elif isinstance(wanted, (list, tuple)):
        items = _as(value, "array<variant>")
        fits = reduce(lambda a, b: a & b, (F.exists(items, _held(w)) for w in wanted), F.startswith(_of(value), F.lit("ARRAY")))
    elif wanted is None:
        fits = F.is_variant_null(value)
    else:
        fits = equals(value, wanted)
    return F.coalesce(fits, F.lit(False))


def _fields(row: Column) -> Column:
    """Fields of an object that aren't null, by name; no field for what is no object."""
    none = F.create_map().cast("map<string, variant>")
    return F.map_filter(F.coalesce(_as(row, "map<string, variant>"), none), lambda k, v: v.isNotNull() & ~F.is_variant_null(v))


def encode_attributes(row: Column) -> Column:
    """Attributes (map of VARIANT scalars) of a VARIANT object, as stores without nested values keep them.

    Nulls are left out; objects and arrays become ``NESTED`` and their JSON with sorted keys.
    """
    nested = lambda v: F.regexp_like(_of(v), F.lit("^(OBJECT|ARRAY)"))
    return F.transform_values(_fields(row), lambda k, v: F.when(nested(v), F.concat(F.lit(NESTED), F.to_json(v)).cast("variant")).otherwise(v))


def decode_attributes(attributes: Column) -> Column:
    """The VARIANT object of encoded attributes; a marked text that isn't JSON stays as it is."""

    def decoded(k: Column, v: Column) -> Column:
        text = _as(v, "string")
        marked = (_of(v) == "STRING") & F.startswith(text, F.lit(NESTED))
        return F.when(marked, F.coalesce(F.try_parse_json(F.substring(text, len(NESTED) + 1, 2**31 - 1)), v)).otherwise(v)

    return F.to_variant_object(F.transform_values(attributes, decoded))


def split_payload(rows: DataFrame, payload: str = "payload", point: str = "point_id") -> DataFrame:
    """The rows with id, document_id, chunk_index, text and metadata in place of a store's payload and point id.

    A payload without an id takes the point's, and one without a text has an empty one. Metadata is what remains without nulls.
    """
    of = F.col(payload)
    rest = F.map_filter(_fields(of), lambda k, v: ~k.isin(*FIXED))
    taken = {
        "id": F.coalesce(F.nullif(_as(metadata_field(of, "id"), "string"), F.lit("")), F.col(point).cast("string")),
        "document_id": _as(metadata_field(of, "document_id"), "string"),
        "chunk_index": _as(metadata_field(of, "chunk_index"), "long"),
        "text": F.coalesce(_as(metadata_field(of, "text"), "string"), F.lit("")),
        "metadata": F.to_variant_object(rest),
    }
    kept = [c for c in rows.columns if c not in (payload, point, *taken)]
    return rows.select(*kept, *(c.alias(n) for n, c in taken.items()))


def shape_hits(hits: DataFrame, with_elements: bool = False, drop: Sequence[str] = ("embedding",)) -> DataFrame:
    """Hits as callers see them: without the vector, with page, span and filename taken from the metadata.

    A field that the hits have as a column already stays as it is, null or not. Elements (JSON text) are a column of
    their own if asked for; otherwise they leave the metadata.
    """
    shaped = hits.drop(*drop)
    meta = F.col("metadata")
    for name, kind in LIFTED.items():
        if name not in shaped.columns:
            shaped = shaped.withColumn(name, _as(metadata_field(meta, name), kind))
    if with_elements:
        return shaped if ELEMENTS in shaped.columns else shaped.withColumn(ELEMENTS, F.to_json(metadata_field(meta, ELEMENTS)))
    fields = F.map_filter(_as(meta, "map<string, variant>"), lambda k, v: k != ELEMENTS)
    return shaped.withColumn("metadata", F.coalesce(F.to_variant_object(fields), meta))
