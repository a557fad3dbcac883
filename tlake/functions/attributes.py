"""Attribute lists and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tlake.functions.scalar import _c, array_first


def any_value_text(value: Column) -> Column:
    """An AnyValue struct as text, whatever kind it holds; NULL when it holds none."""
    return F.coalesce(
        value["stringValue"],
        value["intValue"],
        value["doubleValue"],
        value["boolValue"],
        value["arrayValue"],
        value["kvlistValue"],
        value["bytesValue"],
    )


def attrs_to_map(attrs: Column | str) -> Column:
    """Key/value list → MAP, absent values are ''.

    The last one of equal keys wins; this is ``spark.sql.mapKeyDedupPolicy``,
    which ``session.prepare`` sets and every reader in ``sources`` calls.
    """
    return F.coalesce(
        F.map_from_entries(
            F.transform(
                F.filter(_c(attrs), lambda a: a["key"].isNotNull()),
                lambda a: F.struct(a["key"], F.coalesce(any_value_text(a["value"]), F.lit(""))),
            )
        ),
        empty_map(),
    )


# The kinds of a value in a request.
VALUE_KINDS = ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue", "bytesValue")

_TYPED = {
    "stringValue": ("", "string"), "intValue": ("", "bigint"), "doubleValue": ("", "double"), "boolValue": ("", "boolean"),
    "arrayValue": (".values", "array<variant>"), "kvlistValue": (".values", "array<struct<key:string,value:variant>>"),
    "bytesValue": ("", "string"),
}


def _by_kind(v: Column, type_: str, result: Callable[[Column], Column]) -> Column:
    """``result`` of a struct with a field of the type for each kind. A VARIANT is read once, however often the fields are
    named: a path that it has not costs Spark an exception, and a value has one kind of seven."""
    fields = ", ".join(f"{kind}: {type_}" for kind in VALUE_KINDS)
    return F.get(F.transform(F.array(F.try_variant_get(v, "$", f"struct<{fields}>")), result), 0)


def value_kind(v: Column) -> Column:
    """Which kind a VARIANT value is of, '' when it holds none. The value itself is not made into text for that."""

    def first(values: Column) -> Column:
        out = F.lit("")
        for kind in reversed(VALUE_KINDS):
            held = values[kind].isNotNull() & ~F.is_variant_null(values[kind])
            out = F.when(held, F.lit(kind)).otherwise(out)
        return out

    return _by_kind(v, "variant", first)


def typed_value(v: Column, kind: str) -> Column:
    """The value of one kind out of a VARIANT, NULL when it is of another; lists and pairs hold VARIANTs again, bytes are binary."""
    path, type_ = _TYPED[kind]
    out = F.try_variant_get(v, f"$.{kind}{path}", type_)
    return F.try_to_binary(out, F.lit("base64")) if kind == "bytesValue" else out


def variant_text(v: Column) -> Column:
    """A VARIANT value as text, whatever kind it holds; NULL when it holds none."""
    return _by_kind(v, "string", lambda texts: F.coalesce(*[texts[kind] for kind in VALUE_KINDS]))


def attrs_to_values(attrs: Column | str) -> Column:
    """Key/value list with VARIANT values → MAP of these; the last one of equal keys wins."""
    return F.coalesce(
        F.map_from_entries(F.filter(_c(attrs), lambda a: a["key"].isNotNull())), F.create_map().cast("map<string,variant>")
    )


def values_text(m: Column | str) -> Column:
    """MAP of VARIANT values → the text map of the tables."""
    return F.transform_values(_c(m), lambda _, v: F.coalesce(variant_text(v), F.lit("")))


def as_value(text: Column) -> Column:
    return F.to_variant_object(F.struct(text.alias("stringValue")))


def same_or_text(value: Column, text: Column, came: Column | None = None) -> Column:
    """The value as it came where the text is still the value's, else the text as a value. ``came`` is the value's text in the
    tables, where that is known: then only a value with the text '' is read, as one of no kind has that too."""
    same = variant_text(value) == text
    if came is not None:
        same = (came == text) & ((text != "") | same)
    return F.when(same, value).otherwise(as_value(text))


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def first_attr(attrs: Column | str, key: str) -> Column:
    """Text value of the first attribute with the key, '' when there is none."""
    hit = array_first(attrs, lambda a: a["key"] == F.lit(key))
    return F.coalesce(any_value_text(hit["value"]), F.lit(""))


def map_text(m: Column | str, key: str) -> Column:
    """Map subscript with '' for a missing key."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(""))


def upsert(m: Column | str, entries: dict[str, Column | str]) -> Column:
    """Set keys, replacing values already there. String values are literals."""
    col = F.coalesce(_c(m), empty_map())
    kept = F.map_filter(col, lambda k, _: ~k.isin(*entries))
    parts = [x for k, v in entries.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]
    return F.map_concat(kept, F.create_map(*parts))


def attr_pairs(m: Column | str) -> Column:
    """A map as sorted key/value list: unlike a map it can be grouped, joined, sorted and
    used as a window key."""
    return F.sort_array(F.map_entries(_c(m)))


def attr_key(m: Column | str) -> Column:
    """Canonical text of a map: equal maps give equal text."""
    return F.to_json(attr_pairs(m))


def own_key(key: Column | str, present: Column, *own: Column | str) -> Column:
    """Lookup key that never matches where ``present`` is false.

    Rows without a key to look up would all meet in one shuffle partition under
    an empty or NULL key; made from their own columns, their keys spread.
    """
    return F.when(present, F.concat(F.lit("id:"), _c(key))).otherwise(
        F.concat(F.lit("own:"), F.xxhash64(*own).cast("string"))
    )


def looked_up(key: Column | str) -> Column:
    """The other side of ``own_key``."""
    return F.concat(F.lit("id:"), _c(key))
