from tlake.functions.attributes import (
    any_value_text,
    attr_key,
    attr_pairs,
    attrs_to_map,
    attrs_to_values,
    empty_map,
    first_attr,
    looked_up,
    map_text,
    own_key,
    same_or_text,
    typed_value,
    upsert,
    value_kind,
    values_text,
    variant_text,
)
from tlake.functions.scalar import (
    array_first,
    as_bigint,
    computed_once,
    epoch_micros,
    from_micros,
    from_unix_nanos,
    json_string,
    json_value,
    like_literal,
    literal_time,
    readable_size,
    text,
    time_bucket,
    trunc_second,
    unix_nanos,
    unix_seconds,
)

__all__ = [
    "any_value_text", "array_first", "as_bigint", "attr_key", "attr_pairs", "attrs_to_map",
    "attrs_to_values", "computed_once", "empty_map", "epoch_micros",
    "first_attr", "from_micros", "from_unix_nanos", "json_string", "json_value", "like_literal",
    "literal_time", "looked_up", "map_text", "own_key", "readable_size", "same_or_text", "text", "time_bucket", "trunc_second",
    "typed_value", "unix_nanos", "unix_seconds", "upsert", "value_kind", "values_text", "variant_text",
]
