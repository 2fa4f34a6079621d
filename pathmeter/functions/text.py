"""Text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.btrim(text, F.lit(WHITESPACE))


def preview(text: Column | str, length: int = 50) -> Column:
    """The first characters, with dots when there are more."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.left(text, F.lit(length))
    return F.when(F.length(text) > length, F.concat(head, F.lit("..."))).otherwise(text)


def document_kind(doc: Column | str) -> Column:
    """Kind of an API document by the keys it has.

    A paginated list is judged by its first item; for interfaces the whole item
    is searched for the word, not just its keys.
    """
    doc = F.col(doc) if isinstance(doc, str) else doc
    results = F.try_variant_get(F.try_parse_json(doc), "$.results", "array<variant>")
    item = F.to_json(F.get(results, F.lit(0)))
    item_keys, keys = F.json_object_keys(item), F.json_object_keys(doc)

    def has(where: Column, key: str) -> Column:
        return F.coalesce(F.array_contains(where, key), F.lit(False))

    of_list = (
        F.when(has(item_keys, "device_type"), "device")
        .when(F.coalesce(F.contains(item, F.lit("interface")), F.lit(False)), "interfaces")
        .when(has(item_keys, "remote_address"), "sessions")
    )
    of_single = (
        F.when(has(keys, "device_type"), "device")
        .when(has(keys, "remote_address"), "session")
        .when(has(keys, "interfaces"), "device_with_interfaces")
        .when(has(keys, "bgp_sessions"), "device_with_sessions")
    )
    return F.coalesce(F.when(results.isNotNull(), of_list).otherwise(of_single), F.lit("none"))


def merge_fields(current: Column | str, updates: Column | str) -> Column:
    """All existing fields with the given ones overwritten, also by null.

    A null map counts as empty on either side, so it loses no fields.
    """
    empty = F.create_map().cast("map<string,string>")
    current = F.coalesce(F.col(current) if isinstance(current, str) else current, empty)
    updates = F.coalesce(F.col(updates) if isinstance(updates, str) else updates, empty)
    kept = F.map_filter(current, lambda k, v: ~F.map_contains_key(updates, k))
    return F.map_concat(kept, updates)
