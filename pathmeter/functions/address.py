"""Address columns: validity, splitting, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_BYTE}(\.{_BYTE}){{3}}"
_GROUP = "[0-9A-Fa-f]{1,4}"
_GROUPS = f"({_GROUP}(:{_GROUP})*)?"


def address_family(address: Column | str) -> Column:
    """'4' or '6' for a valid address, else null.

    IPv4 without leading zeros; IPv6 with at most one "::", which stands for a
    group at least, an embedded IPv4 address at its end and a zone id.
    """
    address = F.col(address) if isinstance(address, str) else address
    zoned = address.rlike(r"\A[^%]*(%[^%]+)?\z")
    body = F.regexp_replace(F.substring_index(address, "%", 1), rf":{_V4}\z", ":0:0")
    groups = F.regexp_count(body, F.lit(_GROUP))
    full = body.rlike(rf"\A{_GROUP}(:{_GROUP}){{7}}\z")
    short = body.rlike(rf"\A{_GROUPS}::{_GROUPS}\z") & (groups <= 7)
    return F.when(address.rlike(rf"\A{_V4}\z"), "4").when(zoned & (full | short), "6")


def audit_code(family: Column | str) -> Column:
    """Stable code of the validity message."""
    family = F.col(family) if isinstance(family, str) else family
    return F.when(family.isNull(), F.lit("INVALID")).otherwise(F.concat(F.lit("IPV"), family, F.lit("_VALID")))


def host_part(address: Column | str) -> Column:
    address = F.col(address) if isinstance(address, str) else address
    return F.get(F.split(address, "/"), F.lit(0))


def prefix_length(address: Column | str) -> Column:
    address = F.col(address) if isinstance(address, str) else address
    return F.get(F.split(address, "/"), F.lit(1)).try_cast("int")


def netmask(length: Column | str) -> Column:
    """Dotted IPv4 mask of a prefix length."""
    length = F.col(length) if isinstance(length, str) else length
    full = F.lit(0xFFFFFFFF).cast("bigint")
    mask = F.call_function("shiftleft", full, 32 - length).bitwiseAND(full)
    octets = [F.shiftrightunsigned(mask, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)]
    return F.when(length.between(0, 32), F.concat_ws(".", *octets))


def router_id(primary_ip4: Column | str) -> Column:
    """Primary IPv4 address without its length, or 0.0.0.0."""
    return F.coalesce(host_part(primary_ip4), F.lit("0.0.0.0"))
