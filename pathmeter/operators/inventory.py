"""Devices with their interfaces, addresses and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter.functions import address
from pathmeter.operators import ordered

# Entries of one list in a nested document. Longer lists go on in further pages,
# so that no row, and no task building one, grows with the data.
PAGE = 500


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Every parent with each of its children, and parents without any.

    The same rows as ``parents LEFT JOIN children``, put the other way round:
    in that join a parent with very many children could neither be split nor
    could the parents be broadcast. Here the children may be split, and parents
    without any are found from the distinct keys, combined before the shuffle.
    """
    lonely = parents.join(children.select(key).distinct(), key, "left_anti")
    return children.join(parents, key).unionByName(lonely, allowMissingColumns=True)


def related_rows(
    devices: DataFrame, interfaces: DataFrame, addresses: DataFrame, sessions: DataFrame, primaries: DataFrame
) -> DataFrame:
    """Every device with each related object.

    Interfaces (with their addresses) and sessions are separate branches: joined
    flat they would multiply each other within a device.
    """
    base = devices.join(
        primaries.select(F.col("address_id").alias("primary_ip_id"), F.col("address").alias("primary_ip4")),
        "primary_ip_id",
        "left",
    ).select("device_id", "name", "primary_ip4")
    owned = interfaces.select("device_id", "interface_id", F.col("name").alias("interface_name"))
    by_interface = with_parent(
        addresses.select("interface_id", "address"), with_parent(owned, base, "device_id"), "interface_id"
    ).withColumn("kind", F.lit("interface"))
    by_session = with_parent(
        sessions.select("device_id", F.col("remote_address").alias("address")), base, "device_id"
    ).withColumn("kind", F.lit("session"))
    columns = ["device_id", "name", "primary_ip4", "kind", "interface_name", "address"]
    return by_interface.unionByName(by_session, allowMissingColumns=True).select(*columns)


def device_sessions(devices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of each device, matched by device name."""
    named = devices.select("device_id", F.col("name").alias("device_name"))
    return named.join(sessions.drop("device_id"), "device_name")


def paged_lists(df: DataFrame, key: str, item_id: str, item: Column, out: str, page: int = PAGE) -> DataFrame:
    """(key, page, out): the items of each key in order, in pages of ``page`` entries.

    A page holds the items numbered page * size to (page + 1) * size - 1 in the
    order of ``item_id``, so a new last item moves no other. The page number is
    part of the grouping, so a hot key spreads over tasks.
    """
    numbered = ordered.number_rows(df, [key], [item_id], "_number")
    numbered = numbered.withColumn("page", F.expr(f"(_number - 1) div {int(page)}L"))
    return numbered.groupBy(key, "page").agg(
        F.array_sort(F.collect_list(item)).alias(out)
    )


def device_documents(
    devices: DataFrame, interfaces: DataFrame, addresses: DataFrame, sessions: DataFrame, page: int = PAGE
) -> DataFrame:
    """Nested documents (device_id, page, name, interfaces[], bgp_sessions[]).

    Bottom up: addresses into interfaces, interfaces and sessions into devices.
    """
    address_lists = paged_lists(
        addresses, "interface_id", "address_id", F.struct("address_id", "address", "family"), "ip_addresses", page
    )
    entry = F.struct(
        "interface_id",
        F.coalesce("page", F.lit(0)).cast("bigint").alias("address_page"),
        "name",
        "enabled",
        F.coalesce(
            "ip_addresses", F.expr("cast(array() as array<struct<address_id:bigint,address:string,family:int>>)")
        ).alias("ip_addresses"),
    )
    with_addresses = with_parent(address_lists, interfaces, "interface_id").select(
        "device_id", F.struct("interface_id", "page").alias("_id"), entry.alias("_entry")
    )
    interface_lists = paged_lists(with_addresses, "device_id", "_id", F.col("_entry"), "interfaces", page)
    session_lists = paged_lists(
        sessions, "device_id", "session_id", F.struct("session_id", "remote_address", "remote_asn"), "bgp_sessions", page
    )
    lists = interface_lists.join(session_lists, ["device_id", "page"], "full_outer")
    return with_parent(lists, devices, "device_id").select(
        "device_id",
        F.coalesce("page", F.lit(0).cast("bigint")).alias("page"),
        "name",
        "interfaces",
        "bgp_sessions",
    )


def family_mismatch(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose two addresses are both valid but of different families."""
    audited = pairs.withColumns(
        {"first_family": address.address_family(first), "second_family": address.address_family(second)}
    )
    return audited.where(F.col("first_family") != F.col("second_family"))


# ------------------------------------------------------------------ command rows


def interface_commands(interfaces: DataFrame, addresses: DataFrame) -> DataFrame:
    """Command rows of all enabled interfaces: (device_id, interface_id, step, item, text).

    (step, item) orders the rows of an interface; item is the address id. Rows
    are made one by one, never gathered per interface.
    """
    enabled = interfaces.where("enabled and name is not null and name <> ''")
    # The template's own test, which is case-sensitive.
    routed = ~F.contains(F.col("name"), F.lit("LoopBack"))
    keys = ["device_id", "interface_id"]

    def line(step: int, text: Column, item: Column | None = None) -> Column:
        return F.struct(
            F.lit(step).alias("step"),
            (F.lit(0).cast("bigint") if item is None else item).alias("item"),
            text.alias("text"),
        )

    described = F.coalesce(F.col("description"), F.lit("")) != ""
    own = F.array(
        line(1, F.concat(F.lit("interface "), F.col("name"))),
        F.when(described, line(2, F.concat(F.lit(" description "), F.col("description")))),
        F.when(routed, line(4, F.lit(" ipv6 enable"))),
        line(6, F.lit(" undo shutdown")),
        line(7, F.lit("quit")),
    )
    fixed = enabled.select(*keys, F.inline(F.filter(own, lambda x: x.isNotNull())))
    v4 = F.concat(
        F.lit(" ip address "),
        address.host_part("address"),
        F.lit(" "),
        address.netmask(address.prefix_length("address")),
    )
    v6 = F.concat(F.lit(" ipv6 address "), F.col("address"))
    per_address = enabled.select(*keys, "name").join(
        addresses.select("interface_id", "address_id", "address", "family"), "interface_id"
    )
    listed = per_address.where((F.col("family") == 4) | ((F.col("family") == 6) & routed)).select(
        *keys,
        F.when(F.col("family") == 4, 3).otherwise(5).alias("step"),
        F.col("address_id").alias("item"),
        F.when(F.col("family") == 4, v4).otherwise(v6).alias("text"),
    )
    return fixed.unionByName(listed)


def session_commands(devices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Command rows of each session: (device_id, session_id, line_no, text)."""
    peer = F.concat(F.lit(" peer "), address.host_part("remote_address"))

    def policy_lines(column: str, direction: str) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.expr("cast(array() as array<string>)")),
            lambda p: F.concat(peer, F.lit(" route-policy "), p, F.lit(f" {direction}")),
        )

    lines = F.concat(
        F.array(
            F.concat(peer, F.lit(" as-number "), F.col("remote_asn").cast("string")),
            F.concat(peer, F.lit(" enable")),
            F.lit(" Y"),
        ),
        policy_lines("export_policies", "export"),
        F.array(F.concat(peer, F.lit(" advertise-community"))),
        policy_lines("import_policies", "import"),
    )
    rows = device_sessions(devices, sessions)
    return rows.select("device_id", "session_id", F.posexplode(lines).alias("line_no", "text"))


def router_commands(devices: DataFrame, asn: str = "65000") -> DataFrame:
    """Opening lines of each device's routing section."""
    lines = F.array(
        F.lit("system-view"),
        F.concat(F.lit("    sysname "), F.col("name")),
        F.lit(f"bgp {asn}"),
        F.concat(F.lit(" router-id "), address.router_id("primary_ip4")),
        F.lit("ipv6-family unicast"),
        F.lit(" bestroute as-path-ignore"),
    )
    return devices.select("device_id", F.posexplode(lines).alias("line_no", "text"))


# Sections in the order of a device's text; the fleet-wide ones are the same for
# every device and therefore not repeated per device.
SYSTEM, INTERFACES, PREFIX_LISTS, POLICIES, ROUTER, PEERS, FAMILY, SESSIONS, NETWORKS, END = range(1, 11)


def device_commands(
    devices: DataFrame, interfaces: DataFrame, addresses: DataFrame, sessions: DataFrame
) -> DataFrame:
    """All of a device's own command rows: (device_id, section, key, step, item, text).

    (section, key, step, item) orders the rows of a device; key is the interface
    or session. ``devices`` bring their ``local_asn``; a null one is printed as
    ``None``. The sections PREFIX_LISTS, POLICIES and NETWORKS hold the
    fleet-wide rows of ``policy.prefix_list_commands``, ``rule_commands`` and
    ``network_commands``, once for all devices.
    """
    zero = F.lit(0).cast("bigint")

    def line(section: int, step: int, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(step).alias("step"), zero.alias("item"), text.alias("text")
        )

    asn = F.coalesce(F.col("local_asn").cast("string"), F.lit("None"))
    own = F.array(
        line(SYSTEM, 1, F.lit("system-view")),
        line(SYSTEM, 2, F.concat(F.lit("    sysname "), F.col("name"))),
        line(ROUTER, 1, F.concat(F.lit("bgp "), asn)),
        line(ROUTER, 2, F.concat(F.lit(" router-id "), address.router_id("primary_ip4"))),
        line(FAMILY, 1, F.lit("ipv6-family unicast")),
        line(FAMILY, 2, F.lit(" bestroute as-path-ignore")),
        line(END, 1, F.lit("commit")),
        line(END, 2, F.lit("return")),
    )
    columns = ["device_id", "section", "key", "step", "item", "text"]
    fixed = devices.select("device_id", zero.alias("key"), F.inline(own)).select(*columns)
    of_interfaces = interface_commands(interfaces, addresses).select(
        "device_id", F.lit(INTERFACES).alias("section"), F.col("interface_id").alias("key"), "step", "item", "text"
    )
    # Line 0 of a session names the peer's AS; all of these come before the rest.
    of_sessions = session_commands(devices, sessions).select(
        "device_id",
        F.when(F.col("line_no") == 0, PEERS).otherwise(SESSIONS).alias("section"),
        F.col("session_id").alias("key"),
        F.col("line_no").alias("step"),
        zero.alias("item"),
        "text",
    )
    return fixed.unionByName(of_interfaces).unionByName(of_sessions)
