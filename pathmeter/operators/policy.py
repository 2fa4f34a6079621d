"""Routing policies: matching, communities, command rows, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter.functions import text

ASN = "65000"


def last_rule_wins(rules: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last rule of each key; partial aggregation keeps hot keys cheap."""
    others = [c for c in rules.columns if c not in keys]
    last = F.max_by(F.struct(*others), position).alias("_r")
    return rules.groupBy(*keys).agg(last, F.min(position).alias("first_position")).select(
        *keys, "first_position", "_r.*"
    )


def first_rule_per_list(rules: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Only the first rule of each prefix list is ever emitted."""
    others = [c for c in rules.columns if c not in keys]
    first = F.min_by(F.struct(*others), position).alias("_r")
    return rules.groupBy(*keys).agg(first).select(*keys, "_r.*")


def rendered_rules(rules: DataFrame, names: list[str] | None = None) -> DataFrame:
    return rules.where(F.col("policy_name").isin(names or P.RENDERED_POLICIES))


def session_policies(sessions: DataFrame) -> DataFrame:
    """One row per session, direction and policy; sessions without one stay."""
    directions = F.array(
        F.struct(F.lit("export").alias("direction"), F.col("export_policies").alias("policies")),
        F.struct(F.lit("import").alias("direction"), F.col("import_policies").alias("policies")),
    )
    return sessions.select("session_id", F.inline(directions)).select(
        "session_id", "direction", F.explode_outer("policies").alias("policy")
    )


def rule_communities(rules: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities whose name or value is the rule's; each matches once.

    Two equality joins instead of an OR, which would compare all pairs. The
    second leaves out communities already found by name.
    """
    wanted = rules.where("apply_community <> ''").select("rule_id", "apply_community")
    by_name = wanted.join(communities, F.col("apply_community") == F.col("name"))
    by_value = wanted.join(
        communities.where(~F.col("name").eqNullSafe(F.col("value"))),
        F.col("apply_community") == F.col("value"),
    )
    return by_name.unionByName(by_value).select("rule_id", "apply_community", "name", "value")


def match_lists(rules: DataFrame) -> DataFrame:
    """Prefix lists a rule matches: the IPv6 ones if there are any, else IPv4."""
    v6 = F.size("match_ipv6_address") > 0
    chosen = F.when(v6, F.col("match_ipv6_address")).otherwise(F.col("match_ip_address"))
    return rules.select(
        "rule_id",
        F.when(v6, "ipv6").when(F.size("match_ip_address") > 0, "ip").alias("family"),
        F.explode_outer(chosen).alias("prefix_list"),
    )


def prepend_text(count: Column | str, asn: Column | str = ASN) -> Column:
    """AS-path command: repeated ASN, undo for 0, nothing for null or negatives."""
    count = F.col(count) if isinstance(count, str) else count
    path = F.concat_ws(" ", F.array_repeat(_text(asn), count))
    return F.when(count == 0, F.lit(" undo apply as-path")).when(
        count > 0, F.concat(F.lit(" apply as-path "), path, F.lit(" additive"))
    )


def _given(value: Column) -> Column:
    """Empty text counts as not set."""
    return F.coalesce(value, F.lit("")) != ""


def device_asn(policies: DataFrame, devices: DataFrame, key: str = "device_key") -> DataFrame:
    """Add ``asn``, the AS number of each policy's device as text.

    ``devices`` holds (``key``, local_asn), one row per device. A device without
    a number, or one that is not listed, has "None", as in the router lines.
    """
    numbers = devices.select(key, F.col("local_asn").cast("string").alias("asn"))
    return policies.join(numbers, key, "left").withColumn("asn", F.coalesce("asn", F.lit("None")))


def _text(asn: Column | str) -> Column:
    return F.lit(asn) if isinstance(asn, str) else asn


def policy_commands(policies: DataFrame, keys: list[str], asn: Column | str = ASN) -> DataFrame:
    """Command rows of each policy: keys, line_no, text; ``asn`` may be a column of the policies."""
    community, preference = F.col("apply_community"), F.col("local_preference")
    lines = F.concat(
        F.array(F.concat(F.lit("route-policy "), F.col("policy_name"), F.lit(" permit node 10"))),
        F.transform(
            F.col("match_ipv6_address"), lambda p: F.concat(F.lit(" if-match ipv6 address prefix-list "), p)
        ),
        F.array(
            F.when(_given(community), F.concat(F.lit(" apply community "), community)),
            F.when(_given(preference), F.concat(F.lit(" apply local-preference "), preference)),
            prepend_text("as_path_prepend_count", asn),
            F.lit("quit"),
        ),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return policies.select(*keys, F.posexplode(kept).alias("line_no", "text"))


def rule_commands(rules: DataFrame, communities: DataFrame, asn: Column | str = ASN) -> DataFrame:
    """Command rows of each rendered rule: (rule_id, step, item, text).

    (step, item) orders the rows of a rule: header, match lists, communities,
    preference, path, quit. This form always prepends the ASN, which may be a
    column of the rules, three times.
    """
    rendered = rendered_rules(rules)
    matched = match_lists(rendered).where("prefix_list is not null")
    header = F.concat_ws(
        " ", F.lit("route-policy"), "policy_name", "action", F.lit("node"), F.col("index").cast("string")
    )
    preference = F.col("local_preference")

    def line(step: int, text: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit("").alias("item"), text.alias("text"))

    own = F.array(
        line(1, header),
        F.when(_given(preference), line(4, F.concat(F.lit(" apply local-preference "), preference))),
        F.when(
            F.col("as_path_prepend_count") > 0,
            line(5, F.format_string(" apply as-path %1$s %1$s %1$s additive", _text(asn))),
        ),
        line(6, F.lit("quit")),
    )
    fixed = rendered.select("rule_id", F.inline(F.filter(own, lambda x: x.isNotNull())))
    matches = matched.select(
        "rule_id",
        F.lit(2).alias("step"),
        F.col("prefix_list").alias("item"),
        F.concat(F.lit(" if-match "), F.col("family"), F.lit(" address prefix-list "), F.col("prefix_list")).alias("text"),
    )
    applied = rule_communities(rendered, communities).select(
        "rule_id",
        F.lit(3).alias("step"),
        F.col("name").alias("item"),
        F.concat(F.lit(" apply community "), F.col("value")).alias("text"),
    )
    return fixed.unionByName(matches).unionByName(applied)


def context_commands(policies: DataFrame, keys: list[str], asn: Column | str = ASN) -> DataFrame:
    """Command rows of each policy of a policy context; this form prepends twice."""
    preference = F.col("local_preference")
    lines = F.array(
        F.concat(F.lit("route-policy "), F.col("policy_name"), F.lit(" permit node 10")),
        F.when(F.col("as_path_prepend_count") > 0, F.format_string(" apply as-path %1$s %1$s additive", _text(asn))),
        F.when(preference != 0, F.concat(F.lit(" apply local-preference "), preference.cast("string"))),
        F.lit("quit"),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return policies.select(*keys, "policy_name", F.posexplode(kept).alias("line_no", "text"))


def prefix_list_commands(rules: DataFrame) -> DataFrame:
    """One command per prefix list; other families give none."""
    keyword = F.when(F.col("family") == "ipv4", "ip ip-prefix").when(F.col("family") == "ipv6", "ip ipv6-prefix")
    action = F.when(F.col("action") == "permit", "permit").otherwise("deny")
    command = F.format_string(
        "%s %s index %d %s %s %d", keyword, F.col("list_name"), F.col("index"), action, F.col("ip"), F.col("prefixlen")
    )
    return rules.where(keyword.isNotNull()).select("list_name", command.alias("text"))


def network_commands(rules: DataFrame) -> DataFrame:
    """One network statement per prefix rule."""
    return rules.select(
        "position", F.format_string(" network %s %d", F.col("ip"), F.col("prefixlen")).alias("text")
    )


def drift(desired: DataFrame, current: DataFrame, key: str = "device_id") -> DataFrame:
    """Status of each device's desired text against the current one.

    Both sides are trimmed and hashed before the shuffle, so whole texts are
    compared but only digests move.
    """
    d = desired.select(
        key,
        F.sha2(text.strip("text"), 256).alias("desired_sha"),
        (F.coalesce(text.strip("text"), F.lit("")) == "").alias("_empty"),
    )
    c = current.select(key, F.sha2(text.strip("text"), 256).alias("current_sha"))
    status = (
        F.when(F.coalesce(F.col("_empty"), F.lit(True)), "skipped_empty")
        .when(F.col("current_sha").isNull(), "new")
        .when(F.col("current_sha") == F.col("desired_sha"), "unchanged")
        .otherwise("changed")
    )
    return d.join(c, key, "full_outer").select(key, "desired_sha", "current_sha", status.alias("status"))
