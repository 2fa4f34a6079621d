import ipaddress
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmeter.functions import address, probes, text
from pathmeter.operators import inventory, jsonpaths, policy
from pathmeter.sources import dumps


def test_leaf_paths(spark):
    docs = [
        (1, '{"a":1,"b":{"c":[1,"x",null]},"e":{},"f":true}'), (2, "3"), (3, "{bad"), (4, None), (5, "[]"),
        (6, '[{"p":1.0},[[2]]]'), (7, '{"a":1,"a":2}'),
    ]
    got = jsonpaths.leaf_paths(spark.createDataFrame(docs, "doc_id bigint, doc string")).collect()
    assert {tuple(r) for r in got} == {
        (1, "a", "1", "int"), (1, "b.c[0]", "1", "int"), (1, "b.c[1]", "x", "str"), (1, "b.c[2]", "None", "NoneType"),
        (1, "f", "True", "bool"), (6, "[0].p", "1.0", "float"), (6, "[1][0][0]", "2", "int"), (7, "a", "2", "int"),
    }


def test_deep_and_wide_documents(spark):
    deep = "[" * 300 + "1" + "]" * 300
    wide = json.dumps({"x": list(range(50_000))})
    df = spark.createDataFrame([(1, deep), (2, wide)], "doc_id bigint, doc string")
    counts = {r.doc_id: r["count"] for r in jsonpaths.leaf_paths(df).groupBy("doc_id").count().collect()}
    assert counts == {1: 1, 2: 50_000}


trees = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=2), inner, max_size=3),
    max_leaves=12,
)


def recursive(tree, path=""):
    if isinstance(tree, dict):
        return [p for k, v in tree.items() for p in recursive(v, f"{path}.{k}" if path else k)]
    if isinstance(tree, list):
        return [p for i, v in enumerate(tree) for p in recursive(v, f"{path}[{i}]")]
    return [(path, str(tree), type(tree).__name__)]


@settings(max_examples=200, deadline=None)
@given(st.lists(trees, max_size=3) | st.dictionaries(st.text("xy", min_size=1), trees, max_size=3))
def test_walker_equals_recursion(tree):
    paths, values, types = [], [], []
    jsonpaths.add_leaves([("", tree)], paths, values, types)
    assert list(zip(paths, values, types)) == recursive(tree)
    assert [(path, str(v), type(v).__name__) for path, v in jsonpaths.deep_leaves(tree)] == recursive(tree)


def read_or_error(parse, doc):
    try:
        return repr(parse(doc))
    except ValueError:
        return "error"


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_deep_parser_equals_the_standard_one(data):
    """On whole documents, and on ones with characters put in, taken out or changed."""
    tree = data.draw(st.recursive(
        st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=4),
        lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=2), inner, max_size=3), max_leaves=8,
    ))
    doc = json.dumps(tree, indent=data.draw(st.none() | st.integers(0, 2)), ensure_ascii=data.draw(st.booleans()))
    for _ in range(data.draw(st.integers(0, 2))):
        at = data.draw(st.integers(0, len(doc)))
        doc = doc[:at] + data.draw(st.sampled_from(list('{}[]",:-.0e1 \\nt') + [""])) + doc[at + data.draw(st.integers(0, 1)):]
    assert read_or_error(jsonpaths.parse_deep, doc) == read_or_error(json.loads, doc)


def test_deep_parser_takes_the_last_of_equal_names_at_the_first_place():
    doc = '{"a": 1, "b": [{"": {"x": 1e2}}], "a": NaN, "": {"y": -Infinity}}'
    assert repr(jsonpaths.parse_deep(doc)) == repr(json.loads(doc))
    assert [p for p, _ in jsonpaths.deep_leaves(json.loads(doc))] == ["a", "b[0]..x", "y"]


def test_strip_and_preview(spark):
    samples = ["  a b \n", " x ", "\x1c\x85", "", "y" * 50, "y" * 51]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(text.strip("s").alias("t"), text.preview("s").alias("p")).collect()
    assert [r.t for r in got] == [s.strip() for s in samples]
    assert [r.p for r in got] == [s[:50] + ("..." if len(s) > 50 else "") for s in samples]


def test_merge_fields_keeps_fields_without_updates(spark):
    df = spark.createDataFrame([({"a": "1"}, None), (None, {"b": "2"}), (None, None)], "c map<string,string>, u map<string,string>")
    assert [r[0] for r in df.select(text.merge_fields("c", "u")).collect()] == [{"a": "1"}, {"b": "2"}, {}]


def test_very_deep_documents_are_read(spark):
    n = 200_000
    docs = [
        (1, "[" * n + "]" * n), (2, '{"a": 1}'), (3, "[" * n + "7,[true" + "]" * n + "]"), (4, '{"k":' * n + "null" + "}" * n),
        (5, "[" * n + "1" + "]" * (n - 1)), (6, "[" * n + "1" + "]" * (n + 1)),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, doc string")
    got = {(r.doc_id, r.path, r.value, r.type) for r in jsonpaths.leaf_paths(df).collect()}
    assert got == {
        (2, "a", "1", "int"), (3, "[0]" * n, "7", "int"), (3, "[0]" * (n - 1) + "[1][0]", "True", "bool"),
        (4, ".".join("k" * n), "None", "NoneType"),
    }


def test_leaves_of_one_document_come_in_batches(spark):
    doc = json.dumps({"x": list(range(3 * jsonpaths.BATCH + 5)), "y": "end"})
    got = jsonpaths.leaf_paths(spark.createDataFrame([(None, doc), (2**53 + 1, doc)], "doc_id bigint, doc string"))
    rows = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("int")).alias("s")).collect()
    k = 3 * jsonpaths.BATCH + 5
    assert {tuple(r) for r in rows} == {(None, k + 1, k * (k - 1) // 2), (2**53 + 1, k + 1, k * (k - 1) // 2)}


def test_address_family_is_that_of_the_standard_library(spark):
    rng = random.Random(6)
    parts = ["1", "255", "256", "01", ".", ".", ":", "::", "ffff", "fe80", "12345", "%", "eth0", "g", " "]
    texts = {"".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)} | {":".join("1" * n) for n in range(10)}
    texts |= {"1.2.3.4", "::", "::1", "fe80::1%eth0", "::1%", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4\n", "::1\n", "", "::1.2.3.4.5"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "a string")
    for r in df.select("a", address.address_family("a").alias("f")).collect():
        try:
            want = None if r.a is None else str(ipaddress.ip_address(r.a).version)
        except ValueError:
            want = None
        assert r.f == want, r.a


def test_merge_fields_overwrites_with_null(spark):
    df = spark.sql("select map('a', '1', 'b', '2') c, map('b', cast(null as string), 'n', '3') u")
    assert df.select(text.merge_fields("c", "u")).first()[0] == {"a": "1", "b": None, "n": "3"}


def test_netmasks_and_split(spark):
    df = spark.createDataFrame([("10.0.0.1/0",), ("10.0.0.1/22",), ("10.0.0.1/32",), ("10.0.0.1",), (None,)], "a string")
    got = df.select(address.host_part("a"), address.netmask(address.prefix_length("a")), address.router_id("a")).collect()
    assert [tuple(r) for r in got] == [
        ("10.0.0.1", "0.0.0.0", "10.0.0.1"), ("10.0.0.1", "255.255.252.0", "10.0.0.1"),
        ("10.0.0.1", "255.255.255.255", "10.0.0.1"), ("10.0.0.1", None, "10.0.0.1"), (None, None, "0.0.0.0"),
    ]


def test_ping_average(spark):
    ok = "PING x\nrtt min/avg/max/mdev = 0.1/12.5/9/0.2 ms\n"
    rows = [(ok, 0), (ok, 1), ("none\n", 0), ("a/avg/b/c/1.5f/d", 0), ("avg\n" + ok, 0), (None, 0)]
    df = spark.createDataFrame(rows, "o string, r int")
    inf = float("inf")
    assert [r[0] for r in df.select(probes.ping_average("o", "r")).collect()] == [12.5, inf, inf, inf, inf, inf]


def test_hop_choice(spark):
    hubs = [(1, "p", 1.0), (2, "p", 2.0), (4, "x", 3.0), (4, "d", 4.0)]
    df = spark.createDataFrame([(hubs, "p"), ([], "p"), (None, "p")], "hubs array<struct<count:int,host:string,Avg:double>>, ip string")
    got = df.select(probes.final_hop("hubs"), probes.peer_hop("hubs", "ip"), probes.first_peer_hop("hubs", "ip")).collect()
    assert [h.Avg for h in got[0]] == [4.0, 2.0, 1.0]
    assert list(got[1]) == list(got[2]) == [None, None, None]


def test_api_pages_single_line_and_per_file(spark, tmp_path):
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    page = {"count": 2, "results": [{"id": 1, "name": "a"}, {"id": 2}]}
    one = {"id": 3, "name": "c", "other": [1]}
    empty = {"results": []}
    lines, files = tmp_path / "lines", tmp_path / "files"
    lines.mkdir(), files.mkdir()
    (lines / "d.json").write_text("\n".join(map(json.dumps, (page, one, empty))))
    for i, doc in enumerate((page, one, empty)):
        (files / f"{i}.json").write_text(json.dumps(doc, indent=2))
    want = {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in dumps.read_pages(spark, str(lines), item).collect()} == want
    assert {tuple(r) for r in dumps.read_pages(spark, str(files), item, multi_line=True).collect()} == want


def test_lists_of_a_hot_device_are_paged_whole(spark):
    rows = [(0, i, f"n{i}") for i in range(1000)] + [(d, 2000 + d, "x") for d in range(1, 10)]
    df = spark.createDataFrame(rows, "device_id bigint, id bigint, name string")
    pages = inventory.paged_lists(df, "device_id", "id", F.struct("id", "name"), "items", page=50).collect()
    hot = [p for p in pages if p.device_id == 0]
    assert len(hot) == 20 and max(len(p["items"]) for p in hot) < 120
    assert sorted(x.id for p in hot for x in p["items"]) == list(range(1000))
    assert all(p.page == 0 and len(p["items"]) == 1 for p in pages if p.device_id)


def test_paged_documents_hold_everything(spark):
    devices = spark.createDataFrame([(0, "r0"), (1, "r1")], "device_id bigint, name string")
    interfaces = spark.createDataFrame([(i, 0, f"e{i}", True) for i in range(90)], "interface_id bigint, device_id bigint, name string, enabled boolean")
    addresses = spark.createDataFrame([(i, 0, f"a{i}", 4) for i in range(300)], "address_id bigint, interface_id bigint, address string, family int")
    sessions = spark.createDataFrame([(i, 0, f"s{i}", 65000) for i in range(40)], "session_id bigint, device_id bigint, remote_address string, remote_asn int")
    docs = inventory.device_documents(devices, interfaces, addresses, sessions, page=20).collect()
    found = [i for d in docs for i in d.interfaces or []]
    assert {i.interface_id for i in found} == set(range(90))
    assert sorted(a.address_id for i in found for a in i.ip_addresses) == list(range(300))
    assert sorted(s.session_id for d in docs for s in d.bgp_sessions or []) == list(range(40))
    assert [(d.page, d.interfaces) for d in docs if d.device_id == 1] == [(0, None)]


def test_policy_commands_skip_what_is_not_set(spark):
    df = spark.createDataFrame(
        [("A", ["x"], "", None, None), ("B", [], "c", "100", 0), ("C", [], None, "0", 2), ("D", [], None, None, -1)],
        "policy_name string, match_ipv6_address array<string>, apply_community string, local_preference string, as_path_prepend_count int",
    )
    got = {}
    for r in policy.policy_commands(df, ["policy_name"]).orderBy("policy_name", "line_no").collect():
        got.setdefault(r.policy_name, []).append(r.text)
    assert got["A"] == ["route-policy A permit node 10", " if-match ipv6 address prefix-list x", "quit"]
    assert got["B"][1:] == [" apply community c", " apply local-preference 100", " undo apply as-path", "quit"]
    assert got["C"][1:] == [" apply local-preference 0", " apply as-path 65000 65000 additive", "quit"]
    assert got["D"][1:] == ["quit"]


def test_drift_statuses(spark):
    desired = spark.createDataFrame([(1, "a\n"), (2, "b"), (3, "c"), (4, " \n")], "device_id bigint, text string")
    current = spark.createDataFrame([(1, " a"), (2, "B"), (4, "d"), (5, "e")], "device_id bigint, text string")
    got = {r.device_id: r.status for r in policy.drift(desired, current).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "new", 4: "skipped_empty", 5: "skipped_empty"}
