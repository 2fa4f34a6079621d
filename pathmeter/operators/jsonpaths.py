"""Leaf paths of arbitrary JSON documents.

The nesting is unknown, so no fixed chain of generators can unfold it. A small
walker runs over Arrow batches inside the tasks: one narrow pass without
shuffle, at any depth. A document is parsed as a whole; its leaves are given
out in batches while it is walked, so they do not pile up. Unfolding variants level by level gave the same rows but
took two to three times as long.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmeter import session
from pathmeter.functions import text

BATCH = 20_000


# What may follow in a document: white space, marks, and the scalars but strings.
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def parse_deep(doc: str):
    """What ``json.loads`` gives, with open containers on a list instead of the call stack.

    Slower than the standard parser, so it only takes the documents that nest
    deeper than that one goes.
    """
    end = _SPACE.match(doc, 0).end()
    root: list = []
    # Container, and the name of the member that is read in an object.
    spot: list[tuple] = [(root, None)]
    while True:
        holder, name = spot[-1]
        mark = doc[end : end + 1]
        opened = None
        if mark == '"':
            node, end = scanstring(doc, end + 1)
        elif mark == "{" or mark == "[":
            node = opened = {} if mark == "{" else []
            end += 1
        else:
            found = _SCALAR.match(doc, end)
            if not found:
                raise ValueError(f"no value at {end}")
            word = found.group()
            if word in _NAMED:
                node = _NAMED[word]
            else:
                node = int(word) if found.group(2) is None and found.group(3) is None else float(word)
            end = found.end()
        if isinstance(holder, dict):
            holder[name] = node
        else:
            holder.append(node)
        end = _SPACE.match(doc, end).end()
        if opened is not None:
            if doc[end : end + 1] != ("}" if mark == "{" else "]"):
                name = None
                if mark == "{":
                    name, end = _member(doc, end)
                spot.append((opened, name))
                continue
            end = _SPACE.match(doc, end + 1).end()
        # After a value: the next item, or the ends of containers.
        while len(spot) > 1:
            holder = spot[-1][0]
            mark = doc[end : end + 1]
            if mark == ",":
                end = _SPACE.match(doc, end + 1).end()
                if isinstance(holder, dict):
                    name, end = _member(doc, end)
                    spot[-1] = (holder, name)
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"open container at {end}")
            spot.pop()
            end = _SPACE.match(doc, end + 1).end()
        else:
            if end != len(doc):
                raise ValueError(f"text after the end at {end}")
            return root[0]


def _member(doc: str, end: int) -> tuple[str, int]:
    """Name of a member and where its value begins."""
    if doc[end : end + 1] != '"':
        raise ValueError(f"no name at {end}")
    name, end = scanstring(doc, end + 1)
    end = _SPACE.match(doc, end).end()
    if doc[end : end + 1] != ":":
        raise ValueError(f"no colon at {end}")
    return name, _SPACE.match(doc, end + 1).end()


def add_leaves(todo: list[tuple[str, object]], paths: list[str], values: list[str], types: list[str]) -> None:
    """Append path, text and type name of leaves in document order, until a batch is full.

    ``todo`` holds paths and nodes yet to walk, the next one last; with nodes
    left in it, a further call goes on from there.
    """
    while todo and len(paths) < BATCH:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo.extend([(f"{path}.{k}" if path else k, node[k]) for k in reversed(node)])
        elif isinstance(node, list):
            todo.extend([(f"{path}[{i}]", node[i]) for i in range(len(node) - 1, -1, -1)])
        else:
            paths.append(path)
            values.append(str(node))
            types.append(type(node).__name__)


def deep_leaves(tree: dict | list) -> Iterator[tuple[str, object]]:
    """Path and value of each leaf in document order.

    Paths are put together at leaves only, so a chain of n levels costs n steps
    and not the sum of n paths.
    """
    parts: list[str] = []
    # Children yet to come, and whether the path so far is not empty.
    opened = [(_children(tree, False), False)]
    while opened:
        children, named = opened[-1]
        for part, node in children:
            if isinstance(node, (dict, list)):
                parts.append(part)
                named = named or part != ""
                opened.append((_children(node, named), named))
                break
            yield "".join(parts) + part, node
        else:
            opened.pop()
            if opened:
                parts.pop()


def _children(node: dict | list, named: bool) -> Iterator[tuple[str, object]]:
    if isinstance(node, dict):
        dot = "." if named else ""
        return ((dot + k, v) for k, v in node.items())
    return ((f"[{i}]", v) for i, v in enumerate(node))


def leaf_batches(doc: str | None, paths: list[str], values: list[str], types: list[str]) -> Iterator[None]:
    """Append the leaves of a document; stops for the caller whenever a batch is full."""
    deep = False
    try:
        tree = json.loads(doc) if doc is not None else None
    except RecursionError:
        deep = True
    except ValueError:
        return
    if deep:
        try:
            tree = parse_deep(doc)
        except ValueError:
            return
        for path, node in deep_leaves(tree) if isinstance(tree, (dict, list)) else ():
            paths.append(path)
            values.append(str(node))
            types.append(type(node).__name__)
            if len(paths) >= BATCH:
                yield
        return
    todo = [("", tree)] if isinstance(tree, (dict, list)) else []
    while todo:
        add_leaves(todo, paths, values, types)
        if len(paths) >= BATCH:
            yield


def leaf_paths(documents: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(key, path, value, type) of every scalar below the root.

    Empty containers, documents that are a bare scalar and unreadable text give
    no rows, however deep they nest. Types carry Python's names: str, int,
    float, bool, NoneType.
    """
    names = ["key", "path", "value", "type"]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, values, types, owner = [], [], [], []

            def full() -> pa.RecordBatch:
                out = pa.record_batch([batch.column(0).take(pa.array(owner)), paths, values, types], names)
                for column in (paths, values, types, owner):
                    column.clear()
                return out

            for row, doc in enumerate(batch.column(1)):
                for _ in leaf_batches(doc.as_py(), paths, values, types):
                    owner.extend([row] * (len(paths) - len(owner)))
                    yield full()
                owner.extend([row] * (len(paths) - len(owner)))
            if paths:
                yield full()

    out = documents.select(F.col(key).alias("key"), doc).mapInArrow(
        walk, "key bigint, path string, value string, type string"
    )
    return out.withColumnRenamed("key", key)


def type_histogram(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def listing(leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paths in order within their type; the key breaks ties, so a path that
    occurs in very many documents still spreads over the sort's ranges.

    The leaves are stored first: a global sort reads its input twice, once to
    find the ranges.
    """
    stored = session.materialize(leaves, "leaves")
    return stored.withColumn("preview", text.preview("value")).orderBy("type", "path", key)
