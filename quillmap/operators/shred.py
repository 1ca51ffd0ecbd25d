"""Nested records to related flat tables, by an adjacency table.

Every JSON value becomes a node: ``node, parent, label, ordinal, kind, scalar``. Entity tables are joins of that table:
object nodes with their scalar children, pivoted to columns, and with the object they lie in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.jsontext import parse
from quillmap.session import stage

#: Members under which a record may be wrapped before it is stored.
WRAPPERS = ("payload",)
_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", list: "array", dict: "object"}
NODE_COLUMNS = ("node", "parent", "label", "ordinal", "kind", "scalar")


def parse_record(body: str | None, wrappers: tuple[str, ...] = WRAPPERS, content: tuple[str, ...] = ()):
    """The object a body holds, without its wrappings (JSON text inside a JSON string, an object around the record).

    ``content``: members by which a record is known; an object that has one isn't unwrapped. Bodies that are null, cut off
    or no object give None. Wrappings and nesting may have any depth: each unwrapping leaves less text.
    """
    value = body
    while True:
        if isinstance(value, str):
            try:
                value = parse(value.lstrip("\ufeff"))
            except ValueError:
                return None
        elif isinstance(value, dict) and (inner := next((w for w in wrappers if w in value), None)) and not any(c in value for c in content):
            value = value[inner]
        else:
            break
    return value if isinstance(value, dict) else None


def _scalar(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def adjacency(value, skip: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, str, int, str, str | None]]:
    """Nodes of a value in pre-order; the root is node 0 under parent -1. Members named in ``skip`` are left out whole."""
    stack, number = [(value, -1, "", 0)], 0
    while stack:
        v, parent, label, ordinal = stack.pop()
        kind = _KINDS[type(v)]
        yield number, parent, label, ordinal, kind, None if kind in ("object", "array") else _scalar(v)
        if kind == "object":
            stack.extend((x, number, k, n) for n, (k, x) in reversed(list(enumerate(v.items()))) if k not in skip)
        elif kind == "array":
            stack.extend((x, number, "", n) for n, x in reversed(list(enumerate(v))))
        number += 1


def shred(records: DataFrame, key: str, body: str, content: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """The adjacency table ``key, doc, node, parent, label, ordinal, kind, scalar`` of JSON bodies.

    ``doc`` names the body's content: deliveries of one record with equal bodies have equal rows, with different bodies
    they stay apart. Bodies that aren't one whole JSON object have no rows. Arrays' elements have the empty label and
    their place as ordinal; text is stored as it is, other scalars as JSON. Other columns are ignored; empty tables and
    null bodies give no rows.
    """
    kind, left_out = records.schema[key].dataType.simpleString(), frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            docs: list[int] = []
            rows: list[tuple] = []
            for n, value in enumerate(batch.column(1)):
                text = value.as_py()
                if (record := parse_record(text, content=content)) is None:
                    continue
                doc = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                nodes = list(adjacency(record, left_out))
                rows += nodes
                at += [n] * len(nodes)
                docs += [doc] * len(nodes)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(docs, pa.int64()), *columns], names=["k", "doc", *NODE_COLUMNS])

    source = records.select(records[key].alias("k"), records[body].alias("b")).where(F.col("b").isNotNull())
    out = source.mapInArrow(run, f"k {kind}, doc long, node int, parent int, label string, ordinal int, kind string, scalar string")
    return out.withColumnRenamed("k", key)


def shred_columns(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """The adjacency table of nested columns, each a member of the root object."""
    nested = F.to_json(F.struct(*[records[c] for c in columns]))
    return shred(records.select(records[key].alias("k"), nested.alias("b")), "k", "b").withColumnRenamed("k", key)


class Shredded:
    """Entity tables over one adjacency table. All keep ``key, doc, node`` and the fields of the parents they came by."""

    def __init__(self, nodes: DataFrame, key: str):
        self.nodes, self.key, self.id = nodes, key, [key, "doc"]

    def root(self) -> DataFrame:
        return self.nodes.where(F.col("parent") == -1).select(*self.id, "node")

    def member(self, parents: DataFrame, label: str, kinds: tuple[str, ...] = ("object",)) -> DataFrame:
        """The parents' member of this name, where it is of one of the kinds; ``node`` and ``kind`` are the member's."""
        child = self.nodes.where((F.col("label") == label) & F.col("kind").isin(*kinds))
        return self._below(parents, child.select(*self.id, F.col("parent").alias("_up"), F.col("node").alias("_node"), F.col("kind").alias("_kind")))

    def children(self, parents: DataFrame, name: str, kinds: tuple[str, ...] | None = ("object",), named_by: str | None = None) -> DataFrame:
        """The children of collections, with column ``name``: their label, or in an array their member ``named_by``.

        ``kinds``: those that count, None for all that aren't null. Array elements without a name get none.
        """
        fits = F.col("kind").isin(*kinds) if kinds else F.col("kind") != "null"
        child = self.nodes.where(fits).select(*self.id, F.col("parent").alias("_up"), F.col("node").alias("_node"), F.col("kind").alias("_kind"), F.col("label").alias("_label"))
        found = self._below(parents.withColumnRenamed("kind", "_in"), child, keep="_in")
        if named_by:
            found = found.join(self.fields(named_by), [*self.id, "node"], "left")
            own = F.when(F.col("_in") == "array", F.col(named_by)).otherwise(F.col("_label"))
            found = found.drop(name) if name != named_by and name in found.columns else found
            return found.withColumn("_name", own).drop("_label", "_in", named_by).withColumnRenamed("_name", name)
        return found.withColumn(name, F.when(F.col("_in") != "array", F.col("_label"))).drop("_label", "_in")

    def _below(self, parents: DataFrame, child: DataFrame, keep: str = "") -> DataFrame:
        up = parents.withColumnRenamed("node", "_up")
        up = up.drop("kind") if "kind" in up.columns else up
        return up.join(child, [*self.id, "_up"]).drop("_up").withColumnsRenamed({"_node": "node", "_kind": "kind"})

    def fields(self, *labels: str) -> DataFrame:
        """Scalar children pivoted: ``key, doc, node`` and one text column for each label, of every object that has any."""
        scalars = self.nodes.where(F.col("label").isin(*labels) & ~F.col("kind").isin("object", "array", "null"))
        grouped = scalars.groupBy(*self.id, F.col("parent").alias("node"))
        return grouped.agg(*[F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(x) for x in labels])

    def with_fields(self, entities: DataFrame, *labels: str) -> DataFrame:
        """Entities with columns of their scalar members; missing and null ones are null."""
        return entities.join(self.fields(*labels), [*self.id, "node"], "left")

    def with_own(self, entities: DataFrame, name: str) -> DataFrame:
        """Entities with their own scalar as text; objects and arrays have none."""
        return entities.join(self.nodes.select(*self.id, "node", F.col("scalar").alias(name)), [*self.id, "node"], "left")

    def values(self, entities: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
        """Every scalar at any depth below entities: ``key, doc, node`` of the entity, ``path, kind, value``; nulls have none.

        A path is the chain of labels, in arrays of places, joined by dots; a dot in a label is written ``\\.``. Objects and
        arrays named in ``apart`` right below an entity are left out, being entities of their own.
        """
        child = self.nodes.where("kind != 'null'").select(*self.id, F.col("parent").alias("_at"), F.col("node").alias("_node"), "label", "ordinal", "kind", "scalar")
        level = entities.select(*self.id, "node", F.col("node").alias("_at"), F.lit("").alias("path"), F.lit("object").alias("_in")).distinct()
        parts, inner = [], F.col("kind").isin("object", "array")
        while True:
            below = level.join(child, [*self.id, "_at"]).drop("_at")
            if not parts:
                below = below.where(~(inner & F.col("label").isin(*apart)))
            step = F.when(F.col("_in") == "array", F.col("ordinal").cast("string")).otherwise(F.replace("label", F.lit("."), F.lit("\\.")))
            path = step if not parts else F.concat("path", F.lit("."), step)
            below = stage(below.select(*self.id, "node", F.col("_node").alias("_at"), path.alias("path"), F.col("kind"), "scalar"), "values")
            parts.append(below.where(~inner).select(*self.id, "node", "path", "kind", F.col("scalar").alias("value")))
            level = below.where(inner).select(*self.id, "node", "_at", "path", F.col("kind").alias("_in"))
            if level.isEmpty():
                return reduce(DataFrame.unionByName, parts)

    def with_values(self, entities: DataFrame, **paths: str) -> DataFrame:
        """Entities with a text column for each path below them; missing and null ones are null."""
        found = self.values(entities).where(F.col("path").isin(*paths.values())).groupBy(*self.id, "node")
        wide = found.agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(c) for c, p in paths.items()])
        return entities.join(wide, [*self.id, "node"], "left")
