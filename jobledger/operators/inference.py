"""Schemas that fit a set of JSON documents: types per path, as DDL for reading and as a schema for validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from jobledger.session import materialise

CONTAINERS = ["struct", "array"]

# Parts of JSON text, possessive, so that no text can exhaust the matcher's stack.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_KEY = rf"{_TEXT}\s*+:"
_NUMBER = r"-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_FRACTION = r"-?[0-9]++(?:\.[0-9]++(?:[eE][+-]?[0-9]++)?+|[eE][+-]?[0-9]++)"
# Longer whole numbers stay as they are: whether they are a bigint takes their value.
_WHOLE = r"-?[0-9]{1,18}+(?![0-9.eE])"


def shape(text: Column) -> Column:
    """A JSON text with one value for all of a kind: texts are ``""``, fractions 0.5, whole numbers 0, false is true.

    Keys, order and lengths of lists stay, so a shape has the same kinds at the same paths.  Each
    pattern goes on where the one before ended: what it skips are whole keys and values.
    """
    def each(rows: Column, value: str, skipped: str, by: str) -> Column:
        return F.regexp_replace(rows, rf"(?s)\G((?:{skipped})*+){value}", f"$1{by}")

    text = each(text, _TEXT, rf'[^"]++|{_KEY}', '""')
    text = each(text, _FRACTION, rf'[^"0-9-]++|{_TEXT}|(?!{_FRACTION}){_NUMBER}', "0.5")
    text = each(text, _WHOLE, rf'[^"0-9-]++|{_TEXT}|(?!{_WHOLE}){_NUMBER}', "0")
    return each(text, "false", rf'[^"f]++|{_TEXT}', "true")


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (F.when(name.startswith("OBJECT"), "struct").when(name.startswith("ARRAY"), "array")
             .when(name == "BIGINT", "bigint").when(name.isin("DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "double")
             .when(name == "BOOLEAN", "boolean").when(name.isNull() | (name == "VOID"), "null").otherwise("string"))


def value_kinds(documents: DataFrame, column: str = "doc", most_keys: int = 200) -> DataFrame:
    """How often each kind of value occurs at each path: (path, kind, n).

    Paths read ``$.meta.ts``, ``$.files[]`` (elements) and ``$.cpu{}`` (values
    of a map).  An object path with more than ``most_keys`` different keys is a
    map (kind ``map``, n = 0): its keys are data, not names; a document itself is none.  Texts that are no JSON have no path.

    One pass over the documents counts their shapes; the passes per level of nesting go over
    the different shapes only, with a row per path and kind of each task shuffled.
    """
    spark = documents.sparkSession
    whole = documents.where(F.try_parse_json(F.col(column)).isNotNull())
    shapes = materialise(whole.groupBy(shape(F.col(column)).alias("shape")).agg(F.count("*").alias("times")), "shapes")
    level = shapes.select(F.lit("$").alias("path"), F.try_parse_json("shape").alias("v"), "times")
    found = None
    while True:
        level = level.withColumn("kind", _kind(F.col("v")))
        counts = materialise(level.groupBy("path", "kind").agg(F.sum("times").alias("n")), "kinds")
        found = counts if found is None else found.unionByName(counts)
        if counts.where(F.col("kind").isin(CONTAINERS)).isEmpty():
            return found
        inside = level.where(F.col("kind").isin(CONTAINERS)).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        keys = inside.where("kind = 'struct'").groupBy("path").agg(F.count_distinct("key").alias("keys"))
        maps = [r.path for r in keys.where((F.col("keys") > most_keys) & (F.col("path") != "$")).select("path").collect()]
        if maps:
            found = found.unionByName(spark.createDataFrame([(p, "map", 0) for p in maps], "path string, kind string, n long"))
        own = F.when(F.col("kind") == "array", "[]").when(F.col("path").isin(maps), "{}").otherwise(F.concat(F.lit("."), "key"))
        level = inside.select(F.concat("path", own).alias("path"), F.col("value").alias("v"), "times")


def _join(kinds: set[str]) -> str:
    """The smallest type that holds all kinds: null < bigint < double, one container, else text."""
    real = kinds - {"null", "map"}
    if "map" in kinds and real == {"struct"}:
        return "map"
    if real == {"bigint", "double"}:
        return "double"
    return real.pop() if len(real) == 1 else "string" if real else "null"


@dataclass
class Node:
    """One path of an inferred schema; ``n`` values, of which ``nulls`` are null."""

    type: str = "null"
    kinds: set[str] = field(default_factory=set)
    n: int = 0
    nulls: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def _steps(path: str) -> list[str]:
    """``$.a.b[]`` as [".a", ".b", "[]"]; a key may hold any sign but these."""
    out, at = [], 1
    while at < len(path):
        if path[at:at + 2] in ("[]", "{}"):
            out.append(path[at:at + 2])
            at += 2
            continue
        end = min((k for k in (path.find(s, at + 1) for s in (".", "[]", "{}")) if k > 0), default=len(path))
        out.append(path[at:end])
        at = end
    return out


def _unite(left: Node, right: Node) -> Node:
    """Two nodes as one: the fold of the values of a map."""
    names = left.children.keys() | right.children.keys()
    children = {k: _unite(left.children.get(k, Node()), right.children.get(k, Node())) for k in names}
    kinds = left.kinds | right.kinds
    return Node(_join(kinds), kinds, left.n + right.n, left.nulls + right.nulls, children)


def infer(documents: DataFrame, column: str = "doc", most_keys: int = 200) -> Node:
    """The schema of all documents as a tree.

    Only counts per path reach the driver: as many as the schema has paths, since objects
    with many keys are maps.  Where objects or lists meet other kinds of value, the type is
    text and nothing below it counts.
    """
    root = Node()
    for r in sorted(value_kinds(documents, column, most_keys).collect(), key=lambda r: (len(r.path), r.path, r.kind)):
        node = root
        for name in _steps(r.path):
            node = node.children.setdefault(name, Node())
        node.kinds.add(r.kind)
        node.n += r.n
        node.nulls += r.n if r.kind == "null" else 0
    _fold(root)
    return root


def _fold(node: Node) -> None:
    node.type = _join(node.kinds)
    if node.type not in ("struct", "array", "map"):
        node.children = {}
    for child in node.children.values():
        _fold(child)


def rows(node: Node, path: str = "$") -> list[tuple[str, str, int, int]]:
    """(path, type, n, nulls) of a schema, from the root down."""
    out = [(path, node.type, node.n, node.nulls)]
    for name in sorted(node.children):
        out += rows(node.children[name], path + name)
    return out


def type_rows(documents: DataFrame, column: str = "doc", most_keys: int = 200) -> DataFrame:
    """The inferred schema as a table: path, type, how many values, how many of them null."""
    return documents.sparkSession.createDataFrame(rows(infer(documents, column, most_keys)), "path string, type string, n long, nulls long")


def _ddl_type(node: Node) -> str:
    if node.type == "struct":
        parts = ",".join(f"`{name[1:].replace('`', '``')}`:{_ddl_type(c)}" for name, c in sorted(node.children.items()))
        return f"struct<{parts}>" if parts else "string"
    if node.type == "array":
        return f"array<{_ddl_type(node.children.get('[]', Node()))}>"
    if node.type == "map":
        return f"map<string,{_ddl_type(node.children.get('{}', Node()))}>"
    return "string" if node.type == "null" else node.type


def ddl(node: Node) -> str:
    """The schema as DDL, as ``read_reports`` takes it; what is always null, and objects without fields, are read as text."""
    return ", ".join(f"`{name[1:].replace('`', '``')}` {_ddl_type(c)}" for name, c in sorted(node.children.items()))


# Names of basic types in a validation schema.
NAMES = {"bigint": "long", "double": "double", "boolean": "boolean", "string": "string", "null": "null"}


def _validation_type(node: Node, expected: int) -> object:
    """``expected`` is the number of places the value could stand at; where it is missing or null the type has ``null``."""
    optional = node.nulls > 0 or node.n < expected
    if node.type == "struct":
        return {"type": "record", **validation_schema(node)}
    if node.type == "array":
        items = node.children.get("[]", Node())
        inner = _validation_type(items, items.n)
        if not isinstance(inner, dict):  # ``null`` among the items says that the list may be empty
            inner = [x for x in (inner if isinstance(inner, list) else [inner]) if x != "null"] + ["null"]
        return {"type": "array", "items": inner}
    if node.type == "map":
        values = node.children.get("{}", Node())
        return {"type": "map", "values": _validation_type(values, values.n)}
    kinds = node.kinds & NAMES.keys() or {"string"}
    if "double" in kinds:
        kinds = kinds - {"bigint"}
    names = sorted(NAMES[k] for k in kinds - {"null"}) + (["null"] if optional else [])
    return names if len(names) != 1 else names[0]


def validation_schema(node: Node) -> dict:
    """The schema as ``validate`` takes it; a value that came in several basic types may have any of them."""
    return {"fields": [{"name": name[1:], "type": _validation_type(c, node.n - node.nulls)} for name, c in sorted(node.children.items())]}
