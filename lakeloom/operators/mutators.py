"""The update language of documents, compiled to column expressions.

A document is taken apart when the plan is built into a tree of columns, one for each field; operations change the tree, and at
the end it becomes a struct again. So a list of operations of any length is one projection, without Python at run time. A
field that a document lacks and one that is null are the same, as in any struct.

Operations are dicts with ``op``, ``property`` (a dotted path) and ``value``; ``conditional`` has ``conditions`` (dicts with ``test``,
``property``, ``value``) and ``operations``; ``mergeSets`` takes its list as ``values`` or ``value``. Missing and unknown arguments are errors. legacy=True keeps some surprising results: ``max`` and ``min`` take a stored 0 for missing,
``merge`` leaves what isn't there or isn't an object as it is, ``reverseMerge`` replaces scalars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.predicates import literal, test_of

Tree = dict[str, "Leaf | Tree"]


class Leaf:
    """A field's column and whether it holds an array; ``kind`` is the type where it's known."""

    def __init__(self, column: Column, is_array: bool = False, is_text: bool = False):
        self.column, self.is_array, self.is_text = column, is_array, is_text


def take_apart(doc: Callable[[str], Column], schema: T.StructType) -> Tree:
    """The tree of a document whose fields are got by name."""
    out: Tree = {}
    for f in schema.fields:
        c = doc(f.name)
        if isinstance(f.dataType, T.StructType):
            out[f.name] = take_apart(lambda n, c=c: c.getField(n), f.dataType)
        else:
            out[f.name] = Leaf(c, isinstance(f.dataType, T.ArrayType), isinstance(f.dataType, T.StringType))
    return out


def put_together(tree: Tree) -> Column:
    """The struct of a tree; an inner struct is null if all its fields are."""
    return F.struct(*[_column(v).alias(k) for k, v in tree.items()])


def _column(node: Leaf | Tree) -> Column:
    if isinstance(node, Leaf):
        return node.column
    there = F.coalesce(*[F.when(_column(v).isNotNull(), True) for v in node.values()])
    return F.when(there, put_together(node))


def _leaf(value: Any) -> Leaf | Tree:
    if isinstance(value, dict) and value:
        return {k: _leaf(v) for k, v in value.items()}
    return Leaf(literal(value), isinstance(value, (list, tuple)), isinstance(value, str))


def _none(node: Leaf | Tree) -> Leaf | Tree:
    """Null of the same type."""
    if isinstance(node, Leaf):
        return Leaf(F.when(F.lit(False), node.column), node.is_array, node.is_text)
    return {k: _none(v) for k, v in node.items()}


def _get(tree: Tree, path: str) -> Leaf | Tree | None:
    node: Any = tree
    for name in path.split("."):
        if not isinstance(node, dict) or name not in node:
            return None
        node = node[name]
    return node


def _set(tree: Tree, path: str, node: Leaf | Tree) -> Tree:
    """A copy of the tree with the node at the path, parents made where they're missing."""
    name, _, rest = path.partition(".")
    if not rest:
        return tree | {name: node}
    inner = tree.get(name)
    return tree | {name: _set(inner if isinstance(inner, dict) else {}, rest, node)}


def _as_array(node: Leaf | Tree | None, like: Leaf) -> Column:
    """The current value as a set: a scalar is a set of one, nothing the empty set."""
    empty = F.slice(F.array(like.column), 1, 0) if not like.is_array else F.slice(like.column, 1, 0)
    if node is None:
        return empty
    if not isinstance(node, Leaf):
        return F.coalesce(F.when(_column(node).isNotNull(), F.array(_column(node))), empty)
    return F.coalesce(node.column if node.is_array else F.when(node.column.isNotNull(), F.array(node.column)), empty)


def _merge(old: Leaf | Tree | None, new: Leaf | Tree, ours_wins: bool, legacy: bool) -> Leaf | Tree:
    if old is None:
        return new
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: _merge(old.get(k), new[k], ours_wins, legacy) if k in new else old[k] for k in [*old, *[k for k in new if k not in old]]}
    if isinstance(old, Leaf) and isinstance(new, dict):  # a scalar is kept against an object
        return old
    a, b = _column(old), _column(new)
    array = isinstance(new, Leaf) and new.is_array
    return Leaf(F.coalesce(a, b) if ours_wins else b, array, isinstance(new, Leaf) and new.is_text)


def _choose(condition: Column, yes: Leaf | Tree | None, no: Leaf | Tree | None) -> Leaf | Tree:
    if isinstance(yes, dict) and isinstance(no, dict):
        return {k: _choose(condition, yes.get(k), no.get(k)) for k in [*no, *[k for k in yes if k not in no]]}
    if yes is None:
        yes = _none(no)
    if no is None:
        if isinstance(yes, dict):
            return {k: _choose(condition, v, None) for k, v in yes.items()}
        return Leaf(F.when(condition, yes.column), yes.is_array, yes.is_text)
    same = next(x for x in (yes, no) if isinstance(x, Leaf))
    return Leaf(F.when(condition, _column(yes)).otherwise(_column(no)), same.is_array, same.is_text)


def mutate(tree: Tree, operations: Sequence[dict], legacy: bool = False) -> Tree:
    """The tree after the operations, one after the other."""
    for o in operations:
        tree = _mutate(tree, o, legacy)
    return tree


#: For each operation what it needs besides ``op``.
NEEDED = {"delete": {"property"}, "conditional": {"conditions", "operations"}, "merge": {"value"}, "reverseMerge": {"value"}} | {
    op: {"property", "value"} for op in ("set", "addToSet", "deleteFromSet", "mergeSets", "add", "max", "min")
}


def _check(op: Any, o: dict) -> None:
    if op not in NEEDED:
        raise ValueError(f"unknown operation {op!r}")
    given = {"value" if op == "mergeSets" and k == "values" else k for k, v in o.items() if k != "op" and not (v is None and k in ("property", "value") and k not in NEEDED[op])}
    if missing := NEEDED[op] - given or (NEEDED[op] & {"property"} and not o.get("property") and {"property"}):
        raise ValueError(f"{op} lacks {', '.join(sorted(missing))}")
    if unknown := given - NEEDED[op] - ({"property"} if op in ("merge", "reverseMerge") else set()):
        raise ValueError(f"{op} doesn't know {', '.join(sorted(unknown))}")


def _mutate(tree: Tree, o: dict, legacy: bool) -> Tree:
    op, path = o.get("op"), o.get("property")
    _check(op, o)
    value = o["values"] if op == "mergeSets" and "values" in o else o.get("value")
    if op == "conditional":
        passed = F.lit(True)
        for c in o["conditions"]:
            at = _get(tree, c["property"])
            passed = passed & test_of(c["test"])(_column(at) if at is not None else F.lit(None), literal(c.get("value")))
        return _choose(passed, mutate(tree, o["operations"], legacy), tree)  # type: ignore[return-value]
    old = _get(tree, path) if path else tree
    if op == "delete":
        return tree if old is None else _set(tree, path, _none(old))
    new = _leaf(value)
    if op in ("merge", "reverseMerge"):
        return _merge_at(tree, path, old, new, op == "reverseMerge", legacy)
    if op == "set":
        return _set(tree, path, new)
    if op in ("addToSet", "deleteFromSet"):
        rest = F.filter(_as_array(old, Leaf(_column(new))), lambda x: ~x.eqNullSafe(_column(new)))
        return _set(tree, path, Leaf(F.concat(rest, F.array(_column(new))) if op == "addToSet" else rest, True))
    if op == "mergeSets":
        values = _column(new) if new.is_array else F.array(_column(new))
        return _set(tree, path, Leaf(F.array_union(values, _as_array(old, Leaf(values, True))), True))
    number = _column(new)
    if old is None:
        return _set(tree, path, new)
    now = _column(old)
    if op == "add":
        return _set(tree, path, Leaf(F.concat(F.coalesce(now, F.lit("")), number) if new.is_text or old.is_text else F.coalesce(now, F.lit(0)) + number, False, new.is_text))
    if legacy:
        now = F.when(now != 0, now)
    return _set(tree, path, Leaf(F.greatest(now, number) if op == "max" else F.least(now, number)))


def _merge_at(tree: Tree, path: str | None, old: Any, new: Any, reverse: bool, legacy: bool) -> Tree:
    if not path:
        if not isinstance(new, dict):
            raise ValueError("a merge into the whole document needs an object")
        return _merge(tree, new, reverse, legacy)  # type: ignore[return-value]
    if isinstance(old, dict) and isinstance(new, dict):
        return _set(tree, path, _merge(old, new, reverse, legacy))
    if legacy:
        return _set(tree, path, new) if reverse else tree
    return _set(tree, path, _merge(old, new, reverse, legacy))


def compile_update(schema: T.StructType, operations: Sequence[dict], doc: Column | None = None, legacy: bool = False) -> Column:
    """The struct of the document after the operations; of the row's columns, or of the struct ``doc``. A null doc is one without fields."""
    fields = (lambda n: doc.getField(n)) if doc is not None else F.col
    return put_together(mutate(take_apart(fields, schema), operations, legacy))
