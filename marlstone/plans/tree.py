"""Catalyst plans as small Python trees.

One JSON text per plan crosses from the JVM; everything else is walked here.
This is the only module, with ``rewrite.py``, that touches the JVM plan classes,
which a Spark Connect session does not offer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Node:
    """A plan or expression node: class name, plain fields, children, nested trees."""

    name: str
    fields: dict[str, Any]
    children: list[Node] = field(default_factory=list)
    nested: dict[str, list[Node]] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        """This node and all below, nested expressions and plans included."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += node.children
            for trees in node.nested.values():
                todo += trees

    def depth(self) -> int:
        deepest, todo = 0, [(self, 1)]
        while todo:
            node, at = todo.pop()
            deepest = max(deepest, at)
            todo += [(c, at + 1) for c in node.children]
            todo += [(c, at + 1) for trees in node.nested.values() for c in trees]
        return deepest

    @property
    def expr_id(self) -> str | None:
        said = self.fields.get("exprId")
        return f"{said['id']}:{said.get('jvmId', '')}" if isinstance(said, dict) else None

    @property
    def parts(self) -> list[str]:
        """Name parts of an unresolved name, as Scala prints a list."""
        said = self.fields.get("nameParts") or self.fields.get("multipartIdentifier") or "[]"
        return [p.strip() for p in said.strip("[]").split(",")] if isinstance(said, str) else list(said)


def _is_tree(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict) and "class" in value[0] and "num-children" in value[0]


def _trees(value: Any) -> list[Node]:
    if _is_tree(value):
        return [build(value)]
    if isinstance(value, list):
        return [t for v in value for t in _trees(v)]
    return []


def build(rows: list[dict]) -> Node:
    """A tree from Catalyst's preorder list of nodes."""
    at = 0

    def one() -> Node:
        nonlocal at
        row = rows[at]
        at += 1
        node = Node(row["class"].rsplit(".", 1)[-1].rstrip("$"), {})
        for k, v in row.items():
            if trees := _trees(v):
                node.nested[k] = trees
            elif k not in ("class", "num-children"):
                node.fields[k] = v
        node.children = [one() for _ in range(row["num-children"])]
        return node

    return one()


def parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def sequence(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def unresolved(jplan) -> Node:
    """The parsed plan.  CTE bodies, which are no children, hang under ``cte``."""
    root = build(json.loads(jplan.toJSON()))
    withs = [n for n in _plan_nodes(root) if n.name == "UnresolvedWith"]
    found, todo = [], [jplan]
    while todo:
        j = todo.pop()
        if j.getClass().getSimpleName() == "UnresolvedWith":
            found.append(j)
        todo += reversed(sequence(j.children()))
    for node, j in zip(withs, found, strict=True):
        bodies = []
        for pair in sequence(j.cteRelations()):
            body = unresolved(pair._2())
            body.fields["cte_name"] = pair._1()
            bodies.append(body)
        node.nested["cte"] = bodies
    return root


def _plan_nodes(root: Node) -> Iterator[Node]:
    """Preorder over plan children only."""
    yield root
    for c in root.children:
        yield from _plan_nodes(c)


def analyzed(frame) -> Node:
    return build(json.loads(frame._jdf.queryExecution().analyzed().toJSON()))
