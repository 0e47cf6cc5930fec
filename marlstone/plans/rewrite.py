"""Rewrites of parsed plans: the small-cell condition and the cell counts.

The statement's one grouping of customers is found under limits, sorts and
HAVING at the top of the plan; anything else is refused, never guessed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import TABLES
from .policy import Refused, table_name
from .tree import parser, sequence

WRAPPERS = ("GlobalLimit", "LocalLimit", "Offset", "Sort", "UnresolvedHaving")
CELL_CUSTOMERS, CELL_ROWS, CELL_DIM = "_cell_customers", "_cell_rows", "_cell_dim_"


def frame_of(session: SparkSession, jplan) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, jplan), session)


def _seq(session: SparkSession, items: list):
    return session._jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)


def _name(jplan) -> str:
    return jplan.getClass().getSimpleName()


def cell_of(jplan, kind: str = "Aggregate") -> tuple[list, object]:
    """The wrappers above the top grouping, outermost first, and the grouping.

    Aggregates without GROUP BY are parsed as a ``Project``.
    """
    above = []
    while _name(jplan) in WRAPPERS:
        above.append(jplan)
        jplan = sequence(jplan.children())[0]
    if _name(jplan) != kind:
        raise Refused("small_cell_unplaceable")
    return above, jplan


def user_key(jplan) -> str:
    """The column that names a customer in the rows under a grouping."""
    found: list[tuple[str, str]] = []
    todo = [(jplan, None)]
    while todo:
        node, alias = todo.pop()
        name = _name(node)
        if name == "UnresolvedRelation":
            table = table_name(sequence(node.multipartIdentifier()))
            if table not in TABLES:
                raise Refused("small_cell_unplaceable")
            found.append((table, alias or table))
        elif name == "SubqueryAlias":
            todo.append((sequence(node.children())[0], node.identifier().name()))
        elif name in ("Join", "Filter"):
            todo += [(c, None) for c in sequence(node.children())]
        else:
            raise Refused("small_cell_unplaceable")
    people = [alias for table, alias in found if table == "users"]
    if len(people) != 1:
        raise Refused("small_cell_unplaceable")
    return f"`{people[0]}`.id"


def rebuilt(session: SparkSession, above: list, inner) -> object:
    for node in reversed(above):
        inner = node.withNewChildren(_seq(session, [inner]))
    return inner


def grouped_by(cell, dims: int) -> list[str]:
    """SQL of the grouping's ``dims`` expressions, in the order of the GROUP BY."""
    items = sequence(cell.aggregateExpressions())
    bare = lambda e: e.child() if _name(e) in ("Alias", "UnresolvedAlias") else e
    found = []
    for e in sequence(cell.groupingExpressions()):
        if _name(e) in ("Literal", "UnresolvedOrdinal"):
            place = int(str(e.value() if _name(e) == "Literal" else e.ordinal()))
            found.append(bare(items[place - 1]).sql())
        elif _name(e) == "UnresolvedAttribute" and e.sql().strip("`").upper() == "ALL" and dims != 1:
            found += [bare(x).sql() for x in items if "(" not in bare(x).sql()]
        else:
            found.append(e.sql())
    if len(found) != dims:
        raise Refused("small_cell_unplaceable")
    return found


def with_minimum(session: SparkSession, sql: str, k: int, counts: int | None = None) -> DataFrame:
    """The statement with ``count(DISTINCT customer) >= k`` on its grouping.

    The condition is ANDed into the statement's own HAVING and so comes before
    its ORDER BY and LIMIT.  With ``counts``, the number of its grouping
    expressions, every row also ends with their values as text and its cell's
    customers and rows, for the differencing guard.
    """
    parse = parser(session)
    above, cell = cell_of(parse.parsePlan(sql))
    key = user_key(sequence(cell.children())[0])
    if counts is not None:
        extra = [parse.parseExpression(f"CAST({e} AS STRING) AS {CELL_DIM}{i}") for i, e in enumerate(grouped_by(cell, counts))]
        extra += [parse.parseExpression(f"count(DISTINCT {key}) AS {CELL_CUSTOMERS}"), parse.parseExpression(f"count(*) AS {CELL_ROWS}")]
        named = _seq(session, sequence(cell.aggregateExpressions()) + extra)
        cell = cell.copy(cell.groupingExpressions(), named, cell.child(), cell.hint())
    enough = parse.parseExpression(f"count(DISTINCT {key}) >= {int(k)}")
    catalyst = session._jvm.org.apache.spark.sql.catalyst
    if above and _name(above[-1]) == "UnresolvedHaving":
        own = above.pop()
        enough = catalyst.expressions.And(own.havingCondition(), enough)
    return frame_of(session, rebuilt(session, above, catalyst.analysis.UnresolvedHaving(enough, cell)))


def population(session: SparkSession, sql: str) -> DataFrame:
    """One row, ``customers`` and ``n``: the people and rows an ungrouped statement is about."""
    parse = parser(session)
    above, cell = cell_of(parse.parsePlan(sql), "Project")
    if any(_name(n) == "UnresolvedHaving" for n in above):
        raise Refused("small_cell_unplaceable")
    key = user_key(sequence(cell.children())[0])
    counted = [parse.parseExpression(f"count(DISTINCT {key}) AS customers"), parse.parseExpression("count(*) AS n")]
    return frame_of(session, cell.copy(_seq(session, counted), cell.child()))
