"""Check that a statement only reads: every node and function of the parsed plan has to be one that is allowed.

The plan is walked as a whole: children, common table expressions, and the
plans of subqueries inside expressions.  What isn't on the list is refused, so
a kind of command that a later Spark adds is refused too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Kinds of plan nodes that a query is made of.
NODES = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "InlineTable", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation",
    "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnionLoop", "UnionLoopRef", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Values", "Window", "WithCTE", "WithWindowDefinition", "UnresolvedOrderBy",
}
TABLE_FUNCTIONS = {"explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack"}
#: Functions that run code by name or tell of the environment.
REFUSED_FUNCTIONS = {"current_user", "input_file_block_length", "input_file_block_start", "input_file_name", "java_method", "reflect", "session_user", "try_reflect", "user"}


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(jvm, plan) -> Iterator:
    """The plan's nodes, those of its common table expressions and of the subqueries in its expressions."""
    logical = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    subquery = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [x for part in (node.children(), node.innerChildren()) for x in _items(part)]
        if logical.isInstance(node):
            waiting += _items(node.expressions())
        elif subquery.isInstance(node):
            waiting.append(node.plan())


def refused(spark: SparkSession, text: str) -> str | None:
    """What in the statement is not allowed; None if it only reads."""
    jvm = spark._jvm
    logical = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    for node in _nodes(jvm, spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        kind = _kind(node)
        if logical.isInstance(node) and kind not in NODES:
            return kind
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            return "a table outside the views"
        if kind == "UnresolvedTableValuedFunction" and (name := node.name().apply(node.name().size() - 1).lower()) not in TABLE_FUNCTIONS:
            return f"the table function {name}"
        if kind == "UnresolvedFunction" and (name := node.nameParts().apply(node.nameParts().size() - 1).lower()) in REFUSED_FUNCTIONS:
            return f"the function {name}"
    return None
