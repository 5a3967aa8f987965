"""What a SQL text may do, read from its parsed plan.

Spark's own parser says what a text means, so quotes, escapes and comments cannot
hide anything: only relational operators are let through, tables have to be mounted
views or names that a WITH clause in scope defines, and functions that call into
Java are refused. Nothing is resolved or run before the plan has passed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ledgerlens.functions import constants as K

#: Plan nodes of queries; commands, inserts, scripts and names made at run time are not among them.
QUERY_NODES = frozenset(
    "Aggregate AsOfJoin CTERelationDef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin "
    "LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range Sample Sort SubqueryAlias Tail Union "
    "UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases "
    "UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithCTE WithWindowDefinition "
    "UnresolvedOrdinal UnresolvedGroupBy".split())
JAVA_CALLS = frozenset(("reflect", "try_reflect", "java_method"))
_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_PLAN_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.PlanExpression"

# a literal may hold escaped quotes
_LITERAL = r"'(?:\\.|''|[^'\\])*'|\"(?:\\.|\"\"|[^\"\\])*\"|--[^\n]*|/\*.*?\*/"
_LITERALS, _QUOTED = re.compile(_LITERAL, re.S), re.compile(_LITERAL + "|`(?:``|[^`])*`", re.S)
_JAVA = re.compile(r"(?<![\w.])(reflect|java_method|try_reflect)\s*\(", re.I)
_PATH = re.compile(r"(?<![\w`])`?(csv|json|orc|parquet|text|avro|xml|binaryfile|delta)`?\s*\.\s*`", re.I)


def refuse_text(query: str) -> None:
    """What the words alone show, without a session: write keywords, known formats before a path, calls into Java."""
    bare = _QUOTED.sub(" ", query).upper()
    open_names = _LITERALS.sub(" ", query)
    if _PATH.search(open_names):
        raise ValueError("SQL may read the mounted files only, not paths")
    if _JAVA.search(open_names.replace("`", "")):
        raise ValueError("SQL may not call into Java")
    found = re.search(rf"(?<![A-Z0-9_])({'|'.join(K.WRITE_KEYWORDS)})(?![A-Z0-9_])", bare)
    if found:
        raise ValueError(f"SQL operation {found.group(1)!r} is not allowed")
    if not re.match(r"[\s(]*(SELECT|WITH|VALUES|FROM|TABLE)\b", bare):
        raise ValueError("only queries are allowed")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class ParsedQuery:
    """A query as Spark's parser reads it."""

    def __init__(self, spark: SparkSession, text: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self.text = text.strip().rstrip(";")
        try:
            self.plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(self.text)
        except PySparkException as error:
            raise ValueError(f"not a query: {str(error).splitlines()[0]}") from error

    def _is(self, node, name: str) -> bool:
        return bool(self._jvm.java.lang.Class.forName(name, False, self._gateway.jvm.Thread.currentThread().getContextClassLoader()).isInstance(node))

    def _walk(self, node, defined: frozenset[str], plan: bool = True) -> Iterator[tuple[str, object, frozenset[str]]]:
        """(class, node, names that WITH clauses define there) of every plan node and expression, subqueries included."""
        kind = node.getClass().getSimpleName()
        yield ("plan" if plan else "expression"), node, defined
        if kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                name = relation._1().lower()
                yield from self._walk(relation._2(), defined | {name} if node.allowRecursion() else defined)
                defined = defined | {name}
            yield from self._walk(node.child(), defined)
            return
        for child in _items(node.children()):
            yield from self._walk(child, defined, plan)
        if plan:
            for expression in _items(node.expressions()):
                yield from self._walk(expression, defined, False)
        elif self._is(node, _PLAN_EXPRESSION):
            yield from self._walk(node.plan(), defined)

    def check(self, tables: Iterable[str]) -> None:
        """Refuse all but queries over ``tables``; raises ValueError."""
        allowed = {t.lower() for t in tables}
        for place, node, defined in self._walk(self.plan, frozenset()):
            kind = node.getClass().getSimpleName()
            if place == "plan" and kind not in QUERY_NODES:
                raise ValueError(f"only queries are allowed, not {kind}")
            if kind == "UnresolvedRelation":
                parts = _items(node.multipartIdentifier())
                if len(parts) != 1 or parts[0].lower() not in allowed | defined:
                    raise ValueError(f"SQL may read the mounted files only, not {'.'.join(parts)}")
            elif kind == "ExpressionWithUnresolvedIdentifier":
                raise ValueError("SQL may not make up names at run time")
            elif kind == "UnresolvedFunction":
                parts = [p.lower() for p in _items(node.nameParts())]
                if parts[-1] in JAVA_CALLS:
                    raise ValueError("SQL may not call into Java")

    def has_own_limit(self) -> bool:
        """Whether the outermost operator limits the rows."""
        node = self.plan
        while node.getClass().getSimpleName() == "UnresolvedWith":
            node = node.child()
        return node.getClass().getSimpleName() == "GlobalLimit"
