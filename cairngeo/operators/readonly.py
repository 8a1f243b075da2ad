"""Read-only SQL with a row cap and a time limit.

A text is taken when it is a SELECT without a refused word whose plan, as Spark has analysed it, reads nothing but named
tables, views and the given DataFrames. The parsed plan is looked at first, so that nothing is opened that the text names
by a path or by an expression; the analysed plan then has to consist of what is allowed: its leaves are tables of a
catalogue, views, or rows without a source, and no expression calls into the JVM by reflection. Nothing runs before that.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from ..functions import text as text_functions

# Refused words, row cap, time limit in seconds.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE")
REFLECTIVE = ("reflect", "try_reflect", "java_method")

# What a plan may read: rows that the text itself makes, references within the plan, and named relations (`_named`).
PLAIN_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef")
# Expressions and nodes that run what the text names.
CALLING = ("CallMethodViaReflection", "TryReflect", "ScriptTransformation", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier")
MAX_ROWS = 1000
TIMEOUT = 30.0


class NotReadOnly(ValueError):
    """The text is not a SELECT, holds a refused word, or reads or runs more than tables."""


@dataclass(frozen=True)
class Answer:
    rows: DataFrame
    probe: DataFrame
    max_rows: int

    def truncated(self) -> bool:
        """Whether a row beyond the cap exists."""
        return self.probe.count() > self.max_rows


def check(text: str) -> str:
    clean = text.strip().rstrip(";").strip()
    for word in FORBIDDEN:
        if re.search(rf"\b{word}\b", clean, re.IGNORECASE):
            raise NotReadOnly(f"the query holds the word {word}")
    if not re.match(r"SELECT\b", clean, re.IGNORECASE):
        raise NotReadOnly("only SELECT is allowed")
    return clean


def _nodes(tree) -> Iterator[dict]:
    """Every node of a plan in its JSON form, expressions and plans inside them included."""
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        tree = list(tree.values())
    if isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)


def check_parsed(spark: SparkSession, clean: str) -> None:
    """Refuse what the parsed plan shows: scripts, names made by expressions, calls into the JVM, files named by their path."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(clean)
    for node in _nodes(json.loads(plan.toJSON())):
        kind = node["class"].rsplit(".", 1)[1]
        if kind in CALLING:
            raise NotReadOnly("scripts and IDENTIFIER are not allowed")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            name = str(node.get("nameParts", node.get("name", ""))).strip("[]").split(", ")[-1].lower()
            if name in REFLECTIVE:
                raise NotReadOnly(f"the function {name} is not allowed")
        if kind == "UnresolvedRelation":
            parts = node["multipartIdentifier"].strip("[]").split(", ")
            if len(parts) > 1 and not _is_table(spark, parts):
                raise NotReadOnly(f"{'.'.join(parts)} is no table")


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def check_analysed(df: DataFrame) -> None:
    """Accept an analysed plan only if all it reads is named and nothing in it calls by reflection.

    What lies below a view is the view's own affair.
    """
    plans, expressions = [df._jdf.queryExecution().analyzed()], []
    while plans or expressions:
        if expressions:
            one = expressions.pop()
            if _kind(one) in CALLING:
                raise NotReadOnly(f"{one.prettyName()} is not allowed")
            expressions += _all(one.children())
            if _is_a(df.sparkSession, one, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                plans.append(one.plan())
            continue
        one = plans.pop()
        kind, below = _kind(one), _all(one.children())
        if kind in CALLING:
            raise NotReadOnly("scripts are not allowed")
        if kind == "View":
            continue
        if not below and kind not in PLAIN_LEAVES and not _named(one, kind):
            raise NotReadOnly(f"the query reads a {kind} that is no table or view")
        plans += below
        expressions += _all(one.expressions())


def _is_a(spark: SparkSession, node, name: str) -> bool:
    return spark.sparkContext._jvm.java.lang.Class.forName(name, False, node.getClass().getClassLoader()).isInstance(node)


def _named(leaf, kind: str) -> bool:
    """Whether a leaf is a table of a catalogue, not a file or another source named by the text."""
    if kind == "HiveTableRelation":
        return True
    if kind == "LogicalRelation":
        return leaf.catalogTable().isDefined()
    return kind == "DataSourceV2Relation" and leaf.identifier().isDefined()


def _is_table(spark: SparkSession, parts: list[str]) -> bool:
    try:
        return spark.catalog.tableExists(".".join(f"`{p}`" for p in parts))
    except AnalysisException:
        return False


def readonly_sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, max_rows: int = MAX_ROWS
) -> Answer:
    """Checked SELECT over the session's tables and the given DataFrames, capped.

    The given ones stand in front of tables and views of the same name, in this query only.
    """
    clean = check(text)
    check_parsed(spark, clean)
    views = {name: f"given_{uuid.uuid4().hex}" for name in tables or {}}
    for name, view in views.items():
        tables[name].createTempView(view)
    given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    try:
        whole = spark.sql(f"WITH {given} {clean}" if given else clean)
        check_analysed(whole)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return Answer(whole.limit(max_rows), whole.limit(max_rows + 1), max_rows)


def run(spark: SparkSession, text: str, max_rows: int = MAX_ROWS, timeout: float = TIMEOUT) -> tuple[list[Row], bool]:
    """Rendered rows and the truncated flag; the job is cancelled after ``timeout`` seconds."""
    clean = check(text)
    check_parsed(spark, clean)
    whole = spark.sql(clean)
    check_analysed(whole)
    tag = f"readonly-{uuid.uuid4().hex}"
    context = spark.sparkContext
    timer = threading.Timer(timeout, context.cancelJobsWithTag, [tag])
    context.addJobTag(tag)
    timer.start()
    try:
        rows = text_functions.rendered(whole).limit(max_rows + 1).collect()
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return rows[:max_rows], len(rows) > max_rows
