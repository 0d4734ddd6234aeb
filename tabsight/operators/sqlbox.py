"""Guarded read-only SQL over one dataset (P11; A16-A18 are queries through it).

Three fences, each of them an allow-list:

* The statement runs in a session of its own, where the dataset's names are the only temporary views and no function but
  Spark's own exists. Views and functions of the caller's session can't be named there, and none is replaced.
* The parsed plan, before anything is resolved: only known kinds of query nodes; relations are the dataset or a common table
  expression that is in scope at that place; functions are built in and don't reach outside.
* The analysed plan: every leaf is the dataset's own view, rows written in the statement, a range, or a common table expression;
  no expression calls the JVM, Python or the file system.

What passes is handed back to the caller's session as a plan like any other, so filters and projections reach the scan and
literals, comments and hints mean what they say. The row cap is applied outside the statement.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

NAMES = ("dataset", "data")
ROW_CAP = 1000

#: Nodes of parsed queries.
QUERY_NODES = frozenset("""
    Project Filter Aggregate Sort Join LateralJoin Union Distinct Except Intersect GlobalLimit LocalLimit Offset Sample Generate Pivot Unpivot
    SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving WithWindowDefinition UnresolvedWith UnresolvedHint UnresolvedInlineTable
    UnresolvedRelation UnresolvedTableValuedFunction OneRowRelation LocalRelation RepartitionByExpression Repartition PipeOperator""".split())
#: Statements other than queries that read only.
READING_COMMANDS = frozenset({"ExplainCommand", "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "ShowColumns"})
#: Nodes of analysed queries; a View must be the dataset's.
ANALYSED_NODES = frozenset("""
    Project Filter Aggregate Sort Join LateralJoin Union Distinct Except Intersect GlobalLimit LocalLimit Offset Sample Generate Expand Window
    SubqueryAlias ResolvedHint WithCTE CTERelationDef UnionLoop RepartitionByExpression Repartition PipeOperator Deduplicate""".split())
ANALYSED_LEAVES = frozenset({"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"})
#: Generators of rows from their arguments; any other table function may read elsewhere.
ROW_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "sequence"})
#: Built-in functions that call into the JVM, tell about files, the session or the user, or only raise.
OUTSIDE_FUNCTIONS = frozenset("""
    reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true
    current_user user session_user current_catalog current_database current_schema version""".split())
#: Their expressions, and code that isn't Spark's.
OUTSIDE_EXPRESSIONS = frozenset("""
    CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength RaiseError CurrentUser CurrentDatabase CurrentCatalog SparkVersion
    ScalaUDF PythonUDF PythonUDAF PythonUDTF ScalaUDAF ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction UserDefinedGenerator
    VariableReference""".split())


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


class _Box:
    """Parses and analyses statements in a session that holds nothing but the dataset."""

    def __init__(self, spark: SparkSession, names: tuple[str, ...], df: DataFrame | None = None):
        jvm = spark.sparkContext._jvm
        base = "org.apache.spark.sql.catalyst."
        named = jvm.java.lang.Class.forName
        self.tree, self.plan, self.holder, self.command = (named(base + n) for n in (
            "trees.TreeNode", "plans.QueryPlan", "expressions.PlanExpression", "plans.logical.Command"))
        self.names = frozenset(n.lower() for n in names)
        self.functions = getattr(jvm, base + "analysis.FunctionRegistry").functionSet()
        self.function_id = getattr(jvm, base + "FunctionIdentifier")
        self.dataset = jvm.org.apache.spark.sql.classic.Dataset
        self.session = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if key.startswith("spark.sql.") and self.session.conf.isModifiable(key):
                self.session.conf.set(key, value)
        if df is not None:
            own = self.dataset.ofRows(self.session._jsparkSession, df._jdf.queryExecution().analyzed())
            for n in names:
                own.createOrReplaceTempView(n)

    def state(self):
        return self.session._jsparkSession.sessionState()

    # the parsed plan

    def parsed(self, node, scope: frozenset[str]) -> Iterator[str]:
        """What is wrong with a plan whose relations may be those of ``scope``."""
        kind = node.getClass().getSimpleName()
        if self.command.isInstance(node):
            if kind not in READING_COMMANDS:
                yield f"{kind} isn't a read-only query"
                return
            inner = node.logicalPlan() if kind == "ExplainCommand" else node.plan() if kind == "DescribeQueryCommand" else None
            if inner is not None:
                yield from self.parsed(inner, scope)
                return
            target = node.child() if kind == "ShowColumns" else node.relation()
            parts = _seq(target.multipartIdentifier()) if target.getClass().getSimpleName() == "UnresolvedTableOrView" else []
            if len(parts) != 1 or parts[0].lower() not in self.names:
                yield f"{'.'.join(parts)} isn't the dataset"
            return
        if kind not in QUERY_NODES:
            yield f"{kind} isn't part of a read-only query"
            return
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in scope:
                yield f"{'.'.join(parts)} isn't the dataset"
        elif kind == "UnresolvedTableValuedFunction" and _seq(node.name())[-1].lower() not in ROW_FUNCTIONS:
            yield f"table function {'.'.join(_seq(node.name()))} may read elsewhere"
        if kind == "UnresolvedWith":
            # an expression sees the ones before it, itself if it may recurse, and what is visible around
            inside = scope
            for relation in _seq(node.cteRelations()):
                name = relation._1().lower()
                yield from self.parsed(relation._2(), inside | {name} if node.allowRecursion() else inside)
                inside = inside | {name}
            yield from self.parsed(node.child(), inside)
            return
        for child in _seq(node.children().toSeq()):
            yield from self.parsed(child, scope)
        for e in _seq(node.expressions().toSeq()):
            yield from self.expression(e, scope)

    def expression(self, e, scope: frozenset[str]) -> Iterator[str]:
        todo = [e]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if "UnresolvedIdentifier" in kind or kind in ("NamedParameter", "PosParameter"):
                yield f"{kind} names something when it runs"
            elif kind == "UnresolvedFunction" or kind == "UnresolvedGenerator":
                yield from self.function(_seq(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()])
            if self.holder.isInstance(node):
                yield from self.parsed(node.plan(), scope)
            todo += [x for x in _seq(node.children().toSeq()) if self.tree.isInstance(x)]

    def function(self, parts: list[str]) -> Iterator[str]:
        name = parts[-1].lower()
        if len(parts) > 1:
            yield f"function {'.'.join(parts)} isn't Spark's own"
        elif name in OUTSIDE_FUNCTIONS:
            yield f"function {name} reaches outside the dataset"
        elif not self.functions.contains(self.function_id(name)):
            yield f"function {name} isn't Spark's own"

    # the analysed plan

    def analysed(self, plan) -> Iterator[str]:
        todo = [plan]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if self.plan.isInstance(node):
                if kind == "View":
                    about = node.desc().identifier()
                    if not node.isTempView() or about.database().isDefined() or about.table().lower() not in self.names:
                        yield f"view {about.unquotedString()} isn't the dataset"
                    continue  # what the dataset is made of is its owner's affair
                leaf = node.children().isEmpty()
                if kind not in (ANALYSED_LEAVES if leaf else ANALYSED_NODES):
                    yield f"{kind} isn't part of the dataset"
                todo += _seq(node.expressions().toSeq())
            elif kind in OUTSIDE_EXPRESSIONS:
                yield f"{kind} reaches outside the dataset"
            todo += [x for x in _seq(node.children().toSeq()) + _seq(node.innerChildren().toSeq()) if self.tree.isInstance(x)]
            if self.holder.isInstance(node):
                todo.append(node.plan())

    def statement(self, sql: str):
        """The parsed plan of a statement that keeps to the rules, else ValueError."""
        try:
            plan = self.state().sqlParser().parsePlan(sql or "")
        except ParseException as e:
            raise ValueError(str(e).strip().splitlines()[0]) from None
        wrong = next(self.parsed(plan, self.names), None)
        if wrong:
            raise ValueError(wrong)
        return plan

    def planned(self, sql: str):
        plan = self.statement(sql)
        kind = plan.getClass().getSimpleName()
        query = plan.logicalPlan() if kind == "ExplainCommand" else plan.plan() if kind == "DescribeQueryCommand" else None if self.command.isInstance(plan) else plan
        if query is not None:
            done = self.state().executePlan(query, self._mode()).analyzed()
            wrong = next(self.analysed(done), None)
            if wrong:
                raise ValueError(wrong)
        if query is plan:
            return done
        return self.session.sql(sql)._jdf.queryExecution().analyzed()  # a reading command of Spark's own

    def _mode(self):
        return getattr(self.session.sparkContext._jvm, "org.apache.spark.sql.execution.CommandExecutionMode").SKIP()


def validate_sql(sql: str, names: tuple[str, ...] = NAMES, spark: SparkSession | None = None) -> tuple[bool, str]:
    """Whether ``sql`` is one read-only statement over the dataset by its parsed plan, and why not.

    ``run_sql`` also judges the analysed plan, for which the dataset must be there.
    """
    try:
        _Box(spark or SparkSession.getActiveSession(), names).statement(sql)
    except ValueError as e:
        return False, str(e)
    return True, "ok"


def run_sql(spark: SparkSession, df: DataFrame, sql: str, limit: int | None = None, cap: int = ROW_CAP,
            names: tuple[str, ...] = NAMES) -> DataFrame:
    """Validated statement over ``df`` as a lazy DataFrame of at most min(limit or cap, cap) rows."""
    return _planned(spark, df, sql, names).limit(min(limit or cap, cap))


def _planned(spark: SparkSession, df: DataFrame, sql: str, names: tuple[str, ...]) -> DataFrame:
    box = _Box(spark, names, df)
    try:
        plan = box.planned(sql)
    except AnalysisException:
        raise
    except ValueError as e:
        raise ValueError(f"Refused SQL: {e}") from None
    return DataFrame(box.dataset.ofRows(spark._jsparkSession, plan), spark)


def run_sql_result(spark: SparkSession, df: DataFrame, sql: str, limit: int | None = None, cap: int = ROW_CAP) -> dict:
    """API-shaped result: columns, rows, row_count, truncated (more rows than were asked for), execution_time_ms, sql_executed."""
    t0, most = time.time(), min(limit or cap, cap)
    out = _planned(spark, df, sql, NAMES)
    rows = [r.asDict(recursive=True) for r in out.limit(most + 1).collect()]  # bounded by the row cap
    return {"columns": out.columns, "rows": rows[:most], "row_count": min(len(rows), most), "truncated": len(rows) > most,
            "execution_time_ms": round((time.time() - t0) * 1000, 2), "sql_executed": sql.strip().rstrip(";")}
