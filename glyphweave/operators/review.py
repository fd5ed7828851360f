"""Clerical review: the log of thresholds and verdicts, and what it makes of scored pairs.

The log is one JSON document with lists of runs, thresholds and decisions, to which events are only added.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

SCHEMA = (
    "schema string, format_version int, runs array<struct<run_id:string,reviewer:string,started:string,ended:string,n_pairs:bigint,n_shown:bigint>>,"
    "thresholds array<struct<event_id:string,seq:bigint,run_id:string,reviewer:string,at:string,status:string,rule:string,expr:string,cuts:array<struct<score:string,operator:string,value:double>>,note:string>>,"
    "decisions array<struct<event_id:string,seq:bigint,run_id:string,reviewer:string,at:string,pair_id:string,decision:string,comment:string>>"
)


@dataclass
class Decisions:
    """Tables of a log: runs, thresholds, cuts, all events, the latest verdict of each reviewer on each pair, and pairs on which they differ."""

    runs: DataFrame
    thresholds: DataFrame
    cuts: DataFrame
    events: DataFrame
    decisions: DataFrame
    disagreements: DataFrame


def read_decisions(spark: SparkSession, path: str | Sequence[str], reviewer: str | None = None) -> Decisions:
    """Read one log or several; events that stand in more than one count once. A withdrawn verdict (clear) is none."""
    log = spark.read.schema(SCHEMA).json(path if isinstance(path, str) else list(path), multiLine=True)
    bad = log.where((F.col("format_version") != 1) | ~F.coalesce(F.endswith(F.col("schema"), lit("/decisions")), lit(False)))
    if not bad.isEmpty():
        raise ValueError("this is no decision log of version 1")
    rows = lambda name: log.select(F.explode(name).alias("e")).select("e.*")
    runs = rows("runs").dropDuplicates(["run_id"])
    thresholds, events = rows("thresholds").dropDuplicates(["event_id"]), rows("decisions").dropDuplicates(["event_id"])
    if reviewer is not None:
        thresholds, events = (d.where(F.col("reviewer") == reviewer) for d in (thresholds, events))
    latest = Window.partitionBy("reviewer", "pair_id").orderBy(F.desc("at"), F.desc("run_id"), F.desc("seq"))
    now = events.withColumn("k", F.row_number().over(latest)).where("k = 1 and decision in ('include', 'exclude')").drop("k")
    differ = now.groupBy("pair_id").agg(F.countDistinct("decision").alias("n"), F.sort_array(F.collect_set("reviewer")).alias("reviewers")).where("n > 1").drop("n")
    return Decisions(runs, thresholds, thresholds.select("event_id", "rule", F.explode("cuts").alias("c")).select("event_id", "rule", "c.*"), events, now, differ)


_CALLS = {"abs": "abs", "round": "round", "pmin": "least", "pmax": "greatest", "is_na": "isnull", "ifelse": "if", "xor": "<>"}
_OPERATORS = {
    ast.And: "and", ast.Or: "or", ast.BitAnd: "and", ast.BitOr: "or", ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=",
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/",
}


def rule_sql(text: str, columns: Sequence[str]) -> str:
    """A rule of comparisons of columns as SQL; anything else is refused."""
    ready = re.sub(r"\bAND\b|&&|&", " and ", text)
    ready = re.sub(r"\bOR\b|\|\||\|", " or ", ready)
    ready = re.sub(r"\bNOT\b|!(?!=)", " not ", ready)
    ready = re.sub(r"\bis\.na\b", "is_na", ready).replace("^", "**")

    def of(e: ast.expr) -> str:
        if isinstance(e, ast.Name):
            if e.id in ("TRUE", "FALSE"):
                return e.id
            if e.id not in columns:
                raise ValueError(f"{e.id} is no column that a rule may use")
            return f"`{e.id}`"
        if isinstance(e, ast.Constant) and isinstance(e.value, (int, float)):
            return repr(e.value)
        if isinstance(e, ast.BoolOp):
            return "(" + f" {_OPERATORS[type(e.op)]} ".join(map(of, e.values)) + ")"
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Pow):
            return f"pow({of(e.left)}, {of(e.right)})"
        if isinstance(e, ast.BinOp) and type(e.op) in _OPERATORS:
            return f"({of(e.left)} {_OPERATORS[type(e.op)]} {of(e.right)})"
        if isinstance(e, ast.UnaryOp):
            return f"({'not' if isinstance(e.op, ast.Not) else '-'} {of(e.operand)})"
        if isinstance(e, ast.Compare) and len(e.ops) == 1 and type(e.ops[0]) in _OPERATORS:
            return f"({of(e.left)} {_OPERATORS[type(e.ops[0])]} {of(e.comparators[0])})"
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in _CALLS and not e.keywords:
            args = list(map(of, e.args))
            return f"({args[0]} <> {args[1]})" if e.func.id == "xor" else f"{_CALLS[e.func.id]}({', '.join(args)})"
        raise ValueError("a rule may only compare and combine columns and numbers")

    return of(ast.parse(ready.strip(), mode="eval").body)


def _cut(cuts: Sequence[dict], rule: str, columns: Sequence[str]) -> Column:
    tests = {">=": lambda c, v: c >= v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, "<": lambda c, v: c < v}
    each = [F.coalesce(tests[c["operator"]](F.col(c["score"]), c["value"]), lit(False)) for c in cuts if c["score"] in columns]
    out = each[0] if each else lit(False)
    for e in each[1:]:
        out = (out | e) if rule == "any" else (out & e)
    return out


def apply_decisions(pairs: DataFrame, decisions: Decisions, pair_id: str = "pair_id", reviewer: str | None = None, rule: str = "last", thresholds: bool = True, column: str = "link") -> DataFrame:
    """``pairs`` with the link and its reason: a verdict if there is one, else the last accepted threshold.

    Of several reviewers the last verdict counts, or (unanimous) only one that all share; disputed pairs fall
    back to the threshold. The log's thresholds are few and read on the driver; verdicts are joined.
    """
    if rule not in ("last", "unanimous"):
        raise ValueError("rule is last or unanimous")
    inside = lit(None).cast("boolean")
    if thresholds:
        accepted = decisions.thresholds.where("status = 'accepted'")
        accepted = accepted.where(F.col("reviewer") == reviewer) if reviewer is not None else accepted
        last = accepted.orderBy(F.desc("at"), F.desc("run_id"), F.desc("seq")).first()
        if last is not None:
            inside = _cut([c.asDict() for c in last["cuts"]], last["rule"], pairs.columns)
            if last["expr"]:
                try:
                    inside = F.coalesce(F.expr(rule_sql(last["expr"], pairs.columns)).cast("boolean"), lit(False))
                except (ValueError, SyntaxError) as problem:
                    warnings.warn(f"the recorded rule is not used, but its cuts: {problem}", stacklevel=2)
    held = decisions.decisions if reviewer is None else decisions.decisions.where(F.col("reviewer") == reviewer)
    verdict = held.groupBy("pair_id").agg(F.countDistinct("decision").alias("n"), F.max_by("decision", F.struct("at", "run_id", "seq")).alias("said"))
    if rule == "unanimous":
        verdict = verdict.withColumn("said", F.when(F.col("n") > 1, lit("disputed")).otherwise(F.col("said")))
    verdict = verdict.select(F.col("pair_id").alias("__pair"), "said")
    judged = pairs.join(verdict, F.col(pair_id) == F.col("__pair"), "left")
    link = F.when(F.col("said") == "include", lit(True)).when(F.col("said") == "exclude", lit(False)).otherwise(inside)
    reason = F.when(F.col("said").isin("include", "exclude"), lit("decision")).when(F.col("said") == "disputed", lit("disputed")).when(inside.isNotNull(), lit("threshold"))
    return judged.withColumn(column, link).withColumn(f"{column}_reason", reason).drop("__pair", "said")


def audit_sample(pairs: DataFrame, pair_id: str, n: int, seed: int = 0) -> DataFrame:
    """n pairs at random, the same ones for the same seed."""
    return pairs.orderBy(F.xxhash64(F.col(pair_id), lit(seed)), pair_id).limit(n)
