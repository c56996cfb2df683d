"""Shape validation: constraints as rows, one pass per kind of component.

Shapes are parsed on the driver (a shape file is small) into constraint rows, which are
broadcast. All property constraints of one kind are then checked together: focus nodes from
typed nodes and the subclass closure, counts by one aggregation with map-side combine, values
that need no more than themselves before any join.
"""

from __future__ import annotations

import functools
import json
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.functions import literals
from graphloom.model import SH, SUBCLASS, TYPE, XSD, object_key
from graphloom.operators import closure
from graphloom.sources import turtle

RESULT = ("graph_id", "focus_node", "path", "message", "severity", "source_shape", "component", "value")
COMPONENTS = ("minCount", "maxCount", "class", "datatype", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "hasValue", "in", "nodeKind", "sparql", "uniqueKey")


@dataclass(frozen=True)
class Constraint:
    """One component of one property shape. ``arg`` is its value as text; a unique key lists its paths there, by
    blanks, ``in`` its values, by blanks or as a JSON list."""

    shape: str
    target: str
    path: str
    inverse: bool
    component: str
    arg: str
    severity: str = "Violation"
    message: str | None = None


def parse(text: str) -> list[Constraint]:
    """Constraints of a Turtle text of shapes."""
    rows = turtle.parse(text, "shapes")
    by: dict[str, list[tuple[str, tuple]]] = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[3], r))
    get = lambda n, p: [r for q, r in by.get(n, []) if q == p]
    one = lambda n, p: next((r[4] for r in get(n, p)), None)

    def items(node: str) -> list[str]:
        out = []
        while node and node != turtle.RDF + "nil":
            out += [r[4] for r in get(node, turtle.RDF + "first")]
            node = one(node, turtle.RDF + "rest")
        return out

    out = []
    for shape in sorted({r[1] for r in rows if r[3] == SH + "targetClass"}):
        for target in (r[4] for r in get(shape, SH + "targetClass")):
            for prop in (r[4] for r in get(shape, SH + "property")):
                path = one(prop, SH + "path")
                inv = one(path, SH + "inversePath")
                severity = (one(prop, SH + "severity") or SH + "Violation").rsplit("#", 1)[-1]
                for p, r in by.get(prop, []):
                    comp = p.removeprefix(SH)
                    if comp in COMPONENTS and comp not in ("sparql", "uniqueKey"):
                        out.append(Constraint(shape, target, inv or path, bool(inv), comp, json.dumps(items(r[4]), ensure_ascii=False) if comp == "in" else r[4], severity, one(prop, SH + "message")))
            for sp in (r[4] for r in get(shape, SH + "sparql")):
                pre = {one(d, SH + "prefix"): one(d, SH + "namespace") for x in get(sp, SH + "prefixes") for d in [r[4] for r in get(x[4], SH + "declare")]}
                head = "".join(f"PREFIX {k}: <{v}>\n" for k, v in pre.items())
                out.append(Constraint(shape, target, "", False, "sparql", head + (one(sp, SH + "select") or ""), (one(sp, SH + "severity") or SH + "Violation").rsplit("#", 1)[-1], one(sp, SH + "message")))
    return out


def types(graph: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(graph_id, node, class) by type and the subclass closure; of the ``wanted`` classes only, if given."""
    t = closure.edges_of(graph, TYPE).select("graph_id", F.col("s").alias("node"), F.col("o").alias("class"))
    up = closure.transitive(closure.edges_of(graph, SUBCLASS)).select("graph_id", F.col("s").alias("class"), F.col("o").alias("sup"))
    some = lambda df, c: df if wanted is None else df.where(F.col(c).isin(wanted))
    up = some(up, "sup")
    if up.isEmpty():
        return some(t, "class").dropDuplicates()
    return some(t, "class").unionByName(t.join(up, ["graph_id", "class"]).select("graph_id", "node", F.col("sup").alias("class"))).dropDuplicates()


#: Components that need no more than the value.
ALONE = ("datatype", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "in", "nodeKind")


def broken_value(comp: Column, arg: Column, o: Column, kind: Column, dt: Column) -> Column:
    """The value breaks the component, one of ``ALONE``; false for any other."""
    lit, dt = kind == "lit", F.coalesce(dt, F.lit(""))
    listed = F.when(arg.startswith("["), F.from_json(arg, "array<string>")).otherwise(F.split(arg, " "))

    def ordered(holds):
        """The value keeps to its bound: as exact numbers, as others where they are too large for that, or as times."""
        exact, bound = literals.number(o, dt), arg.try_cast("decimal(38,18)")
        rough, rough_bound = F.when(literals.is_number(dt), o.try_cast("double")), arg.try_cast("double")
        at, at_bound = F.when(dt.isin(XSD + "dateTime", XSD + "date"), F.try_to_timestamp(o)), F.try_to_timestamp(arg)
        return F.coalesce(holds(exact, bound), holds(rough, rough_bound), holds(at, at_bound), F.lit(False))

    return (
        F.when(comp == "datatype", ~lit | (dt != arg) | ~literals.well_formed(o, dt))
        .when(comp == "minInclusive", ~ordered(lambda v, b: v >= b))
        .when(comp == "maxInclusive", ~ordered(lambda v, b: v <= b))
        .when(comp == "minExclusive", ~ordered(lambda v, b: v > b))
        .when(comp == "maxExclusive", ~ordered(lambda v, b: v < b))
        .when(comp == "minLength", ~F.coalesce(F.length(o) >= arg.try_cast("int"), F.lit(False)))
        .when(comp == "maxLength", ~F.coalesce(F.length(o) <= arg.try_cast("int"), F.lit(False)))
        .when(comp == "pattern", ~F.rlike(o, arg))
        .when(comp == "in", ~F.array_contains(listed, o))
        .when(comp == "nodeKind", F.when(arg.endswith("#IRI"), kind != "iri").when(arg.endswith("#Literal"), ~lit).when(arg.endswith("#BlankNode"), kind != "bnode").otherwise(F.lit(False)))
        .otherwise(F.lit(False))
    )


class Validator:
    def __init__(self, constraints: list[Constraint]):
        self.constraints = constraints

    def results(self, graph: DataFrame) -> DataFrame:
        """(graph_id, focus_node, path, message, severity, source_shape, component, value): a row per broken component and value.

        The constraints say which branches there are; each branch reads the paths of its own constraints.
        """
        wanted = {c.target for c in self.constraints} | {c.arg for c in self.constraints if c.component == "class"}
        typed = keep(types(graph, sorted(wanted)), "types")
        of = lambda *kinds: [c for c in self.constraints if c.component in kinds]
        parts = []
        for branch, cons in ((self._counts, of("minCount", "maxCount")), (self._held, of("hasValue")), (self._alone, of(*ALONE)), (self._members, of("class"))):
            if cons:
                parts.append(branch(graph, typed, cons))
        for c in self.constraints:
            if c.component == "sparql":
                parts.append(self._sparql(graph, typed, c))
            elif c.component == "uniqueKey":
                parts.append(self._unique(graph, typed, c))
        if not parts:
            return graph.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in RESULT))
        return functools.reduce(DataFrame.unionByName, parts).select(*RESULT)

    @staticmethod
    def _focus(typed: DataFrame, cons: list[Constraint]) -> DataFrame:
        """A row per focus node and constraint; the constraints are those of a shapes file."""
        schema = "shape string, target string, path string, inverse boolean, component string, arg string, severity string, message string"
        table = F.broadcast(typed.sparkSession.createDataFrame([astuple(c) for c in cons], schema))
        return typed.join(table, typed["class"] == table.target).select("graph_id", F.col("node").alias("focus"), *table.columns)

    @staticmethod
    def _rows(graph: DataFrame, cons: list[Constraint]) -> DataFrame:
        """(graph_id, focus, path, inverse, key, v) of the paths that the constraints name, either way; a graph is a set, so is this."""
        val = F.struct("o", "o_kind", "o_dt", "o_lang")
        none = F.lit(None).cast("string")
        ahead, back = sorted({c.path for c in cons if not c.inverse}), sorted({c.path for c in cons if c.inverse})
        parts = []
        if ahead:
            parts.append(graph.where(F.col("p").isin(ahead)).select("graph_id", F.col("s").alias("focus"), F.col("p").alias("path"), F.lit(False).alias("inverse"), object_key().alias("key"), val.alias("v")))
        if back:
            subject = F.struct(F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
            parts.append(graph.where(F.col("p").isin(back) & (F.col("o_kind") != "lit")).select("graph_id", F.col("o").alias("focus"), F.col("p").alias("path"), F.lit(True).alias("inverse"), F.col("s").alias("key"), subject.alias("v")))
        return functools.reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _result(df: DataFrame, value: Column) -> DataFrame:
        name = F.concat(F.lit("sh:"), F.upper(F.substring("component", 1, 1)), F.expr("substring(component, 2)"), F.lit("ConstraintComponent"))
        text = F.coalesce("message", F.concat(F.col("component"), F.lit(" of "), F.col("path"), F.lit(" is broken")))
        return df.select("graph_id", F.col("focus").alias("focus_node"), "path", text.alias("message"), "severity", F.col("shape").alias("source_shape"), name.alias("component"), value.alias("value"))

    AT = ("graph_id", "focus", "path", "inverse")

    def _counts(self, graph: DataFrame, typed: DataFrame, cons: list[Constraint]) -> DataFrame:
        keys = self._rows(graph, cons).select(*self.AT, "key").dropDuplicates()  # repeated triples count once; no values are carried
        n = keys.groupBy(*self.AT).agg(F.count("*").alias("n"))
        got = self._focus(typed, cons).join(n, list(self.AT), "left").withColumn("n", F.coalesce("n", F.lit(0)))
        arg = F.col("arg").try_cast("bigint")
        broken = got.where(((F.col("component") == "minCount") & (F.col("n") < arg)) | ((F.col("component") == "maxCount") & (F.col("n") > arg)))
        return self._result(broken, F.lit(None).cast("string"))

    def _held(self, graph: DataFrame, typed: DataFrame, cons: list[Constraint]) -> DataFrame:
        args = sorted({c.arg for c in cons})
        held = self._rows(graph, cons).where(F.col("v.o").isin(args)).select(*self.AT, F.col("v.o").alias("arg"))
        return self._result(self._focus(typed, cons).join(held, [*self.AT, "arg"], "left_anti"), F.lit(None).cast("string"))

    def _alone(self, graph: DataFrame, typed: DataFrame, cons: list[Constraint]) -> DataFrame:
        """Values are judged before they meet their focus nodes: only broken ones are shuffled."""
        spark = graph.sparkSession
        table = F.broadcast(spark.createDataFrame(sorted({(c.path, c.inverse, c.component, c.arg) for c in cons}), "path string, inverse boolean, component string, arg string"))
        pairs = self._rows(graph, cons).join(table, ["path", "inverse"])
        broken = pairs.where(broken_value(F.col("component"), F.col("arg"), F.col("v.o"), F.col("v.o_kind"), F.col("v.o_dt"))).select(*self.AT, "component", "arg", "key", "v").dropDuplicates([*self.AT, "component", "arg", "key"])
        return self._result(self._focus(typed, cons).join(broken, [*self.AT, "component", "arg"]), F.col("v.o"))

    def _members(self, graph: DataFrame, typed: DataFrame, cons: list[Constraint]) -> DataFrame:
        rows = self._rows(graph, cons).select(*self.AT, "key", "v").dropDuplicates([*self.AT, "key"])
        pairs = self._focus(typed, cons).join(rows, list(self.AT)).withColumn("vo", F.when(F.col("v.o_kind") == "lit", F.lit(None)).otherwise(F.col("v.o")))
        members = typed.select("graph_id", F.col("node").alias("vo"), F.col("class").alias("arg"))
        return self._result(pairs.join(members, ["graph_id", "vo", "arg"], "left_anti"), F.col("v.o"))

    def _lone(self, df: DataFrame, c: Constraint) -> DataFrame:
        return df.select("graph_id", "focus", *(F.lit(x).cast("string").alias(n) for n, x in (("path", None), ("severity", c.severity), ("shape", c.shape), ("component", "sparql" if c.component == "sparql" else "uniqueKey"), ("message", c.message or f"{c.component} is broken"))))

    def _sparql(self, graph: DataFrame, typed: DataFrame, c: Constraint) -> DataFrame:
        from graphloom.plans.sparql import Engine

        focus = typed.where(F.col("class") == c.target).select("graph_id", F.col("node").alias("this")).dropDuplicates()
        got = Engine(graph).select(c.arg, seed=focus).select("graph_id", F.col("this").alias("focus")).join(focus.withColumnRenamed("this", "focus"), ["graph_id", "focus"], "left_semi")
        return self._result(self._lone(got, c), F.lit(None).cast("string"))

    def _unique(self, graph: DataFrame, typed: DataFrame, c: Constraint) -> DataFrame:
        """Focus nodes that share their values of all key paths with another; by counting, never by pairs."""
        paths = c.arg.split(" ")
        focus = typed.where(F.col("class") == c.target).select("graph_id", F.col("node").alias("focus")).dropDuplicates()
        keys = [f"k{i}" for i in range(len(paths))]
        held = graph.where(F.col("p").isin(paths)).select("graph_id", F.col("s").alias("focus"), "p", object_key().alias("k")).groupBy("graph_id", "focus").agg(*(F.collect_set(F.when(F.col("p") == p, F.col("k"))).alias(k) for k, p in zip(keys, paths)))
        full = held.join(focus, ["graph_id", "focus"], "left_semi")
        for k in keys:  # a row per combination of a node's values; a node without a value of some path has none
            full = full.withColumn(k, F.explode(k))
        shared = full.groupBy("graph_id", *keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        found = full.join(shared, ["graph_id", *keys], "left_semi").select("graph_id", "focus").dropDuplicates()
        return self._result(self._lone(found, c), F.lit(None).cast("string"))


def bad_decimals(graph: DataFrame) -> DataFrame:
    """Literals typed decimal that are none; where there are any, validation reports them alone."""
    return graph.where((F.col("o_kind") == "lit") & (F.col("o_dt") == XSD + "decimal") & ~literals.well_formed(F.col("o"), F.col("o_dt")))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """hard (severity names a violation), soft and total results."""
    hard = F.lower(F.coalesce("severity", F.lit(""))).contains("violation")
    return results.groupBy(*by).agg(F.count_if(hard).alias("hard"), F.count_if(~hard).alias("soft"), F.count("*").alias("total"))


def validated(constraints: list[Constraint], graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, graphs with ill-formed decimals): such a graph does not conform, and it is not validated further."""
    bad = keep(bad_decimals(graph).select("graph_id").dropDuplicates(), "bad_decimals")
    sound = graph if bad.isEmpty() else graph.join(bad, "graph_id", "left_anti")
    return Validator(constraints).results(sound), bad


def conforms(results: DataFrame, graphs: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(graph_id, conforms): no result at all, and no ill-formed decimal (``bad``: the graphs with one)."""
    no = results.select("graph_id") if bad is None else results.select("graph_id").unionByName(bad.select("graph_id"))
    return graphs.select("graph_id").dropDuplicates().join(no.dropDuplicates().withColumn("bad", F.lit(True)), "graph_id", "left").select("graph_id", F.col("bad").isNull().alias("conforms"))
