"""Drafting: requirements to axioms by rules or by a generator, and the texts a generator gets."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import Rules, slug
from graphloom.model import CLASS, COLUMNS, COMMENT, DOMAIN, OBJECT_PROPERTY, OWL, RANGE, TYPE, XSD


class Generator(Protocol):
    """What drafts, repairs and patches; a generator over the network implements the same three calls.

    Each takes and returns DataFrames, so one call serves all requirements or graphs at once.
    """

    def draft(self, requirements: DataFrame) -> DataFrame: ...

    def repair(self, prompts: DataFrame) -> DataFrame: ...

    def apply(self, patches: DataFrame) -> DataFrame: ...


def _emit(df: DataFrame, rows: list) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("graph_id", F.explode(F.array(*rows)).alias("t")).select("graph_id", "t.s", F.lit("iri").alias("s_kind"), "t.p", "t.o", "t.o_kind", F.when(F.col("t.o_kind") == "lit", XSD + "string").alias("o_dt"), none.alias("o_lang")).select(*COLUMNS).dropDuplicates()


def _st(s, p, o, kind="iri"):
    return F.struct(s.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


class RuleGenerator:
    """The deterministic generator: keyword rules over the text, one projection and one explode."""

    def __init__(self, rules: Rules, base: str, prefixes: dict[str, str] | None = None):
        self.rules, self.base, self.prefixes = rules, base, prefixes or {}

    def draft(self, requirements: DataFrame) -> DataFrame:
        """requirements (graph_id, identifier, text): a property with domain and range, both classes, and an axiom node with its source."""
        b = F.lit(self.base)
        text = F.coalesce("text", F.lit(""))
        s, p, o = (F.concat(b, slug(self.rules.term(text, w))) for w in ("subjects", "predicates", "objects"))
        axiom = F.concat(b, F.concat_ws("_", *(slug(self.rules.term(text, w)) for w in ("subjects", "predicates", "objects"))))
        named = requirements.select("graph_id", s.alias("s"), p.alias("p"), o.alias("o"), axiom.alias("x"), F.coalesce("identifier", F.lit("")).alias("id"))
        c = F.col
        return _emit(named, [_st(c("p"), TYPE, F.lit(OBJECT_PROPERTY)), _st(c("p"), DOMAIN, c("s")), _st(c("p"), RANGE, c("o")), _st(c("s"), TYPE, F.lit(CLASS)), _st(c("o"), TYPE, F.lit(CLASS)),
                             _st(c("x"), TYPE, F.lit(OWL + "Axiom")), _st(c("x"), F.concat(b, F.lit("sourceRequirement")), c("id"), "lit")])

    def repair(self, prompts: DataFrame) -> DataFrame:
        """prompts (graph_id, idx, prompt): the first word names a class; its repair node carries the prompt as a comment."""
        b = F.lit(self.base)
        focus = slug(F.split(F.coalesce("prompt", F.lit("")), r"\s+")[0])
        named = prompts.select("graph_id", F.concat(b, focus).alias("c"), F.concat(b, focus, F.lit("_repair_"), F.col("idx").cast("string")).alias("x"), F.coalesce("prompt", F.lit("")).alias("m"))
        c = F.col
        return _emit(named, [_st(c("c"), TYPE, F.lit(CLASS)), _st(c("x"), TYPE, F.lit(OWL + "Axiom")), _st(c("x"), COMMENT, c("m"), "lit")])

    def apply(self, patches: DataFrame) -> DataFrame:
        from graphloom.operators.repair import applied

        return applied(patches, self.base, self.prefixes)


def generator(kind: str, rules: Rules, base: str, prefixes: dict[str, str] | None = None, registry: dict | None = None) -> Generator:
    """A registered generator by name, or the rules where there is none of that name."""
    make = (registry or {}).get(kind)
    return make(base) if make else RuleGenerator(rules, base, prefixes)


def repair_prompts(results: DataFrame) -> DataFrame:
    """(graph_id, prompt): ``message | path=... | focus=...`` of each result."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}="), c))
    return results.select("graph_id", F.concat_ws(" | ", "message", part("path", "path"), part("focus", "focus_node")).alias("prompt"))


def context_text(ctx: DataFrame) -> DataFrame:
    """(graph_id, context): classes and properties with their ends, a line each, in order."""
    line = F.when(F.col("kind") == "class", F.concat(F.lit("- class "), "name")).otherwise(F.concat(F.lit("- "), "kind", F.lit(" property "), "name", F.lit(" ("), "domain", F.lit(" -> "), "range", F.lit(")")))
    return ctx.groupBy("graph_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("context"))  # a schema, not data


def axioms_text(examples: DataFrame) -> DataFrame:
    """(ord, text) of examples (ord, identifier, text, axioms): the requirement and its axioms, prefixes first, a line each."""
    a = F.col("axioms")
    declared = F.array_sort(F.transform(F.map_entries(F.coalesce(a["prefixes"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.concat(F.lit("@prefix "), e["key"], F.lit(": <"), e["value"], F.lit("> ."))))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    body = F.array_join(F.concat(declared, some(a["tbox"]), some(a["abox"])), "\n")
    head = F.concat(F.lit("- ["), "identifier", F.lit("] "), "text")
    return examples.select("ord", F.when(body == "", head).otherwise(F.concat(head, F.lit("\n"), body)).alias("text"))


def draft_prompt(batches: DataFrame, context: str, examples: str | DataFrame) -> DataFrame:
    """(batch, prompt) of requirements (batch, ord, identifier, text): context, examples, then the requirements in order.

    Examples are a text, or requirements with axioms, of which a prompt holds a handful.
    """
    if not isinstance(examples, str):
        examples = "\n".join(r.text for r in axioms_text(examples).orderBy("ord").collect()) or "- none"
    line = F.concat(F.lit("- ["), "identifier", F.lit("] "), "text")
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]))  # a batch holds a fixed number
    return batches.groupBy("batch").agg(body.alias("b")).select("batch", F.concat_ws("\n\n", F.lit(f"A. Vocabulary\n{context}"), F.lit(f"B. Examples\n{examples}"), F.concat(F.lit("C. Requirements\n"), "b")).alias("prompt"))


# The characters of a graph's text that a prompt shows. The limit is the generator's, not the engine's.
REPAIR_CONTEXT, APPLY_CONTEXT = 4000, 6000


def repair_request(prompts: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, request) of prompts (graph_id, prompt) and graphs (graph_id, turtle): what is wrong, in order, and the graph's beginning."""
    said = prompts.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("prompt")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("all"))  # the results of one graph
    return said.join(graphs, "graph_id").select("graph_id", F.concat(F.lit("Repair these results:\n"), "all", F.lit("\n\nGraph:\n"), F.left("turtle", F.lit(REPAIR_CONTEXT))).alias("request"))


def apply_request(patches: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, request) of patches and graphs (graph_id, turtle): the plan as JSON, in order, and the graph's beginning."""
    row = F.struct("subject", "predicate", "object", "action", "message")
    plan = patches.groupBy("graph_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("plan"))  # the patches of one graph
    return plan.join(graphs, "graph_id").select("graph_id", F.concat(F.lit("Apply these patches:\n"), "plan", F.lit("\n\nGraph:\n"), F.left("turtle", F.lit(APPLY_CONTEXT))).alias("request"))
