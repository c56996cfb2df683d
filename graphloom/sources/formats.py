"""Graph files of several formats, on any file system that Spark reads.

The format goes by the suffix. N-Triples and N-Quads are read line by line in the JVM; Turtle and
RDF/XML are read whole, a file a row, by the tasks. A file that cannot be parsed is an error, since
half a graph is none; ``strict=False`` leaves it out.

Defined results: an unknown suffix is read as Turtle; an empty file is an empty graph; a graph is
named by its file, without folder and suffix, and for N-Quads by the fourth term, where there is one.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import COLUMNS, RDF, SCHEMA, XSD
from graphloom.sources import turtle

# The suffixes of the formats.
SUFFIXES = {"turtle": (".ttl", ".n3"), "xml": (".owl", ".rdf", ".xml"), "nt": (".nt",), "nquads": (".nq",)}
XML = "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {f"{{{RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}


def guess(path: str) -> str | None:
    """The format of a file name, or None."""
    suffix = os.path.splitext(path.lower())[1]
    return next((f for f, all_ in SUFFIXES.items() if suffix in all_), None)


class XmlError(ValueError):
    pass


class _Xml:
    """Statements of an RDF/XML document: node elements hold property elements, which hold nodes or text."""

    def __init__(self, graph: str):
        self.graph, self.rows, self.n = graph, [], 0

    def fresh(self) -> str:
        self.n += 1
        return f"_:{self.graph}_x{self.n}"

    def add(self, s: str, p: str, o: str, dt: str | None = None, lang: str | None = None, lit: bool = False) -> None:
        kind = lambda t: "bnode" if t.startswith("_:") else "iri"
        self.rows.append((self.graph, s, kind(s), p, o, "lit" if lit else kind(o), dt if lit else None, lang))

    def iri(self, tag: str) -> str:
        if not tag.startswith("{"):
            raise XmlError(f"a name without a namespace: {tag}")
        return tag[1:].replace("}", "", 1)

    def resolve(self, ref: str, base: str) -> str:
        from urllib.parse import urljoin

        return urljoin(base, ref) if base else ref

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        get = lambda x: e.get(f"{{{RDF}}}{x}")
        if get("about") is not None:
            s = self.resolve(get("about"), base)
        elif get("ID") is not None:
            s = self.resolve("#" + get("ID"), base)
        else:
            s = f"_:{self.graph}_{get('nodeID')}" if get("nodeID") else self.fresh()
        if e.tag != f"{{{RDF}}}Description":
            self.add(s, RDF + "type", self.iri(e.tag))
        for k, v in e.attrib.items():
            if k not in _SYNTAX and not k.startswith(XML):
                p = self.iri(k)
                self.add(s, p, v) if p == RDF + "type" else self.literal(s, p, v, None, lang)
        place = 0
        for c in e:
            if c.tag == f"{{{RDF}}}li":
                place += 1
            self.prop(s, c, f"{RDF}_{place}" if c.tag == f"{{{RDF}}}li" else self.iri(c.tag), base, lang)
        return s

    def literal(self, s: str, p: str, text: str, dt: str | None, lang: str | None) -> None:
        lang = lang.lower() if lang and not dt else None
        self.add(s, p, text, dt or (RDF + "langString" if lang else XSD + "string"), lang, True)

    def prop(self, s: str, e: ET.Element, p: str, base: str, lang: str | None) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        get = lambda x: e.get(f"{{{RDF}}}{x}")
        kind, inner = get("parseType"), list(e)
        if kind == "Literal":
            text = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in inner)
            self.add(s, p, text, RDF + "XMLLiteral", None, True)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in inner]
            cells = [self.fresh() for _ in items]
            self.add(s, p, cells[0] if cells else RDF + "nil")
            for cell, item, rest in zip(cells, items, [*cells[1:], RDF + "nil"]):
                self.add(cell, RDF + "first", item)
                self.add(cell, RDF + "rest", rest)
        elif kind == "Resource":
            o = self.fresh()
            self.add(s, p, o)
            for c in inner:
                self.prop(o, c, self.iri(c.tag), base, lang)
        elif get("resource") is not None:
            self.add(s, p, self.resolve(get("resource"), base))
        elif get("nodeID") is not None:
            self.add(s, p, f"_:{self.graph}_{get('nodeID')}")
        elif inner:
            if len(inner) > 1:
                raise XmlError(f"{p} holds several nodes")
            self.add(s, p, self.node(inner[0], base, lang))
        else:
            more = {k: v for k, v in e.attrib.items() if k not in _SYNTAX and not k.startswith(XML)}
            if more and not (e.text or "").strip():
                o = self.fresh()
                self.add(s, p, o)
                for k, v in more.items():
                    self.literal(o, self.iri(k), v, None, lang)
            else:
                self.literal(s, p, e.text or "", get("datatype"), lang)


def parse_xml(text: str, graph: str = "g", base: str = "") -> list[tuple]:
    """Canonical rows of an RDF/XML text (a set, in order); XmlError where it is none."""
    if not text.strip():
        return []
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise XmlError(str(e)) from None
    x = _Xml(graph)
    nodes = list(root) if root.tag == f"{{{RDF}}}RDF" else [root]
    base, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for e in nodes:
        x.node(e, base, lang)
    return list(dict.fromkeys(x.rows))


def parse(text: str, fmt: str, graph: str = "g") -> list[tuple]:
    return parse_xml(text, graph) if fmt == "xml" else turtle.parse(text, graph)


def parse_column(df: DataFrame, graph_col: str, text_col: str, fmt: str = "turtle", strict: bool = False) -> DataFrame:
    """Triples of a column of texts; one that cannot be parsed gives none, or an error if ``strict``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                if t is not None:
                    try:
                        rows += parse(t, fmt, str(g))
                    except (turtle.TurtleError, XmlError, RecursionError):
                        if strict:
                            raise
            yield pd.DataFrame(rows, columns=list(COLUMNS))

    return df.select(graph_col, text_col).mapInPandas(run, SCHEMA)


def load(spark: SparkSession, path: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Triples of the files at a path (a file, folder or pattern of one format), read by the tasks through Spark's file systems."""
    fmt = fmt or guess(path) or "turtle"
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), r"\.[^.]*$", "")
    if fmt in ("nt", "nquads"):
        lines = spark.read.text(path).select(name.alias("graph"), "value")
        if fmt == "nquads":
            quad = r"^(.*\S)\s+(<[^>]*>|_:\S+)\s*\.\s*(?:#.*)?$"
            # Four terms: what stands before the last one is a statement of its own.
            rest = F.regexp_extract("value", quad, 1)
            four = rest.rlike(r"^\s*\S+\s+<[^>]*>\s+(?:<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*+\"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*$")
            g = F.regexp_replace(F.regexp_extract("value", quad, 2), "^<|>$", "")
            lines = lines.select(F.when(four, g).otherwise(F.col("graph")).alias("graph"), F.when(four, F.concat(rest, F.lit(" ."))).otherwise(F.col("value")).alias("value"))
        return turtle.read_ntriples(lines, F.col("graph"))
    return parse_column(spark.read.text(path, wholetext=True).select(name.alias("graph"), "value"), "graph", "value", fmt, strict)
