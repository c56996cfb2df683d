"""Turtle and N-Triples: a parser, writers and a Spark data source ``turtle``.

Files are parsed whole, one to a task; a file that cannot be parsed fails as a whole, so no
half of it is ever committed. N-Triples, being one statement a line, stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.model import COLUMNS, RDF, SCHEMA, XSD

_LEX = re.compile(
    r"""(?P<ws>[\s]+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<dir>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<dt>\^\^)
    |(?P<p>[;,.\[\]()])""",
    re.X | re.S,
)
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        if x not in _ESC:
            raise TurtleError(f"unknown escape \\{x}")
        return _ESC[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S) if "\\" in s else s


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    at = 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at : at + 20]!r} at line {text.count(chr(10), 0, at) + 1}")
        if m.lastgroup != "ws":
            yield m.lastgroup, m.group(), at
        at = m.end()


class _Parser:
    def __init__(self, text: str, graph: str, prefixes: dict[str, str] | None = None):
        self.text, self.graph = text, graph
        self.prefixes, self.base = dict(prefixes or {}), ""
        self.toks = list(tokens(text))
        self.i = self.n = 0
        self.names: dict[str, str] = {}
        self.rows: list[tuple] = []

    def fail(self, what: str):
        at = self.toks[self.i][2] if self.i < len(self.toks) else len(self.text)
        raise TurtleError(f"expected {what} at line {self.text.count(chr(10), 0, at) + 1}")

    def peek(self) -> tuple[str, str]:
        return self.toks[self.i][:2] if self.i < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def expect(self, what: str) -> None:
        if self.next()[1] != what:
            self.i -= 1
            self.fail(repr(what))

    def fresh(self) -> tuple[str, str]:
        self.n += 1
        return f"_:{self.graph}_{self.n}", "bnode"

    def resolve(self, iri: str) -> str:
        iri = _unescape(iri[1:-1])
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else self.base + iri

    def expanded(self, name: str) -> str:
        p, local = name.split(":", 1)
        if p not in self.prefixes:
            raise TurtleError(f"prefix {p}: is not declared")
        return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, t = self.peek()
            if kind == "dir" or (kind == "word" and t.upper() in ("PREFIX", "BASE")):
                self.next()
                if t.lstrip("@").upper() == "PREFIX":
                    k, name = self.next()
                    if k != "pname" or not name.endswith(":"):
                        self.fail("a prefix")
                    k, iri = self.next()
                    if k != "iri":
                        self.fail("an IRI")
                    self.prefixes[name[:-1]] = self.resolve(iri)
                else:
                    self.base = self.resolve(self.next()[1])
                if t[0] == "@":
                    self.expect(".")
                continue
            if (kind, t) == ("p", "["):
                s = self.property_list()
                if self.peek()[1] != ".":
                    self.verbs(s)
            else:
                self.verbs(self.subject())
            self.expect(".")
        return self.rows

    def subject(self) -> tuple[str, str]:
        t = self.term()
        if t[1] == "lit":
            self.i -= 1
            self.fail("a subject")
        return t[:2]

    def term(self) -> tuple:
        """(value, kind) or (lexical, 'lit', datatype, language)."""
        kind, t = self.next()
        if kind == "iri":
            return self.resolve(t), "iri"
        if kind == "pname":
            return self.expanded(t), "iri"
        if kind == "bnode":
            if t not in self.names:
                self.names[t] = self.fresh()[0]
            return self.names[t], "bnode"
        if kind in ("str", "long"):
            lex = _unescape(t[3:-3] if kind == "long" else t[1:-1])
            k, x = self.peek()
            if k == "lang":
                self.next()
                return lex, "lit", RDF + "langString", x[1:].lower()
            if k == "dt":
                self.next()
                dt = self.term()
                if dt[1] != "iri":
                    self.fail("a datatype")
                return lex, "lit", dt[0], None
            return lex, "lit", XSD + "string", None
        if kind == "num":
            return t, "lit", XSD + ("double" if re.search("[eE]", t) else "decimal" if "." in t else "integer"), None
        if kind == "word" and t in ("true", "false"):
            return t, "lit", XSD + "boolean", None
        if (kind, t) == ("p", "["):
            self.i -= 1
            return self.property_list()
        if (kind, t) == ("p", "("):
            return self.collection()
        self.i -= 1
        self.fail("a term")

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((self.graph, s[0], s[1], p, o[0], o[1], *(o[2:] if len(o) > 2 else (None, None))))

    def property_list(self) -> tuple[str, str]:
        self.expect("[")
        node = self.fresh()
        if self.peek()[1] != "]":
            self.verbs(node)
        self.expect("]")
        return node

    def collection(self) -> tuple[str, str]:
        items = []
        while self.peek()[1] != ")":
            if self.peek()[0] == "end":
                self.fail("')'")
            items.append(self.term())
        self.next()
        head: tuple[str, str] = (RDF + "nil", "iri")
        for item in reversed(items):
            node = self.fresh()
            self.add(node, RDF + "first", item)
            self.add(node, RDF + "rest", head)
            head = node
        return head

    def verbs(self, s: tuple[str, str]) -> None:
        while True:
            kind, t = self.peek()
            if (kind, t) == ("word", "a"):
                self.next()
                p = RDF + "type"
            else:
                got = self.term()
                if got[1] != "iri":
                    self.i -= 1
                    self.fail("a predicate")
                p = got[0]
            while True:
                self.add(s, p, self.term())
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
                more = True
            else:
                more = self.toks[self.i - 1][1] == ";"
            if not more or self.peek()[1] in (".", "]"):
                return


def parse(text: str, graph: str = "g", prefixes: dict[str, str] | None = None) -> list[tuple]:
    """Canonical rows of a Turtle text (a set, in order); TurtleError where it is none."""
    return list(dict.fromkeys(_Parser(text, graph, prefixes).parse()))


def load(spark: SparkSession, text: str, graph: str = "g", prefixes: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(parse(text, graph, prefixes), SCHEMA)


def parse_column(df: DataFrame, graph_col: str, text_col: str) -> DataFrame:
    """Triples of a column of Turtle texts; a text that cannot be parsed gives none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                if t is not None:
                    try:
                        rows += parse(t, str(g))
                    except (TurtleError, RecursionError):
                        pass
            yield pd.DataFrame(rows, columns=list(COLUMNS))

    return df.select(graph_col, text_col).mapInPandas(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/**/*.ttl", recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, part):
        import os

        with open(part.path, encoding="utf-8") as f:
            yield from parse(f.read(), os.path.splitext(os.path.basename(part.path))[0])


class TurtleSource(DataSource):
    """``spark.dataSource.register(TurtleSource)``, then ``spark.read.format("turtle").load(path)``."""

    @classmethod
    def name(cls):
        return "turtle"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _nt_term(v, kind, dt, lang):
    esc = v
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull() & (dt != XSD + "string"), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    return F.when(kind == "iri", F.concat(F.lit("<"), v, F.lit(">"))).when(kind == "bnode", v).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))


def ntriples(graph: DataFrame) -> DataFrame:
    """(graph_id, line): a statement a line."""
    none = F.lit(None).cast("string")
    return graph.select("graph_id", F.concat_ws(" ", _nt_term(F.col("s"), F.col("s_kind"), none, none), F.concat(F.lit("<"), "p", F.lit(">")), _nt_term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), F.lit(".")).alias("line"))


def write_ntriples(graph: DataFrame, path: str) -> None:
    ntriples(graph).select("line").write.text(path)


def read_ntriples(lines: DataFrame, graph="g") -> DataFrame:
    """Triples of a column ``value`` of N-Triples lines, of a graph by name or column; comments and blank lines are skipped, other lines that do not match are left out."""
    pat = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
    x = lambda i: F.regexp_extract("value", pat, i)
    s, o = F.col("s_"), F.col("o_")
    lit = o.startswith('"')
    lex = F.regexp_extract("o_", r'^"((?:[^"\\]|\\.)*+)"', 1)
    for a, b in (("\\\\", "\u0000"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0000", "\\")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    dt, lang = F.regexp_extract("o_", r'"\^\^<([^>]*)>$', 1), F.regexp_extract("o_", r'"@([A-Za-z0-9-]+)$', 1)
    inner = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    kind = lambda c: F.when(c.startswith("<"), "iri").otherwise("bnode")
    named = F.lit(graph) if isinstance(graph, str) else graph
    return lines.select(named.alias("graph_id"), x(1).alias("s_"), x(2).alias("p"), x(3).alias("o_")).where("s_ <> ''").select(
        "graph_id", inner(s).alias("s"), kind(s).alias("s_kind"), "p", F.when(lit, lex).otherwise(inner(o)).alias("o"), F.when(lit, "lit").otherwise(kind(o)).alias("o_kind"),
        F.when(lit, F.when(dt != "", dt).when(lang != "", RDF + "langString").otherwise(XSD + "string")).alias("o_dt"), F.when(lit & (lang != ""), F.lower(lang)).alias("o_lang"),
    )


def turtle_text(rows: list[tuple], prefixes: dict[str, str]) -> str:
    """A readable Turtle text of a (small) graph: subjects in order, blank nodes by label."""

    def name(iri: str) -> str:
        for p, ns in sorted(prefixes.items(), key=lambda x: -len(x[1])):
            if iri.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w\-]*", iri[len(ns) :]):
                return f"{p}:{iri[len(ns) :]}"
        return f"<{iri}>"

    def obj(r: tuple) -> str:
        _, _, _, _, o, kind, dt, lang = r
        if kind != "lit":
            return o if kind == "bnode" else name(o)
        esc = o.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f'"{esc}"' + (f"@{lang}" if lang else f"^^{name(dt)}" if dt and dt != XSD + "string" else "")

    out = [f"@prefix {p}: <{ns}> ." for p, ns in sorted(prefixes.items())]
    by: dict[tuple, list[tuple]] = {}
    for r in sorted(set(rows), key=lambda r: tuple(x or "" for x in r)):
        by.setdefault((r[1], r[2]), []).append(r)
    for (s, kind), rs in by.items():
        lines = [f"    {'a' if r[3] == RDF + 'type' else name(r[3])} {obj(r)}" for r in rs]
        out.append(f"\n{s if kind == 'bnode' else name(s)}\n" + " ;\n".join(lines) + " .")
    return "\n".join(out) + "\n"


def turtle_lines(graph: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(line): a Turtle text of a graph of any size, in order of its statements; each partition declares the prefixes.

    Names are shortened where their local part is plain; a statement stands on one line.
    """
    short = lambda iri: F.concat(F.lit("<"), iri, F.lit(">"))

    def name(iri):
        out = short(iri)
        for p, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
            local = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
            out = F.when(iri.startswith(ns) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*\z"), F.concat(F.lit(p + ":"), local)).otherwise(out)
        return out

    none = F.lit(None).cast("string")
    term = lambda v, kind, dt, lang: F.when(kind == "iri", name(v)).otherwise(_nt_term(v, kind, dt, lang))
    line = F.concat_ws(" ", term(F.col("s"), F.col("s_kind"), none, none), F.when(F.col("p") == RDF + "type", "a").otherwise(name(F.col("p"))), term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), F.lit("."))
    head = [f"@prefix {p}: <{ns}> ." for p, ns in sorted(prefixes.items())]

    def run(batches):
        import pyarrow as pa

        begun = False
        for b in batches:
            if b.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], schema=b.schema)
            yield b

    return graph.select("s", "p", "o", line.alias("line")).dropDuplicates(["line"]).repartitionByRange("s", "p", "line").sortWithinPartitions("s", "p", "line").select("line").mapInArrow(run, "line string")
