"""SPARQL ASK and SELECT compiled to DataFrame plans over many graphs at once.

Covered: PREFIX, BASE, basic graph patterns with ``a ; ,``, blank-node property lists, FILTER
with = != < <= > >= && || ! and bound(), EXISTS and NOT EXISTS in any depth, BIND (also of
EXISTS), VALUES, OPTIONAL, UNION, MINUS, and the paths p+ p* p? ^p p/q p|q. Anything else is an error of
that query alone: its result is a failed row with the message.

Ground triples of all queries of a suite are looked up in one pass, so that a query made of
them is a projection. EXISTS starts from the distinct outer bindings, so nested patterns see
outer variables as the specification says.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.model import TYPE, XSD, literal_key, object_key
from graphloom.operators.closure import transitive
from graphloom.sources.turtle import _unescape

_LEX = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<num>[+-]?(?:\d+\.\d+|\d+))
    |(?P<bnode>_:\w+)|(?P<pname>(?:[A-Za-z][\w.\-]*)?:[\w\-.]*[\w\-]|(?:[A-Za-z][\w.\-]*)?:)|(?P<word>[A-Za-z]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*+/|^?@-])""",
    re.X,
)


class SparqlError(ValueError):
    pass


@dataclass
class Group:
    items: list = field(default_factory=list)  # (kind, ...)


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.toks, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m.group()))
            at = m.end()
        self.i, self.n = 0, 0
        self.prefixes = dict(prefixes or {})

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def word(self, *names: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in names

    def expect(self, what: str) -> None:
        t = self.next()
        if t[1].upper() != what:
            raise SparqlError(f"expected {what!r}, not {t[1] or 'the end'!r}")

    def fresh(self) -> tuple[str, str]:
        self.n += 1
        return "var", f"__b{self.n}"

    def query(self) -> tuple[str, list[str], Group]:
        while self.word("PREFIX", "BASE"):
            if self.next()[1].upper() == "PREFIX":
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
            else:
                self.next()
        form = self.next()[1].upper()
        names: list[str] = []
        if form == "SELECT":
            if self.word("DISTINCT"):
                self.next()
            while self.peek()[0] == "var":
                names.append(self.next()[1][1:])
            if self.peek()[1] == "*":
                self.next()
        elif form != "ASK":
            raise SparqlError(f"{form or 'an empty query'} is not supported")
        if self.word("WHERE"):
            self.next()
        g = self.group()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r} after the pattern")
        return form, names, g

    def group(self) -> Group:
        self.expect("{")
        g = Group()
        while self.peek()[1] != "}":
            if self.peek()[0] == "end":
                raise SparqlError("expected '}'")
            if self.peek()[1] == ".":
                self.next()
            elif self.word("FILTER"):
                self.next()
                if self.word("EXISTS", "NOT"):
                    g.items.append(("filter", self.primary()))
                else:
                    self.expect("(")
                    g.items.append(("filter", self.expr()))
                    self.expect(")")
            elif self.word("BIND"):
                self.next()
                self.expect("(")
                e = self.expr()
                self.expect("AS")
                g.items.append(("bind", self.next()[1][1:], e))
                self.expect(")")
            elif self.word("VALUES"):
                self.next()
                g.items.append(self.values())
            elif self.word("OPTIONAL", "MINUS"):
                kind = self.next()[1].lower()
                g.items.append((kind, self.group()))
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    self.next()
                    parts.append(self.group())
                g.items.append(("union", parts))
            else:
                self.triples(g)
        self.next()
        return g

    def values(self) -> tuple:
        if self.peek()[0] == "var":
            names, wide = [self.next()[1][1:]], False
        else:
            self.expect("(")
            names, wide = [], True
            while self.peek()[0] == "var":
                names.append(self.next()[1][1:])
            self.expect(")")
        self.expect("{")
        rows = []
        while self.peek()[1] != "}":
            if wide:
                self.expect("(")
                row = []
                while self.peek()[1] != ")":
                    row.append(self.undef())
                self.next()
                if len(row) != len(names):
                    raise SparqlError("VALUES rows of unequal length")
                rows.append(tuple(row))
            else:
                rows.append((self.undef(),))
        self.next()
        return "values", names, rows

    def undef(self):
        if self.word("UNDEF"):
            self.next()
            return None
        return self.const()

    def const(self) -> str:
        t = self.term(Group())
        if t[0] != "const":
            raise SparqlError("a constant was expected")
        return t[1]

    def iri(self) -> str:
        kind, t = self.next()
        if kind == "iri":
            return t[1:-1]
        if kind == "pname":
            p, local = t.split(":", 1)
            if p not in self.prefixes:
                raise SparqlError(f"prefix {p}: is not declared")
            return self.prefixes[p] + local
        raise SparqlError(f"unexpected {t!r}")

    def term(self, g: Group) -> tuple[str, str]:
        kind, t = self.peek()
        if kind == "var":
            self.next()
            return "var", t[1:]
        if kind == "bnode":
            self.next()
            return "var", "__" + t[2:]
        if kind == "str":
            self.next()
            lex = _unescape(t[1:-1])
            if self.peek()[1] == "^^":
                self.next()
                return "const", literal_key(lex, self.iri())
            if self.peek()[1] == "@":
                self.next()
                return "const", literal_key(lex, None, self.next()[1].lower())
            return "const", literal_key(lex)
        if kind == "num":
            self.next()
            return "const", literal_key(t, XSD + ("decimal" if "." in t else "integer"))
        if kind == "word" and t in ("true", "false"):
            self.next()
            return "const", literal_key(t, XSD + "boolean")
        if t == "[":
            self.next()
            node = self.fresh()
            if self.peek()[1] != "]":
                self.verbs(node, g)
            self.expect("]")
            return node
        return "const", self.iri()

    def triples(self, g: Group) -> None:
        s = self.term(g)
        if self.peek()[1] not in (".", "}"):
            self.verbs(s, g)

    def verbs(self, s: tuple[str, str], g: Group) -> None:
        while True:
            p = ("var", self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                o = self.term(g)
                g.items.append(("triple", s, p, o))
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "}", "]"):
                return

    def path(self):
        parts = [self.sequence()]
        while self.peek()[1] == "|":
            self.next()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = [self.step()]
        while self.peek()[1] == "/":
            self.next()
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self):
        if self.peek()[1] == "^":
            self.next()
            return ("inv", self.step())
        if self.peek()[1] == "(":
            self.next()
            p = self.path()
            self.expect(")")
        elif self.peek() == ("word", "a"):
            self.next()
            p = ("iri", TYPE)
        else:
            p = ("iri", self.iri())
        if self.peek()[1] in ("+", "*", "?"):
            p = ({"+": "plus", "*": "star", "?": "opt"}[self.next()[1]], p)
        return p

    def expr(self):
        left = self.conj()
        while self.peek()[1] == "||":
            self.next()
            left = ("or", left, self.conj())
        return left

    def conj(self):
        left = self.rel()
        while self.peek()[1] == "&&":
            self.next()
            left = ("and", left, self.rel())
        return left

    def rel(self):
        left = self.primary()
        if self.peek()[1] in ("=", "!=", "<", "<=", ">", ">="):
            op = self.next()[1]
            return ("cmp", op, left, self.primary())
        return left

    def primary(self):
        if self.peek()[1] == "!":
            self.next()
            return ("not", self.primary())
        if self.peek()[1] == "(":
            self.next()
            e = self.expr()
            self.expect(")")
            return e
        if self.word("EXISTS"):
            self.next()
            return ("exists", self.group())
        if self.word("NOT"):
            self.next()
            self.expect("EXISTS")
            return ("not", ("exists", self.group()))
        if self.word("BOUND"):
            self.next()
            self.expect("(")
            v = self.next()[1][1:]
            self.expect(")")
            return ("bound", v)
        return self.term(Group())


def parse(text: str, prefixes: dict[str, str] | None = None) -> tuple[str, list[str], Group]:
    return _Parser(text, prefixes).query()


def split_queries(text: str) -> list[str]:
    """ASK queries of a file, cut where braces balance; other texts are left out."""
    out, buffer, depth, seen = [], [], 0, False
    for line in text.splitlines():
        bare = re.sub(r'<[^>]*>|"[^"]*"', "", line).split("#")[0]
        if not buffer and not line.strip():
            continue
        buffer.append(line)
        depth += bare.count("{") - bare.count("}")
        seen = seen or "{" in bare
        if seen and depth <= 0:
            out.append("\n".join(buffer).strip())
            buffer, depth, seen = [], 0, False
    if any(x.strip() for x in buffer):
        out.append("\n".join(buffer).strip())
    return [q for q in out if "ask" in q.lower()]


def variables(g: Group) -> set[str]:
    """All variables of a group, in any depth."""

    def of_expr(e) -> set[str]:
        if e[0] == "var":
            return {e[1]}
        if e[0] == "exists":
            return variables(e[1])
        if e[0] == "bound":
            return {e[1]}
        return set().union(*(of_expr(x) for x in e[1:] if isinstance(x, tuple)), set())

    out: set[str] = set()
    for it in g.items:
        if it[0] == "triple":
            out |= {t[1] for t in it[1:] if t[0] == "var"}
        elif it[0] == "filter":
            out |= of_expr(it[1])
        elif it[0] == "bind":
            out |= {it[1]} | of_expr(it[2])
        elif it[0] == "values":
            out |= set(it[1])
        elif it[0] == "union":
            out |= set().union(*(variables(x) for x in it[1]))
        else:
            out |= variables(it[1])
    return out


def ground(g: Group) -> set[tuple[str, str, str]]:
    """Triples without variables and with a plain predicate, in any depth."""
    out: set[tuple[str, str, str]] = set()

    def in_expr(e):
        if e[0] == "exists":
            walk(e[1])
        else:
            for x in e[1:]:
                if isinstance(x, tuple):
                    in_expr(x)

    def walk(x: Group):
        for it in x.items:
            if it[0] == "triple":
                if it[1][0] == it[3][0] == "const" and it[2][0] == "iri":
                    out.add((it[1][1], it[2][1], it[3][1]))
            elif it[0] in ("filter", "bind"):
                in_expr(it[-1])
            elif it[0] == "union":
                for y in it[1]:
                    walk(y)
            elif it[0] in ("optional", "minus"):
                walk(it[1])

    walk(g)
    return out


HITS = "__hits"
#: Graphs up to which the table with a row per graph is broadcast.
FEW_GRAPHS = 100_000


def number(c: Column) -> Column:
    """The numeric value of a term key, else null."""
    return F.regexp_extract(c, r'^"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))"\^\^http://www\.w3\.org/2001/XMLSchema#(?:integer|decimal|double|float|int|long|short|nonNegativeInteger)$', 1).try_cast("decimal(38,18)")


_LITERAL = re.compile(r'"(.*)"(?:\^\^(.*)|@(.*))?', re.S)


def same_object(key: str) -> Column:
    """The object is the term of this key, said of the plain columns, so that scans can filter by it."""
    m = _LITERAL.fullmatch(key)
    if not m:
        return (F.col("__o") == key) & (F.col("o_kind") != "lit")
    lex, dt, lang = m.groups()
    kind = (F.col("__o") == lex) & (F.col("o_kind") == "lit")
    if lang:
        return kind & (F.col("o_lang") == lang)
    plain = F.coalesce("o_dt", F.lit(XSD + "string"))
    return kind & F.col("o_lang").isNull() & (plain == (dt or XSD + "string"))


class Engine:
    """Queries over graphs given as canonical triples; ``graphs`` (graph_id) may list empty graphs too."""

    def __init__(self, triples: DataFrame, graphs: DataFrame | None = None):
        self.spark: SparkSession = triples.sparkSession
        # Triples are a set, so what a pattern binds is one as well: no pattern has to drop duplicates. Repeated rows would do no harm but work.
        self.t = triples.select("graph_id", "s", "p", object_key().alias("o"), F.col("o").alias("__o"), "o_kind", "o_dt", "o_lang")
        self.graphs = (graphs if graphs is not None else self.t.select("graph_id")).select("graph_id").dropDuplicates()
        self.known: dict[tuple[str, str, str], int] = {}
        self._paths: dict[str, DataFrame] = {}
        self._n = 0
        self.few = False

    def unit(self, groups: list[Group]) -> DataFrame:
        """A row per graph with the numbers of the ground triples it holds, by one pass over the triples."""
        wanted = sorted(set().union(*(ground(g) for g in groups), set()))
        self.known = {t: i for i, t in enumerate(wanted)}
        if not wanted:
            return self.graphs.withColumn(HITS, F.array().cast("array<int>"))
        table = self.spark.createDataFrame([(*t, i) for t, i in self.known.items()], "s string, p string, o string, i int")
        hits = self.t.join(F.broadcast(table), ["s", "p", "o"]).groupBy("graph_id").agg(F.collect_set("i").alias(HITS))  # as many as the queries name
        return self.graphs.join(hits, "graph_id", "left").withColumn(HITS, F.coalesce(HITS, F.array().cast("array<int>")))

    # paths ---------------------------------------------------------------------------------
    def path(self, p) -> DataFrame:
        """(graph_id, s, o) of a path."""
        key = repr(p)
        if key not in self._paths:
            self._paths[key] = self._path(p)
        return self._paths[key]

    def _path(self, p) -> DataFrame:
        kind = p[0]
        if kind == "iri":
            return self.t.where(F.col("p") == p[1]).select("graph_id", "s", "o")  # what is not asked for is never read
        if kind == "inv":
            return self.path(p[1]).select("graph_id", F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return functools.reduce(DataFrame.unionByName, (self.path(x) for x in p[1])).dropDuplicates()
        if kind == "seq":
            out = self.path(p[1][0])
            for x in p[1][1:]:
                nxt = self.path(x).select("graph_id", F.col("s").alias("o"), F.col("o").alias("o2"))
                out = out.join(nxt, ["graph_id", "o"]).select("graph_id", "s", F.col("o2").alias("o")).dropDuplicates()
            return out
        base = self.path(p[1])
        if kind == "plus":
            return keep(transitive(base), "path")
        reach = keep(transitive(base), "path") if kind == "star" else base
        nodes = self.t.select("graph_id", F.explode(F.array("s", "o")).alias("s")).dropDuplicates()
        return reach.unionByName(nodes.select("graph_id", "s", F.col("s").alias("o"))).dropDuplicates()

    # patterns ------------------------------------------------------------------------------
    def solve(self, g: Group, seed: DataFrame | None) -> DataFrame:
        """Solutions of a group that extend ``seed`` (graph_id, __hits, bound variables); no seed: of all graphs, for a group that begins with a pattern."""
        out, filters, run = seed, [], []
        for it in [*g.items, ("end",)]:
            kind = it[0]
            if kind == "triple":
                run.append(it[1:])
                continue
            if kind == "filter":
                filters.append(it[1])  # filters hold for the whole group
                continue
            if run:
                out, run = self.basic(out, run), []
            if kind == "end":
                break
            if kind == "bind":
                out, c = self.expr(out, it[2])
                out = out.withColumn(it[1], c)
            elif kind == "values":
                out = self.values(out, it[1], it[2])
            elif kind == "union":
                parts = [self.solve(x, out) for x in it[1]]
                out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            elif kind == "optional":
                shared = self.shared(out, it[1])
                inner = self.solve(it[1], out.select("graph_id", HITS, *shared).dropDuplicates()).drop(HITS)
                out = out.join(inner, ["graph_id", *shared], "left")
            elif kind == "minus":
                inner = self.solve(it[1], self.fresh_seed(out))
                shared = [c for c in inner.columns if c in out.columns and c not in ("graph_id", HITS)]
                if shared:
                    out = out.join(inner.select("graph_id", *shared).dropDuplicates(), ["graph_id", *shared], "left_anti")
        for e in filters:
            out, c = self.expr(out, e)
            out = out.where(c)
        return out.select("graph_id", HITS, *(c for c in out.columns if c not in ("graph_id", HITS) and not c.startswith("__x")))

    def fresh_seed(self, df: DataFrame) -> DataFrame:
        return df.select("graph_id", HITS).dropDuplicates(["graph_id"])

    def shared(self, df: DataFrame, g: Group) -> list[str]:
        names = variables(g)
        return [c for c in df.columns if c in names]

    def join(self, left: DataFrame, right: DataFrame, names) -> DataFrame:
        return left.join(right, ["graph_id", *(n for n in dict.fromkeys(names) if n in left.columns)])

    def values(self, out: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
        """VALUES: an inline table; rows with UNDEF, or without a shared variable, are unfolded in place."""
        shared = [n for n in names if n in out.columns]
        if shared and all(v is not None for r in rows for v in r):
            return out.join(F.broadcast(self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))), shared)  # as many rows as the query names
        if not rows:
            return out.where("false").withColumns({n: F.lit(None).cast("string") for n in names if n not in shared})
        each = F.explode(F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, r))) for r in rows)))
        out = out.withColumn("__v", each)
        for n in shared:
            out = out.where(F.col(f"__v.{n}").isNull() | (F.col(f"__v.{n}") == F.col(n)))
        return out.withColumns({n: F.col(f"__v.{n}") for n in names if n not in shared}).drop("__v")

    def is_ground(self, s, p, o) -> bool:
        return s[0] == o[0] == "const" and p[0] == "iri" and (s[1], p[1], o[1]) in self.known

    def rows(self, s, p, o) -> DataFrame:
        """(graph_id, the pattern's variables) of one triple pattern."""
        if p[0] == "var":
            rows = self.t
        elif p[0] == "iri" and o[0] == "const":
            rows = self.t.where((F.col("p") == p[1]) & same_object(o[1])).withColumn("p", F.lit(""))
            o = ("skip", "")
        else:
            rows = self.path(p).withColumn("p", F.lit(""))
        names, conds, cols = [], [], []
        for c, t in (("s", s), ("p", p if p[0] == "var" else ("skip", "")), ("o", o)):
            if t[0] == "const":
                conds.append(F.col(c) == t[1])
            elif t[0] == "var":
                if t[1] in names:
                    conds.append(F.col(c) == F.col(cols[names.index(t[1])]))
                else:
                    names.append(t[1])
                    cols.append(c)
        for c in conds:
            rows = rows.where(c)
        return rows.select("graph_id", *(F.col(c).alias(n) for c, n in zip(cols, names)))

    def basic(self, out: DataFrame | None, patterns: list[tuple]) -> DataFrame:
        """A basic graph pattern: ground triples are conditions, patterns of one subject are joined
        with each other first, and these stars then with what is bound, by their shared variables."""
        stars: dict[tuple, DataFrame] = {}
        for s, p, o in patterns:
            if self.is_ground(s, p, o):
                out = out.where(F.array_contains(HITS, self.known[s[1], p[1], o[1]]))
            else:
                got = self.rows(s, p, o)
                stars[s] = got if s not in stars else self.join(stars[s], got, [c for c in got.columns if c != "graph_id"])
        left = list(stars.values())
        while left:
            bound = [] if out is None else [c for c in out.columns if c not in ("graph_id", HITS)]
            k = next((i for i, d in enumerate(left) if set(d.columns) & set(bound)), 0)
            star = left.pop(k)
            if out is None:
                out = star.withColumn(HITS, F.array().cast("array<int>"))
            elif not bound and self.few:
                out = star.join(F.broadcast(out), "graph_id")  # a row per graph, counted
            else:
                out = self.join(out, star, [c for c in star.columns if c != "graph_id"])
        return out

    # expressions ---------------------------------------------------------------------------
    def only_ground(self, g: Group) -> Column | None:
        """A group of ground triples alone is a condition on the hits."""
        if g.items and all(it[0] == "triple" and it[1][0] == it[3][0] == "const" and it[2][0] == "iri" and (it[1][1], it[2][1], it[3][1]) in self.known for it in g.items):
            return functools.reduce(lambda a, b: a & b, (F.array_contains(HITS, self.known[it[1][1], it[2][1], it[3][1]]) for it in g.items))
        return None

    def expr(self, df: DataFrame, e) -> tuple[DataFrame, Column]:
        kind = e[0]
        if kind == "exists":
            c = self.only_ground(e[1])
            if c is not None:
                return df, c
            shared = self.shared(df, e[1])
            self._n += 1
            name = f"__x{self._n}"
            seed = df.select("graph_id", HITS, *shared).dropDuplicates(["graph_id", *shared])
            found = self.solve(e[1], seed).select("graph_id", *shared).dropDuplicates().withColumn(name, F.lit(True))
            return df.join(found, ["graph_id", *shared], "left"), F.coalesce(F.col(name), F.lit(False))
        if kind in ("and", "or"):
            df, a = self.expr(df, e[1])
            df, b = self.expr(df, e[2])
            return df, (a & b) if kind == "and" else (a | b)
        if kind == "not":
            df, a = self.expr(df, e[1])
            return df, ~a
        if kind == "bound":
            return df, F.col(e[1]).isNotNull() if e[1] in df.columns else F.lit(False)
        if kind == "cmp":
            df, a = self.expr(df, e[2])
            df, b = self.expr(df, e[3])
            if e[1] in ("=", "!="):
                na, nb = number(a), number(b)
                same = F.when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise(a == b)
                return df, same if e[1] == "=" else ~same
            na, nb = number(a), number(b)
            return df, {"<": na < nb, "<=": na <= nb, ">": na > nb, ">=": na >= nb}[e[1]]
        if kind == "var":
            if e[1] not in df.columns:
                return df, F.lit(None).cast("string")
            return df, F.col(f"`{e[1]}`")
        if kind == "const":
            return df, F.lit(e[1])
        raise SparqlError(f"{kind} is not supported")

    # queries -------------------------------------------------------------------------------
    def select(self, query: str, prefixes: dict[str, str] | None = None, seed: DataFrame | None = None) -> DataFrame:
        _, names, g = parse(query, prefixes)
        if seed is None and not ground(g) and g.items and g.items[0][0] == "triple" and not any(it[0] in ("union", "minus") for it in g.items):
            out = self.solve(g, None)
        else:
            unit = self.unit([g])
            out = self.solve(g, unit if seed is None else unit.join(seed, "graph_id"))
        return out.select("graph_id", *(names or [c for c in out.columns if c not in ("graph_id", HITS) and not c.startswith("__")])).dropDuplicates()

    def ask(self, queries: list[str], prefixes: dict[str, str] | None = None) -> DataFrame:
        """(graph_id, cq_id, success, message) of all queries in one plan; cq_id from 1."""
        parsed: list = []
        for q in queries:
            try:
                parsed.append(parse(q, prefixes))
            except SparqlError as e:
                parsed.append(e)
        unit = keep(self.unit([p[2] for p in parsed if not isinstance(p, Exception)]), "hits")
        self.few = unit.count() <= FEW_GRAPHS
        out = []
        for i, p in enumerate(parsed, 1):
            try:
                if isinstance(p, Exception):
                    raise p
                items = p[2].items
                df = self.solve(p[2], unit)
                if len(df.columns) == 2 and not any(x[0] == "union" for x in items):  # no variables: a row per graph at most
                    yes = df.select("graph_id", F.lit(True).alias("success"))
                else:
                    yes = df.select("graph_id").dropDuplicates().withColumn("success", F.lit(True))
                res = self.graphs.join(yes, "graph_id", "left").select("graph_id", F.lit(i).alias("cq_id"), F.coalesce("success", F.lit(False)).alias("success"), F.lit(None).cast("string").alias("message"))
            except SparqlError as e:
                res = self.graphs.select("graph_id", F.lit(i).alias("cq_id"), F.lit(False).alias("success"), F.lit(str(e)).alias("message"))
            out.append(res)
        if not out:
            return self.graphs.select("graph_id", F.lit(0).alias("cq_id"), F.lit(False).alias("success"), F.lit("").alias("message")).limit(0)
        return functools.reduce(DataFrame.unionByName, out)
