"""Relational tables as triples: a direct mapping that projects only the wanted columns."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import COLUMNS, TYPE, XSD, triples

BASE = "http://data.example.org/"
#: Spark type -> literal type.
DATATYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date"}


@dataclass(frozen=True)
class TableMap:
    """A table's key, its class, foreign keys (column -> table) and literal columns."""

    name: str
    keys: tuple[str, ...]
    references: dict[str, str] = field(default_factory=dict)
    literals: tuple[str, ...] = ()

    def subject(self, *cols: str):
        """The IRI of a row; null, and so no triples, where a part of the key is null."""
        return F.concat(F.lit(BASE + self.name), *(x for c in cols for x in (F.lit("/"), F.col(c).cast("string"))))


def mapped(df: DataFrame, m: TableMap, graph: str = "g") -> DataFrame:
    """Type, reference and literal triples of a table; null values have none.

    A branch per predicate, each reading the key and one column: a pattern on one predicate
    leaves a single branch of the plan, the others fold away before anything is read.
    """
    kinds = dict(df.dtypes)
    s = m.subject(*m.keys)
    parts = [triples(df, s, F.lit(TYPE), F.lit(BASE + m.name.capitalize()), graph=graph)]
    parts += [triples(df.where(F.col(c).isNotNull()), s, F.lit(f"{BASE}{m.name}#{c}"), F.concat(F.lit(f"{BASE}{t}/"), F.col(c).cast("string")), graph=graph) for c, t in m.references.items()]
    parts += [triples(df, s, F.lit(f"{BASE}{m.name}#{c}"), F.col(c), "lit", XSD + DATATYPES.get(kinds[c], "string"), graph) for c in m.literals]
    return functools.reduce(DataFrame.unionByName, parts).select(*COLUMNS)


__all__ = ["BASE", "TableMap", "mapped", "triples"]
