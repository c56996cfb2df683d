"""Lexical checks and values of typed literals, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.model import XSD

DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"
INTEGER = r"^[+-]?[0-9]+\z"
FLOAT = r"^(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)\z"
DATE_TIME = r"^-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?\z"
NUMERIC = ("decimal", "double", "float", "integer", "int", "long", "short")


def days_fit(v: Column) -> Column:
    """The day exists in its month, by the proleptic Gregorian calendar; a sign or a longer year changes only leap years."""
    y, m, d = (F.regexp_extract(v, r"^-?([0-9]{4,})-([0-9]{2})-([0-9]{2})", i) for i in (1, 2, 3))
    y4 = F.pmod(F.right(y, F.lit(4)).try_cast("int"), F.lit(400))
    leap = (F.pmod(y4, F.lit(4)) == 0) & ((F.pmod(y4, F.lit(100)) != 0) | (y4 == 0))
    most = F.when(m.isin("04", "06", "09", "11"), 30).when(m == "02", F.when(leap, 29).otherwise(28)).otherwise(31)
    return d.try_cast("int") <= most


def well_formed(lex: Column, dt: Column) -> Column:
    """Whether a literal is in the lexical space of its type; types that are not checked always are."""
    return (
        F.when(dt == XSD + "decimal", lex.rlike(DECIMAL))
        .when(dt.isin(XSD + "double", XSD + "float"), lex.rlike(FLOAT))
        .when(dt.isin(*(XSD + x for x in ("integer", "int", "long", "short"))), lex.rlike(INTEGER))
        .when(dt == XSD + "dateTime", lex.rlike(DATE_TIME) & F.coalesce(days_fit(lex), F.lit(False)))
        .when(dt == XSD + "boolean", lex.isin("true", "false", "0", "1"))
        .otherwise(F.lit(True))
    )


def is_number(dt: Column) -> Column:
    return dt.isin(*(XSD + x for x in NUMERIC))


def number(lex: Column, dt: Column) -> Column:
    """The value of a numeric literal, else null."""
    return F.when(is_number(dt), lex.try_cast("decimal(38,18)"))
