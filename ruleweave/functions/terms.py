"""Expressions over terms: labelled nulls, literals, N-Triples lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "_:r"


def labelled_null(rule: int, var: str, frontier: list[Column], spelled: bool = False) -> Column:
    """The null that a rule's existential variable has for one match of its frontier.

    It depends on the frontier's values alone, so it is the same in every task and
    every retry.  `spelled` keeps the values readable, for cyclic-term checks.
    """
    args = F.to_json(F.struct(*(c.cast("string").alias(f"a{i}") for i, c in enumerate(frontier)))) if frontier else F.lit("")
    if spelled:
        return F.concat(F.lit(f"{NULL_MARK}{rule}_{var}("), F.concat_ws(",", *(c.cast("string") for c in frontier)), F.lit(")"))
    return F.concat(F.lit(f"{NULL_MARK}{rule}_{var}_"), F.sha2(args, 256))


def is_null(c: Column) -> Column:
    return c.cast("string").startswith(NULL_MARK)


def plain_literal(c: Column) -> Column:
    """A quoted literal without its xsd:string type, which means the same."""
    return F.when(c.startswith('"'), F.regexp_replace(c, r'\^\^<http://www\.w3\.org/2001/XMLSchema#string>$', "")).otherwise(c)


#: Subject, predicate and object of an N-Triples line.
TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$"


def triple_part(line: Column, i: int) -> Column:
    """Subject (1), predicate (2) or object (3) of a line; empty if it is no triple."""
    return F.regexp_extract(line, TRIPLE, i)
