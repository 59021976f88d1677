"""N-Triples rendering of (s, p, o, o_kind, datatype, lang) rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_literal(col: Column) -> Column:
    """Escape backslash, quote, newline and carriage return."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\r"), F.lit("\\r"))


def term(o: Column, o_kind: Column, datatype: Column, lang: Column) -> Column:
    literal = F.concat(
        F.lit('"'), escape_literal(o), F.lit('"'),
        F.when(lang.isNotNull(), F.concat(F.lit("@"), lang))
        .when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">")))
        .otherwise(F.lit("")),
    )
    return F.when(o_kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(literal)


def ntriple(s: Column, p: Column, o: Column, o_kind: Column, datatype: Column, lang: Column) -> Column:
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), term(o, o_kind, datatype, lang), F.lit(" ."))
