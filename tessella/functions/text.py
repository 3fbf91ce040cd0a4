"""String expressions: tokens, pair keys, rule fields, number formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = " ||| "
#: ASCII white space; the same set in Java's and other engines' regular expressions.
BLANK = r"[ \t\n\r\f\x0B]+"


def tokens(col: Column) -> Column:
    """Words between runs of white space; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), BLANK), lambda w: w != "")


def pair_key(src: Column, tgt: Column) -> Column:
    return F.concat(src, F.lit(SEPARATOR), tgt)


def fields(line: Column) -> Column:
    """The fields of a delimited line."""
    return F.split(line, r" \|\|\| ")


def bracketed(col: Column) -> Column:
    """What stands in the first square brackets; empty without."""
    return F.regexp_extract(col, r"\[([^\]]*)\]", 1)


def tree_leaves(sexp: Column) -> Column:
    """Leaves of an s-expression: words that neither open nor close a bracket and don't follow an opening one as its label."""
    return F.filter(F.regexp_extract_all(sexp, F.lit(r"(?:\(\s*[^\s()]*)|([^\s()]+)"), 1), lambda w: w != "")


def printed(col: Column, spec: str) -> Column:
    """A number as C's printf shows it (``%.5g`` drops trailing zeros, which Java's formats don't); null stays null."""

    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else spec % x).astype(object)

    return F.pandas_udf(show, StringType())(col.cast("double"))
