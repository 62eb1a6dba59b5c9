"""Keeping the columns of a user's table apart from one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of just this name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name of theirs can meet another."""
    return F.struct(*[quoted(c) for c in docs.columns])


def unused(docs: DataFrame, wish: str) -> str:
    """``wish``, with underscores behind it until no column is called so in any case."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
