"""Values that arrive as ordered fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType


def _joined(text: str, *order: str) -> str:
    by = ", ".join(f"`{c}`" for c in order)
    return f"listagg(`{text}`, '\\n') within group (order by {by})"


def assemble(
    fragments: DataFrame, keys: list[str], order: str, text: str, value: str = "content", block: int | None = 4096
) -> DataFrame:
    """``keys, value``: the fragments of a key in ``order``, joined by newlines; null counts as empty.

    Runs of ``block`` positions are joined first, each in a group of its own, so
    the sort of a key with very many fragments is spread over tasks and only the
    joining of its blocks, in order, is left to the task that holds the value.
    ``block=None`` saves that exchange where no key has many fragments; so does
    an ``order`` that is not an integer, which has no blocks.
    """
    lines = fragments.select(*keys, F.col(order).alias("__at"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    whole = F.expr(_joined("__text", "__at", "__text")).alias(value)
    if block is None or not isinstance(fragments.schema[order].dataType, IntegralType):
        return lines.groupBy(*keys).agg(whole)
    blocks = lines.groupBy(*keys, F.floor(F.col("__at") / block).alias("__block")).agg(
        F.expr(_joined("__text", "__at", "__text")).alias("__text")
    )
    return blocks.groupBy(*keys).agg(F.expr(_joined("__text", "__block")).alias(value))
