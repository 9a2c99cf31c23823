"""NULL-safe joins and value buckets shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns appear once."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = " AND ".join(f"`{k}` <=> `__r_{k}`" for k in keys)
    return left.join(renamed, F.expr(cond), how).drop(*[f"__r_{k}" for k in keys])


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`join_on` of two tables that both grow with the input, always by sort and merge.

    Before a run, the planner's sizes know neither rows that are still to be exploded nor how far files are compressed; such a
    table may look small and would be sent to every task through the driver.
    """
    return join_on(left.hint("merge"), right, keys, how)


#: Pieces into which each level of buckets cuts a bucket of the level before; a power of two, so that the levels nest exactly.
PIECES = 2048


def value_bucket(x: str, level: int = 1) -> str:
    """SQL text of a monotone bucket of a double that depends on the value only.

    Away from zero a bucket of level 1 is about 0.05 % wide; each further level cuts every bucket into PIECES. Being a pure
    function of the value, it is the same in every scan and retry, so bucket histograms and bucket members computed in
    different stages always agree.
    """
    return f"cast(floor(signum({x}) * log1p(abs({x}) * 1e15D) * {float(PIECES ** level)!r}D) AS bigint)"
