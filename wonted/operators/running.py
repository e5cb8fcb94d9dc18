"""State before each row: running aggregates over the earlier rows of the same key.

This replaces a row-at-a-time replay.  One window does it for ordinary keys.  A key with too many
rows for one task is cut into chunks: totals per chunk (combined before the shuffle), a window over
the few totals, and a window inside each chunk, which is the usual two-level prefix sum.  The same
carry-in also continues from state stored by earlier incremental batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_SKEW, SkewPolicy
from wonted.operators.skew import chunk_columns


def _aggregate(kind: str, value: str) -> str:
    if kind == "count":
        return f"sum(if({value}, 1L, 0L))"
    return f"{kind}({value})"


def _merge(kind: str, a: str, b: str) -> str:
    if kind in ("sum", "count"):
        return f"if({a} IS NULL AND {b} IS NULL, NULL, coalesce({a}, 0) + coalesce({b}, 0))"
    return f"least({a}, {b})" if kind == "min" else f"greatest({a}, {b})"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, str]],
    *,
    hot: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
    carry: DataFrame | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add one column per aggregate over all rows of ``keys`` strictly before this one in ``order``.

    ``aggs`` maps a new column to ("sum" | "min" | "max", value) or ("count", condition), both SQL
    text.  ``order`` ends with a unique row id.  With ``descending`` the rows *after* this one are
    meant.  ``hot`` lists large values of ``keys[0]``.  ``carry`` holds earlier state: the keys and
    the same columns, one row per key.
    """
    way = "DESC" if descending else "ASC"
    by = list(keys)
    if hot is not None:
        df = chunk_columns(df, keys[0], order, hot, policy)
        by.append("_chunk")

    def over(partition, ordering):
        return (
            f"OVER (PARTITION BY {', '.join(partition)} "
            f"ORDER BY {', '.join(f'{o} {way}' for o in ordering)} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        )

    out = df.selectExpr(
        "*", *[f"{_aggregate(k, v)} {over(by, order)} AS {n}" for n, (k, v) in aggs.items()]
    )
    offsets = None
    if carry is not None:
        offsets = carry.selectExpr(*keys, *[f"{n} AS _o_{n}" for n in aggs])
    if hot is not None:
        totals = (
            df.filter("size(_chunk) > 0")
            .groupBy(*by)
            .agg(*[F.expr(f"{_aggregate(k, v)} AS {n}") for n, (k, v) in aggs.items()])
        )
        chunks = totals.selectExpr(
            *by,
            *[
                f"{'sum' if k == 'count' else k}({n}) {over(keys, ['_chunk'])} AS {n}"
                for n, (k, _) in aggs.items()
            ],
        )
        if offsets is not None:
            # the state of a split key goes into its few chunk totals, not onto its rows
            chunks = _add_offsets(chunks.join(offsets, keys, "left"), aggs)
            whole = offsets.selectExpr("*", "cast(array() AS array<bigint>) AS _chunk")
        chunks = chunks.selectExpr(*by, *[f"{n} AS _o_{n}" for n in aggs])
        offsets = chunks if offsets is None else chunks.unionByName(whole)
    if offsets is not None:
        out = _add_offsets(out.join(offsets, by, "left"), aggs).drop("_chunk")
    counts = [n for n, (k, _) in aggs.items() if k == "count"]
    if not counts:
        return out
    return out.selectExpr(*[f"coalesce({c}, 0L) AS {c}" if c in counts else c for c in out.columns])


def _add_offsets(df: DataFrame, aggs: dict) -> DataFrame:
    kept = [c for c in df.columns if c not in aggs and not c.startswith("_o_")]
    merged = [f"{_merge(k, f'_o_{n}', n)} AS {n}" for n, (k, _) in aggs.items()]
    return df.selectExpr(*kept, *merged)
