"""Folded names and domains: expressions where the text is ASCII, Python once per distinct other text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_SKEW, SkewPolicy
from wonted.functions.text import display_name_ascii, is_ascii, normalize_display_name, skeleton, skeleton_ascii
from wonted.operators.skew import lookup_join
from wonted.session import checkpointed


def with_folded(
    df: DataFrame, column: str, row_id: str, plain: dict[str, str], other: dict[str, Column], policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Add columns that depend on one text column: ``plain`` has their SQL text where it is ASCII, ``other`` the column otherwise.

    Where all texts are ASCII, which a look at the one column tells, no Python runs and nothing is joined.
    Else the distinct other texts are folded and joined back; ASCII rows have keys of their own there, so they spread out.
    """
    ascii_ = is_ascii(column)
    cheap = df.selectExpr("*", *[f"if({ascii_}, {text}, NULL) AS {name}" for name, text in plain.items()])
    odd = df.filter(f"NOT {ascii_}").select(column).distinct()
    if odd.isEmpty():
        return cheap
    found = checkpointed(odd.select(F.col(column).alias("_key"), *[c.alias(f"_other_{n}") for n, c in other.items()]))
    own = F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    keyed = cheap.withColumn("_key", F.when(F.expr(f"NOT {ascii_}"), F.col(column)).otherwise(own))
    joined = lookup_join(keyed, found, "_key", row_id, policy)
    return joined.withColumns({n: F.coalesce(n, f"_other_{n}") for n in plain}).select(*cheap.columns)


def with_names(messages: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Add name_norm and name_skel of from_display_name; NULL for no or an empty name."""
    name = "from_display_name"
    norm = f"nullif({display_name_ascii(name)}, '')"
    other = F.nullif(normalize_display_name(name), F.lit(""))
    return with_folded(
        messages, name, "msg_id", {"name_norm": norm, "name_skel": skeleton_ascii(norm)},
        {"name_norm": other, "name_skel": skeleton(other)}, policy,
    )


def with_skeleton(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the lookalike-folded form of a column of hosts or domains, whose rows are few per text."""
    return with_folded(df, column, column, {name: skeleton_ascii(column)}, {name: skeleton(column)})
