"""Lookalike domains and shared display names, without comparing pairs.

Two strings are within two edits (insert, delete, substitute, swap neighbours; no piece edited twice)
exactly when each can be brought to one common *form*: mark substituted places, mark swapped
neighbours, drop the extra characters.  So every domain emits its forms, trusted domains keep the
earliest activation per form, and an equality join on the form gives the exact answer.  No pair is
generated and no distance has to be verified afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, Registry
from wonted.functions.domains import is_freemail
from wonted.functions.sql import literal
from wonted.functions.text import skeleton

SUBSTITUTED, SWAPPED = "\x01", "\x02"


def edit_forms(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` once per form of a string column, with form, marks and drops: every result of
    applying at most two edits to the string (some more than once, as in a run of equal letters)."""
    s = column

    def edit(width, out, marks, drops):
        return (
            f"named_struct('pos', i, 'width', {width}, 'out', {out}, 'marks', {marks}, 'drops', {drops})"
        )

    at, left, right = f"sequence(1, length({s}))", f"substr({s}, i, 1)", f"substr({s}, i + 1, 1)"
    pair = f"concat('{SWAPPED}', least({left}, {right}), greatest({left}, {right}))"
    unequal = f"filter({at}, i -> i < length({s}) AND {left} <> {right})"
    single = (
        f"concat(transform({at}, i -> {edit(1, literal(SUBSTITUTED), 1, 0)}), "
        f"transform({at}, i -> {edit(1, literal(''), 0, 1)}), "
        f"transform({unequal}, i -> {edit(2, pair, 1, 0)}))"
    )
    head = f"substr({s}, 1, e.pos - 1), e.out"
    once = (
        f"named_struct('form', concat({head}, substr({s}, e.pos + e.width)), "
        "'marks', e.marks, 'drops', e.drops)"
    )
    between = f"substr({s}, e.pos + e.width, x.pos - e.pos - e.width)"
    both = (
        f"named_struct('form', concat({head}, {between}, x.out, substr({s}, x.pos + x.width)), "
        "'marks', e.marks + x.marks, 'drops', e.drops + x.drops)"
    )
    later = "filter(_edits, x -> x.pos >= e.pos + e.width)"
    forms = (
        f"concat(array(named_struct('form', {s}, 'marks', 0, 'drops', 0)), "
        f"transform(_edits, e -> {once}), "
        f"flatten(transform(_edits, e -> transform({later}, x -> {both}))))"
    )
    kept = [c for c in df.columns]
    return df.selectExpr("*", f"{single} AS _edits").selectExpr(*kept, f"inline({forms})")


def domain_forms(domains: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Forms of the skeletons of domains long enough to be compared; keeps the other columns."""
    long = domains.filter(f"length(rd) >= {registry.lookalike_min_len}")
    return edit_forms(long.withColumn("_skel", skeleton("rd")), "_skel").drop("_skel")


def match_forms(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    """(rd, look0, look1, look2): struct(pos, target) of the earliest trusted other domain whose
    skeleton is equal, within one and within two edits.

    ``candidates`` are forms with rd; ``trusted`` forms with rd and trust_pos.  At equal activation
    the smaller name is taken.
    """
    earliest = W.partitionBy("form", "drops").orderBy("trust_pos", "rd")
    targets = (
        trusted.dropDuplicates(["form", "drops", "rd"])
        .withColumn("_r", F.row_number().over(earliest))
        .filter("_r <= 2")  # two, so that one of them is another domain
        .selectExpr("form", "marks", "drops AS t_drops", "struct(trust_pos AS pos, rd AS target) AS hit")
    )
    found = (
        candidates.select("rd", "form", "marks", "drops")
        .join(targets, ["form", "marks"])
        .selectExpr("rd", "hit", "marks + drops + t_drops AS edits")
        .filter("hit.target <> rd AND edits <= 2")
    )
    return found.groupBy("rd").agg(
        *[F.expr(f"min(if(edits <= {k}, hit, NULL)) AS look{k}") for k in (0, 1, 2)]
    )


def can_be_target(domains: DataFrame) -> DataFrame:
    """Trusted domains that others may imitate: anyone can have an address at a freemail one."""
    return domains.filter(f"trust_pos IS NOT NULL AND NOT {is_freemail('rd')}")


def lookalikes(domains: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """``match_forms`` of every domain (rd, trust_pos or NULL) against the trusted ones among them."""
    forms = domain_forms(domains, registry)
    return match_forms(forms, can_be_target(forms))


def name_owners(names: DataFrame, acts: DataFrame) -> DataFrame:
    """(name_skel, owner1, owner2): the two earliest moments at which different senders became
    established owners of a display name.  Two suffice, as one of them is not the reader."""
    used = (
        names.groupBy(F.col("b").alias("name_skel"), "sender")
        .agg(F.min("first_pos").alias("used_pos"))
    )
    established = acts.filter("pos3 IS NOT NULL").select("sender", "pos3")
    owned = used.join(established, "sender").selectExpr(
        "name_skel", "struct(greatest(used_pos, pos3) AS pos, sender) AS own"
    )
    rank = F.row_number().over(W.partitionBy("name_skel").orderBy("own"))
    return (
        owned.withColumn("_r", rank)
        .filter("_r <= 2")
        .groupBy("name_skel")
        .agg(*[F.expr(f"min(if(_r = {i}, own, NULL)) AS owner{i}") for i in (1, 2)])
    )
