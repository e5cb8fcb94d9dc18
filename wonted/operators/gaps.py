"""Median gap between a sender's messages, only where a long silence makes it matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, Registry, SkewPolicy
from wonted.operators.running import running
from wonted.operators.skew import NONE_HOT, HotKeys
from wonted.session import checkpointed

#: Bits of a gap that one round of ``prefix_select`` settles.
DIGIT = 6


def median_gaps(
    state: DataFrame,
    *,
    registry: Registry = DEFAULT_REGISTRY,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """(msg_id, gap, median_gap) for messages after a silence of at least ``registry.dormant_gap``.

    ``state`` is in time order with sender, t, msg_id, sent_at, p_n, p_last.  Gaps are counted per
    (sender, stretch between silences, gap); a message after a silence asks for the middle of the earlier stretches.
    Where nobody was silent, one look at the times is all.
    """
    silence = f"coalesce(gap >= {registry.dormant_gap}, false)"
    silent = f"{silence} AND p_n >= {registry.min_baseline}"
    order, common = ["t", "msg_id"], {"hot": hot.get("sender"), "policy": policy}
    gaps = state.selectExpr("sender", "t", "msg_id", "p_n", "sent_at - p_last AS gap")
    asking = checkpointed(gaps.filter(silent).select("sender").distinct())
    if asking.isEmpty():
        return no_medians(state)
    gaps = gaps.join(asking, "sender", "left_semi")
    counted = running(gaps, ["sender"], order, {"_before": ("count", silence)}, **common)
    stretches = checkpointed(
        counted.selectExpr("sender", "msg_id", "p_n", "gap", f"_before + if({silence}, 1, 0) AS at")
    )
    events = (
        stretches.filter("gap IS NOT NULL")
        .groupBy("sender", "at", F.col("gap").alias("g"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return prefix_medians(events, stretches.filter(silent).select("sender", "at", "msg_id", "gap"))


def no_medians(state: DataFrame) -> DataFrame:
    return state.sparkSession.createDataFrame([], f"msg_id {dict(state.dtypes)['msg_id']}, gap bigint, median_gap double")


def prefix_medians(events: DataFrame, readers: DataFrame) -> DataFrame:
    """(msg_id, gap, median_gap) of ``readers`` (sender, at, msg_id, gap): the median of the ``events`` of the sender
    (sender, at, g, n) at smaller ``at``, each counted n times; n may be negative, where a gap was split later.

    Readers with fewer than two earlier gaps are left out.
    """
    both = events.selectExpr("sender", "at", "1 AS side", "cast(NULL AS bigint) AS msg_id", "cast(NULL AS bigint) AS gap", "n")
    asked = readers.selectExpr("sender", "at", "0 AS side", "msg_id", "gap", "0L AS n")
    per_at = both.groupBy("sender", "at", "side", "msg_id", "gap").agg(F.sum("n").alias("n")).unionByName(asked)
    sizes = per_at.selectExpr(
        "*", "sum(n) OVER (PARTITION BY sender ORDER BY at, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size"
    ).filter("side = 0 AND size >= 2")
    middles = sizes.selectExpr("sender", "at", "msg_id", "gap", "size", "explode(array_distinct(array((size - 1) div 2, size div 2))) AS k")
    found = prefix_select(events, middles)
    return found.groupBy("msg_id", "gap").agg(F.avg("g").alias("median_gap"))


def prefix_select(events: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (sender, at, k, size, others) with g: the k-th smallest (from 0) of the sender's ``size`` events at smaller ``at``.

    The value is found digit by digit from the highest: events that share the digits found so far are counted by next
    digit and place, a running sum over the places tells a target how many lie before it, and the digit in which
    its rank falls is the next.  A round costs the events still in question and ``2 ** DIGIT`` rows a target,
    whatever the number of targets a sender has.  As soon as all targets together have no more events in question than
    a round costs, at once for most data, these are looked through.
    """
    others = [c for c in targets.columns if c not in ("sender", "at", "k", "size")]
    events = checkpointed(events)
    rows, top = events.agg(F.count(F.lit(1)), F.coalesce(F.max("g"), F.lit(0))).first()
    open_ = checkpointed(targets.selectExpr("*", "0L AS found"))
    n_targets, shift = open_.count(), DIGIT * -(-int(top).bit_length() // DIGIT)
    while shift and open_.agg(F.sum("size")).first()[0] > rows + n_targets * 2**DIGIT:
        shift -= DIGIT
        open_ = checkpointed(_next_digit(events, open_, shift, others))
    if not shift:
        return open_.withColumnRenamed("found", "g").drop("k", "size")
    near = events.selectExpr("sender", "at AS when", f"shiftright(g, {shift}) AS found", "g", "n")
    met = near.join(open_, ["sender", "found"]).filter("when < at").groupBy("sender", "at", "k", *others, "g").agg(F.sum("n").alias("n"))
    names = ", ".join(["sender", "at", "k", *others])
    upto = met.selectExpr("*", f"sum(n) OVER (PARTITION BY {names} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c")
    # k counts from the first event in question
    return upto.filter("c > k").groupBy("sender", "at", "k", *others).agg(F.min("g").alias("g")).drop("k")


def _next_digit(events: DataFrame, open_: DataFrame, shift: int, others: list[str]) -> DataFrame:
    """Targets with one more digit found, their rank and number of events among those that share it."""
    near = events.selectExpr("sender", "at", f"shiftright(g, {shift + DIGIT}) AS found", f"int(shiftright(g, {shift}) & {2**DIGIT - 1}) AS digit", "n")
    near = near.join(open_.select("sender", "found").distinct(), ["sender", "found"], "left_semi")
    counts = near.groupBy("sender", "found", "digit", "at").agg(F.sum("n").alias("n"))
    asked = open_.drop("size").selectExpr("*", f"explode(sequence(0, {2**DIGIT - 1})) AS digit")
    rows = counts.selectExpr("*", "1 AS side").unionByName(asked.selectExpr("*", "0L AS n", "0 AS side"), allowMissingColumns=True)
    before = "sum(n) OVER (PARTITION BY sender, found, digit ORDER BY at, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c"
    told = rows.selectExpr("*", before).filter("side = 0")
    told = told.groupBy("sender", "at", "k", "found", *others).agg(F.expr("transform(array_sort(collect_list(struct(digit, c))), x -> x.c) AS counts"))
    walk = (
        "aggregate(counts, named_struct('digit', 0, 'left', k, 'done', false), (a, c) -> named_struct("
        "'digit', if(a.done OR a.left < c, a.digit, a.digit + 1), "
        "'left', if(a.done OR a.left < c, a.left, a.left - c), 'done', a.done OR a.left < c))"
    )
    told = told.selectExpr("sender", "at", "found", *others, "counts", f"{walk} AS w")
    return told.selectExpr("sender", "at", "w.left AS k", "counts[w.digit] AS size", *others, f"found * {2**DIGIT} + w.digit AS found")
