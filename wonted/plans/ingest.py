"""One ingest run over landed rows: what is new, what is invalid, where the marks end up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, FOLDER_ROLES, Registry, SkewPolicy
from wonted.functions.sql import one_of
from wonted.operators.ordinals import arrival_numbers
from wonted.session import checkpointed
from wonted.sources import landed as landed_
from wonted.sources.landed import RunStats


@dataclass
class IngestRun:
    """Result of a run: all facts, the new ones, the folders read anew and the folder state.

    ``sources.tables.write_run`` stores it.
    """

    facts: DataFrame
    new_facts: DataFrame
    invalid: DataFrame
    folders: DataFrame
    stats: RunStats


def ingest(
    landed: DataFrame,
    mine: DataFrame,
    folders: DataFrame,
    facts: DataFrame | None = None,
    *,
    listing: DataFrame | None = None,
    first_number: int = 1,
    structure_only: bool = False,
    registry: Registry = DEFAULT_REGISTRY,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> IngestRun:
    """Take the new rows of every folder up to its first gap.

    ``landed`` has the rows the source lists, with ``served`` false where the content was missing.  Without a msg_id the
    accepted rows are numbered from ``first_number``, sent folders first.
    ``folders`` is the stored state (account_id, folder, role, generation, last_seen_uid), ``listing`` the source's own
    (account_id, folder, role, generation); without it the row that arrived last tells a folder's generation (without
    msg_id: the largest counts).  A folder whose generation changed, up or down, loses its facts and starts again; rows of
    other generations, which a table that is only appended to still lists, are stale and counted.  Rows of folders without a
    known role are left out.  Rows without a sender are not stored, but the mark moves past them.

    Two jobs read the landed rows: one sums up each folder from narrow columns, one makes the facts, which are counted
    as they are written.
    """
    rows = landed if "served" in landed.columns else landed.selectExpr("*", "true AS served")
    rows = rows.filter(one_of("folder_role", FOLDER_ROLES))
    by_arrival = "msg_id" in rows.columns
    last = "msg_id" if by_arrival else "generation"
    if listing is None:
        listing = rows.groupBy("account_id", "folder").agg(
            F.max_by("folder_role", last).alias("role"), F.max_by("generation", last).alias("generation")
        )
    listed = checkpointed(landed_.valid_folders(listing))  # a row per folder, like the state; read by every step below
    known = landed_.valid_folders(landed_.known_folders(folders, listed))
    invalid = checkpointed(landed_.invalidated_folders(known, listed))
    state = checkpointed(landed_.reset_folders(known, invalid))
    before = facts if facts is None else landed_.without_folders(facts, invalid)
    unseen = landed_.unseen_rows(landed_.current_rows(rows, listed, policy), state, policy)
    accepted = landed_.contiguous_prefix(unseen, policy)
    summary = checkpointed(landed_.folder_summary(rows, unseen, accepted, listed))
    if not by_arrival:
        accepted = arrival_numbers(accepted, first_number)
    counted = Observation("new facts")
    new = landed_.message_facts(accepted, mine, structure_only=structure_only, registry=registry, policy=policy)
    new = checkpointed(new.observe(counted, F.count(F.lit(1)).alias("n")))  # stored once: counted here, written by the caller
    return IngestRun(
        facts=new if before is None else before.unionByName(new, allowMissingColumns=True),
        new_facts=new,
        invalid=invalid,
        folders=checkpointed(landed_.advanced_marks(state, summary)),
        stats=landed_.run_stats(counted.get["n"], summary, state, invalid),
    )
