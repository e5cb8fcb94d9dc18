"""Writing facts and derived tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wonted.operators.features import stale_scores
from wonted.sources import facts as facts_

if TYPE_CHECKING:
    from wonted.plans.ingest import IngestRun

DERIVED = (
    "message_scores", "message_score_features", "sender_profiles", "domain_profiles",
    "thread_reply_credits", "sender_values",
)


KEY = ["account_id", "folder", "generation", "uid"]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None  # nothing written yet


def write_facts(facts: DataFrame, folder: str, run: int = 0) -> None:
    """Add the facts of one run, each (account, folder, generation, uid) once and only if no earlier run has it.

    Other runs' rows stay as they are; writing a run again replaces its own rows.
    """
    once = facts.dropDuplicates(KEY)
    stored = read_facts(facts.sparkSession, folder, before=run)
    if stored is not None:
        once = once.join(stored.select(*KEY), KEY, "left_anti")
    once.write.mode("overwrite").parquet(f"{folder}/messages/run={int(run)}")


def forget(folders: DataFrame, folder: str, run: int) -> None:
    """Delete what runs before this one stored for some folders (account_id, folder; a NULL folder means the whole
    account).  Only the decision is written; readers leave the rows out."""
    gone = folders.selectExpr("bigint(account_id) AS account_id", "string(folder) AS folder").distinct()
    gone.write.mode("overwrite").parquet(f"{folder}/forgotten/run={int(run)}")


def read_facts(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """Facts that are stored and not deleted, or None before the first write.

    With ``before``, those of earlier runs, as deletions up to and with that run leave them.
    """
    rows, gone = _stored(spark, f"{folder}/messages"), _stored(spark, f"{folder}/forgotten")
    if rows is None:
        return None
    if before is not None:
        rows = rows.filter(F.col("run") < before)
        gone = None if gone is None else gone.filter(F.col("run") <= before)
    if gone is None:
        return rows.drop("run")
    last = gone.groupBy("account_id", "folder").agg(F.max("run").alias("_gone"))
    whole = last.filter("folder IS NULL").selectExpr("account_id", "_gone AS _all_gone")
    kept = rows.join(last, ["account_id", "folder"], "left").join(whole, "account_id", "left")
    return kept.filter("run >= coalesce(greatest(_gone, _all_gone), run)").select(*rows.columns).drop("run")


def write_run(done: IngestRun, folder: str, run: int) -> None:
    """Store one ingest run: deletions, new facts, folder state.  The state comes last, so that a run that failed
    half-way is done again from the old state with the same number."""
    forget(done.invalid, folder, run)
    write_facts(done.new_facts, folder, run)
    done.folders.write.mode("overwrite").parquet(f"{folder}/folders/run={int(run)}")


def read_folders(spark: SparkSession, folder: str) -> DataFrame | None:
    """Folder state after the last stored run."""
    states = _stored(spark, f"{folder}/folders")
    if states is None:
        return None
    last = states.agg(F.max("run").alias("run"))
    return states.join(F.broadcast(last), "run", "left_semi").drop("run")  # one row


def write_scores(scores: DataFrame, features: DataFrame, folder: str, run: int) -> None:
    """Replace the scores and features of the messages in ``scores``; those of other messages stay."""
    timed = scores.selectExpr("*", "unix_timestamp() AS scored_at")
    features.write.mode("overwrite").parquet(f"{folder}/message_score_features/run={int(run)}")
    timed.write.mode("overwrite").parquet(f"{folder}/message_scores/run={int(run)}")


def read_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and features of the last run that scored each message."""
    scores = spark.read.parquet(f"{folder}/message_scores")
    last = scores.groupBy("msg_id").agg(F.max("run").alias("run"))
    pair = ["msg_id", "run"]
    features = spark.read.parquet(f"{folder}/message_score_features")
    return scores.join(last, pair, "left_semi").drop("run"), features.join(last, pair, "left_semi").drop("run")


def rescore_stale(derived, folder: str, run: int) -> None:
    """Replace the stored scores of other registry versions by those of a replay."""
    spark = derived.scores.sparkSession
    stale = stale_scores(read_scores(spark, folder)[0], derived.registry).select("msg_id")
    parts = [df.join(stale, "msg_id", "left_semi") for df in (derived.scores, derived.features)]
    write_scores(*parts, folder, run)


def write_dimensions(facts: DataFrame, folder: str) -> None:
    """The tables exploded or grouped from the facts."""
    tables = {
        "senders": facts_.sender_dimension(facts),
        "message_attachments": facts_.message_attachments(facts),
        "message_link_domains": facts_.message_link_domains(facts),
        "message_recipients": facts_.message_recipients(facts),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_derived(derived, folder: str) -> None:
    """Replace every derived table by the result of a replay, as run 0.  Scores carry the time of writing; no
    comparison uses it."""
    tables = {
        "message_scores": derived.scores.selectExpr("*", "unix_timestamp() AS scored_at", "0 AS run"),
        "message_score_features": derived.features.selectExpr("*", "0 AS run"),
        "sender_profiles": derived.sender_profiles(),
        "domain_profiles": derived.domain_profiles(),
        "thread_reply_credits": derived.credits,
        "sender_values": derived.values,
    }
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("run") if "run" in df.columns else writer).parquet(f"{folder}/{name}")


def read_derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in DERIVED:
        raise KeyError(name)
    if name.startswith("message_score"):
        return read_scores(spark, folder)[name == "message_score_features"]
    return spark.read.parquet(f"{folder}/{name}")
