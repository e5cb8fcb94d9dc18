"""State of the incremental job: append-only tables of what each batch contributed.

All state merges by sum, min or max, so a batch only adds rows under its own batch number and the
state before batch N is the merge of the rows with a smaller number.  A repeated batch overwrites its
own rows and reads none of them, hence every batch counts exactly once, also after lost executors or a
restart.  ``merge`` puts the state so far beside them as one row per key, so a batch reads the keys' state and the
few batches since, not the history.  A store that was rebuilt continues in a folder of its own (``renewed``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wonted.functions.position import TYPE as POSITION

SCHEMAS = {
    "marks": "account_id bigint, folder string, generation bigint, last_seen_uid bigint",
    "passed": "account_id bigint, folder string, generation bigint, uid bigint",  # rows without a usable sender
    "holds": "n bigint",  # one row per batch that has a snapshot of held rows
    "messages": (
        "account_id bigint, folder string, generation bigint, uid bigint, msg_id bigint, message_id string, "
        "direction string, sender string, from_email_norm string, from_display_name string, "
        "reply_to_email_norm string, recipients array<string>, sent_at bigint, sent_hour_local int, "
        "sent_dow_local int, size_bytes bigint, "
        "attachments array<struct<mime_type:string,extension:string,size_bytes:bigint>>, "
        "link_domains map<string,int>, links_extracted boolean, is_reply boolean, thread_id bigint, "
        "thread_depth int, root_key string, auth_spf string, auth_dkim string, auth_dmarc string"
    ),
    "sender_state": (
        "sender string, p_n bigint, p_first bigint, p_last bigint, p_size decimal(38,0), p_size2 decimal(38,0), "
        "p_links bigint, p_links2 decimal(38,0), p_hours bigint, p_att bigint"
    ),
    "sender_hours": "sender string, sent_hour_local int, p_hour bigint",
    "sender_gaps": "sender string, g bigint, n bigint",  # gaps between neighbouring times, negative where one was split
    "sender_values": f"sender string, kind string, a string, b string, n bigint, first_pos {POSITION}",
    "sender_names": f"sender string, kind string, a string, b string, n bigint, first_pos {POSITION}",
    "thread_senders": "thread_id bigint, sender string, min_in bigint",
    "credits": f"thread_id bigint, sender string, kind string, pos {POSITION}",
    "activations": f"sender string, pos3 {POSITION}, pos2 {POSITION}",
    "domains": f"rd string, reply_pos {POSITION}, n_replied_threads bigint, trust_pos {POSITION}",
    "trusted_forms": f"rd string, trust_pos {POSITION}, form string, marks int, drops int",
    "message_scores": (
        "msg_id bigint, engine_version string, trust_tier_at_scoring int, baseline_n bigint, anomaly_score double"
    ),
    "message_score_features": (
        "msg_id bigint, feature string, raw_value double, weight double, contribution double, explanation string"
    ),
}

# How rows of different batches with the same key merge.
MERGES = {
    "marks": (["account_id", "folder", "generation"], {"last_seen_uid": "max"}),
    "sender_state": (
        ["sender"],
        {
            "p_n": "sum", "p_first": "min", "p_last": "max", "p_size": "sum", "p_size2": "sum",
            "p_links": "sum", "p_links2": "sum", "p_hours": "sum", "p_att": "sum",
        },
    ),
    "sender_hours": (["sender", "sent_hour_local"], {"p_hour": "sum"}),
    "sender_gaps": (["sender", "g"], {"n": "sum"}),
    "sender_values": (["sender", "kind", "a", "b"], {"n": "sum", "first_pos": "min"}),
    "sender_names": (["sender", "kind", "a", "b"], {"n": "sum", "first_pos": "min"}),
    "thread_senders": (["thread_id", "sender"], {"min_in": "min"}),
    "activations": (["sender"], {"pos3": "min", "pos2": "min"}),
    "domains": (["rd"], {"reply_pos": "min", "n_replied_threads": "sum", "trust_pos": "min"}),
}


class Store:
    """Tables below one shared folder.

    With ``before``, as the batch of that number finds it: rebuilds by it or later ones do not count.
    """

    def __init__(self, spark: SparkSession, folder: str, before: int | None = None):
        self.spark, self.root = spark, folder.rstrip("/")
        last = self._last(f"{self.root}/renewals", before)
        self.folder = self.root if last is None else f"{self.root}/renewed-{last[0]}"

    def _read(self, path: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _last(self, path: str, before: int | None) -> tuple[int, int] | None:
        """(batch, n) of the last note, below ``before`` if given, in a table with one row a note."""
        noted = self._read(path, T.StructType.fromDDL("n bigint, batch_id bigint"))
        if noted is None:
            return None
        last = noted.filter("true" if before is None else f"batch_id < {int(before)}").agg(F.max(F.struct("batch_id", "n"))).first()[0]
        return None if last is None else (last["batch_id"], last["n"])

    def _note(self, path: str, batch: int, n: int = 1) -> None:
        self.spark.range(1).selectExpr(f"{int(n)}L AS n").write.mode("overwrite").parquet(f"{path}/batch_id={int(batch)}")

    def renewed(self, batch: int) -> Store:
        """The empty store in which a batch rebuilds this one; ``renew`` makes it the current one."""
        new = Store(self.spark, self.root, before=-1)
        new.folder = f"{self.root}/renewed-{int(batch)}"
        return new

    def renew(self, batch: int) -> None:
        self._note(f"{self.root}/renewals", batch)

    def write(self, table: str, df: DataFrame, batch: int) -> DataFrame:
        """Replace one batch's rows and read them back, which also cuts the lineage."""
        path = f"{self.folder}/{table}/batch_id={int(batch)}"
        schema = T.StructType.fromDDL(SCHEMAS[table])
        shaped = df.selectExpr(*[f"cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema])
        shaped.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def rows(self, table: str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one (a partition filter)."""
        schema = T.StructType.fromDDL(SCHEMAS[table] + ", batch_id bigint")
        df = self._read(f"{self.folder}/{table}", schema)
        if df is None:
            return self.spark.createDataFrame([], schema)  # before the first batch
        return df if before is None else df.filter(F.col("batch_id") < before)

    def state(self, table: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Merged state, only for the rows that match ``keys`` (joined on its columns) if given.

        ``keys`` come from the batch, so the join keeps what the batch can touch before merging.
        """
        by, merges = MERGES[table]
        df, merged = self.rows(table, before), self._last(f"{self.folder}/merges", None if before is None else before + 1)
        if merged is not None:
            base = self._read(f"{self.folder}/merged-{merged[1]}/{table}", T.StructType.fromDDL(SCHEMAS[table]))
            df = df.filter(F.col("batch_id") >= merged[0]).drop("batch_id").unionByName(base)
        if keys is not None:
            df = df.join(keys.distinct(), keys.columns, "left_semi")
        return df.groupBy(*by).agg(*[F.expr(f"{how}({c}) AS {c}") for c, how in merges.items()])

    def merge_if_due(self, batch: int, every: int) -> None:
        """Before a batch: put the merged state of all earlier ones beside them, once in ``every`` batches.

        The note that makes it count comes last.  Two places take turns: the state before it stays until then.
        """
        last, place = self._last(f"{self.folder}/merges", batch + 1) or (0, 1)
        if batch - last < every:
            return
        for table in MERGES:
            schema = T.StructType.fromDDL(SCHEMAS[table])
            cast = [f"cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
            self.state(table, batch).selectExpr(*cast).write.mode("overwrite").parquet(f"{self.folder}/merged-{1 - place}/{table}")
        self._note(f"{self.folder}/merges", batch, 1 - place)

    def taken(self, before: int) -> DataFrame:
        """Keys of the rows that batches before one took, with or without a usable sender."""
        columns = ["account_id", "folder", "generation", "uid"]
        return self.rows("messages", before).select(*columns).union(self.rows("passed", before).select(*columns))

    def hold(self, df: DataFrame, batch: int) -> None:
        """Replace the snapshot of the facts that wait behind a gap after this batch.

        Two places take turns, so a batch writes over the snapshot before the one it read, and no older one stays.
        """
        place = 1 - (self._held_place(batch) or 0)
        df.write.mode("overwrite").parquet(f"{self.folder}/held/{place}")
        self.write("holds", self.spark.range(1).selectExpr(f"{place}L AS n"), batch)

    def _held_place(self, before: int) -> int | None:
        return self.rows("holds", before).agg(F.max_by("n", "batch_id")).first()[0]

    def held(self, before: int) -> DataFrame | None:
        """The last snapshot of waiting facts before a batch."""
        place = self._held_place(before)
        return None if place is None else self.spark.read.parquet(f"{self.folder}/held/{place}")

    def compact(self, folder: str, last_batch: int) -> Store:
        """A store in a new folder with everything up to a batch merged under its number."""
        new = Store(self.spark, folder)
        for table in SCHEMAS:
            upto = last_batch + 1
            df = self.state(table, upto) if table in MERGES else self.rows(table, upto).drop("batch_id")
            new.write(table, df, last_batch)
        waiting = self.held(last_batch + 1)
        if waiting is not None:
            new.hold(waiting, last_batch)
        return new
