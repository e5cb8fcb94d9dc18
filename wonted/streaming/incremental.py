"""Scoring messages as they arrive, batch by batch, with Structured Streaming.

A batch is judged against the state stored before it plus what arrives earlier within it; cost follows
the batch and the state of the senders, threads, names and domains in it, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, FOLDER_ROLES, Registry, SkewPolicy
from wonted.functions.sql import one_of
from wonted.operators import arrival, baseline, features, lookalike, relations, threads
from wonted.operators.skew import find_hot_keys, lookup_join, salted_left_join
from wonted.plans.rebuild import MESSAGE, Derived, replay
from wonted.session import checkpointed
from wonted.sources import facts as facts_
from wonted.sources.landed import FOLDER_KEY, contiguous_prefix, message_facts
from wonted.streaming.store import Store

ORDER = ["msg_id"]


KEY = ["account_id", "folder", "generation", "uid"]


def current_generations(rows: DataFrame) -> DataFrame:
    """(account_id, folder, _listed): the generation of the row that arrived last."""
    return rows.groupBy("account_id", "folder").agg(F.max_by("generation", "msg_id").alias("_listed"))


def known_marks(store: Store, batch: int) -> DataFrame:
    """(account_id, folder, _known, _mark) of what is stored; a store holds one generation of a folder."""
    return store.state("marks", batch).selectExpr("account_id", "folder", "generation AS _known", "last_seen_uid AS _mark")


def follow_generations(rows: DataFrame, store: Store, batch: int, **options) -> Store:
    """The store to go on with.  If a folder comes with another generation than the stored one, larger or smaller, its rows
    are gone at the source: everything else is scored again, in order of arrival, in a renewed store, as if they had never come."""
    by = ["account_id", "folder"]
    changed = current_generations(rows).join(known_marks(store, batch), by).filter("_listed <> _known").select(*by)
    changed = checkpointed(changed)
    if changed.isEmpty():
        return store
    new = rebuild_store(store, store.renewed(batch), batch - 1, without=changed, **options)
    store.renew(batch)
    return new


def new_rows(messages: DataFrame, store: Store, batch: int, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Each (account, folder, generation, uid) once, if no earlier batch took it, in any order of uids.

    Only the current generation of a folder counts.  Rows above the stored mark of their folder are new without a
    look at what is stored.
    """
    by = ["account_id", "folder"]
    once = messages.dropDuplicates(KEY)
    folders = current_generations(once).join(known_marks(store, batch), by, "left").selectExpr(
        f"{FOLDER_KEY} AS folder_key", "_listed AS _current", "if(_known = _listed, _mark, NULL) AS _mark",
    )
    keyed = lookup_join(once.selectExpr("*", f"{FOLDER_KEY} AS folder_key"), folders, "folder_key", "uid", policy)
    current = keyed.filter("generation = _current")
    above = current.filter("_mark IS NULL OR uid > _mark").select(*messages.columns)
    below = current.filter("uid <= _mark").select(*messages.columns)
    if below.isEmpty():  # the usual case: nothing stored is read
        return above
    seen = store.taken(batch).join(below.select(*KEY), KEY, "left_semi")
    return above.unionByName(below.join(seen, KEY, "left_anti"))


def arrived_facts(landed: DataFrame, mine: DataFrame, **options) -> DataFrame:
    """Facts of landed rows of folders with a known role, with served and deleted.  From here on there is no text and no
    file name."""
    served = landed if "served" in landed.columns else landed.withColumn("served", F.lit(True))
    rows = served if "deleted" in landed.columns else served.withColumn("deleted", F.lit(False))
    rows = rows.filter(one_of("folder_role", FOLDER_ROLES))
    return message_facts(rows, mine, also=("served", "deleted"), usable_only=False, **options)


def released_rows(arrived: DataFrame, store: Store, batch: int, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Facts of this batch (``arrived_facts``) and those held back earlier, up to the first gap of their folder.

    A row with ``served`` false is a gap: it and everything behind it in the folder are held back until the row
    is served or listed as ``deleted``.
    """
    earlier = store.held(batch)
    rows = arrived if earlier is None else earlier.unionByName(arrived)
    best = W.partitionBy(*KEY).orderBy(F.desc("deleted"), F.desc("served"), "msg_id")
    rows = rows.withColumn("_i", F.row_number().over(best)).filter("_i = 1 AND NOT deleted").drop("_i")
    waiting = checkpointed(new_rows(rows, store, batch, policy))
    released = contiguous_prefix(waiting, policy)
    store.hold(waiting.join(released.select(*KEY), KEY, "left_anti"), batch)
    return released


def score_landed_batch(
    landed: DataFrame,
    mine: DataFrame,
    store: Store,
    batch: int,
    *,
    registry: Registry = DEFAULT_REGISTRY,
    policy: SkewPolicy = DEFAULT_SKEW,
    structure_only: bool = False,
) -> DataFrame:
    """From landed rows to scores in one step: facts, current generation, gap rule, scores."""
    options = {"registry": registry, "policy": policy}
    arrived = checkpointed(arrived_facts(landed, mine, structure_only=structure_only, **options))
    store = follow_generations(arrived, store, batch, **options)
    released = checkpointed(released_rows(arrived, store, batch, policy))
    usable = "from_email_norm <> ''"
    store.write("passed", released.filter(f"NOT ({usable})").select(*KEY), batch)
    return score_batch(released.filter(usable).drop("served", "deleted"), store, batch, fresh=True, **options)


def current_messages(store: Store) -> DataFrame:
    """Stored messages; those of a folder that was numbered anew left with the store that had them."""
    return store.rows("messages")


def rebuild_store(store: Store, into: Store | str, batch: int, without: DataFrame | None = None, **options) -> Store:
    """A new store with the current messages, scored again in order of arrival, what was passed over and what waits.
    ``without`` lists folders (account_id, folder) to leave out."""
    new = Store(store.spark, into) if isinstance(into, str) else into

    def kept(df: DataFrame) -> DataFrame:
        return df if without is None else df.join(without, ["account_id", "folder"], "left_anti")

    new.write("passed", kept(store.rows("passed", batch + 1)).select(*KEY), batch)
    score_batch(kept(store.rows("messages", batch + 1)).drop("sender", "batch_id"), new, batch, fresh=True, **options)
    held = store.held(batch + 1)
    if held is not None:
        new.hold(kept(held), batch)
    return new


def with_threads(messages: DataFrame, store: Store, batch: int, policy: SkewPolicy) -> DataFrame:
    """Thread id and depth from reply headers, continuing stored threads; a given thread_id is kept."""
    if "thread_id" in messages.columns:
        given = "root_key" in messages.columns
        return messages if given else messages.withColumn("root_key", F.lit(None).cast("string"))
    stored = store.rows("messages", batch)
    asked = messages.selectExpr(f"explode({threads.ANCESTORS}) AS message_id").distinct()
    known = stored.join(asked, "message_id", "left_semi").select(
        "message_id", "msg_id", "thread_id", "thread_depth"
    )
    keys = messages.selectExpr(f"{threads.ROOT_KEY} AS root_key").distinct()
    roots = stored.filter("root_key IS NOT NULL").join(keys, "root_key", "left_semi")
    found = threads.resolve_threads(
        messages.select("msg_id", "message_id", "in_reply_to", "references"),
        known=known, known_roots=roots.select("root_key", "thread_id").distinct(), policy=policy,
    )
    return messages.drop("thread_depth", "root_key").join(found, "msg_id")


def score_batch(
    messages: DataFrame,
    store: Store,
    batch: int,
    *,
    registry: Registry = DEFAULT_REGISTRY,
    policy: SkewPolicy = DEFAULT_SKEW,
    fresh: bool = False,
) -> DataFrame:
    """Judge one batch in order of arrival (msg_id) and store its facts, scores and contributions.

    Returns the scores.  Repeating a batch number replaces its results by the same ones.  ``fresh`` tells that the rows
    are current and new, which is looked up otherwise.
    """
    for column, default in (("generation", "1L"), ("folder", "'INBOX'"), ("account_id", "1L"), ("uid", "msg_id")):
        if column not in messages.columns:
            messages = messages.withColumn(column, F.expr(default))
    if not fresh:
        messages = checkpointed(messages)
        store = follow_generations(messages, store, batch, registry=registry, policy=policy)
        messages = new_rows(messages, store, batch, policy)
    prepared = facts_.prepare(with_threads(messages, store, batch, policy), order_by="msg_id", registry=registry)
    prepared = checkpointed(prepared)  # read by every branch below
    hot = find_hot_keys(prepared, ["sender", "thread_id", "name_skel", "rd"], "msg_id", "msg_id", policy)
    common = {"hot": hot, "policy": policy}
    everything = facts_.incoming(prepared)
    inc, out = everything.select(*MESSAGE, "thread_id"), facts_.outgoing(prepared)

    # credits
    in_threads = inc.select("thread_id").union(out.select("thread_id"))
    known = store.state("thread_senders", batch, in_threads)
    credited = store.rows("credits", batch).join(in_threads.distinct(), "thread_id", "left_semi")
    credits = store.write(
        "credits", arrival.arrival_credits(inc, out, known=known, credited=credited, **common), batch
    )

    # the senders' own state, once for everything that reads it
    senders = inc.select("sender")
    state = baseline.prior_state(inc, ORDER, carry=store.state("sender_state", batch, senders), **common)
    hours_before = store.state("sender_hours", batch, senders)
    state = checkpointed(baseline.prior_same_hour(state, ORDER, carry=hours_before, **common))

    # activations: stored ones first, as they are earlier
    reached = relations.join_activations(relations.one_way_of(state, registry), credits)
    acts = store.write("activations", reached, batch)
    before = store.state("activations", batch, senders.union(acts.select("sender")))
    acts_now = _earliest(before.unionByName(acts), "sender", "pos3", "pos2")

    # domains
    fresh_domains = relations.domain_replies(credits, registry).join(
        relations.domain_trust(acts, registry), "rd", "full"
    )
    domains = store.write("domains", fresh_domains, batch)
    touched = inc.select("rd").union(domains.select("rd"))
    domains_before = store.state("domains", batch, touched)
    both = domains_before.select("rd", "reply_pos", "trust_pos").unionByName(
        domains.select("rd", "reply_pos", "trust_pos")
    )
    domains_now = _earliest(both, "rd", "reply_pos", "trust_pos")
    newly = domains.filter("trust_pos IS NOT NULL").join(
        domains_before.filter("trust_pos IS NOT NULL"), "rd", "left_anti"
    )
    forms = lookalike.domain_forms(lookalike.can_be_target(newly).select("rd", "trust_pos"), registry)
    forms = store.write("trusted_forms", forms, batch)
    trusted = store.rows("trusted_forms", batch).drop("batch_id").unionByName(forms)
    candidates = lookalike.domain_forms(inc.select("rd").distinct(), registry)
    alike = lookalike.match_forms(candidates, trusted)

    # values and names
    values = store.write("sender_values", baseline.sender_values(inc), batch)
    values_before = store.state("sender_values", batch, senders)
    first_uses = values.join(values_before, ["sender", "kind", "a", "b"], "left_anti")
    link_counts = (
        values_before.filter("kind = 'link'").groupBy("sender").agg(F.count(F.lit(1)).alias("p_link_domains"))
    )
    names = store.write("sender_names", baseline.sender_names(inc), batch)
    shown = names.select("b").distinct()
    named = store.rows("sender_names", batch).drop("batch_id").join(shown, "b", "left_semi")
    owners_acts = store.state("activations", batch, named.select("sender")).unionByName(acts)
    owners = lookalike.name_owners(
        named.unionByName(names), _earliest(owners_acts, "sender", "pos3", "pos2")
    )

    # judge
    times = state.select("sender", "msg_id", "sent_at", "p_n", "p_last")

    def past(who: DataFrame) -> DataFrame:
        seen = store.rows("messages", batch).filter("direction = 'in'").select("sender", "msg_id", "sent_at")
        return seen.join(who, "sender", "left_semi")

    gap_events = checkpointed(arrival.arrival_gap_events(times, past, **common))
    known_gaps = lambda who: store.state("sender_gaps", batch, who)
    median = arrival.arrival_median_gaps(times, gap_events, known_gaps, registry=registry)
    per_domain = domains_now.join(alike, "rd", "full")
    context = senders.distinct().selectExpr("sender", f"{relations.sender_domain(registry)} AS rd")
    context = salted_left_join(context, per_domain, "rd", "sender", hot.get("rd"), policy).drop("rd")
    context = context.join(acts_now.select("sender", "pos3"), "sender", "left")
    judged = salted_left_join(state, context, "sender", "msg_id", hot.get("sender"), policy)
    judged = salted_left_join(judged, owners, "name_skel", "msg_id", hot.get("name_skel"), policy)
    new = baseline.novelties(first_uses, ORDER, carry=link_counts, **common)
    judged = judged.join(new, "msg_id", "left").join(median, "msg_id", "left")
    judged = judged.selectExpr("*", f"{relations.tier_before(registry)} AS tier")
    scored = features.with_features(judged, registry)
    shown = [c for c in scored.columns if c.startswith(("raw_", "explain_"))]
    scored = checkpointed(scored.select("msg_id", "tier", "p_n", "anomaly_score", *shown))  # two tables are made of it

    scores = store.write("message_scores", features.message_scores(scored, registry), batch)
    store.write("message_score_features", features.score_features(scored, registry), batch)

    # what this batch adds to the state
    added = {n: F.expr(_total(k, v)).alias(n) for n, (k, v) in baseline.own_state().items()}
    store.write("sender_state", inc.groupBy("sender").agg(*added.values()), batch)
    hours = baseline.sender_hours(inc, "sent_hour_local").withColumnRenamed("n", "p_hour")
    store.write("sender_hours", hours, batch)
    store.write("sender_gaps", gap_events.groupBy("sender", "g").agg(F.sum("n").alias("n")).filter("n <> 0"), batch)
    store.write("thread_senders", relations.thread_senders(inc), batch)
    store.write("messages", prepared, batch)
    passed = store.rows("passed", batch + 1).filter(F.col("batch_id") == batch)
    took = prepared.select(*KEY).unionByName(passed.select(*KEY))
    marks = took.groupBy("account_id", "folder", "generation").agg(F.max("uid").alias("last_seen_uid"))
    store.write("marks", marks, batch)
    return scores


def _total(kind: str, value: str) -> str:
    return f"sum(if({value}, 1L, 0L))" if kind == "count" else f"{kind}({value})"


def _earliest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])


def late_senders(store: Store) -> DataFrame:
    """Senders with messages that arrived after later ones of theirs: their live scores may differ
    from a replay, so a rebuild is due."""
    seen = store.rows("messages").filter("direction = 'in'")
    per_batch = seen.groupBy("sender", "batch_id").agg(
        F.min("sent_at").alias("lo"), F.max("sent_at").alias("hi"),
        F.expr("min_by(sent_at, msg_id) AS first"), F.expr("max_by(sent_at, msg_id) AS last"),
    )
    inside = per_batch.filter("lo < first OR hi > last").select("sender")
    earlier = F.max("hi").over(W.partitionBy("sender").orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1))
    across = per_batch.withColumn("_before", earlier).filter("lo < _before").select("sender")
    return inside.union(across).distinct()


def replay_store(store: Store, *, registry: Registry = DEFAULT_REGISTRY, **options) -> Derived:
    """Replay everything current in order of time, as after a first read, late arrivals or a renumbered folder."""
    messages = current_messages(store).drop("sender", "batch_id", "root_key")
    return replay(facts_.prepare(messages, registry=registry), registry=registry, **options)


def score_stream(
    source: DataFrame,
    store_folder: str,
    checkpoint: str,
    *,
    mine: DataFrame | None = None,
    registry: Registry = DEFAULT_REGISTRY,
    policy: SkewPolicy = DEFAULT_SKEW,
    available_now: bool = True,
    merge_every: int = 16,
) -> StreamingQuery:
    """Start scoring a stream of message facts or, given the identities ``mine``, of landed rows.

    The checkpoint holds the source offsets; results are exactly once because a batch replaces its own output.  The
    state is merged to one row per key once in ``merge_every`` batches.
    """
    options = {"registry": registry, "policy": policy}

    def run(df: DataFrame, batch_id: int) -> None:
        store = Store(source.sparkSession, store_folder, before=batch_id)
        store.merge_if_due(batch_id, merge_every)
        if mine is None:
            score_batch(df, store, batch_id, **options)
        else:
            score_landed_batch(df, mine, store, batch_id, **options)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed Parquet files, optionally a bounded number per batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
