"""Named queries over general tables (events, orders, conversations, pages, documents, ...).

Each takes (spark, folder) and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY
from wonted.functions import domains as dm
from wonted.functions import stats as st
from wonted.functions import text as tx
from wonted.functions.position import id_of, position, time_of
from wonted.operators import baseline, features, gaps, lookalike, ordinals, relations, threads
from wonted.plans import reports
from wonted.plans.ingest import ingest
from wonted.plans.rebuild import ORDER, Derived, replay
from wonted.session import work_folder
from wonted.sources import archive, facts, landed, shaped, tables
from wonted.sources.shaped import read
from wonted.streaming import incremental
from wonted.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, folder)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


# ---- inputs --------------------------------------------------------------------------------------


def mail(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    return facts.prepare(shaped.mail_events(read(spark, folder, "events")), names=names)


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return facts.incoming(mail(spark, folder))


def replayed(spark: SparkSession, folder: str, *names: str) -> Derived:
    names = names or features.NAMES
    return replay(mail(spark, folder, "display_name_collision" in names), names=names)


def credits(spark: SparkSession, folder: str) -> DataFrame:
    m = mail(spark, folder)
    return relations.reply_credits(facts.incoming(m), facts.outgoing(m))


def rule(name: str) -> Query:
    """Query of a single feature: message, raw value, explanation."""

    def run(spark, folder):
        scored = replayed(spark, folder, name).scored
        return scored.filter(f"raw_{name} IS NOT NULL").selectExpr(
            "msg_id", f"raw_{name} AS raw_value", f"explain_{name} AS explanation"
        )

    run.__name__ = name
    return query(run)


for _name in features.NAMES:
    if _name not in ("dormant_resurrection", "embedded_addr_mismatch"):
        rule(_name)


@query
def auth_levels(spark, folder):
    """All levels of the authentication rule, by verdicts that vary."""
    k = "int(regexp_extract(props, '([0-9]+)', 1))"
    verdicts = [f"if({k} % 10 = 1, 'fail', 'none') AS auth_dmarc", f"if({k} % 2 = 0, 'fail', 'pass') AS auth_dkim",
                f"element_at(array('pass', 'fail', 'softfail'), {k} % 3 + 1) AS auth_spf"]
    judged = read(spark, folder, "events").selectExpr("event_id AS msg_id", *verdicts)
    rows = judged.selectExpr("msg_id", *features.feature("auth_fail")).filter("raw_auth_fail IS NOT NULL")
    return rows.selectExpr("msg_id", "raw_auth_fail AS raw_value", "explain_auth_fail AS explanation")


@query
def embedded_addr_mismatch(spark, folder):
    """Addresses inside a text against the domain of its sender."""
    scored = read(spark, folder, "documents").selectExpr(
        "doc_id AS msg_id", "text AS from_display_name",
        "if(doc_id % 2 = 0, 'example.com', 'quayside.com') AS rd",
        "concat('d', doc_id, '@', if(doc_id % 2 = 0, 'example.com', 'quayside.com')) AS sender",
    ).selectExpr("msg_id", *features.feature("embedded_addr_mismatch"))
    return scored.filter("raw_embedded_addr_mismatch IS NOT NULL").selectExpr(
        "msg_id", "raw_embedded_addr_mismatch AS raw_value", "explain_embedded_addr_mismatch AS explanation"
    )


@query
def dormant_resurrection(spark, folder):
    """The silence rule over several years of orders (any other flag is taken as given)."""
    m = facts.prepare(shaped.mail_orders(read(spark, folder, "orders")))
    times = baseline.prior_state(m.select("sender", "t", "msg_id", "sent_at"), ORDER, only=baseline.TIMES)
    r = DEFAULT_REGISTRY
    return (
        gaps.median_gaps(times)
        .filter(f"median_gap > 0 AND gap > {r.dormant_multiple} * median_gap")
        .selectExpr("msg_id", "gap", "median_gap", "gap div 86400 AS days")
    )


# ---- scores --------------------------------------------------------------------------------------


@query
def anomaly_score(spark, folder):
    return replayed(spark, folder).scores


@query
def score_features(spark, folder):
    return replayed(spark, folder).features.drop("explanation")


@query
def score_explanations(spark, folder):
    return replayed(spark, folder).features.select("msg_id", "feature", "explanation")


@query
def stale_scores(spark, folder):
    """Scores that a changed registry makes stale: all of those stamped with the old version."""
    scores = replayed(spark, folder, "auth_fail").scores
    newer = DEFAULT_REGISTRY.changed(weights={"auth_fail": 20.0})
    return features.stale_scores(scores, newer)


@query
def silent_scores(spark, folder):
    """Scores over several years of orders: a long silence counts where another rule fired, too."""
    failed = F.when(F.col("o_orderkey") % 3 == 0, "fail").otherwise("pass").alias("auth_dmarc")
    orders = read(spark, folder, "orders")
    m = shaped.mail_orders(orders).join(orders.select(F.col("o_orderkey").alias("msg_id"), failed), "msg_id")
    d = replay(facts.prepare(m, names=False), names=("auth_fail", "dormant_resurrection"))
    return d.scored.selectExpr("msg_id", "tier", "anomaly_score", "explain_dormant_resurrection AS explanation").withColumn(
        "explanation", F.expr("if(anomaly_score > 15, explanation, NULL)")
    )


@query
def rescored(spark, folder):
    """Stored scores of an older registry for every other message, replaced, and read back as the current ones."""
    base = f"{work_folder(spark)}/scores-{uuid.uuid4().hex}"
    m = facts.prepare(shaped.mail_events(read(spark, folder, "events")), names=False)
    older = DEFAULT_REGISTRY.changed(weights={"auth_fail": 20.0})
    for run, (registry, some) in enumerate(((older, "msg_id % 2 = 0"), (DEFAULT_REGISTRY, "msg_id % 2 = 1"))):
        d = replay(m, registry=registry, names=("auth_fail",))
        tables.write_scores(d.scores.filter(some), d.features.filter(some), base, run)
    now = replay(m, names=("auth_fail",))
    tables.rescore_stale(now, base, 2)
    scores, why = tables.read_scores(spark, base)
    points = why.groupBy("msg_id").agg(F.sum("contribution").alias("points"))
    return scores.join(points, "msg_id", "left").select("msg_id", "engine_version", "anomaly_score", "points")


# ---- baselines -----------------------------------------------------------------------------------


@query
def prior_state(spark, folder):
    """State of the sender before each message."""
    state = baseline.prior_same_hour(baseline.prior_state(incoming(spark, folder), ORDER), ORDER)
    size_std, links_std = st.std_of("p_size", "p_size2", "p_n", st.LOG_DIGITS), st.std_of("p_links", "p_links2", "p_n")
    return state.selectExpr(
        "msg_id", "p_n", "p_first", "p_last", "sent_at - p_last AS gap", "p_hours", "p_hour", "p_att",
        f"round({st.mean_of('p_size', 'p_n', st.LOG_DIGITS)}, 6) AS size_mean", f"round({size_std}, 6) AS size_std",
        f"round({st.mean_of('p_links', 'p_n')}, 6) AS links_mean", f"round({links_std}, 6) AS links_std",
    )


@query
def sender_profile(spark, folder):
    profile = replayed(spark, folder, "auth_fail").sender_profiles()
    return profile.selectExpr(
        "sender", "n_messages", "n_threads", "n_replied_threads", "n_user_initiated", "trust_tier",
        "array_join(hour_histogram, ',') AS hours", "array_join(dow_histogram, ',') AS weekdays",
        "round(log_size_mean, 6) AS log_size_mean", "round(log_size_m2, 6) AS log_size_m2",
        "round(links_mean, 6) AS links_mean", "round(links_m2, 6) AS links_m2", "n_with_attachments",
        "n_with_links", "n_replyto_divergent", "first_msg_at", "last_msg_at",
    )


@query
def domain_profile(spark, folder):
    replies = relations.domain_replies(credits(spark, folder))
    return baseline.domain_profiles(incoming(spark, folder), replies)


@query
def value_counts(spark, folder):
    """Names, attachment types, link domains and Reply-To addresses per sender."""
    m = facts.incoming(mail(spark, folder, names=True))
    values = baseline.sender_values(m).unionByName(baseline.sender_names(m))
    return values.selectExpr("sender", "kind", "a AS value", "b AS detail", "n", f"{time_of('first_pos')} AS first_seen_at")


@query
def first_uses(spark, folder):
    """Values first used with each message, and link domains known before."""
    new = baseline.novelties(baseline.sender_values(incoming(spark, folder)), ORDER)
    return new.selectExpr(
        "msg_id", "array_join(new_links, ',') AS new_links", "array_join(new_attachments, ',') AS new_attachments",
        "coalesce(new_reply_to, false) AS new_reply_to", "p_link_domains",
    )


# ---- relations -----------------------------------------------------------------------------------


def flat_credits(c: DataFrame) -> DataFrame:
    return c.selectExpr("thread_id", "sender", "kind", f"{time_of('pos')} AS at", f"{id_of('pos')} AS msg_id")


@query
def reply_credits(spark, folder):
    return flat_credits(credits(spark, folder))


@query
def conversation_credits(spark, folder):
    m = facts.prepare(shaped.mail_conversations(read(spark, folder, "conversations")))
    return flat_credits(relations.reply_credits(facts.incoming(m), facts.outgoing(m)))


@query
def trust_activations(spark, folder):
    """Per sender the messages at which tiers 3 and 2 became active."""
    acts = relations.activations(incoming(spark, folder), credits(spark, folder), ORDER)
    return acts.selectExpr("sender", f"{id_of('pos3')} AS tier3_at", f"{id_of('pos2')} AS tier2_at")


@query
def trust_tier_asof(spark, folder):
    scores = replayed(spark, folder, "cold_links").scores
    return scores.select("msg_id", "trust_tier_at_scoring", "baseline_n")


@query
def trust_tier_current(spark, folder):
    return replayed(spark, folder, "auth_fail").tiers()


@query
def thread_resolution(spark, folder):
    """Conversations as threads: by In-Reply-To, by a References chain, and by References to the root only."""
    m = shaped.mail_conversations(read(spark, folder, "conversations"))
    chain = "transform(filter(sequence(0, turn), i -> i < turn), i -> concat('<', conv, '.', i, '>'))"
    m = m.selectExpr("*", "msg_id div 1000 AS conv", "msg_id % 1000 AS turn").selectExpr(
        "msg_id", "message_id", "CASE conv % 3 WHEN 0 THEN in_reply_to WHEN 1 THEN NULL ELSE if(turn > 0, '<lost>', NULL) END AS in_reply_to",
        f"CASE conv % 3 WHEN 1 THEN {chain} WHEN 2 THEN slice({chain}, 1, 1) ELSE references END AS references",
    )
    return threads.resolve_threads(m).select("msg_id", "thread_id", "thread_depth")


@query
def similar_hosts(spark, folder):
    """Hosts of pages that resemble an earlier host within two edits."""
    host = f"get({dm.link_hosts('url')}, 0)"
    hosts = read(spark, folder, "pages").selectExpr(f"{host} AS rd", "page_id").groupBy("rd").agg(
        F.expr(f"{position('min(page_id)', 'min(page_id)')} AS trust_pos")
    )
    found = lookalike.lookalikes(hosts)
    return found.selectExpr(
        "rd AS host", "look1.target AS within_one", "look2.target AS within_two"
    )


# ---- scalar functions ----------------------------------------------------------------------------


@query
def normalize_address(spark, folder):
    raw = (
        "concat(' <', replace(c_name, '#', '.'), '+t', c_nationkey, '@', "
        "if(c_nationkey % 2 = 0, 'Mail.Example.CO.UK', 'GoogleMail.com'), '.> ')"
    )
    return read(spark, folder, "customer").selectExpr(
        "c_custkey", f"{tx.normalize_address(raw)} AS address"
    ).selectExpr(
        "c_custkey", "address", f"{tx.address_domain('address')} AS domain",
        f"{dm.reg_domain(tx.address_domain('address'))} AS reg_domain",
    ).selectExpr("*", f"{dm.is_freemail('reg_domain')} AS is_freemail")


@query
def registrable_domains(spark, folder):
    hosts = read(spark, folder, "pages").selectExpr(f"explode({dm.link_hosts('url')}) AS host")
    return hosts.distinct().selectExpr("host", f"{dm.reg_domain('host')} AS reg_domain")


@query
def link_domains(spark, folder):
    """Links per page and registrable domain, from address and whole source."""
    rows = read(spark, folder, "pages").selectExpr(
        "page_id", f"explode({dm.link_domain_list("concat(url, ' ', html)")}) AS reg_domain"
    )
    return rows.groupBy("page_id", "reg_domain").agg(F.count(F.lit(1)).alias("n"))


@query
def emails_in_text(spark, folder):
    return (
        read(spark, folder, "documents")
        .selectExpr("doc_id", f"posexplode({tx.emails_in_text('text')}) AS (at, email)")
        .selectExpr("doc_id", "at", "email", f"{dm.reg_domain(tx.address_domain('email'))} AS reg_domain")
    )


@query
def text_skeletons(spark, folder):
    """Lookalike-folded whole texts, as digests."""
    return read(spark, folder, "documents").select(
        "doc_id", F.md5(tx.skeleton("text")).alias("skeleton_md5")
    )


@query
def display_names(spark, folder):
    names = read(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('  \"', replace(c_name, '#', '  # '), ' ', c_mktsegment, '\" ') AS name"
    )
    return names.select("c_custkey", tx.normalize_display_name("name").alias("name_norm")).withColumn(
        "name_skeleton", tx.skeleton("name_norm")
    )


@query
def auth_verdicts(spark, folder):
    header = (
        "concat('mx.example.com; SPF = ', event_type, ' x=y; dkim=', if(event_id % 3 = 0, 'Pass', 'FAIL'), "
        "if(event_id % 2 = 0, '; dmarc=none; dmarc=fail', ''))"
    )
    return read(spark, folder, "events").selectExpr(
        "event_id", *[f"{tx.auth_verdict(header, m)} AS {m}" for m in ("spf", "dkim", "dmarc")]
    )


@query
def sender_local_times(spark, folder):
    """Date headers back to epoch, hour and weekday on the sender's clock."""
    header = "concat(date_format(o_orderdate, 'E, d MMM yyyy'), ' ', lpad(o_orderkey % 24, 2, '0'), ':07:09 -0530')"
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{st.sender_local_time(header)} AS s"
    ).selectExpr("o_orderkey", "s.epoch", "s.hour", "s.dow")


@query
def message_id_tokens(spark, folder):
    """Tokens of reference headers, and file extensions."""
    header = "concat('<', event_id, '.', user_id, '@x>', ' junk <', event_type, '@y> <unclosed')"
    name = "if(event_id % 3 = 0, event_type, concat(event_type, '.Tar.', upper(event_type), event_id))"
    return read(spark, folder, "events").selectExpr(
        "event_id", f"array_join({tx.message_id_list(header)}, '|') AS ids",
        f"{tx.file_extension(name)} AS extension", f"{tx.format_size('event_id * 700')} AS size",
    )


@query
def osa_distances(spark, folder):
    """Edit distance between the names of neighbouring customers."""
    c = read(spark, folder, "customer")
    other = c.selectExpr("c_custkey - 1 AS c_custkey", "concat(c_name, c_mktsegment) AS other")
    pairs = c.selectExpr("c_custkey", "concat(c_name, c_mktsegment) AS name").join(other, "c_custkey")
    return pairs.selectExpr("c_custkey", f"{tx.osa_distance('name', 'other')} AS distance")


# ---- facts, dimensions, ingest -------------------------------------------------------------------


@query
def sender_dimension(spark, folder):
    return facts.sender_dimension(mail(spark, folder))


@query
def message_children(spark, folder):
    """Attachments, link domains and recipients exploded from the facts."""
    m = mail(spark, folder)
    a = facts.message_attachments(m).selectExpr("msg_id", "'attachment' AS kind", "extension AS value", "1 AS n")
    d = facts.message_link_domains(m).selectExpr("msg_id", "'link' AS kind", "reg_domain AS value", "n")
    r = facts.message_recipients(m).selectExpr("msg_id", "'recipient' AS kind", "email_norm AS value", "1 AS n")
    return a.unionByName(d).unionByName(r)


@query
def reassembled_facts(spark, folder):
    """Nested facts put together again from the flat table and its children."""
    m = mail(spark, folder)
    flat = m.select("msg_id", "direction")
    nested = facts.assemble_facts(flat, facts.message_attachments(m), facts.message_link_domains(m))
    return nested.selectExpr(
        "msg_id", "direction", "coalesce(array_size(attachments), 0) AS n_attachments",
        f"{facts.N_LINKS} AS n_links", "get(attachments, 0).extension AS extension",
    )


def landed_pages(spark, folder) -> DataFrame:
    """Pages as landed mail: page source as the text part, its number as a header set."""
    part = (
        "named_struct('maintype', '{0}', 'subtype', {1}, 'disposition', {2}, 'filename', {3}, 'size', {4}, 'text', {5})"
    )
    body = part.format("text", "'html'", "''", "cast(NULL AS string)", "bigint(octet_length(html))", "concat(url, ' ', html)")
    file = part.format("application", "'zip'", "if(page_id % 2 = 0, 'attachment', '')", "if(page_id % 3 = 0, 'a.B.ZIP', NULL)", "page_id", "cast(NULL AS string)")
    return read(spark, folder, "pages").selectExpr(
        "page_id % 2 AS account_id", "'INBOX' AS folder", "if(page_id % 7 = 0, 'sent', 'inbox') AS folder_role",
        "1L AS generation", "page_id AS uid", "page_id AS msg_id", "bigint(octet_length(html)) AS size_bytes",
        "concat('Page ', page_id) AS from_name",
        "if(page_id % 11 = 0, '', concat('P', page_id % 20, '+x@Example.COM')) AS from_addr",
        "concat('P', page_id % 10, '@example.com') AS reply_to_addr",
        "array('p1@example.com', '', 'other@x.org') AS to_addrs",
        "if(page_id % 2 = 0, array('cc@x.org'), NULL) AS cc_addrs",
        "concat('Mon, 5 Jan 2026 ', lpad(page_id % 24, 2, '0'), ':00:00 +0200') AS date_hdr",
        "concat('<', page_id, '@x>') AS message_id_hdr",
        "if(page_id % 5 = 0, concat('<', page_id - 1, '@x>'), NULL) AS in_reply_to_hdr",
        "if(page_id % 4 = 0, concat('<a> <', page_id - 2, '@x>'), NULL) AS references_hdr",
        "if(page_id % 3 = 0, 'mx; dmarc=fail; spf=pass', NULL) AS auth_results_hdr",
        f"array({body}, {file}) AS parts",
    )


@query
def header_facts(spark, folder):
    """Message facts from landed headers and structure."""
    me = spark.sql(
        "SELECT stack(3, 0L, 'P1@Example.com', 0L, 'p2+x@example.com', 1L, 'p3@example.com') AS (account_id, a)"
    ).selectExpr("account_id", f"{tx.normalize_address('a')} AS email_norm")
    f = landed.message_facts(landed_pages(spark, folder), me)
    return f.selectExpr(
        "msg_id", "direction", "from_email_norm", "from_display_name", "reply_to_email_norm", "to_me_directly",
        "n_recipients", "array_join(recipients, ',') AS recipients", "sent_at", "sent_hour_local", "sent_dow_local",
        "size(attachments) AS n_attachments", "get(attachments, 0).extension AS extension",
        f"{facts.N_LINKS} AS n_links", "links_extracted", "message_id", "in_reply_to",
        "size(references) AS n_references", "is_reply", "auth_spf", "auth_dmarc",
    )


def document_files(spark, folder) -> DataFrame:
    """Documents as message files (path, content) of six shapes: plain, base64 with an encoded name, quoted-printable,
    multipart with an attachment and an unknown charset, framed, and frames that are broken in two ways."""
    said = "concat('http://www.', lang, '.example.org/ ', text)"
    coded = "concat('=?utf-8?B?', base64(encode({0}, 'UTF-8')), '?=')"
    name = f"if(kind = 1, {coded.format("concat('Döc, ', doc_id)")}, 'Doc')"
    plain = "'Content-Type: text/plain; charset={0}\\nContent-Transfer-Encoding: {1}\\n\\n'"
    file = (
        "'\\n--cut\\nContent-Type: application/zip\\nContent-Transfer-Encoding: base64\\nContent-Disposition: attachment; filename=\"', "
        f"{coded.format("'Rëport.ZIP'")}, '\"\\n\\nUEs=\\n--cut--\\n'"
    )
    body = (
        f"CASE kind WHEN 1 THEN concat({plain.format('utf-8', 'base64')}, base64(encode(said, 'UTF-8'))) "
        f"WHEN 2 THEN concat({plain.format('utf-8', 'quoted-printable')}, replace(said, '=', '=3D')) "
        f"WHEN 3 THEN concat('Content-Type: multipart/mixed; boundary=cut\\n\\n--cut\\n', {plain.format('x-unknown', '8bit')}, said, {file}) "
        f"ELSE concat({plain.format('utf-8', '8bit')}, said) END"
    )
    whole = (
        f"concat('From: ', {name}, ' <d', doc_id, '@', lang, '.Example.com>\\nTo: a@x.org, B <b@x.org>\\n', "
        "'Date: Mon, 5 Jan 2026 10:00:00 +0000\\nMessage-ID: <', doc_id, '@x>\\nMIME-Version: 1.0\\n', " + body + ")"
    )
    count = "CASE WHEN kind = 4 THEN string(octet_length(whole)) WHEN doc_id % 12 = 5 THEN 'many' ELSE string(octet_length(whole) + 99) END"
    shaped_ = read(spark, folder, "documents").selectExpr("doc_id", "lang", "doc_id % 6 AS kind", f"{said} AS said")
    return shaped_.selectExpr("doc_id", "kind", f"{whole} AS whole").selectExpr(
        "concat('/store/', doc_id, if(kind < 4, '.eml', '.emlx')) AS path",
        f"encode(if(kind < 4, whole, concat({count}, '\\n', whole, if(kind = 4, '<plist/>', ''))), 'UTF-8') AS content",
    )


@query
def parsed_messages(spark, folder):
    """Whole texts wrapped as message files, parsed back, and turned into facts."""
    parsed = archive.good_rows(archive.parse_messages(document_files(spark, folder))).selectExpr(
        "*", "uid % 2 AS account_id", "'INBOX' AS folder", "'inbox' AS folder_role", "1L AS generation", "uid AS msg_id"
    )
    me = spark.sql("SELECT stack(2, 0L, 'b@x.org', 1L, 'b@x.org') AS (account_id, email_norm)")
    f = landed.message_facts(parsed, me)
    return f.selectExpr(
        "msg_id", "from_email_norm", "from_display_name", "to_me_directly", "n_recipients", "sent_at", "size_bytes",
        f"{facts.N_LINKS} AS n_links", "message_id", "get(attachments, 0).extension AS extension",
        "get(attachments, 0).size_bytes AS attachment_bytes",
    )


@query
def unreadable_files(spark, folder):
    """Message files that could not be read, counted by reason."""
    return archive.unreadable_counts(archive.parse_messages(document_files(spark, folder)))


def landed_events(spark, folder) -> DataFrame:
    """Events as landed rows of 3 accounts with a folder per event type."""
    return read(spark, folder, "events").selectExpr(
        "user_id % 3 AS account_id", "event_type AS folder", "event_id AS uid", "2L AS generation",
        "event_id % 97 = 5 AS deleted", "NOT (event_id % 1009 = 7) AS served",
    )


def folder_state(spark, folder) -> DataFrame:
    """A mark in the middle of each folder but 'view', which is new; 'error' has an old generation."""
    rows = landed_events(spark, folder).filter("folder <> 'view'")
    return rows.groupBy("account_id", "folder").agg(
        F.expr("max(uid) div 2 AS last_seen_uid"), F.expr("max(if(folder = 'error', 1L, 2L)) AS generation")
    ).selectExpr("account_id", "folder", "'other' AS role", "generation", "last_seen_uid")


@query
def unseen_rows(spark, folder):
    rows = landed.unseen_rows(landed_events(spark, folder), folder_state(spark, folder))
    return rows.select("account_id", "folder", "uid")


@query
def contiguous_prefix(spark, folder):
    rows = landed.contiguous_prefix(landed_events(spark, folder))
    return rows.select("account_id", "folder", "uid")


@query
def advanced_marks(spark, folder):
    state = landed.known_folders(
        folder_state(spark, folder), landed_events(spark, folder).withColumn("role", F.lit("inbox"))
    )
    accepted = landed.contiguous_prefix(landed.unseen_rows(landed_events(spark, folder), state))
    return landed.advanced_marks(state, accepted)


@query
def invalidated_generation(spark, folder):
    """Facts kept after folders with another generation were dropped."""
    rows, state = landed_events(spark, folder), folder_state(spark, folder)
    server = rows.select("account_id", "folder", "generation").distinct()
    kept, _ = landed.drop_invalidated(rows, state, server)
    return kept.select("account_id", "folder", "uid")


@query
def switched_source(spark, folder):
    """Folder state after one account moved to another source."""
    _, state = landed.switch_source(landed_events(spark, folder), folder_state(spark, folder), 1)
    return state


# ---- mailbox catalogue ---------------------------------------------------------------------------


def catalogue(spark, folder) -> DataFrame:
    """Four mailboxes per nation, some URLs quoted and some not, and a local one."""
    paths = "array('INBOX', '%5BGmail%5D/All%20Mail', 'Sent Items', 'Sent%20Messages', 'Other')"
    return read(spark, folder, "nation").selectExpr(
        "n_nationkey", "n_name", f"posexplode({paths}) AS (i, path)"
    ).selectExpr(
        "bigint(n_nationkey * 10 + i) AS rowid",
        "concat(if(i = 4, 'local', 'imap'), '://', n_name, '/', path) AS url",
    )


def store_messages(spark, folder) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS rowid", "o_custkey % 25 * 10 + o_orderkey % 5 AS mailbox", "o_custkey % 40 AS sender",
        "int(o_orderstatus = 'P') AS deleted",
    )


@query
def mailbox_catalogue(spark, folder):
    c, m = catalogue(spark, folder), store_messages(spark, folder)
    return archive.mailboxes(c).join(archive.highest_rowids(c, m), "rowid")


@query
def folder_selection(spark, folder):
    return archive.sync_folders(catalogue(spark, folder), store_messages(spark, folder))


@query
def account_detection(spark, folder):
    """The account each address sent most from."""
    people = read(spark, folder, "customer").selectExpr("c_custkey AS rowid", "concat(c_name, '@X.org') AS address")
    counts = archive.sender_counts(catalogue(spark, folder), store_messages(spark, folder), people)
    return archive.detect_accounts(counts, people.selectExpr("address AS email"))


# ---- reports -------------------------------------------------------------------------------------


@query
def ranked_listing(spark, folder):
    return replayed(spark, folder).listing(limit=300).drop("message_id")


@query
def tier_listing(spark, folder):
    """The default listing of senders now at tier 2, by the cheap features."""
    d = replayed(spark, folder, "auth_fail", "size_anomaly", "send_hour_anomaly")
    return d.listing(tier=2).select("msg_id", "from_email_norm", "anomaly_score", "tier", "tier_label", "severity")


@query
def listing_features(spark, folder):
    """Listing rows with their features, strongest first."""
    d = replayed(spark, folder, "auth_fail", "cold_attachment", "cold_links", "cold_replyto")
    rows = d.listing(limit=100)
    return reports.listing_details(rows.select("msg_id", "anomaly_score"), d.features).selectExpr(
        "msg_id", "anomaly_score", "array_join(features.feature, ',') AS features"
    )


@query
def status_counts(spark, folder):
    m = mail(spark, folder)
    return reports.status(m, facts.sender_dimension(m))


@query
def sender_detail(spark, folder):
    d = replayed(spark, folder, "auth_fail")
    return reports.sender_detail(facts.sender_dimension(mail(spark, folder)), d.sender_profiles())


# ---- streaming -----------------------------------------------------------------------------------


@query
def stream_score(spark, folder):
    """All events landed in two steps and scored in order of arrival by the streaming job."""
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = read(spark, folder, "events")
    half = events.agg(F.expr("max(event_id) div 2")).first()[0]
    for arrived in (f"event_id <= {half}", f"event_id > {half}"):
        shaped.mail_events(events.filter(arrived)).write.mode("append").parquet(f"{base}/landed")
        schema = spark.read.parquet(f"{base}/landed").schema
        stream = incremental.file_stream(spark, f"{base}/landed", schema)
        job = incremental.score_stream(stream, f"{base}/store", f"{base}/offsets")
        job.awaitTermination()
    return Store(spark, f"{base}/store").rows("message_scores").drop("batch_id")


def landed_mail(spark, folder) -> DataFrame:
    """Events as landed mail: three accounts with a folder per event type."""
    return read(spark, folder, "events").selectExpr(
        "user_id % 3 AS account_id", "event_type AS folder", "'inbox' AS folder_role", "1L AS generation",
        "event_id AS uid", "event_id AS msg_id", "10L AS size_bytes", "concat('User ', user_id) AS from_name",
        "concat('U', user_id, '@Example.com') AS from_addr", "'' AS reply_to_addr", "array('me@x.org') AS to_addrs",
        "array() AS cc_addrs", "date_format(ts, 'd MMM yyyy HH:mm:ss +0000') AS date_hdr",
        "concat('<', event_id, '@x>') AS message_id_hdr", "cast(NULL AS string) AS in_reply_to_hdr",
        "cast(NULL AS string) AS references_hdr", "cast(NULL AS string) AS auth_results_hdr",
        f"cast(array() AS array<{landed.PART}>) AS parts", "event_id % 1009 <> 7 AS served",
    )


@query
def stream_ingest(spark, folder):
    """Landed files taken one by one: interleaved ids, gaps of which the second file fills every other one, and a
    folder that the second file numbers anew, with a smaller generation; the current messages with their live baselines."""
    base = f"{work_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = landed_mail(spark, folder)
    filled = rows.filter("NOT served AND uid % 2 = 1").withColumn("served", F.lit(True))
    renumbered = rows.filter("folder = 'error'").withColumn("generation", F.lit(0).cast("bigint"))
    second = rows.filter("uid % 2 = 1 AND served AND folder <> 'error'").unionByName(filled.filter("folder <> 'error'"))
    for part in (rows.filter("uid % 2 = 0 OR NOT served"), second.unionByName(renumbered)):
        part.write.mode("append").parquet(f"{base}/landed")
        stream = incremental.file_stream(spark, f"{base}/landed", rows.schema)
        mine = spark.sql("SELECT explode(array(0L, 1L, 2L)) AS account_id, 'me@x.org' AS email_norm")
        incremental.score_stream(stream, f"{base}/store", f"{base}/offsets", mine=mine).awaitTermination()
    store = Store(spark, f"{base}/store")
    live = store.rows("message_scores").select("msg_id", "baseline_n")
    return incremental.current_messages(store).join(live, "msg_id").select(
        "account_id", "folder", "generation", "uid", "sender", "sent_at", "baseline_n"
    )


def mail_of_runs(spark, folder) -> DataFrame:
    """``landed_mail`` with unreadable rows, sent folders, and senders that are the accounts' own."""
    rows = landed_mail(spark, folder)
    return rows.selectExpr(
        *[c for c in rows.columns if c not in ("folder_role", "uid")], "uid + 2 AS uid",
        "if(folder = 'purchase', 'sent', 'inbox') AS folder_role", "if(uid % 101 = 3, 'ValueError: cut', NULL) AS parse_error",
    )


def ingest_history(spark, folder):
    """Stored runs: half of the rows with gaps; all rows, twice; one folder numbered anew with a smaller generation; one
    account read again from another source.  The folder of the store, and the counts of each run."""
    base, counts = f"{work_folder(spark)}/runs-{uuid.uuid4().hex}", []
    rows = mail_of_runs(spark, folder)
    accounts = read(spark, folder, "nation").filter("n_nationkey < 3").selectExpr(
        "bigint(n_nationkey) AS id", "concat('box', n_nationkey, '@x.org') AS email", "array(concat('U', n_nationkey, '+me@Example.com')) AS aliases",
        "'oauth2' AS auth_method",
    )
    mine = landed.identities(landed.valid_accounts(accounts))
    whole = rows.withColumn("served", F.lit(True))
    again = whole.filter("folder = 'error' AND uid % 2 = 0").selectExpr(
        *[c for c in whole.columns if c not in ("generation", "msg_id")], "0L AS generation", "msg_id + 1000000000000 AS msg_id"
    )
    none = spark.createDataFrame([], "account_id bigint, folder string, role string, generation bigint, last_seen_uid bigint")
    for run, listed in ((0, rows.filter("uid % 2 = 0")), (1, whole), (1, whole), (2, whole.unionByName(again)), (3, whole.unionByName(again))):
        before = tables.read_folders(spark, base) if run != 1 else first
        state, stored = before if before is not None else none, tables.read_facts(spark, base, before=run)
        if run == 3:
            stored, state = landed.switch_source(stored, state, 1)
            tables.forget(spark.sql("SELECT 1L AS account_id, string(NULL) AS folder"), base, run)
        done = ingest(listed, mine, state, stored)
        if run == 3:  # what the switch deletes stays deleted beside what the run itself found invalid
            done.invalid = done.invalid.unionByName(spark.sql("SELECT 1L AS account_id, string(NULL) AS folder"))
        tables.write_run(done, base, run)
        first = tables.read_folders(spark, base) if run == 0 else first
        counts.append((len(counts), done.stats.new_messages, done.stats.skipped, done.stats.invalidated, done.stats.stale, done.stats.initial_backfill))
    return base, counts


@query
def ingest_runs(spark, folder):
    """What each run of ``ingest_history`` counted: new, unreadable, invalidated, stale, first reads."""
    _, counts = ingest_history(spark, folder)
    return spark.createDataFrame(
        counts, "step int, new_messages bigint, skipped bigint, invalidated bigint, stale bigint, initial_backfill boolean"
    )


@query
def ingested_facts(spark, folder):
    """The facts that are stored after the runs of ``ingest_history``."""
    base, _ = ingest_history(spark, folder)
    return tables.read_facts(spark, base).select("account_id", "folder", "generation", "uid", "direction", "from_email_norm")


@query
def arrival_numbers(spark, folder):
    """Landed rows numbered in order of arrival, sent folders first."""
    return ordinals.arrival_numbers(mail_of_runs(spark, folder)).select("account_id", "folder", "uid", "msg_id")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Every message scored against the state before it, highest scores first."""
    return QUERIES["ranked_listing"](spark, folder)
