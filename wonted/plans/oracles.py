"""The queries once more as plain SQL for DuckDB, written from the definitions.

Shared common table expressions: ``mail`` shapes events like ``sources.shaped`` does; ``prior`` is
window state; credits come from a plain join of threads, tiers and features from comparisons of
positions (pos = time and id in one number).
"""

from __future__ import annotations

from wonted.config import TIER_LABELS
from wonted.sources.shaped import EVENT_DOMAINS

SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"
# Own lists, not the library's: open mailbox providers and suffixes of two labels that the tables can hold.
FREEMAIL = "'gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'yahoo.com', 'icloud.com', 'gmx.de', 'web.de', 'orange.fr', 'free.fr'"
SUFFIXES = "'co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'com.mx', 'co.za', 'co.in'"

# Landed rows of the ingest runs.
RUN_ROWS = "SELECT user_id, user_id % 3 AS account_id, event_type AS folder, event_id + 2 AS uid, event_id % 1009 <> 7 AS served FROM events"

CTES = {
    "mail": f"""
      SELECT event_id AS msg_id, {SECONDS.format('ts')} AS sent_at, CAST(hour(ts) AS INT) AS hr,
        CAST(isodow(ts) - 1 AS INT) AS dow, 'u' || user_id || '@' || dom AS sender, dom AS rd,
        'user ' || (user_id % 40) AS name,
        CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'out' ELSE 'in' END AS direction,
        user_id * 10 + k % 5 AS thread_id, CAST(floor(value * 100) AS BIGINT) + 1 AS size,
        CAST(CASE WHEN event_type = 'click' THEN k % 4 ELSE 0 END AS BIGINT) AS n_links,
        CASE WHEN event_type = 'click' AND k % 4 > 0 THEN 'site' || (k % 30) || '.net' END AS link,
        CASE WHEN event_type = 'signup' THEN ['pdf', 'zip', 'docx', 'png'][k % 4 + 1] END AS ext,
        CASE WHEN k % 25 = 0 THEN 'r' || k || '@elsewhere.net' END AS reply,
        CASE WHEN k % 50 = 1 THEN 'fail' ELSE 'pass' END AS dmarc,
        {SECONDS.format('ts')}::HUGEINT * 10000000000 + event_id AS pos
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
              {list(EVENT_DOMAINS)}[user_id % 10 + 1] AS dom FROM events)""",
    "inc": "SELECT * FROM mail WHERE direction = 'in'",
    "outs": "SELECT * FROM mail WHERE direction = 'out'",
    "prior": """
      SELECT *, count(*) OVER p AS p_n, min(nullif(sent_at, 0)) OVER p AS p_first, max(sent_at) OVER p AS p_last,
        avg(ln(greatest(size, 1))) OVER p AS size_mean, coalesce(stddev_samp(ln(greatest(size, 1))) OVER p, 0) AS size_std,
        avg(n_links) OVER p AS links_mean, coalesce(stddev_samp(n_links) OVER p, 0) AS links_std,
        count(hr) OVER p AS p_hours, count(ext) OVER p AS p_att,
        count(*) OVER (PARTITION BY sender, hr ORDER BY sent_at, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_hour,
        link IS NOT NULL AND row_number() OVER (PARTITION BY sender, link ORDER BY sent_at, msg_id) = 1 AS new_link,
        ext IS NOT NULL AND row_number() OVER (PARTITION BY sender, ext ORDER BY sent_at, msg_id) = 1 AS new_ext,
        reply IS NOT NULL AND row_number() OVER (PARTITION BY sender, reply ORDER BY sent_at, msg_id) = 1 AS new_reply
      FROM inc
      WINDOW p AS (PARTITION BY sender ORDER BY sent_at, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "known": """
      SELECT *, coalesce(sum(CASE WHEN new_link THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY sent_at, msg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_link_domains FROM prior""",
    "wrote": "SELECT thread_id, sender, min(sent_at) AS min_in FROM inc GROUP BY ALL",
    "events_of_credit": """
      SELECT w.thread_id, w.sender, 'replied' AS kind, min(o.pos) AS pos FROM wrote w JOIN outs o
        ON o.thread_id = w.thread_id AND o.sent_at > w.min_in GROUP BY ALL
      UNION ALL
      SELECT o.thread_id, o.sender, 'initiated', min(o.pos) FROM outs o LEFT JOIN wrote w
        ON w.thread_id = o.thread_id AND w.sender = o.sender
        WHERE w.min_in IS NULL OR o.sent_at <= w.min_in GROUP BY ALL""",
    "credits": "SELECT thread_id, sender, arg_min(kind, pos) AS kind, min(pos) AS pos FROM events_of_credit GROUP BY ALL",
    "one_way": """
      SELECT sender, min(pos) AS own2 FROM prior WHERE p_n >= 1
        AND greatest(p_last, sent_at) - least(p_first, nullif(sent_at, 0)) >= 604800 GROUP BY ALL""",
    "acts": """
      SELECT sender, split_part(sender, '@', 2) AS rd, pos3, least(own2, pos3) AS pos2
      FROM one_way FULL JOIN (SELECT sender, min(pos) AS pos3 FROM credits GROUP BY ALL) USING (sender)""",
    "replies": """
      SELECT split_part(sender, '@', 2) AS rd, min(pos) AS reply_pos, count(*) AS n_replied
      FROM credits WHERE kind = 'replied' GROUP BY ALL""",
    "trust": "SELECT rd, min(pos2) AS trust_pos FROM acts GROUP BY ALL",
    "tiered": f"""
      SELECT k.*, pos3, trust_pos, CASE WHEN pos3 < pos THEN 3 WHEN p_n >= 2 AND p_last - p_first >= 604800 THEN 2
        WHEN k.rd NOT IN ({FREEMAIL}) AND reply_pos < pos THEN 1 ELSE 0 END AS tier
      FROM known k LEFT JOIN acts a USING (sender) LEFT JOIN replies r ON r.rd = k.rd LEFT JOIN trust t ON t.rd = k.rd""",
    "likenesses": f"""
      SELECT a.rd, b.rd AS target, b.trust_pos AS target_pos, CASE WHEN a.sk = b.sk THEN 1.0
        ELSE CASE damerau_levenshtein(a.sk, b.sk) WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 END END AS likeness
      FROM (SELECT DISTINCT rd, translate(lower(rd), '0135', 'oles') AS sk FROM inc) a
      JOIN (SELECT rd, trust_pos, translate(lower(rd), '0135', 'oles') AS sk FROM trust) b
        ON a.rd <> b.rd AND length(a.rd) >= 6 AND length(b.rd) >= 6 AND b.rd NOT IN ({FREEMAIL}) AND b.trust_pos IS NOT NULL""",
    "alike": """
      SELECT m.msg_id, arg_min(s.target, row(-s.likeness, s.target_pos, s.target)) AS target, max(s.likeness) AS likeness
      FROM tiered m JOIN likenesses s ON s.rd = m.rd AND s.target_pos < m.pos AND s.likeness IS NOT NULL
      WHERE NOT coalesce(m.trust_pos < m.pos, false) GROUP BY ALL""",
    "owners": """
      SELECT i.name, i.sender AS owner, greatest(min(i.pos), any_value(a.pos3)) AS owned
      FROM inc i JOIN acts a USING (sender) WHERE a.pos3 IS NOT NULL GROUP BY ALL""",
    "collisions": """
      SELECT m.msg_id, arg_min(o.owner, row(o.owned, o.owner)) AS owner
      FROM inc m JOIN owners o ON o.name = m.name AND o.owner <> m.sender AND o.owned < m.pos GROUP BY ALL""",
    "raws": """
      SELECT msg_id, 'lookalike_domain' AS feature, 25.0 AS weight, CAST(likeness AS DOUBLE) AS raw,
        'domain ''' || rd || ''' resembles known domain ''' || target || '''' AS explanation FROM alike JOIN tiered USING (msg_id)
      UNION ALL SELECT msg_id, 'display_name_collision', 25.0, 1.0, 'display name ''' || name || ''' matches known contact <'
        || owner || '> but address is <' || sender || '>' FROM collisions JOIN tiered USING (msg_id)
      UNION ALL SELECT msg_id, 'auth_fail', 15.0, 1.0, 'DMARC failed for sending domain' FROM tiered WHERE dmarc = 'fail'
      UNION ALL SELECT msg_id, 'reply_to_divergence', 10.0, 1.0, 'replies redirect to <' || reply
        || '>, never seen from this sender in ' || p_n || ' messages' FROM tiered WHERE tier >= 2 AND new_reply
      UNION ALL SELECT msg_id, 'attachment_type_novelty', 15.0, p_n / (p_n + 10), 'first .' || ext || ' from this sender in '
        || p_n || ' messages' FROM tiered WHERE tier >= 2 AND p_n >= 8 AND new_ext AND p_att > 0
      UNION ALL SELECT msg_id, 'first_attachment_ever', 10.0, p_n / (p_n + 10), 'first attachment of any kind (.' || ext
        || ') in ' || p_n || ' messages from this sender' FROM tiered WHERE tier >= 2 AND p_n >= 8 AND ext IS NOT NULL AND p_att = 0
      UNION ALL SELECT msg_id, 'link_domain_novelty', 10.0, p_n / (p_n + 10), 'links to ' || link || ', never linked before ('
        || p_link_domains || ' prior link domains)' FROM tiered WHERE tier >= 2 AND p_n >= 8 AND new_link
      UNION ALL SELECT msg_id, 'send_hour_anomaly', 8.0, 1 - 24 * ((p_hour + 0.5) / (p_hours + 12)), 'sent at ' || lpad(CAST(hr AS VARCHAR), 2, '0')
        || ':00 sender-local; ' || p_hour || ' of ' || p_hours || ' prior messages at this hour'
        FROM tiered WHERE tier >= 2 AND p_n >= 8 AND p_hours >= 8
      UNION ALL SELECT msg_id, 'link_density_anomaly', 5.0, ((n_links - links_mean) / greatest(links_std, 1.0) - 2.0) / 4.0,
        n_links || ' links; sender''s typical is ' || printf('%.1f', links_mean) || ' ± ' || printf('%.1f', greatest(links_std, 1.0))
        FROM tiered WHERE tier >= 2 AND p_n >= 8 AND n_links > 0
      UNION ALL SELECT msg_id, 'size_anomaly', 5.0, (abs(ln(size) - size_mean) / greatest(size_std, 0.35) - 2.5) / 4.0,
        (CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024)
          ELSE size || ' B' END) || ' message; sender''s typical is ' || (CASE WHEN t >= 1048576 THEN printf('%.1f MB', t / 1048576)
          WHEN t >= 1024 THEN printf('%.1f KB', t / 1024) ELSE t || ' B' END)
        FROM (SELECT *, CAST(floor(exp(size_mean)) AS BIGINT) AS t FROM tiered) WHERE tier >= 2 AND p_n >= 8
      UNION ALL SELECT msg_id, 'cold_attachment', 12.0, CASE WHEN p_n = 0 THEN 1.0 ELSE 0.5 END, 'attachment from ' || who FROM cold WHERE ext IS NOT NULL
      UNION ALL SELECT msg_id, 'cold_links', 6.0, CASE WHEN p_n = 0 THEN 1.0 ELSE 0.5 END, n_links || ' link(s) from ' || who FROM cold WHERE n_links > 0
      UNION ALL SELECT msg_id, 'cold_replyto', 8.0, CASE WHEN p_n = 0 THEN 1.0 ELSE 0.5 END, who || ' redirects replies to <' || reply || '>'
        FROM cold WHERE reply IS NOT NULL""",
    "cold": """
      SELECT *, CASE WHEN p_n = 0 THEN 'a never-seen sender' ELSE 'a barely-known sender (' || p_n || ' prior messages)' END AS who
      FROM tiered WHERE tier <= 1 AND p_n < 8""",
    "fired": "SELECT msg_id, feature, weight, round(least(raw, 1.0), 4) AS raw_value, explanation FROM raws WHERE raw > 0",
    "scores": """
      SELECT msg_id, '1.0.0' AS engine_version, tier AS trust_tier_at_scoring, p_n AS baseline_n,
        least(round(coalesce(s, 0), 4), 100.0) AS anomaly_score
      FROM tiered LEFT JOIN (SELECT msg_id, sum(raw_value * weight) AS s FROM fired GROUP BY ALL) USING (msg_id)""",
    "now": f"""
      SELECT sender, CASE WHEN pos3 IS NOT NULL THEN 3 WHEN n >= 2 AND last_at - first_at >= 604800 THEN 2
        WHEN split_part(sender, '@', 2) NOT IN ({FREEMAIL}) AND reply_pos < last_pos THEN 1 ELSE 0 END AS trust_tier
      FROM (SELECT sender, count(*) AS n, min(nullif(sent_at, 0)) AS first_at, max(sent_at) AS last_at, max(pos) AS last_pos FROM inc GROUP BY ALL)
        FULL JOIN (SELECT sender, min(pos) AS pos3 FROM credits GROUP BY ALL) USING (sender)
        LEFT JOIN replies ON replies.rd = split_part(sender, '@', 2)""",
    "people": f"""
      SELECT sender AS email_norm, rd AS domain, rd AS reg_domain, translate(lower(rd), '0135', 'oles') AS reg_domain_skeleton,
        rd IN ({FREEMAIL}) AS is_freemail, min(sent_at) AS first_seen_at, max(sent_at) AS last_seen_at FROM mail GROUP BY ALL""",
    "profiles": """
      SELECT sender, coalesce(n_messages, 0) AS n_messages, coalesce(n_threads, 0) AS n_threads,
        coalesce(n_replied_threads, 0) AS n_replied_threads, coalesce(n_user_initiated, 0) AS n_user_initiated, trust_tier,
        coalesce(hours, array_to_string([0 for x in range(24)], ',')) AS hours,
        coalesce(weekdays, array_to_string([0 for x in range(7)], ',')) AS weekdays,
        log_size_mean, log_size_m2, links_mean, links_m2, coalesce(n_with_attachments, 0) AS n_with_attachments,
        coalesce(n_with_links, 0) AS n_with_links, coalesce(n_replyto_divergent, 0) AS n_replyto_divergent, first_msg_at, last_msg_at
      FROM (SELECT sender, count(*) AS n_messages,
          count(*) FILTER (sent_at = first_in) AS n_threads,
          array_to_string([len(list_filter(list(hr), lambda v: v = x)) for x in range(24)], ',') AS hours,
          array_to_string([len(list_filter(list(dow), lambda v: v = x)) for x in range(7)], ',') AS weekdays,
          round(avg(ln(size)), 6) AS log_size_mean, round(coalesce(var_samp(ln(size)) * (count(*) - 1), 0), 6) AS log_size_m2,
          round(avg(n_links), 6) AS links_mean, round(coalesce(var_samp(n_links) * (count(*) - 1), 0), 6) AS links_m2,
          count(ext) AS n_with_attachments, count(link) AS n_with_links, count(reply) AS n_replyto_divergent,
          coalesce(min(nullif(sent_at, 0)), 0) AS first_msg_at, max(sent_at) AS last_msg_at
        FROM (SELECT *, min(sent_at) OVER (PARTITION BY thread_id, sender) AS first_in FROM inc) GROUP BY sender)
      FULL JOIN (SELECT sender, count(*) FILTER (kind = 'replied') AS n_replied_threads,
          count(*) FILTER (kind = 'initiated') AS n_user_initiated FROM credits GROUP BY ALL) USING (sender)
      LEFT JOIN now USING (sender)""",
    "landed": """
      SELECT user_id % 3 AS account_id, event_type AS folder, event_id AS uid, 2 AS generation, event_id % 97 = 5 AS deleted,
        NOT (event_id % 1009 = 7) AS served FROM events""",
    "folders": """
      SELECT account_id, folder, 'other' AS role, CASE WHEN folder = 'error' THEN 1 ELSE 2 END AS generation,
        max(uid) // 2 AS last_seen_uid FROM landed WHERE folder <> 'view' GROUP BY ALL""",
    "mailboxes": """
      SELECT n_nationkey * 10 + i - 1 AS rowid_, n_name AS account_uuid,
        ['INBOX', '[Gmail]/All Mail', 'Sent Items', 'Sent Messages'][i] AS path FROM nation, range(1, 5) AS r(i)""",
    "stored": """
      SELECT o_orderkey AS id, o_custkey % 25 * 10 + o_orderkey % 5 AS mailbox, o_custkey % 40 AS sender,
        o_orderstatus = 'P' AS deleted FROM orders""",
}

REG_DOMAIN = f"""
  CASE WHEN array_to_string(split({{0}}, '.')[-2:], '.') IN ({SUFFIXES}) THEN array_to_string(split({{0}}, '.')[-3:], '.')
  ELSE array_to_string(split({{0}}, '.')[-2:], '.') END"""


def sql(body: str) -> str:
    """A statement with the common table expressions it uses, directly or through others."""
    import re

    needed: list[str] = []

    def visit(text):
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "''", text)):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    shared = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    own = body.strip().removeprefix("WITH ")
    return shared + (",\n" if own != body.strip() else "\n") + own


def one_feature(name: str) -> str:
    return f"SELECT msg_id, raw_value, explanation FROM fired WHERE feature = '{name}'"


LABEL = "CASE tier " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TIER_LABELS.items()) + " END"
SEVERITY = "CASE WHEN anomaly_score >= 30 THEN 'hi' WHEN anomaly_score >= 10 THEN 'mid' ELSE 'lo' END"
LINK = r"""https?://(?:[^\s/@"''<>]*@)?([^\s/:?#"''<>\)\]]+)"""
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
UNFLAGGED = "SELECT msg_id, least(round(sum(raw_value * weight), 4), 100.0) AS s FROM fired WHERE feature IN ({0}) GROUP BY ALL"


def partial_scores(*names: str) -> str:
    chosen = ", ".join(f"'{n}'" for n in names)
    return (
        "(SELECT t.msg_id, t.sender, t.sent_at, t.tier AS then_tier, p_n, coalesce(s, 0.0) AS anomaly_score FROM tiered t "
        f"LEFT JOIN ({UNFLAGGED.format(chosen)}) USING (msg_id))"
    )


ORACLES = {
    **{
        n: one_feature(n)
        for n in (
            "lookalike_domain", "display_name_collision", "auth_fail", "reply_to_divergence",
            "attachment_type_novelty", "first_attachment_ever", "link_domain_novelty", "send_hour_anomaly",
            "size_anomaly", "cold_attachment", "cold_links", "cold_replyto",
        )
    },
    "link_density_anomaly": "SELECT msg_id, raw_value, explanation FROM fired WHERE feature = 'link_density_anomaly'",
    "embedded_addr_mismatch": f"""
      SELECT doc_id AS msg_id, CAST(1.0 AS DOUBLE) AS raw_value, 'display name shows ''' || foreign_[1] || ''' but real sender is <d' || doc_id || '@' || rd || '>' AS explanation
      FROM (SELECT doc_id, rd, list_filter([lower(x) for x in regexp_extract_all(text, '{EMAIL}')],
          lambda e: array_to_string(split(split_part(e, '@', 2), '.')[-2:], '.') <> rd) AS foreign_
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'example.com' ELSE 'quayside.com' END AS rd FROM documents))
      WHERE len(foreign_) > 0""",
    "dormant_resurrection": f"""
      WITH o AS (SELECT o_orderkey AS msg_id, o_custkey AS sender, {SECONDS.format('o_orderdate')} AS ts_ FROM orders),
      g AS (SELECT *, ts_ - lag(ts_) OVER w AS gap, count(*) OVER w - 1 AS n FROM o WINDOW w AS (PARTITION BY sender ORDER BY ts_, msg_id)),
      c AS (SELECT * FROM g WHERE gap >= 90 * 86400 AND n >= 8)
      SELECT c.msg_id, c.gap, median(g.gap) AS median_gap, c.gap // 86400 AS days
      FROM c JOIN g ON g.sender = c.sender AND g.ts_ < c.ts_ AND g.gap IS NOT NULL
      GROUP BY c.msg_id, c.gap HAVING median(g.gap) > 0 AND c.gap > 6 * median(g.gap) AND count(*) >= 2""",
    "anomaly_score": "SELECT * FROM scores",
    "score_features": "SELECT msg_id, feature, raw_value, CAST(weight AS DOUBLE) AS weight, round(raw_value * weight, 4) AS contribution FROM fired",
    "score_explanations": "SELECT msg_id, feature, explanation FROM fired",
    "stale_scores": """
      SELECT msg_id, '1.0.0' AS engine_version, CAST(CASE WHEN dmarc = 'fail' THEN 15.0 ELSE 0.0 END AS DOUBLE) AS anomaly_score FROM inc""",
    "prior_state": """
      SELECT msg_id, p_n, p_first, p_last, sent_at - p_last AS gap, p_hours, p_hour, p_att, round(size_mean, 6) AS size_mean,
        round(size_std, 6) AS size_std, round(links_mean, 6) AS links_mean, round(links_std, 6) AS links_std FROM prior""",
    "sender_profile": "SELECT * FROM profiles",
    "domain_profile": f"""
      SELECT i.rd AS reg_domain, count(DISTINCT sender) AS n_senders, count(*) AS n_messages,
        coalesce(any_value(n_replied), 0) AS n_replied_threads, i.rd IN ({FREEMAIL}) AS is_freemail,
        min(sent_at) AS first_seen_at, max(sent_at) AS last_seen_at
      FROM inc i LEFT JOIN replies r ON r.rd = i.rd GROUP BY i.rd""",
    "value_counts": """
      SELECT sender, kind, value, detail, CAST(sum(n) AS BIGINT) AS n, arg_min(sent_at, pos) AS first_seen_at FROM (
        SELECT sender, 'link' AS kind, link AS value, '' AS detail, n_links AS n, sent_at, pos FROM inc
        UNION ALL SELECT sender, 'attachment', ext, 'application/' || ext, 1, sent_at, pos FROM inc
        UNION ALL SELECT sender, 'reply_to', reply, '', 1, sent_at, pos FROM inc
        UNION ALL SELECT sender, 'name', name, translate(name, '0135', 'oles'), 1, sent_at, pos FROM inc)
      WHERE value IS NOT NULL GROUP BY ALL""",
    "first_uses": """
      SELECT msg_id, CASE WHEN new_link THEN link ELSE '' END AS new_links, CASE WHEN new_ext THEN '.' || ext ELSE '' END AS new_attachments,
        new_reply AS new_reply_to, CAST(p_link_domains AS BIGINT) AS p_link_domains FROM known WHERE new_link OR new_ext OR new_reply""",
    "reply_credits": """
      SELECT thread_id, sender, kind, CAST(pos // 10000000000 AS BIGINT) AS "at", CAST(pos % 10000000000 AS BIGINT) AS msg_id FROM credits""",
    "conversation_credits": """
      WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS id, conv_id * 1000000 + turn * 60 AS ts_, role = 'assistant' AS sent_,
          'peer' || conv_id || '@quayside.com' AS peer FROM conversations),
      w AS (SELECT conv_id, min(ts_) AS first_in FROM c WHERE NOT sent_ GROUP BY ALL),
      ev AS (SELECT c.conv_id, peer, CASE WHEN first_in < ts_ THEN 'replied' ELSE 'initiated' END AS kind, ts_, id
        FROM c LEFT JOIN w USING (conv_id) WHERE sent_)
      SELECT conv_id AS thread_id, peer AS sender, arg_min(kind, row(ts_, id)) AS kind, min(ts_) AS "at", arg_min(id, row(ts_, id)) AS msg_id
      FROM ev GROUP BY ALL""",
    "trust_activations": """
      SELECT sender, CAST(pos3 % 10000000000 AS BIGINT) AS tier3_at, CAST(pos2 % 10000000000 AS BIGINT) AS tier2_at FROM acts""",
    "trust_tier_asof": "SELECT msg_id, tier AS trust_tier_at_scoring, p_n AS baseline_n FROM tiered",
    "trust_tier_current": "SELECT sender, trust_tier FROM now",
    "thread_resolution": """
      WITH RECURSIVE up AS (
        SELECT a.conv_id * 1000 + a.turn AS msg_id, b.conv_id * 1000 + b.turn AS parent
        FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id
          AND b.turn = CASE WHEN a.conv_id % 3 = 2 THEN least(0, a.turn - 1) ELSE a.turn - 1 END),
      walk AS (SELECT msg_id, msg_id AS thread_id, 0 AS thread_depth FROM up WHERE parent IS NULL
        UNION ALL SELECT u.msg_id, w.thread_id, w.thread_depth + 1 FROM up u JOIN walk w ON u.parent = w.msg_id)
      SELECT * FROM walk""",
    "similar_hosts": rf"""
      WITH h AS (SELECT lower(regexp_extract(url, '{LINK}', 1)) AS host, min(page_id) AS ts_ FROM pages GROUP BY 1),
      p AS (SELECT a.host, b.host AS other, b.ts_, damerau_levenshtein(translate(a.host, '0135', 'oles'), translate(b.host, '0135', 'oles')) AS d
        FROM h a JOIN h b ON a.host <> b.host AND abs(length(a.host) - length(b.host)) <= 2 WHERE length(a.host) >= 6 AND length(b.host) >= 6)
      SELECT host, arg_min(other, ts_) FILTER (d <= 1) AS within_one, arg_min(other, ts_) FILTER (d <= 2) AS within_two
      FROM p WHERE d <= 2 GROUP BY host""",
    "normalize_address": f"""
      SELECT c_custkey, address, split_part(address, '@', 2) AS domain, {REG_DOMAIN.format("split_part(address, '@', 2)")} AS reg_domain,
        {REG_DOMAIN.format("split_part(address, '@', 2)")} IN ({FREEMAIL}) AS is_freemail
      FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN lower(replace(c_name, '#', '.')) || '@mail.example.co.uk'
        ELSE lower(replace(c_name, '#', '')) || '@googlemail.com' END AS address FROM customer)""",
    "registrable_domains": rf"""
      SELECT DISTINCT host, {REG_DOMAIN.format('lower(host)')} AS reg_domain
      FROM (SELECT unnest(regexp_extract_all(url, '{LINK}', 1, 'i')) AS host FROM pages)""",
    "link_domains": rf"""
      SELECT page_id, reg_domain, count(*) AS n FROM (SELECT page_id, {REG_DOMAIN.format('lower(host)')} AS reg_domain
        FROM (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '{LINK}', 1, 'i')) AS host FROM pages)) GROUP BY ALL""",
    "emails_in_text": rf"""
      SELECT doc_id, CAST(n_ - 1 AS INT) AS "at", email, {REG_DOMAIN.format("split_part(email, '@', 2)")} AS reg_domain
      FROM (SELECT doc_id, unnest(m) AS email, generate_subscripts(m, 1) AS n_
        FROM (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '{EMAIL}')] AS m FROM documents))""",
    "text_skeletons": "SELECT doc_id, md5(translate(strip_accents(lower(text)), '0135', 'oles')) AS skeleton_md5 FROM documents",
    "display_names": """
      SELECT c_custkey, lower(replace(c_name, '#', ' # ') || ' ' || c_mktsegment) AS name_norm,
        translate(lower(replace(c_name, '#', ' # ') || ' ' || c_mktsegment), '0135', 'oles') AS name_skeleton FROM customer""",
    "auth_verdicts": """
      SELECT event_id, event_type AS spf, CASE WHEN event_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS dkim,
        CASE WHEN event_id % 2 = 0 THEN 'none' END AS dmarc FROM events""",
    "sender_local_times": f"""
      SELECT o_orderkey, {SECONDS.format("date_trunc('day', o_orderdate)")} + (o_orderkey % 24) * 3600 + 7 * 60 + 9 + 330 * 60 AS epoch,
        CAST(o_orderkey % 24 AS INT) AS hour, CAST(isodow(o_orderdate) - 1 AS INT) AS dow FROM orders""",
    "message_id_tokens": """
      SELECT event_id, '<' || event_id || '.' || user_id || '@x>|<' || event_type || '@y>' AS ids,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE left(lower(event_type || event_id), 16) END AS extension,
        CASE WHEN event_id * 700 >= 1048576 THEN printf('%.1f MB', event_id * 700 / 1048576)
          WHEN event_id * 700 >= 1024 THEN printf('%.1f KB', event_id * 700 / 1024) ELSE (event_id * 700) || ' B' END AS size FROM events""",
    "osa_distances": """
      SELECT a.c_custkey, CAST(least(damerau_levenshtein(a.c_name || a.c_mktsegment, b.c_name || b.c_mktsegment), 3) AS INT) AS distance
      FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""",
    "sender_dimension": "SELECT * FROM people",
    "message_children": """
      SELECT msg_id, 'attachment' AS kind, ext AS value, 1 AS n FROM mail WHERE ext IS NOT NULL
      UNION ALL SELECT msg_id, 'link', link, CAST(n_links AS INT) FROM mail WHERE link IS NOT NULL
      UNION ALL SELECT msg_id, 'recipient', sender, 1 FROM outs""",
    "reassembled_facts": """
      SELECT msg_id, direction, CASE WHEN ext IS NULL THEN 0 ELSE 1 END AS n_attachments, n_links, ext AS extension FROM mail""",
    "header_facts": rf"""
      WITH p AS (SELECT *, page_id % 2 AS acct, 'p' || (page_id % 20) || '@example.com' AS sender, 'p' || (page_id % 10) || '@example.com' AS reply,
          CASE WHEN page_id % 3 = 0 THEN 'fail' END AS dmarc FROM pages WHERE page_id % 11 <> 0),
      q AS (SELECT *, page_id % 7 = 0 OR ((acct = 0 AND sender IN ('p1@example.com', 'p2@example.com') OR acct = 1 AND sender = 'p3@example.com')
          AND dmarc IS DISTINCT FROM 'fail') AS out FROM p)
      SELECT page_id AS msg_id, CASE WHEN out THEN 'out' ELSE 'in' END AS direction, sender AS from_email_norm, 'Page ' || page_id AS from_display_name,
        CASE WHEN reply <> sender THEN reply END AS reply_to_email_norm, acct = 0 AS to_me_directly,
        CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS n_recipients,
        CASE WHEN NOT out THEN '' ELSE 'p1@example.com,other@x.org' || CASE WHEN page_id % 2 = 0 THEN ',cc@x.org' ELSE '' END END AS recipients,
        1767571200 + (page_id % 24) * 3600 - 7200 AS sent_at, CAST(page_id % 24 AS INT) AS sent_hour_local, 0 AS sent_dow_local,
        CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN 1 ELSE 0 END AS n_attachments,
        CASE WHEN page_id % 3 = 0 THEN 'zip' WHEN page_id % 2 = 0 THEN '' END AS extension,
        len(regexp_extract_all(url || ' ' || html, '{LINK}', 1, 'i')) AS n_links, true AS links_extracted, '<' || page_id || '@x>' AS message_id,
        CASE WHEN page_id % 5 = 0 THEN '<' || (page_id - 1) || '@x>' END AS in_reply_to, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS n_references,
        page_id % 5 = 0 OR page_id % 4 = 0 AS is_reply, CASE WHEN page_id % 3 = 0 THEN 'pass' END AS auth_spf, dmarc AS auth_dmarc FROM q""",
    "parsed_messages": """
      SELECT doc_id AS msg_id, 'd' || doc_id || '@' || lang || '.example.com' AS from_email_norm, CASE kind WHEN 1 THEN 'Döc, ' || doc_id ELSE 'Doc' END AS from_display_name,
        true AS to_me_directly, 2 AS n_recipients, CAST(1767607200 AS BIGINT) AS sent_at,
        strlen('From: ' || CASE kind WHEN 1 THEN '=?utf-8?B?' || base64(encode('Döc, ' || doc_id)) || '?=' ELSE 'Doc' END || ' <d' || doc_id || '@' || lang || '.Example.com>')
          + strlen('To: a@x.org, B <b@x.org>') + strlen('Date: Mon, 5 Jan 2026 10:00:00 +0000') + strlen('Message-ID: <' || doc_id || '@x>') + strlen('MIME-Version: 1.0')
          + CASE kind WHEN 1 THEN strlen('Content-Transfer-Encoding: base64') WHEN 2 THEN strlen('Content-Transfer-Encoding: quoted-printable') ELSE strlen('Content-Transfer-Encoding: 8bit') END
          + CASE kind WHEN 3 THEN strlen('Content-Type: multipart/mixed; boundary=cut--cutContent-Type: text/plain; charset=x-unknown--cutContent-Type: application/zip')
              + strlen('Content-Transfer-Encoding: base64Content-Disposition: attachment; filename=""UEs=--cut--') + strlen('=?utf-8?B?' || base64(encode('Rëport.ZIP')) || '?=') + 11
            ELSE strlen('Content-Type: text/plain; charset=utf-8') END + 8
          + CASE kind WHEN 1 THEN strlen(base64(encode(said))) + 2 * ((strlen(base64(encode(said))) - 1) // 76) WHEN 2 THEN strlen(replace(said, '=', '=3D')) ELSE strlen(said) END AS size_bytes,
        1 + len(regexp_extract_all(text, 'https?://', 0, 'i')) AS n_links, '<' || doc_id || '@x>' AS message_id,
        CASE kind WHEN 3 THEN 'zip' END AS extension, CASE kind WHEN 3 THEN 2 END AS attachment_bytes
      FROM (SELECT *, doc_id % 6 AS kind, 'http://www.' || lang || '.example.org/ ' || text AS said FROM documents) WHERE kind < 5""",
    "unreadable_files": """
      SELECT 'ValueError' AS reason, count(*) AS n FROM documents WHERE doc_id % 6 = 5 HAVING count(*) > 0""",
    "unseen_rows": """
      SELECT account_id, folder, uid FROM landed LEFT JOIN folders USING (account_id, folder)
      WHERE NOT deleted AND uid > coalesce(last_seen_uid, 0)""",
    "contiguous_prefix": """
      SELECT account_id, folder, uid FROM landed LEFT JOIN (SELECT account_id, folder, min(uid) AS gap FROM landed WHERE NOT served GROUP BY ALL)
      USING (account_id, folder) WHERE gap IS NULL OR uid < gap""",
    "advanced_marks": """
      WITH st AS (SELECT * FROM folders UNION ALL SELECT DISTINCT account_id, folder, 'inbox', CAST(NULL AS BIGINT), 0 FROM landed WHERE folder = 'view'),
      un AS (SELECT landed.* FROM landed JOIN st USING (account_id, folder) WHERE NOT deleted AND uid > last_seen_uid),
      ok AS (SELECT un.* FROM un LEFT JOIN (SELECT account_id, folder, min(uid) AS gap FROM un WHERE NOT served GROUP BY ALL) USING (account_id, folder)
        WHERE gap IS NULL OR uid < gap),
      top AS (SELECT account_id, folder, max(uid) AS u, max(generation) AS g FROM ok GROUP BY ALL)
      SELECT account_id, folder, role, coalesce(g, generation) AS generation, greatest(last_seen_uid, coalesce(u, 0)) AS last_seen_uid
      FROM st LEFT JOIN top USING (account_id, folder)""",
    "invalidated_generation": "SELECT account_id, folder, uid FROM landed WHERE folder <> 'error'",
    "switched_source": """
      SELECT account_id, folder, role, CAST(CASE WHEN account_id = 1 THEN NULL ELSE generation END AS BIGINT) AS generation,
        CASE WHEN account_id = 1 THEN 0 ELSE last_seen_uid END AS last_seen_uid FROM folders""",
    "mailbox_catalogue": """
      SELECT rowid_ AS rowid, account_uuid, path, coalesce(top, 0) AS top
      FROM mailboxes LEFT JOIN (SELECT mailbox, max(id) AS top FROM stored GROUP BY ALL) ON mailbox = rowid_""",
    "folder_selection": """
      WITH live AS (SELECT m.*, n FROM mailboxes m JOIN (SELECT mailbox, count(*) AS n FROM stored WHERE NOT deleted GROUP BY ALL) ON mailbox = rowid_),
      r AS (SELECT *, CASE WHEN path LIKE 'Sent%' THEN 'sent' ELSE 'inbox' END AS role,
        CASE path WHEN '[Gmail]/All Mail' THEN 0 WHEN 'INBOX' THEN 1 WHEN 'Sent Messages' THEN 0 ELSE 2 END AS p FROM live)
      SELECT account_uuid, role, arg_min(path, p) AS path, arg_min(rowid_, p) AS rowid, arg_min(n, p) AS n FROM r GROUP BY ALL""",
    "account_detection": """
      WITH c AS (SELECT lower(c_name || '@X.org') AS email, account_uuid, count(*) AS n
        FROM stored s JOIN mailboxes m ON s.mailbox = m.rowid_ JOIN customer ON c_custkey = s.sender WHERE NOT deleted GROUP BY ALL)
      SELECT email, arg_min(account_uuid, row(-n, account_uuid)) AS account_uuid, max(n) AS n FROM c GROUP BY ALL""",
    "ranked_listing": f"""
      SELECT *, {LABEL} AS tier_label, {SEVERITY} AS severity FROM (
        SELECT t.msg_id, t.sender AS from_email_norm, t.name AS from_display_name, t.sent_at, CASE WHEN ext IS NULL THEN 0 ELSE 1 END AS n_attachments,
          t.n_links, t.size AS size_bytes, s.anomaly_score, coalesce(n.trust_tier, t.tier) AS tier, s.trust_tier_at_scoring, s.baseline_n, s.engine_version
        FROM tiered t JOIN scores s USING (msg_id) LEFT JOIN now n ON n.sender = t.sender ORDER BY s.anomaly_score DESC, t.sent_at DESC, t.msg_id LIMIT 300)""",
    "tier_listing": f"""
      SELECT s.msg_id, s.sender AS from_email_norm, anomaly_score, trust_tier AS tier, '{TIER_LABELS[2]}' AS tier_label, {SEVERITY} AS severity
      FROM {partial_scores('auth_fail', 'size_anomaly', 'send_hour_anomaly')} s JOIN now USING (sender) WHERE trust_tier = 2
      ORDER BY anomaly_score DESC, sent_at DESC, msg_id LIMIT 200""",
    "listing_features": f"""
      SELECT l.msg_id, l.anomaly_score, coalesce(f, '') AS features
      FROM (SELECT * FROM {partial_scores('auth_fail', 'cold_attachment', 'cold_links', 'cold_replyto')} ORDER BY anomaly_score DESC, sent_at DESC, msg_id LIMIT 100) l
      LEFT JOIN (SELECT msg_id, string_agg(feature, ',' ORDER BY -raw_value * weight, feature) AS f FROM fired
        WHERE feature IN ('auth_fail', 'cold_attachment', 'cold_links', 'cold_replyto') GROUP BY ALL) USING (msg_id)""",
    "stream_score": "SELECT * FROM scores",
    "stream_ingest": f"""
      WITH e AS (SELECT user_id % 3 AS account_id, event_type AS folder, event_id AS uid, 'u' || user_id || '@example.com' AS sender,
          {SECONDS.format('ts')} AS sent_at, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS generation,
          event_id % 1009 = 7 AND (event_id % 2 = 0 OR event_type = 'error') AS missing, event_id % 1009 <> 7 AS served_first FROM events),
      gaps AS (SELECT account_id, folder, min(uid) AS gap FROM e WHERE missing GROUP BY ALL),
      firsts AS (SELECT account_id, folder, min(uid) AS first_gap FROM e WHERE NOT served_first GROUP BY ALL),
      got AS (SELECT e.*, CASE WHEN folder <> 'error' AND uid % 2 = 0 AND (first_gap IS NULL OR uid < first_gap) THEN 0 ELSE 1 END AS batch
        FROM e LEFT JOIN gaps USING (account_id, folder) LEFT JOIN firsts USING (account_id, folder) WHERE gap IS NULL OR uid < gap)
      SELECT account_id, folder, generation, uid, sender, sent_at, count(*) OVER (PARTITION BY sender ORDER BY batch, uid) - 1 AS baseline_n FROM got""",
    "ingest_runs": f"""
      WITH r AS ({RUN_ROWS}),
      early AS (SELECT account_id, folder, min(uid) AS gap FROM r WHERE NOT served AND uid % 2 = 0 GROUP BY ALL),
      e AS (SELECT r.*, uid % 2 = 0 AND (gap IS NULL OR uid < gap) AS taken FROM r LEFT JOIN early USING (account_id, folder)),
      marks AS (SELECT account_id, folder, coalesce(max(uid) FILTER (taken), 0) AS mark FROM e GROUP BY ALL),
      late AS (SELECT e.* FROM e JOIN marks USING (account_id, folder) WHERE uid > mark),
      again AS (SELECT * FROM r WHERE folder = 'error' AND uid % 2 = 0),
      started AS (SELECT count(*) FILTER (mark = 0) > 0 AS fresh FROM marks),
      second AS (SELECT count(*) AS n, count(*) FILTER ((uid - 2) % 101 = 3) AS bad FROM late)
      SELECT CAST(0 AS INT) AS step, count(*) FILTER (taken) AS new_messages, count(*) FILTER ((uid - 2) % 101 = 3 AND uid % 2 = 0) AS skipped,
        CAST(0 AS BIGINT) AS invalidated, CAST(0 AS BIGINT) AS stale, true AS initial_backfill FROM e
      UNION ALL SELECT i, n, bad, 0, 0, fresh FROM second, started, range(1, 3) t(i)
      UNION ALL SELECT 3, (SELECT count(*) FROM again), (SELECT count(*) FILTER ((uid - 2) % 101 = 3) FROM again),
        (SELECT count(DISTINCT account_id) FROM again), (SELECT count(*) FROM r WHERE folder = 'error'), true
      UNION ALL SELECT 4, count(*), count(*) FILTER ((uid - 2) % 101 = 3), 0, (SELECT count(*) FROM r WHERE folder = 'error'), true
        FROM (SELECT * FROM r WHERE folder <> 'error' UNION ALL SELECT * FROM again) WHERE account_id = 1""",
    "ingested_facts": f"""
      WITH r AS ({RUN_ROWS}),
      early AS (SELECT account_id, folder, min(uid) AS gap FROM r WHERE NOT served AND uid % 2 = 0 GROUP BY ALL),
      e AS (SELECT r.*, uid % 2 = 0 AND (gap IS NULL OR uid < gap) AS taken FROM r LEFT JOIN early USING (account_id, folder)),
      m AS (SELECT *, coalesce(max(uid) FILTER (taken) OVER (PARTITION BY account_id, folder), 0) AS mark FROM e)
      SELECT account_id, folder, CAST(CASE WHEN folder = 'error' THEN 0 ELSE 1 END AS BIGINT) AS generation, uid,
        CASE WHEN folder = 'purchase' OR user_id = account_id THEN 'out' ELSE 'in' END AS direction, 'u' || user_id || '@example.com' AS from_email_norm
      FROM m WHERE CASE WHEN folder = 'error' THEN uid % 2 = 0 ELSE account_id = 1 OR taken OR uid > mark END""",
    "arrival_numbers": f"""
      SELECT account_id, folder, uid, row_number() OVER (ORDER BY folder <> 'purchase', account_id, folder, uid) AS msg_id FROM ({RUN_ROWS})""",
    "auth_levels": """
      SELECT event_id AS msg_id, raw AS raw_value, CASE raw WHEN 1.0 THEN 'DMARC failed for sending domain' WHEN 0.8 THEN 'DKIM and SPF both failed'
        ELSE 'SPF softfail for sending domain' END AS explanation
      FROM (SELECT event_id, CAST(CASE WHEN k % 10 = 1 THEN 1.0 WHEN k % 2 = 0 AND k % 3 > 0 THEN 0.8 WHEN k % 3 = 2 THEN 0.4 END AS DOUBLE) AS raw
        FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)) WHERE raw IS NOT NULL""",
    "silent_scores": f"""
      WITH o AS (SELECT o_orderkey AS msg_id, o_custkey AS sender, {SECONDS.format('o_orderdate')} AS ts_ FROM orders),
      g AS (SELECT *, ts_ - lag(ts_) OVER w AS gap, count(*) OVER w - 1 AS n, lag(ts_) OVER w - first_value(ts_) OVER w AS span
        FROM o WINDOW w AS (PARTITION BY sender ORDER BY ts_, msg_id)),
      c AS (SELECT c.msg_id, c.gap FROM g c JOIN g ON g.sender = c.sender AND (g.ts_, g.msg_id) < (c.ts_, c.msg_id) AND g.gap IS NOT NULL
        WHERE c.gap >= 90 * 86400 AND c.n >= 8 GROUP BY c.msg_id, c.gap
        HAVING median(g.gap) > 0 AND c.gap > 6 * median(g.gap) AND count(*) >= 2)
      SELECT g.msg_id, CAST(CASE WHEN n >= 2 AND span >= 7 * 86400 THEN 2 ELSE 0 END AS INT) AS tier,
        CAST(CASE WHEN g.msg_id % 3 > 0 THEN 0 WHEN c.msg_id IS NULL THEN 15 ELSE 20 END AS DOUBLE) AS anomaly_score,
        CASE WHEN g.msg_id % 3 = 0 AND c.msg_id IS NOT NULL THEN 'first message in ' || (c.gap // 86400) || ' days, combined with other anomalies' END AS explanation
      FROM g LEFT JOIN c ON c.msg_id = g.msg_id""",
    "rescored": """
      SELECT msg_id, '1.0.0' AS engine_version, CAST(CASE WHEN dmarc = 'fail' THEN 15.0 ELSE 0.0 END AS DOUBLE) AS anomaly_score,
        CAST(CASE WHEN dmarc = 'fail' THEN 15.0 END AS DOUBLE) AS points FROM inc""",
    "status_counts": "SELECT count(*) AS messages, count(*) FILTER (direction = 'in') AS incoming, count(DISTINCT sender) AS senders FROM mail",
    "sender_detail": """
      SELECT p.*, n_messages, n_replied_threads, n_user_initiated, trust_tier, n_with_attachments, n_with_links, first_msg_at, last_msg_at
      FROM people p LEFT JOIN profiles ON sender = email_norm""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLES.items()}
