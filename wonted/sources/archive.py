"""Mail archives: message files, framed files, and the mailbox catalogue beside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, INBOX_NAMES, SENT_NAMES, Registry
from wonted.functions.sql import literal

PARSED = (
    "path string, uid bigint, partial boolean, parse_error string, from_name string, from_addr string, "
    "reply_to_addr string, to_addrs array<string>, cc_addrs array<string>, date_hdr string, "
    "message_id_hdr string, in_reply_to_hdr string, references_hdr string, auth_results_hdr string, "
    "size_bytes bigint, parts array<struct<maintype:string,subtype:string,disposition:string,"
    "filename:string,size:bigint,text:string>>"
)


FOLD = re.compile(r"\r?\n(?=[ \t])|\r?\n$")


def unframe(content: bytes) -> bytes:
    """The message inside a framed file: a line with its byte count, the message, other data."""
    line, newline, rest = content.partition(b"\n")
    if not newline or not line:
        raise ValueError("no line with the length of the frame")
    try:
        size = int(line.strip())
    except ValueError:
        raise ValueError("the length of the frame is no number") from None
    if not 0 <= size <= len(rest):
        raise ValueError(f"frame of {size} bytes, fewer are there")
    return rest[:size]


def _decoded(part, limit: int) -> tuple[int | None, str | None]:
    """Size of a part's content and, for small text parts, the text."""
    body = part.get_payload(decode=True)
    if body is None:
        return None, None
    if part.get_content_type() not in ("text/plain", "text/html") or len(body) > limit:
        return len(body), None
    return len(body), _characters(body, part.get_content_charset())


def _filename(part) -> str | None:
    name = part.get_filename()
    return None if name is None else _decoded_words(_plain(name))


def _plain(raw: str) -> str:
    """A raw header value on one line, undecodable bytes replaced."""
    if "\n" in raw or "\r" in raw:
        raw = FOLD.sub("", raw)
    return raw if raw.isascii() else raw.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _decoded_words(text: str) -> str:
    """Encoded words replaced by what they stand for; the text itself where they cannot be read."""
    from email.header import decode_header

    if "=?" not in text:
        return text
    try:
        pieces = [(x.encode("utf-8", "replace") if isinstance(x, str) else x, charset) for x, charset in decode_header(text)]
        return "".join(_characters(x, charset) for x, charset in pieces)
    except Exception:
        return text


def _characters(raw: bytes, charset: str | None) -> str:
    try:
        return raw.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return raw.decode("utf-8", errors="replace")


def _people(lines: list[str]) -> list[tuple[str, str]]:
    """Names and addresses of address headers.  Addresses are split before encoded names are read, which may hold commas."""
    from email.utils import getaddresses

    return [(_decoded_words(n), a) for n, a in getaddresses(lines)] if lines else []


def _columns(raw: bytes, limit: int) -> dict:
    """Header and structure columns of one message; every later rule is a Spark expression."""
    from email import message_from_bytes

    msg = message_from_bytes(raw)
    headers: dict[str, list[str]] = {}
    for name, value in msg.raw_items():
        headers.setdefault(name.lower(), []).append(_plain(str(value)))

    def first(header: str) -> str | None:
        value = next(iter(headers.get(header, ())), None)
        return None if value is None else _decoded_words(value)

    name, addr = next(iter(_people(headers.get("from", [])[:1])), ("", ""))
    parts = []
    for part in msg.walk():
        if part.is_multipart():
            continue
        size, text = _decoded(part, limit)
        parts.append(
            {
                "maintype": part.get_content_maintype(),
                "subtype": part.get_content_subtype(),
                "disposition": (part.get_content_disposition() or "").lower(),
                "filename": _filename(part),
                "size": size,
                "text": text,
            }
        )
    return {
        "from_name": name,
        "from_addr": addr,
        "reply_to_addr": next((a for _, a in _people(headers.get("reply-to", [])[:1])), ""),
        "to_addrs": [a for _, a in _people(headers.get("to", []))],
        "cc_addrs": [a for _, a in _people(headers.get("cc", []))],
        "date_hdr": first("date"),
        "message_id_hdr": first("message-id"),
        "in_reply_to_hdr": first("in-reply-to"),
        "references_hdr": first("references"),
        "auth_results_hdr": first("authentication-results"),
        "size_bytes": len(raw),
        "parts": parts,
    }


def message_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every message file below a path; Spark lists and splits the files."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{eml,emlx}")
        .load(path)
        .select("path", "content")
    )


def parse_messages(files: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Landed columns of message files (path, content), a bounded Arrow batch at a time.

    A file that cannot be read gives a row with ``parse_error`` instead of failing the job.
    """
    names = [f.strip().split(" ")[0] for f in PARSED.split(", ")]
    limit = registry.max_text_bytes

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                leaf = file.rsplit("/", 1)[-1]
                stem = leaf.split(".", 1)[0]
                row = dict.fromkeys(names) | {
                    "path": file,
                    "uid": int(stem) if stem.isdecimal() else None,
                    "partial": leaf.endswith(".partial.emlx"),
                }
                try:
                    raw = unframe(content) if leaf.endswith(".emlx") else bytes(content)
                    row |= _columns(raw, limit)
                except Exception as e:  # one bad message never stops a run; it is counted
                    row["parse_error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({"uid": "Int64", "size_bytes": "Int64"})

    return files.select("path", "content").mapInPandas(parse, PARSED)


def read_messages(spark: SparkSession, path: str, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    return parse_messages(message_files(spark, path), registry)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parse_error IS NULL")


def unreadable_counts(parsed: DataFrame) -> DataFrame:
    """Number of skipped rows by reason."""
    return (
        parsed.filter("parse_error IS NOT NULL")
        .groupBy(F.substring_index("parse_error", ":", 1).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- mailbox catalogue: mailboxes(rowid, url), messages(rowid, mailbox, sender, deleted), addresses


def mailboxes(catalogue: DataFrame) -> DataFrame:
    """(rowid, account_uuid, path) of network mailboxes, path percent-decoded."""
    return catalogue.filter("url LIKE 'imap://%'").selectExpr(
        "rowid",
        "regexp_extract(url, '^imap://([^/]*)', 1) AS account_uuid",
        # a plus sign stands for itself in a path
        "url_decode(replace(regexp_replace(regexp_replace(url, '^imap://[^/]*', ''), '^/+', ''), '+', '%2B')) AS path",
    )


def sender_counts(catalogue: DataFrame, messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """(email, account_uuid, n): live messages an address sent within an account.

    Messages are counted per (mailbox, sender) first, so the joins see few rows whatever the mailbox
    sizes are.
    """
    counted = messages.filter("deleted = 0").groupBy("mailbox", "sender").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(mailboxes(catalogue).selectExpr("rowid AS mailbox", "account_uuid"), "mailbox")
        .join(addresses.selectExpr("rowid AS sender", "lower(address) AS email"), "sender")
        .groupBy("email", "account_uuid")
        .agg(F.sum("n").alias("n"))
    )


def detect_accounts(counts: DataFrame, owners: DataFrame) -> DataFrame:
    """Per address of ``owners`` (email) the account it sent most from; the smaller id at a tie."""
    return (
        counts.join(owners.selectExpr("lower(email) AS email").distinct(), "email", "left_semi")
        .groupBy("email")
        .agg(F.expr("min_by(account_uuid, struct(-n, account_uuid)) AS account_uuid"), F.max("n").alias("n"))
    )


def sync_folders(catalogue: DataFrame, messages: DataFrame) -> DataFrame:
    """Per account and role the first non-empty folder in order of preference."""
    wanted = [(n, "inbox", i) for i, n in enumerate(INBOX_NAMES)]
    wanted += [(n, "sent", i) for i, n in enumerate(SENT_NAMES)]
    rows = ", ".join(f"struct({literal(p)} AS path, '{r}' AS role, {i} AS priority)" for p, r, i in wanted)
    live = messages.filter("deleted = 0").groupBy(F.col("mailbox").alias("rowid")).agg(F.count(F.lit(1)).alias("n"))
    boxes = mailboxes(catalogue).join(live, "rowid")
    ranked = boxes.selectExpr("*", f"get(filter(array({rows}), w -> w.path = path), 0) AS w").filter("w IS NOT NULL")
    best = W.partitionBy("account_uuid", "w.role").orderBy("w.priority", "rowid")
    return (
        ranked.withColumn("_r", F.row_number().over(best))
        .filter("_r = 1")
        .selectExpr("account_uuid", "w.role AS role", "path", "rowid", "n")
    )


def find_mailbox(catalogue: DataFrame, account_uuid: str, path: str) -> DataFrame:
    """The mailbox with a path, whether its URL is stored quoted or not."""
    plain = f"imap://{account_uuid}/{path}"
    return mailboxes(catalogue).join(
        catalogue.selectExpr("rowid", "url"), "rowid"
    ).filter(
        f"account_uuid = {literal(account_uuid)} AND (path = {literal(path)} OR url = {literal(plain)})"
    ).select("rowid")


def highest_rowids(catalogue: DataFrame, messages: DataFrame) -> DataFrame:
    """(rowid, top): largest message id per mailbox, deleted ones included, 0 for an empty one."""
    top = messages.groupBy(F.col("mailbox").alias("rowid")).agg(F.max("rowid").alias("top"))
    return mailboxes(catalogue).select("rowid").join(top, "rowid", "left").selectExpr("rowid", "coalesce(top, 0L) AS top")
