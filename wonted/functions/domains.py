"""Host names: registrable domain, freemail test, hosts of links.

The public-suffix rules become hash-set membership tests on the last labels of the host, so the
registrable domain is an ordinary expression: no join, no shuffle, no Python.  Like all of
``wonted.functions`` these take and return Spark SQL expression text, for ``F.expr``/``selectExpr``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from wonted.functions.sql import BLANKS, literal, one_of

# Mailbox providers open to everyone; reputation never spreads inside them.
FREEMAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com",
    "yahoo.com", "ymail.com", "rocketmail.com", "aol.com", "icloud.com", "me.com", "mac.com",
    "proton.me", "protonmail.com", "pm.me", "tutanota.com", "tuta.io", "gmx.com", "gmx.net",
    "gmx.de", "web.de", "mail.com", "mail.ru", "yandex.com", "yandex.ru", "zoho.com",
    "fastmail.com", "fastmail.fm", "hey.com", "qq.com", "163.com", "126.com", "sina.com",
    "naver.com", "daum.net", "hushmail.com", "mailfence.com", "posteo.de", "runbox.com",
    "comcast.net", "verizon.net", "att.net", "sbcglobal.net", "cox.net", "charter.net",
    "earthlink.net", "juno.com", "optonline.net", "btinternet.com", "sky.com", "talktalk.net",
    "virginmedia.com", "orange.fr", "wanadoo.fr", "free.fr", "sfr.fr", "laposte.net",
    "t-online.de", "freenet.de", "libero.it", "virgilio.it", "tiscali.it", "seznam.cz", "wp.pl",
    "onet.pl", "o2.pl", "interia.pl", "rediffmail.com", "duck.com", "duckduckgo.com",
    "simplelogin.io", "anonaddy.me",
)

# Providers that ignore dots in the local part.
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")

# Suffixes of two labels in the built-in list, written as "second level: top levels".
SECOND_LEVEL_SUFFIXES = {
    "co": "uk jp kr nz za in il id th ke tz ug zw at cr ve",
    "com": "au br cn mx ar tr sg hk tw my ph vn ua pl pt co pe ec eg sa ng pk bd",
    "org": "uk au br cn mx tr sg hk tw my za nz il in pl",
    "net": "uk au br cn mx tr sg hk tw my nz in pl",
    "ac": "uk jp kr nz za in il id th ke at",
    "gov": "uk au br cn tr sg hk tw my za in il pl",
    "edu": "au br cn mx ar tr sg hk tw my pl pe",
    "or": "jp kr id th at ke",
    "ne": "jp kr ke",
    "go": "jp kr id th ke",
}

# Last labels that are reserved for special use and never a public suffix.
SPECIAL_USE_LABELS = (
    "localhost", "local", "localdomain", "internal", "intranet", "lan", "home", "corp", "test",
    "invalid", "example", "onion",
)


@dataclass(frozen=True)
class SuffixRules:
    """Public-suffix rules grouped by their number of labels.

    ``open_top_level`` accepts any plausible single last label as a suffix; it is meant for the small
    built-in list and switched off when a full list file is loaded.
    """

    version: str
    exact: tuple
    wildcard: tuple = ()
    exception: tuple = ()
    open_top_level: bool = False

    @classmethod
    def from_lines(cls, lines, version: str) -> SuffixRules:
        """Rules from the text of a public-suffix list; its private-domain section is left out."""
        exact, wild, exc = [], [], []
        for raw in lines:
            line = raw.strip()
            if "BEGIN PRIVATE DOMAINS" in line:
                break
            if not line or line.startswith("//"):
                continue
            rule = line.split()[0].lower()
            if rule.startswith("!"):
                exc.append(rule[1:])
            elif rule.startswith("*."):
                wild.append(rule[2:])
            else:
                exact.append(rule)
        return cls(version, tuple(exact), tuple(wild), tuple(exc))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, version: str) -> SuffixRules:
        """Rules from a list file (about ten thousand short lines) readable by the cluster."""
        text = spark.read.text(path, wholetext=True).first()
        return cls.from_lines(text[0].splitlines() if text else [], version)


DEFAULT_SUFFIXES = SuffixRules(
    version="builtin-1",
    exact=tuple(f"{s}.{t}" for s, tops in SECOND_LEVEL_SUFFIXES.items() for t in tops.split()),
    open_top_level=True,
)


def clean_host(host: str) -> str:
    """Trimmed, dot-stripped, lower-cased host."""
    return f"lower(btrim(btrim({host}, {literal(BLANKS)}), '.'))"


def reg_domain(host: str, rules: SuffixRules = DEFAULT_SUFFIXES) -> str:
    """Registrable domain of any host text; see ``reg_domain_of_clean``."""
    return reg_domain_of_clean(clean_host(host), rules)


def reg_domain_of_clean(host: str, rules: SuffixRules = DEFAULT_SUFFIXES) -> str:
    """Registrable domain of a clean host by the longest matching suffix rule (an exception rule
    wins over all); the host itself when none matches."""

    def tail(k):
        return f"substring_index({host}, '.', -{k})"

    def of_size(entries, k):
        return [e for e in entries if e.count(".") + 1 == k]

    exceptions, cases = [], []
    for k in sorted({e.count(".") + 1 for e in rules.exception}, reverse=True):
        exceptions.append(f"WHEN {one_of(tail(k), of_size(rules.exception, k))} THEN {tail(k)}")
    longest = max([0, *(e.count(".") + 1 for e in rules.exact), *(e.count(".") + 2 for e in rules.wildcard)])
    for k in range(longest, 0, -1):
        if wild := of_size(rules.wildcard, k - 1):
            enough = f"size(split({host}, '[.]')) >= {k}"
            cases.append(f"WHEN {one_of(tail(k - 1), wild)} AND {enough} THEN {tail(k + 1)}")
        if exact := of_size(rules.exact, k):
            cases.append(f"WHEN {one_of(tail(k), exact)} THEN {tail(k + 1)}")
    if rules.open_top_level:
        plausible = f"{tail(1)} RLIKE {literal(TOP_LEVEL)}"
        special = one_of(tail(1), SPECIAL_USE_LABELS)
        cases.append(f"WHEN {plausible} AND NOT {special} THEN {tail(2)}")
    return f"CASE {' '.join(exceptions + cases)} ELSE {host} END"


def is_freemail(domain: str) -> str:
    return one_of(domain, FREEMAIL_DOMAINS)


TOP_LEVEL = r"^(?:\p{L}{2,63}|xn--[a-z0-9-]+)$"
LINK_HOST = r"""(?iU)https?://(?:[^\s/@"'<>]*@)?([^\s/:?#"'<>\)\]]+)"""


def link_hosts(text: str) -> str:
    """Hosts of the http(s) links in a text, in order; user info, port and path are left out."""
    return f"regexp_extract_all({text}, {literal(LINK_HOST)}, 1)"


def link_domain_list(text: str, rules: SuffixRules = DEFAULT_SUFFIXES) -> str:
    """Registrable domain of every link in a text, one entry per link."""
    cleaned = f"transform({link_hosts(text)}, h -> {clean_host('h')})"
    return f"filter(transform({cleaned}, h -> {reg_domain_of_clean('h', rules)}), d -> d <> '')"
