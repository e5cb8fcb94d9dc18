"""Addresses, display names, header fields and string similarity.

Everything takes and returns Spark SQL expression text, except the two folds that need Unicode
decomposition, which Spark lacks: those are columns backed by one Arrow UDF each.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wonted.functions.domains import DEFAULT_SUFFIXES, DOTLESS_DOMAINS, SuffixRules, reg_domain_of_clean
from wonted.functions.sql import BLANKS, literal, one_of

# Characters folded onto the Latin letter they look like.
LOOKALIKE_LETTERS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s",
    "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ѡ": "w", "ѵ": "v", "ꞅ": "s",
    # Greek
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "ω": "w",
    # digits and stroked letters
    "0": "o", "1": "l", "3": "e", "5": "s", "ø": "o", "ł": "l", "đ": "d",
    # other Latin
    "ı": "i", "ǀ": "l", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v",
}

_FOLD = str.maketrans(LOOKALIKE_LETTERS)


@F.pandas_udf(T.StringType())
def _skeleton_unicode(text: pd.Series) -> pd.Series:
    def fold(s):
        kept = (c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        return "".join(kept).translate(_FOLD)

    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold_unicode(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def is_ascii(text: str) -> str:
    """Whether every character takes one byte."""
    return f"(octet_length({text}) = char_length({text}))"


def skeleton_ascii(text: str) -> str:
    """Lookalike-folded form of text known to be ASCII; stays in generated JVM code."""
    pairs = {k: v for k, v in LOOKALIKE_LETTERS.items() if k.isascii()}
    return f"translate(lower({text}), '{''.join(pairs)}', '{''.join(pairs.values())}')"


def skeleton(column: str | Column) -> Column:
    """Lookalike-folded form: lower case, compatibility decomposition, no accents, folded letters.

    Only non-ASCII strings of a named column go through the UDF, the others reach it as NULL; all of a computed one do.
    ``operators.folding`` keeps ASCII rows away from Python altogether.
    """
    if isinstance(column, Column):
        return _skeleton_unicode(column)
    plain, text = F.expr(is_ascii(column)), F.col(column)
    return F.when(plain, F.expr(skeleton_ascii(column))).otherwise(_skeleton_unicode(F.when(~plain, text)))


def _trim(text: str, characters: str) -> str:
    return f"btrim({text}, {literal(characters)})"


def plain_name(name: str) -> str:
    """Display name without outer blanks and quotes, inner white space collapsed."""
    bare = _trim(_trim(_trim(name, BLANKS), '"'), BLANKS)
    return f"regexp_replace({bare}, {literal(f'[{BLANKS}]+')}, ' ')"


def display_name_ascii(name: str) -> str:
    return f"lower({plain_name(name)})"


def normalize_display_name(name: str) -> Column:
    """``plain_name``, case-folded."""
    s, plain = F.expr(plain_name(name)), F.expr(is_ascii(name))
    return F.when(plain, F.lower(s)).otherwise(_casefold_unicode(F.when(~plain, s)))


def address_domain(address: str) -> str:
    """Text after the last '@' (the whole text when there is none)."""
    return f"substring_index({address}, '@', -1)"


def normalize_address(address: str, rules: SuffixRules = DEFAULT_SUFFIXES) -> str:
    """Canonical mailbox: lower case, no tag, and no local dots where the provider ignores them."""
    a = f"lower({_trim(_trim(address, BLANKS), '<>')})"
    domain = _trim(address_domain(a), ".")
    local = f"substring_index(regexp_replace({a}, '@[^@]*$', ''), '+', 1)"
    dotless = f"({one_of(reg_domain_of_clean(domain, rules), DOTLESS_DOMAINS)} OR {one_of(domain, DOTLESS_DOMAINS)})"
    return (
        f"CASE WHEN instr({a}, '@') = 0 THEN {a} "
        f"WHEN {dotless} THEN concat(replace({local}, '.', ''), '@', {domain}) "
        f"ELSE concat({local}, '@', {domain}) END"
    )


EMAIL_TOKEN = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"


def emails_in_text(text: str) -> str:
    """Address-like tokens of a text, lower-cased, in order."""
    found = f"transform(regexp_extract_all({text}, {literal(EMAIL_TOKEN)}, 0), e -> lower(e))"
    # most texts have no '@' and need no pattern at all
    return f"if(instr({text}, '@') > 0, {found}, cast(array() AS array<string>))"


def auth_verdict(header: str, mechanism: str) -> str:
    """First verdict of one mechanism (spf, dkim, dmarc) in an Authentication-Results header."""
    pattern = literal(rf"(?iU)\b{mechanism}\s*=\s*([a-z0-9]+)")
    return f"nullif(lower(regexp_extract({header}, {pattern}, 1)), '')"


def message_id_list(header: str) -> str:
    """All <...> tokens of a header."""
    return f"coalesce(regexp_extract_all({header}, '<[^<>]+>', 0), cast(array() AS array<string>))"


def file_extension(filename: str) -> str:
    """Lower-case text after the last dot, at most 16 characters; empty when there is no dot."""
    ext = f"left(lower(substring_index({filename}, '.', -1)), 16)"
    return f"CASE WHEN instr({filename}, '.') > 0 THEN {ext} ELSE '' END"


def one_decimal(x: str) -> str:
    """One decimal of a number from 0, rounded by its exact binary value; exactly half-way goes to the even digit.

    Scaling by a power of two is exact: the number is (whole + rest) / 2^40; ``over`` is how far it is above the middle.
    """
    one = "1099511627776"  # 2^40
    parts = f"named_struct('whole', bigint(floor(v * {one}D)), 'rest', v * {one}D - floor(v * {one}D))"
    tenths = f"named_struct('k', p.whole * 10 div {one}, 'over', double(p.whole * 10 % {one} - 549755813888L) + 10D * p.rest)"
    digits = f"CASE WHEN q.over < 0 THEN q.k WHEN q.over > 0 THEN q.k + 1 ELSE q.k + q.k % 2 END"
    shown = f"transform(transform(transform(array({x}), v -> {parts}), p -> {tenths}), q -> {digits})"
    return f"if({x} < 500000D, get(transform({shown}, d -> concat(d div 10, '.', d % 10)), 0), format_string('%.1f', {x}))"


def format_size(n_bytes: str) -> str:
    return (
        f"CASE WHEN {n_bytes} >= 1048576 THEN concat({one_decimal(f'({n_bytes} / 1048576D)')}, ' MB') "
        f"WHEN {n_bytes} >= 1024 THEN concat({one_decimal(f'({n_bytes} / 1024D)')}, ' KB') "
        f"ELSE concat(cast({n_bytes} AS string), ' B') END"
    )


def osa_distance(a: str, b: str, cap: int = 3) -> str:
    """Optimal-string-alignment distance, capped: a fold over the rows of the edit matrix.

    State: ``cur`` the last finished row, ``old`` the row above it.  For single comparisons; similar
    domains are found by equality joins instead (``operators.lookalike``).
    """
    here, there = f"substr({a}, i, 1)", f"substr({b}, j, 1)"
    swapped = (
        f"i > 1 AND j > 1 AND {here} = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = {there}"
    )
    cell = (
        f"least(m.cur[j] + 1, element_at(r, -1) + 1, m.cur[j - 1] + if({here} = {there}, 0, 1), "
        f"if({swapped}, get(m.old, j - 2) + 1, NULL))"
    )
    row = f"aggregate(sequence(1, length({b})), array(i), (r, j) -> concat(r, array({cell})))"
    full = (
        f"aggregate(sequence(1, length({a})), "
        f"named_struct('cur', sequence(0, length({b})), 'old', sequence(0, length({b}))), "
        f"(m, i) -> named_struct('cur', {row}, 'old', m.cur), m -> element_at(m.cur, -1))"
    )
    # a swap counts two in the built-in distance, which is banded and cheap, so it settles most pairs
    return (
        f"CASE levenshtein({a}, {b}, {2 * cap - 2}) WHEN -1 THEN {cap} WHEN 0 THEN 0 WHEN 1 THEN 1 "
        f"ELSE CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN least(greatest(length({a}), length({b})), {cap}) "
        f"ELSE least({full}, {cap}) END END"
    )
