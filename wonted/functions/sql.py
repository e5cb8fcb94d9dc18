"""Writing Spark SQL expression text."""

from __future__ import annotations


# White space as str.strip counts it; Java's \s is narrower.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def literal(text: str) -> str:
    """A quoted SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(expression: str, members) -> str:
    return f"({expression} IN ({', '.join(literal(m) for m in members)}))"


def say(*parts: str) -> str:
    """SQL text that joins parts: those starting with "=" are SQL, shown empty when NULL."""
    return "concat(%s)" % ", ".join(
        f"coalesce(cast({p[1:]} AS string), '')" if p.startswith("=") else literal(p) for p in parts
    )
