"""Rows for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside; a table may have them too.
CLASHING = ("size", "part", "row", "keep", "shard", "slot", "twin", "h1", "salt", "rank", "class", "p", "fp", "regs", "label", "score")


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta lambda mu nu xi".split()) for _ in range(n))


def odd_rows(seed=3):
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared lines."""
    rng = random.Random(seed)
    shared = "a line that a number of documents have in common"
    rows = [(i, words(rng, rng.randint(0, 60)) + f"\n  {shared.upper() if i % 3 else shared}\t\n" * (i % 2), "en", f"s{i % 4}", None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "\n\n", "en", "s1", 2), (103, "é" * 30 + "\n" + shared, "fr", "sé", 5)]
    rows += [(None, shared, None, "s1", 1), (None, None, None, None, None), (7, "another text under a used number\n" + shared, "en", "s2", 3)]
    rows += [(200, words(rng, 30_000), "en", "s0", 9), (201, "x" * 50_000, "en", "s0", 9)]
    rows += [rows[5]] * 3 + [(300 + i, "the very same text in many rows of this small table, again and again", "en", "s3", 1) for i in range(30)]
    return rows


def plain(df):
    """Rows of a result as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
