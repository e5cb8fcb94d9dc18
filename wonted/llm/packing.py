"""Sequences filled by minimum bin slack over remaining lengths.

1. Every document becomes tokens and one end token, cut into pieces of ``capacity`` and a remainder.  Only
   (id, start, length, checksum) goes on.
2. The remaining lengths of all pieces are one histogram with at most ``capacity`` entries, however large the
   corpus; it alone is brought to the driver.
3. A window takes the longest remaining length and, by subset-sum dynamic programming on bitsets (bit s: sum s
   is reachable), the multiset of other lengths whose sum comes closest to what is left of the capacity; counts
   come out by walking the layers back.  The multiset is used as often as the counts allow, so each step
   exhausts a length and there are at most about ``capacity`` patterns.
4. Pieces of one length are numbered by salted ranks; the number gives pattern, window and place by arithmetic.

Results for odd input: null or empty text is the end token alone; null and repeated ids are rows like any other;
an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wonted.llm.common import read, saved

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_loaded: dict = {}


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Place of a public vocabulary's files, without their extension."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")[: -len(".json")]


def token_ids(place: str | None = None):
    """A function from text to little-endian unsigned 32-bit ids; loaded once per process.

    The rank file holds the same vocabulary and splits the same way, several times faster; texts with the
    special token or with characters outside common letters, marks and blanks go to the tokenizer itself.
    """
    place = place or vocabulary()
    if place not in _loaded:
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(f"{place}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(f"{place}.json")
        odd = re.compile(r"<\|endoftext\|>|[^\t\n\r -~\xa1-\xac\xae-ɏ]|[^\s]{2000}")

        def ids(text: str) -> np.ndarray:
            got = slow.encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text)
            return np.array([*got, END_ID], dtype="<u4")

        _loaded[place] = ids
    return _loaded[place]


def pieces(docs: DataFrame, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(place)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "")
                raw = memoryview(ids.tobytes())
                for a in range(0, len(ids), capacity):
                    b = min(a + capacity, len(ids))
                    rows.append((doc_id, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=[x.split()[0] for x in PIECES.split(", ")])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` without passing it."""
    reach, layers, mask, full = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        n, step = min(counts[length], room // length), 1
        while n and not reach & full:  # 1, 2, 4, ... and the rest make up any count
            step = min(step, n)
            layers.append((length, step, reach))
            reach |= reach << (length * step) & mask
            n, step = n - step, step * 2
        if reach & full:
            break
    s, chosen = reach.bit_length() - 1, {}
    for length, step, before in reversed(layers):
        if not before >> s & 1:
            chosen[length] = chosen.get(length, 0) + step
            s -= length * step
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) until every piece has its place; the longest length left opens each window."""
    left, out = {x: n for x, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        out.append((times, dict(sorted(chosen.items(), reverse=True))))
        for x, n in chosen.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return out


def _places(found: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per (length, pattern): length, first rank, count per window, first sequence, offset; sorted by length, rank."""
    used: dict[int, int] = {}
    sequence, rows = 0, []
    for times, chosen in found:
        offset = 0
        for length, n in chosen.items():
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def packed(cut: DataFrame, capacity: int = CAPACITY, salt_rows: int = 1_000) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``; any column ``length`` will do."""
    cut = saved(cut)
    columns = cut.columns
    hist = saved(cut.groupBy("length").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / salt_rows)))
    table = _places(patterns({r["length"]: r["n"] for r in hist.collect()}, capacity))  # at most ``capacity`` rows

    key = [c for c in ("doc_id", "start", "ids_crc32") if c in columns]
    salted = cut.join(F.broadcast(hist.select("length", "salts")), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(*key), F.col("salts")))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_salt.select("length", "salt", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy(*key)
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*columns, (F.col("first") + F.col("rank")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.int64(1) << np.int64(48)
        keys = table[:, 0] * shift + table[:, 1]
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            t = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - t[:, 1]
            yield f.drop(columns="rank").assign(sequence_id=t[:, 3] + nth // t[:, 2], offset=t[:, 4] + nth % t[:, 2] * length)

    types = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return ranked.mapInPandas(place, f"{types}, sequence_id long, offset long")


def query(spark, folder: str) -> DataFrame:
    return packed(pieces(read(spark, folder, "documents")))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and where they lie in the training sequences."""
    return packed(pieces(docs))
