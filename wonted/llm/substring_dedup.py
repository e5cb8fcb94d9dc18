"""Byte strings that start more than once, by suffix arrays over anchored contexts.

Every window of ``length`` bytes is owned by one of the grams of ``GRAM`` bytes in it: the one with the smallest
hash, the leftmost on a tie.  Equal windows have equal owners at equal places, so all occurrences of a string meet
under its owner's hash, and only the hash, the place and a hash of the owned context move.

1. Per document, the runs of windows with one owner: (gram hash, context hash, place, windows).
2. Gram hashes that occur once are dropped.  Where all contexts of a gram are equal, all its windows repeat.
3. Where they differ, one context of each kind is cut from its document.  The contexts of a task's grams form
   one text, whose suffix array is built in two stages: only suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets of first bytes in order.  Neighbours in the array
   with a common prefix of ``length`` bytes or more are repeats.
4. A gram with more than ``wide`` different contexts would be too much for one task: its windows are hashed (128
   bits) and counted instead, combined before the shuffle.
5. Spans go back to their documents, are merged and cut out.

A document longer than ``SLICE`` bytes is anchored in overlapping slices, with the same result.

Results for odd input: null text is empty; documents shorter than ``length`` lose nothing; rows that share an id
keep apart by their text; repeated rows are documents of their own, so all their long strings repeat; null ids are
ids like any other (inside, the smallest 64-bit integer stands for them); empty tables give no rows.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import partitions, read, saved, texts
from wonted.llm.hashing import BYTE_VALUES, chunks, mix, powers, running, text_bytes

GRAM = 128
SLICE = 1 << 19
PLACE_BITS = 21  # of a byte within a chunk
SECOND_VALUES = mix(BYTE_VALUES)


NO_ID = -(1 << 63)


def owned(docs: DataFrame) -> DataFrame:
    """owner (the id, never null), twin, text.  Spans and texts meet on (owner, twin): always this frame, so that
    the plan deals out the texts once for all its joins."""
    t = texts(docs)
    return t.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("owner"), "twin", "text")


# ---- anchors -------------------------------------------------------------------------------------


def _window_minimum(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima forward and backward in blocks of w."""
    n = len(g)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = g
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner in a chunk of documents: document, first window (place in it), windows, gram hash, context hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    c, inverse = running(data, BYTE_VALUES), powers(len(data))[1]
    g = mix((c[GRAM:] - c[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    placed = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # leftmost on a tie
    owner = (_window_minimum(placed, length - GRAM + 1) & low).astype(np.int64)
    at = np.arange(len(owner))
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + length <= offsets[doc + 1]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(fresh & inside)
    ends = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
    n = ends - runs
    context = mix((c[ends + length - 1] - c[runs]) * inverse[runs] + n.astype(np.uint64))
    return doc[runs], runs - offsets[doc[runs]], n, g[owner[runs]].view(np.int64), context.view(np.int64)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """owner, twin, gram, context, n (windows), places (of the first windows): one row per kind of run in a document,
    so a text that repeats a phrase over and over has few rows."""
    names = ["owner", "twin", "gram", "context", "n", "places"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, doc, at, n, gram, context):
            order = np.lexsort((at, context, gram, doc))
            doc, at, n, gram, context = (x[order] for x in (doc, at, n, gram, context))
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            one = np.flatnonzero(fresh)
            places = pa.ListArray.from_arrays(pa.array(np.append(one, len(doc)), pa.int32()), pa.array(at))
            rows = pa.array(doc[one])
            arrays = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x[one]) for x in (gram, context, n)), places]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in chunks(offsets, SLICE):
                off = offsets[a : b + 1]
                if off[-1] - off[0] <= 2 * SLICE:
                    doc, *run = anchors(data[off[0] : off[-1]], off - off[0], length)
                    yield out(batch, doc + a, *run)
                    continue
                for x in range(off[0], off[-1], SLICE):  # one long document: windows from x to x + SLICE
                    y = min(x + SLICE + length - 1, off[-1])
                    doc, at, *run = anchors(data[x:y], np.array([0, y - x]), length)
                    yield out(batch, doc + a, at + x - off[0], *run)

    return owned(docs).mapInArrow(work, "owner long, twin long, gram long, context long, n long, places array<long>")


# ---- suffix arrays -------------------------------------------------------------------------------


def _eights(text: np.ndarray) -> np.ndarray:
    """At every place the next eight values as one number, most significant first; zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + n]
    return out


def _direct(places: np.ndarray, eights: np.ndarray, equal: np.ndarray, length: int) -> np.ndarray:
    """Places sorted by the ``length`` bytes from there: eight at a time, only within groups still tied.

    equal: a hash of those bytes; a group in which it is the same everywhere is finished.
    """
    order = places[np.argsort(eights[places], kind="stable")]
    key = eights[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    open_ = np.arange(len(order))
    for depth in range(8, length, 8):
        # groups of one, and of equal strings, are done
        g, e = group[open_], equal[order[open_]]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(start, len(g)))
        differ = np.maximum.reduceat(e, start) != np.minimum.reduceat(e, start) if len(g) else np.zeros(0, bool)
        open_ = open_[np.repeat(differ & (sizes > 1), sizes)]
        if not len(open_):
            break
        at = order[open_]
        nxt = np.minimum(at + depth, len(eights) - 1)
        key, g = np.where(at + depth < len(eights), eights[nxt], 0), group[open_]
        o = np.lexsort((key, g))
        order[open_], key = at[o], key[o]
        # a group, whose members are neighbours, splits where the key changes
        change = np.concatenate([[False], group[1:] != group[:-1]])
        change[open_[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = np.cumsum(change)
    return order


def suffix_order(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, equal: np.ndarray, length: int) -> np.ndarray:
    """The wanted places in the order of their suffixes, each read up to the end of its context.

    Two stages: a suffix smaller than its successor is sorted directly; a larger one is its first byte in front of
    its successor, so scanning buckets in order of the first byte finds the larger ones in their order.
    ends: the contexts' ends.  Order within ``length`` bytes; wanted places have that many.
    """
    n = len(text)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    # smaller than its successor: the next different byte is larger; runs up to a context's end are larger
    rises, changes = np.zeros(n, bool), last.copy()
    rises[:-1] = text[:-1] < text[1:]
    rises &= ~last
    changes[:-1] |= text[:-1] != text[1:]
    decides = np.minimum.accumulate(np.where(changes, np.arange(n), n - 1)[::-1])[::-1]
    smaller = rises[decides]

    # a larger suffix needs its successors up to the first smaller one or the context's end
    stop = np.minimum.accumulate(np.where(smaller | last, np.arange(n), n - 1)[::-1])[::-1]
    at = np.flatnonzero(wanted)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, stop[at] + 1, -1)
    taken = np.cumsum(cover[:-1]) > 0

    direct = _direct(np.flatnonzero(taken & smaller), _eights(text), equal, length)
    edges = np.searchsorted(text[direct], np.arange(257))
    larger = taken & ~smaller
    found: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(places: np.ndarray, above: int) -> None:
        """Predecessors that are larger and start with a greater byte go to their buckets, in this order."""
        before = places[places > 0] - 1
        before = before[larger[before] & ~last[before] & (text[before] > above)]
        o = np.argsort(text[before], kind="stable")
        cuts = np.searchsorted(text[before][o], np.arange(257))
        for c in np.unique(text[before]):
            found[c].append(before[o[cuts[c] : cuts[c + 1]]])

    tail = np.flatnonzero(last & larger)  # one byte before the end: the end comes before everything
    for c in np.unique(text[tail]):
        found[c].append(tail[text[tail] == c])
    buckets = []
    for c in range(256):
        parts = []
        front = np.concatenate([*found[c], np.zeros(0, np.int64)]).astype(np.int64)
        while len(front):  # runs of one byte, a step at a time
            parts.append(front)
            front = front[front > 0] - 1
            front = front[larger[front] & ~last[front] & (text[front] == c)]
        bucket = np.concatenate([*parts, direct[edges[c] : edges[c + 1]]]).astype(np.int64)
        if len(bucket):
            hand_on(bucket, c)
            buckets.append(bucket)
    order = np.concatenate([*buckets, np.zeros(0, np.int64)]).astype(np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the last shares its first ``length`` bytes with the next in the array."""
    eights = _eights(text)
    equal, open_ = np.zeros(max(0, len(order) - 1), bool), np.arange(max(0, len(order) - 1))
    for depth in range(0, length, 8):
        step = min(depth, length - 8)  # the last eight may overlap the ones before
        open_ = open_[eights[order[open_] + step] == eights[order[open_ + 1] + step]]
    equal[open_] = True
    return equal


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context whether each of its windows is also another window of these contexts."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.frombuffer(b"".join(contexts), np.uint8)
    wanted = np.zeros(len(text), bool)
    for a, b in zip(starts, ends):
        wanted[a : b - length + 1] = True
    c, inverse = running(text, SECOND_VALUES), powers(len(text))[1]
    stop = np.minimum(np.arange(len(text)) + length, np.repeat(ends, sizes))
    equal = mix((c[stop] - c[:-1]) * inverse)
    order = suffix_order(text, ends, wanted, equal, length)
    same = common_prefixes(order, text, length)
    repeated = np.zeros(len(text), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return [repeated[a : b - length + 1] for a, b in zip(starts, ends)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


# ---- the operator --------------------------------------------------------------------------------


def _by_suffix_array(contexts: DataFrame, length: int, batch_bytes: int = 1 << 19) -> DataFrame:
    """gram, context, first, n: runs of repeated windows in the contexts of one gram (all in one task)."""

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        flags = repeated_windows([x[2] for x in held], length)
        rows = [(gram, context, a, n) for (gram, context, _), f in zip(held, flags) for a, n in zip(*_runs(f))]
        arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(arrays, names=["gram", "context", "first", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for gram, context, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if size > batch_bytes and gram != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append((gram, context, raw))
                size += len(raw)
        if held:
            yield from settle(held)

    rows = contexts.select("gram", "context", "raw").repartition(partitions(contexts), "gram").sortWithinPartitions("gram")
    return rows.mapInArrow(work, "gram long, context long, first long, n long")


def _by_counting(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many contexts: windows hashed and counted, whatever task they are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, context, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text = np.frombuffer(raw, np.uint8)
                n = len(text) - length + 1
                c, d, inverse = running(text, BYTE_VALUES), running(text, SECOND_VALUES), powers(len(text))[1][:n]
                h = [mix((x[length:] - x[:n]) * inverse).view(np.int64) for x in (c, d)]
                arrays = [*map(pa.array, h), pa.array(np.full(n, gram)), pa.array(np.full(n, context)), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "gram", "context", "first"])

    windows = contexts.select("gram", "context", "raw").mapInArrow(work, "h1 long, h2 long, gram long, context long, first long")
    often = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    return windows.join(often, ["h1", "h2"]).select("gram", "context", "first", F.lit(1).cast("long").alias("n"))


def spans(docs: DataFrame, length: int = 400, wide: int = 4096) -> DataFrame:
    """owner, twin, spans: (start, end) byte ranges that repeat, unmerged, for every document that has any."""
    rows = saved(anchor_rows(docs, length))
    grams = rows.groupBy("gram").agg(F.sum(F.size("places")).alias("times"), F.min("context").alias("least"), F.max("context").alias("most"))
    # written first: then a hot gram's side of the join can be split
    grams = saved(grams.filter("times > 1").select("gram", (F.col("least") != F.col("most")).alias("several")))
    shared = saved(rows.join(grams, "gram"))

    mixed = shared.filter("several")
    kinds = mixed.groupBy("gram", "context").agg(F.min(F.struct("owner", "twin", F.col("places")[0].alias("at"), "n")).alias("one"), F.sum(F.size("places")).alias("times"))
    kinds = saved(kinds.select("gram", "context", "times", "one.*"))
    many = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    cut = F.substring(F.col("text").cast("binary"), F.col("at").cast("int") + 1, (F.col("n") + length - 1).cast("int"))

    def contexts(which: DataFrame) -> DataFrame:
        found = kinds.join(which, "gram").join(owned(docs), ["owner", "twin"]).select("owner", "twin", "gram", "context", cut.alias("raw"))
        return found.groupBy("owner", "twin", "gram", "context").agg(F.first("raw").alias("raw"))  # repeated rows once

    narrow = _by_suffix_array(contexts(many.filter(F.col("kinds") <= wide)), length)
    repeats = narrow.union(kinds.filter("times > 1").select("gram", "context", F.lit(0).cast("long").alias("first"), "n"))
    crowded = saved(many.filter(F.col("kinds") > wide))
    if not crowded.isEmpty():
        repeats = repeats.union(_by_counting(contexts(crowded), length))
    repeats = repeats.groupBy("gram", "context").agg(F.collect_list(F.struct("first", "n")).alias("runs"))

    some = mixed.select("owner", "twin", "places", "gram", "context").join(repeats, ["gram", "context"])
    all_ = shared.filter("not several").select("owner", "twin", "places", F.array(F.struct(F.lit(0).cast("long").alias("first"), "n")).alias("runs"))
    found = some.select("owner", "twin", "places", "runs").union(all_)
    found = found.select("owner", "twin", F.explode("places").alias("at"), "runs").select("owner", "twin", "at", F.explode("runs").alias("r"))
    found = found.select("owner", "twin", (F.col("at") + F.col("r.first")).alias("a"), F.col("r.n").alias("n"))
    found = found.select("owner", "twin", F.struct(F.col("a").alias("start"), (F.col("a") + F.col("n") + length - 1).alias("end")).alias("span"))
    return found.groupBy("owner", "twin").agg(F.collect_set("span").alias("spans"))


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw, spans_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = raw.as_buffer().to_pybytes()
                if not spans_.is_valid:
                    out.append((doc_id, len(raw), 0, 0, raw))
                    continue
                s = spans_.values
                a, b = s.field("start").to_numpy(), s.field("end").to_numpy()
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, a, 1)
                np.add.at(cover, b, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out.append((doc_id, len(raw), int(gone.sum()), len(_runs(gone)[0]), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array([r[i] for r in out], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = owned(docs).join(found, ["owner", "twin"], "left")
    rows = rows.select(F.nullif("owner", F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary"), "spans")
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    result = cut_out(docs, spans(docs))
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut can leave half a character
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))
