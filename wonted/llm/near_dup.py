"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification, components.

1. Every document becomes its distinct k-word shingles (64-bit hashes), their count, a 128-bit fingerprint and a
   sketch: register i is floor(1 - log_b(min over the set of an exponential variate)), truncated to a byte.
   Sketches of parts merge by the larger register.
2. Documents with equal sets are one class, named by its smallest id; copies never meet each other.
3. Five registers make a band; classes equal in a band share a bucket.  In a first round each bucket's members
   meet its smallest one only.  Pairs are estimated jointly: the counts of larger, smaller and equal registers
   with both set sizes give the likelihood of every Jaccard value; a pair goes on unless the threshold is refuted
   by ``slack`` nats.  What goes on is verified on the full sets, and verified links are joined into components.
4. After that only members of one bucket that are still in different components matter: those outside the
   bucket's main component meet all others in blocks of bounded size.  A first pass over sketches alone finds who
   still has a partner that is not refuted; only their texts are fetched.  A second pass has the texts in the
   blocks (smaller than the sets, which are made there): every pair not refuted is verified there unless the block has joined its two components already, and
   only the links that join components leave the block.  So no pair is left out, and none is ever shipped.
5. Components by alternating large and small stars, checkpointed each round.

The only links that can be missed are pairs that share no band: at a similarity of 0.85 with 24 bands of 5 fewer
than one in a million, less above; and pairs refuted wrongly by the likelihood, 3 in 100,000 at the threshold itself.

Results for odd input: null or empty text has no shingles, links with nothing and is its own component; a null id
links with nothing, has a null component and is kept; rows that share an id are one document, linked by any of
its texts; repeated rows give repeated results; empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import DOCUMENT_COLUMNS, partitions, read, saved, texts
from wonted.llm.hashing import chunks, shingles, text_bytes, words

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SPACING = 1.2  # base b of the registers
RATE = 20.0  # rate a of the exponential variates: keeps registers of any set above 0
MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Ids, 8 bytes each, that may be broadcast.
LISTED = 500_000
EDGES_PER_TASK = 100_000


# ---- sketches ------------------------------------------------------------------------------------


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of registers per non-empty set; sets lie one after the other from their starts."""
    lowest = np.empty((len(starts), REGISTERS), np.uint64)
    for i, m in enumerate(MULTIPLIERS):
        lowest[:, i] = np.minimum.reduceat(hashes * m, starts)
    variate = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 2.0**64) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(variate) / math.log(SPACING))
    return np.clip(k, 0, 255).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, twin, n (set size), fp (fingerprint of the set), regs; one row per document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in chunks(offsets):
                off = offsets[a : b + 1]
                h, _, _, first = words(data[off[0] : off[-1]], off - off[0])
                sets = list(shingles(h, first, k))
                sizes = np.array([len(s) for s in sets])
                regs = np.zeros((len(sets), REGISTERS), np.uint8)
                if sizes.any():
                    full = sizes > 0
                    regs[full] = registers(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["doc_id", "twin", "n", "fp", "regs"],
                )

    return texts(docs).mapInArrow(work, "doc_id long, twin long, n long, fp binary, regs binary")


def _sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        off = offsets[a : b + 1]
        h, _, _, first = words(data[off[0] : off[-1]], off - off[0])
        yield from shingles(h, first, k)


def wanted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose id is in ``ids``, repeated rows once.

    Up to ``LISTED`` ids, counted, are sent to the texts; with more the texts are dealt out by id."""
    ids = saved(ids)
    if ids.limit(LISTED + 1).count() <= LISTED:
        ids = F.broadcast(ids)
    found = texts(docs).join(ids, "doc_id", "left_semi").groupBy("doc_id", "twin").agg(F.first("text").alias("text"))
    return found.select("doc_id", "text")


def full_sets(wanted: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, shingles (array of hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets_of(batch.column(1), k)]
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate([*sets, np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "shingles"])

    return wanted.mapInArrow(work, "doc_id long, shingles array<long>")


# ---- likelihood ----------------------------------------------------------------------------------


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / math.log(SPACING)


def log_likelihood(j, larger, smaller, equal, na, nb):
    """Of Jaccard value j, given how many registers of a are larger than, smaller than and equal to those of b."""
    u = na / (na + nb)
    v = 1 - u
    up, down = _p(u - v * j), _p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(c > 0, c * np.log(np.maximum(p, 1e-300)), 0.0) for c, p in ((larger, up), (smaller, down), (equal, 1 - up - down))]
    return terms[0] + terms[1] + terms[2]


#: Jaccard values at which the likelihood is looked at; between two of them it hardly changes.
GRID = np.linspace(0.02, 1.0, 50)


def not_refuted(larger, smaller, equal, na, nb, percent: int, slack: float = 8.0) -> np.ndarray:
    """Whether a Jaccard value of percent / 100 or more stays possible: sizes allow it and the likelihood does."""
    larger, smaller, equal, na, nb = (np.asarray(x, np.float64) for x in (larger, smaller, equal, na, nb))
    args, most = (larger, smaller, equal, na, nb), np.minimum(na, nb) / np.maximum(na, nb)
    best, at = np.full(len(na), -np.inf), percent / 100
    for j in GRID[GRID < at]:  # concave in j: above the threshold nothing refutes it
        best = np.maximum(best, log_likelihood(np.minimum(j, most), *args))
    fits = best - log_likelihood(np.minimum(at, most), *args) <= slack
    return fits & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that the sketches do not refute."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5))
            keep = not_refuted((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), batch.column(2), batch.column(3), percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(work, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs linked on their full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s"))
    return linked.filter(f"c > 0 and 100 * c >= {percent} * (s - c)").select("a", "b").distinct()


# ---- components ----------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in links (a, b).

    Large star: neighbours larger than a node go to its smallest neighbour; small star: the smaller ones do.
    Both leave the components as they are and end in stars.  Smallest neighbours come from a pre-aggregated
    grouping and are joined back, so a node with very many links is never one group.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
        state = mark
        tasks = max(1, -(-mark[0] // EDGES_PER_TASK))  # few edges need few tasks, and few files between them
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(lowest.select("a", "m")).coalesce(tasks).distinct().coalesce(tasks))


# ---- the operator --------------------------------------------------------------------------------


def _bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * ROWS + 1, ROWS)) for i in range(BANDS)])


def _blocks(shared: DataFrame, labels: DataFrame, members: DataFrame, few: int, many: int, least: int) -> DataFrame:
    """band, out, all: per bucket with several components, members outside its main component (blocks that
    weigh about ``few``) beside all members (about ``many``); members: rep, weight and columns to carry.

    Buckets with fewer than ``least`` members are left out."""
    marked = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    marked = marked.select("bucket", "band", "rep", F.coalesce("component", "rep").alias("label")).join(members, "rep")
    by_label = marked.groupBy("bucket", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    main = by_label.groupBy("bucket").agg(
        F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("whole"), F.max("w").alias("inside"),
        F.sum("n").alias("members"), F.count("*").alias("labels"),
    )
    main = main.filter(f"labels > 1 and members >= {least}").drop("labels", "members")
    open_ = marked.join(main, "bucket")
    row, salt = F.struct("label", *members.columns), F.xxhash64("rep")
    all_ = open_.groupBy("bucket", "band", F.pmod(salt, F.ceil(F.col("whole") / many)).alias("m")).agg(F.collect_list(row).alias("all"))
    out = open_.filter("label <> main").groupBy("bucket", F.pmod(salt, F.ceil((F.col("whole") - F.col("inside")) / few)).alias("o"))
    blocks = all_.join(out.agg(F.collect_list(row).alias("out")), "bucket").select("band", "out", "all")
    return blocks.repartition(partitions(shared))  # a block is work, not bytes


class _Members:
    """The members in one cell of a block."""

    def __init__(self, rows, k: int):
        f = rows.values
        self.rep, self.label, self.n = (f.field(x).to_numpy(zero_copy_only=False) for x in ("rep", "label", "n"))
        self.regs = np.frombuffer(b"".join(f.field("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        self.rows, self.k, self._sets = f, k, None

    @property
    def sets(self) -> list[np.ndarray]:
        if self._sets is None:
            self._sets = list(_sets_of(self.rows.field("text"), self.k))
        return self._sets


def _candidates(batch: pa.RecordBatch, percent: int, k: int = 0) -> Iterator[tuple]:
    """Per row of ``_blocks`` and bounded number of pairs: out, all, and the places of the pairs not refuted."""
    for i in range(batch.num_rows):
        band = batch.column(0)[i].as_py()
        out, all_ = _Members(batch.column(1)[i], k), _Members(batch.column(2)[i], k)
        xs, ys, equals, largers = [], [], [], []

        def settled():
            x, y, equal, larger = (np.concatenate(v) for v in (xs, ys, equals, largers))
            ok = not_refuted(larger, REGISTERS - equal - larger, equal, out.n[x], all_.n[y], percent)
            order = np.argsort(-equal[ok], kind="stable")
            return out, all_, x[ok][order], y[ok][order]

        for x in range(len(out.rep)):
            y = np.flatnonzero((all_.label != out.label[x]) & (100 * np.minimum(all_.n, out.n[x]) >= percent * np.maximum(all_.n, out.n[x])))
            same = all_.regs[y] == out.regs[x]
            equal = same.sum(1)
            alike = equal >= 0.006 * percent * REGISTERS  # fewer are refuted anyway
            if band and alike.any():  # an earlier bucket has the pair
                alike &= ~same[:, : band * ROWS].reshape(len(y), band, ROWS).all(2).any(1)
            if alike.any():
                y = y[alike]
                xs.append(np.full(len(y), x))
                ys.append(y)
                equals.append(equal[alike])
                largers.append((out.regs[x] > all_.regs[y]).sum(1))
                if sum(map(len, ys)) > 200_000:
                    yield settled()
                    xs, ys, equals, largers = [], [], [], []
        if xs:
            yield settled()


def _still_open(shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """doc_id of every class with a partner in one bucket, in another component, that is not refuted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out, all_, x, y in _candidates(batch, percent):
                yield pa.RecordBatch.from_arrays([pa.array(np.union1d(out.rep[x], all_.rep[y]))], names=["doc_id"])

    members = classes.select("rep", "n", "regs", F.lit(1).alias("weight"))
    # the two members of a bucket of two have met in the first round
    return _blocks(shared, labels, members, 256, 4096, 3).mapInArrow(work, "doc_id long").distinct()


def _joining_links(shared: DataFrame, labels: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): verified links that join the components that share a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, block, root = [], None, {}

            def find(v):
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                return v

            for out, all_, xs, ys in _candidates(batch, percent, k):
                if out is not block:
                    block, root = out, {}
                for x, y in zip(xs, ys):
                    p, q = find(out.label[x]), find(all_.label[y])
                    if p != q:
                        s, t = out.sets[x], all_.sets[y]
                        common = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * common >= percent * (len(s) + len(t) - common):
                            root[p] = q
                            links.append((out.rep[x], all_.rep[y]))
            a, b = (pa.array([z[i] for z in links], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    members = classes.join(wanted.withColumnRenamed("doc_id", "rep"), "rep")
    members = members.select("rep", "n", "regs", "text", (F.octet_length("text") + 200).alias("weight"))
    return _blocks(shared, labels, members, 200_000, 2_000_000, 2).mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, twin, n_shingles, component_id per row: linked where 100 * intersection >= percent * union."""
    marks = saved(sketches(docs, k))
    sets = marks.filter("n > 0 and doc_id is not null")
    by_fp = saved(sets.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("regs").alias("regs")))
    classes = by_fp.select("rep", "n", "regs")

    banded = classes.select("rep", F.posexplode(_bands()).alias("band", "bucket"))
    first = banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last")
    shared = saved(banded.join(first.select("bucket", "first"), "bucket").select("bucket", "band", "rep", "first"))

    stars = shared.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tested = saved(_likely(stars, classes, percent))
    links = _verified(tested, saved(full_sets(wanted_texts(docs, _ends(tested)), k)), percent)
    # rows with one id and several texts, or several ids and one text, belong together
    member = sets.join(by_fp.select("fp", "rep"), "fp").select("doc_id", "rep").distinct()
    own = member.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(own))

    left = saved(wanted_texts(docs, _still_open(shared, labels, classes, percent)))
    rest = saved(_joining_links(shared, labels, classes, left, k, percent))
    if not rest.isEmpty():
        labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(rest))

    found = marks.select("doc_id", "twin", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    linked = F.when(F.col("n") > 0, F.col("component"))
    return found.select("doc_id", "twin", F.col("n").alias("n_shingles"), F.coalesce(linked, "doc_id").alias("component_id"))


def query(spark, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): the one with the smallest id."""
    found = near_duplicates(docs, percent=80)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)
