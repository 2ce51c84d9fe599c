"""SimHash fingerprints, and links between them through a Gray-order hierarchical index.

The index has three tiers, all of them nodes of shared masked bit patterns:
 - Upper nodes, as a distributed table. The 64 bits are cut into 5 blocks; for each choice of 2 blocks, a mask covers the other 3, and all fingerprints with the same bits under a mask are one node. Two fingerprints that differ in at most 2 bits agree in at least 3 blocks, so they meet in a node.
 - A node of more than NODE_ROWS fingerprints is factored again in the same way over the bits that its mask leaves free, into nodes with at most 11 free bits. These hold at most 2048 different fingerprints, whatever the data.
 - Within a node, fingerprints sorted by Gray rank make a tree: every FANOUT neighbours share a pattern of common bits. A self-join walks pairs of tree nodes from the top, and drops a pair when the differences that their common bits have accumulated exceed the limit.
Only a spanning forest of a node's links leaves the node, so that a dense group gives as many edges as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, named, slices
from .graph import MIX, components

SHINGLE_WORDS = 3
SEED = 42
LIMIT = 2
BLOCKS = 5
#: Fingerprints above which an upper node is factored once more.
NODE_ROWS = 4096
FANOUT = 8
#: Pairs of tree nodes compared at a time.
PAIRS = 1 << 18

#: For each byte, its 8 bits in the 8 bytes of a word, lowest first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def shingles(text: bytes, width: int = SHINGLE_WORDS) -> list[bytes]:
    """The space-joined shingles, repeats included, of the lower-cased words; all words if there are fewer than width."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprint of each text: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before = len(hashes)
        hashes += [digest(s, SEED) for s in shingles(text)]
        counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    lanes = _LANES[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    # A lane of one byte holds sums up to 255, so documents are summed in pieces of 255 shingles.
    pieces = -(-counts[full] // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    bits = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
    totals = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(totals * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp), and the columns that are asked for besides: the fingerprint of each document as a long. Null and empty texts have 0."""
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"), *also)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fingerprints(texts).view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _masks(bits: list[int]) -> list[int]:
    """The masks, as signed longs, that cover 3 of 5 equal blocks of the given bit positions."""
    blocks = [bits[i * len(bits) // BLOCKS : (i + 1) * len(bits) // BLOCKS] for i in range(BLOCKS)]
    masks = [sum(1 << b for block in chosen for b in block) for chosen in combinations(blocks, BLOCKS - LIMIT)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the labels of a and b are joined; a label is the least position of its group."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        differ = low < high
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        if not len(a):
            break
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def linked(fp: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each fingerprint, the position of the first one of its group: those of its run that links reach within the run.

    Rows are sorted by run, then Gray rank. Neighbours in Gray order are joined first; then the tree is walked, without pairs whose members are all in one group.
    """
    n = len(fp)
    label = np.arange(n)
    close = (run[1:] == run[:-1]) & (_popcount(fp[1:] ^ fp[:-1]) <= LIMIT)
    label = np.maximum.accumulate(np.where(np.concatenate([[False], close]), 0, label))
    # Levels from the fingerprints up: pattern, mask of the bits that all below share, run.
    levels = [(fp, np.full(n, ~np.uint64(0)), run, np.arange(n))]
    while True:
        pattern, mask, of, _ = levels[-1]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        if len(heads) == len(of):
            break
        place = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
        first = np.flatnonzero(place % FANOUT == 0)
        low, high = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
        common = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
        levels.append((low & common, common, of[first], first))
    top = np.arange(len(levels[-1][0]))
    # The frontier is a stack of (level, a, b), so that at most PAIRS pairs unfold at a time.
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PAIRS:
            stack += [(depth, a[PAIRS:], b[PAIRS:]), (depth, a[:PAIRS], b[:PAIRS])]
            continue
        pattern, mask, _, _ = levels[depth]
        keep = _popcount((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= LIMIT
        a, b = a[keep], b[keep]
        if depth == 0:
            label = _merged(label, a, b)
            continue
        starts = [x[3] for x in levels[1 : depth + 1]]
        low = high = label
        for first in starts:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~one], b[~one]
        if not len(a):
            continue
        first = levels[depth][3]
        size = np.diff(np.append(first, len(levels[depth - 1][0])))
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        ca, cb = first[a][:, None] + i, first[b][:, None] + j
        good = (i < size[a][:, None]) & (j < size[b][:, None]) & (ca <= cb if depth > 1 else ca < cb)
        stack.append((depth - 1, ca[good], cb[good]))
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m1, m2, key, fp, doc), sorted by node: edges (u, v) between the documents of linked fingerprints, a star for each group."""

    def edges(t: pa.Table) -> pa.RecordBatch | None:
        node = [t.column(i).to_numpy() for i in range(3)]
        fp, doc = t.column(3).to_numpy().astype(np.int64).view(np.uint64), t.column(4).to_numpy()
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in node], axis=0)])
        run = np.cumsum(new)
        alone = np.bincount(run)[run] == 1
        fp, doc, run = fp[~alone], doc[~alone], run[~alone]
        if not len(fp):
            return None
        order = np.lexsort((gray_rank(fp), run))
        fp, doc, run = fp[order], doc[order], run[order]
        label = linked(fp, run)
        child = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(doc[child]), pa.array(doc[label[child]])], names=["u", "v"]) if len(child) else None

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        # The last node may go on in the next batch.
        last = [held.column(i)[held.num_rows - 1].as_py() for i in range(3)]
        same = np.all([held.column(i).to_numpy() == last[i] for i in range(3)], axis=0)
        cut = held.num_rows - int(same.sum())
        if cut and (out := edges(held.slice(0, cut))) is not None:
            yield out
        held = held.slice(cut)
    if held is not None and held.num_rows and (out := edges(held)) is not None:
        yield out


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(u, v) for prints (fp, doc) with different fp: edges whose components are those of all links of at most LIMIT bits.

    doc is a long that stands for the fingerprint. An empty table gives an empty one.
    """
    upper = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("m1"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(list(range(64))))]))
    nodes = prints.select("fp", "doc", upper.alias("n")).select(F.col("n.m1").alias("m1"), F.col("n.key").alias("key"), "fp", "doc")
    # Joined by a mix of the key, so that a crowded node's rows can be split over tasks.
    mix = F.col("key").bitwiseXOR(F.lit(MIX)).alias("mix")
    large = nodes.groupBy("m1", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > NODE_ROWS).select("m1", mix)
    nodes = nodes.withColumn("mix", mix)
    small = nodes.join(large, ["m1", "mix"], "left_anti").select("m1", F.lit(-1).cast("short").alias("m2"), "key", "fp", "doc")
    lower = []
    for i, m in enumerate(_masks(list(range(64)))):
        free = [b for b in range(64) if not m >> b & 1]
        lower.append(F.array(*[F.struct(F.lit(k).cast("short").alias("m2"), F.col("fp").bitwiseAND(F.lit(m | s)).alias("key")) for k, s in enumerate(_masks(free))]))
    factored = nodes.join(large, ["m1", "mix"], "left_semi").select("m1", "fp", "doc", F.explode(F.element_at(F.array(*lower), F.col("m1").cast("int") + 1)).alias("n")).select("m1", F.col("n.m2").alias("m2"), F.col("n.key").alias("key"), "fp", "doc")
    every = small.unionByName(factored).repartition("m1", "m2", "key").sortWithinPartitions("m1", "m2", "key")
    return every.mapInArrow(_forest, "u long, v long")


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root): for each fingerprint the least one that links reach, from rows with an fp."""
    distinct = prints.select("fp").distinct()
    reach = components(link_fingerprints(distinct.select("fp", F.col("fp").alias("doc"))), "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return distinct.join(reach, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): each document's fingerprint and the smallest doc_id of its group, which links of at most LIMIT bits between fingerprints join.

    Ids may be of any type that has an order. Documents without words, null texts among them, have fingerprint 0 and link like any other. Repeated rows each have a row, and rows that share an id but not a text belong to their texts' groups. A document whose doc_id is null takes part by its fingerprint, and has a null component if no document of its group has an id. Whole texts count, of whatever length; other columns, of whatever names, are left out; an empty table gives an empty one.
    """
    prints = checkpointed(with_fingerprints(docs, doc_id, text))
    # A fingerprint's ids are summed up before any join, so that copies cost one row.
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = checkpointed(_roots(prints).join(first, "fp"))
    # Joined by a mix of the root, so that a large group's fingerprints can be split over tasks.
    mixed = F.col("root").bitwiseXOR(F.lit(MIX)).alias("mix")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component")).select(mixed, "component")
    group = rooted.select("fp", mixed).join(smallest, "mix").select("fp", "component")
    return prints.join(group, "fp", "left").select("id", "fp", "component")


def _row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """(h1, h2): 128 bits of all columns of a row, with nulls told apart."""
    own = [named(f.name) for f in docs.schema.fields]
    held = [x for c, f in zip(own, docs.schema.fields, strict=True) for x in (c.isNull(), F.map_entries(c) if isinstance(f.dataType, T.MapType) else c)]
    return F.xxhash64(*held).alias("h1"), F.xxhash64(F.lit("second"), *held).alias("h2")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id (a null id comes last); of several of that id, the one with the least hash of all columns; of rows that are equal in all columns, one.

    Groups are those of near_duplicates: documents without a word, null texts among them, are one group. Long texts count whole; columns may have any names; an empty table gives an empty one.
    Rows that are equal are made one before the shuffle, so that no number of copies of a row meets in one task.
    """
    h = _row_hashes(docs)
    prints = checkpointed(with_fingerprints(docs, doc_id, text, h))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    # Copies are summed up by fingerprint first, then groups by root.
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(_roots(prints), "fp").groupBy("root").agg(F.min("best").alias("best"))
    first = best.select("best.h1", "best.h2")
    whole = docs.select(*h, F.struct(*map(named, docs.columns)).alias("doc")).groupBy("h1", "h2").agg(F.first("doc").alias("doc"))
    return whole.join(first, ["h1", "h2"], "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
