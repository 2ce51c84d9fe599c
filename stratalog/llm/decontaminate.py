"""Benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item is a set of windows of 13 consecutive words, and a window the set of its 5-word shingles. To contain a window a text must hold all of its shingles, so a prefix of one shingle is enough: the window's rarest. The texts' shingles are joined with these prefixes; the position that the shingle has in the window bounds where the window can begin and must leave room for its length; and the words at that place are compared with the window's.

Up to a measured size the benchmark is one broadcast index, and documents are searched without a shuffle. A larger one is a distributed table: shingles are ordered by how often the documents hold them, windows with a shingle that no document holds fall out, and what is left is joined by prefix with the documents' shingles, which a filter of fixed size has thinned.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, keep_rows, named, slices

WINDOW = 13
SHINGLE = 5
#: Bytes of benchmark text up to which its index is broadcast; a larger benchmark is joined.
BROADCAST_BYTES = 4 << 20
#: Bits of the filter that documents' shingles pass before they are joined; its size is fixed.
FILTER_BITS = 1 << 25
#: A document is contaminated if at least 1 of so many words is hit.
SHARE = 20

#: A-Z to lower case; other ASCII characters but digits and a-z to spaces.
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` ids; equal runs have equal hashes."""
    out = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for i in range(width):
        out = (out ^ ids[i : len(ids) - width + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of a block of items, reachable by their rarest shingle."""

    def __init__(self, items: list[tuple[str, bytes]]):
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        holders: list[set[str]] = []
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                at = windows.setdefault(tuple(ids[i : i + WINDOW]), len(windows))
                if at == len(holders):
                    holders.append(set())
                holders[at].add(name)
        self.vocabulary, self.holders = vocabulary, holders
        self.length = np.array([len(w) for w in windows], np.int64)
        self.windows = np.full((len(windows), WINDOW), -1, np.int32)
        for k, w in enumerate(windows):
            self.windows[k, : len(w)] = w
        # Shingles have 5 words, or all of them in a shorter window; by width: sorted hashes of prefixes, their windows and positions.
        self.prefixes = []
        for width in sorted({min(SHINGLE, len(w)) for w in windows}):
            own = [k for k, w in enumerate(windows) if min(SHINGLE, len(w)) == width]
            codes = [_codes(self.windows[k, : self.length[k]], width) for k in own]
            often = Counter(np.concatenate(codes).tolist())
            position = np.array([min(range(len(c)), key=lambda i, c=c: (often[int(c[i])], int(c[i]), i)) for c in codes])
            code = np.array([c[i] for c, i in zip(codes, position, strict=True)], np.uint64)
            order = np.argsort(code, kind="stable")
            self.prefixes.append((width, code[order], np.array(own)[order], position[order]))

    def hits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence in the concatenated texts, whose words are ids[start:end]; words that no item has are -1."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        text = np.repeat(np.arange(len(starts)), ends - starts)
        for width, code, window, position in self.prefixes:
            known = np.concatenate([[0], np.cumsum(ids < 0)])
            at = np.flatnonzero(known[width:] == known[:-width]) if len(ids) >= width else np.zeros(0, np.int64)
            if not len(at):
                continue
            own = _codes(ids, width)[at]
            low, high = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, w = np.repeat(at, n) - position[which], window[which]
            # Positional and length bounds, within the text that holds the shingle.
            home = text[np.repeat(at, n)]
            fits = (begin >= starts[home]) & (begin + self.length[w] <= ends[home])
            begin, w = begin[fits], w[fits]
            same = np.ones(len(begin), bool)
            for i in range(WINDOW):
                inside = i < self.length[w]
                same &= ~inside | (ids[np.where(inside, begin + i, 0)] == self.windows[w, i])
            places.append(begin[same])
            found.append(w[same])
        return np.concatenate(places), np.concatenate(found)


def _found(index: Index, texts: list[bytes]) -> tuple[list[np.ndarray], list[set[str]], np.ndarray]:
    """For each text, which of its words are hit, the items that have a window in it, and whether a window of WINDOW words is one of those."""
    get = index.vocabulary.get
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    ids = np.array([get(w, -1) for ws in words for w in ws], np.int32)
    ends = np.cumsum(n)
    starts = ends - n
    place, window = index.hits(ids, starts, ends)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + index.length[window], -1)
    hit = np.cumsum(step[:-1]) > 0
    items: list[set[str]] = [set() for _ in texts]
    for d, w in set(zip(np.searchsorted(ends, place, "right").tolist(), window.tolist(), strict=True)):
        items[d] |= index.holders[w]
    full = np.zeros(len(texts), bool)
    full[np.searchsorted(ends, place[index.length[window] == WINDOW], "right")] = True
    return [hit[s:e] for s, e in zip(starts, ends, strict=True)], items, full


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")


def _index(benchmark: DataFrame, item_id: str, item_text: str, most: int) -> Index | None:
    """The index of all items, if they have at most `most` bytes of text and names."""
    items = _items(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    return Index([(r.item, r.text.encode()) for r in items.collect()]) if size <= most else None


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """A signed 64-bit hash of each run of `width` words."""
    ids = np.array([xxhash.xxh64_intdigest(w, width) for w in words], np.uint64)
    return _codes(ids, width).view(np.int64)


def _filter(codes: DataFrame, bits: int):
    """A broadcast filter of fixed size that all values of the column code pass, and few others; built from the bits that are set, each part of them once."""
    slot = F.pmod(F.xxhash64("code"), F.lit(bits))
    pages = codes.select((slot / 65536).cast("int").alias("page"), F.pmod(slot, F.lit(65536)).cast("int").alias("bit")).distinct().groupBy("page").agg(F.collect_list("bit").alias("bits"))
    out = np.zeros(bits, bool)
    for r in pages.toLocalIterator():
        out[r.page * 65536 + np.array(r.bits, np.int64)] = True
    return codes.sparkSession.sparkContext.broadcast(np.packbits(out))


def _passes(held: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Which codes pass the filter, by the hash that the filter was built with."""
    raw = codes.astype("<i8").tobytes()
    at = np.array([xxhash.xxh64_intdigest(raw[i : i + 8], 42) for i in range(0, len(raw), 8)], np.uint64).view(np.int64) % bits
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _text_key(text: str) -> list[Column]:
    """128 bits of a text. Equal texts have the same hits, so that they are searched for once."""
    return [F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit("second"), F.col(text)).alias("h2")]


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, bits: int) -> DataFrame:
    """(h1, h2, n_hit, whole, items) of texts with a hit, for a benchmark of any size.

    No group is gathered but a text's own hits. Both sides of each join are dealt by its key and neither is a sum by it, so that adaptive execution can split a shingle that very many documents hold.
    """
    array = pa.list_(pa.string())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = [x.decode() for x in words_of(t.encode())]
                own = [w[i : i + WINDOW] for i in range(max(1, len(w) - WINDOW + 1))] if w else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, array)], names=["item", "words"])

    key = F.xxhash64("words").alias("w1"), F.xxhash64(F.lit("second"), "words").alias("w2")
    held = checkpointed(_items(benchmark, item_id, item_text).mapInArrow(windows, "item string, words array<string>").select("item", "words", *key).distinct())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w1, w2, code, position = [], [], [], []
            for a, b, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _shingles([w.encode() for w in words], min(SHINGLE, len(words)))
                w1 += [a] * len(own)
                w2 += [b] * len(own)
                code += own.tolist()
                position += range(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(code, pa.int64()), pa.array(position, pa.int32())], names=["w1", "w2", "code", "position"])

    single = held.groupBy("w1", "w2").agg(F.first("words").alias("words"))
    shingles = checkpointed(single.select("w1", "w2", "words").mapInArrow(cut, "w1 long, w2 long, code long, position int"))
    # Widths under SHINGLE are those of short items.
    widths = sorted(r.n for r in single.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect())
    texts = docs.select(*_text_key(text), F.col(text).alias("text")).where("text is not null")

    def counted(passed):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, own in slices(batch, 2):
                    code = [c for t in own for w in [words_of(t)] for n in widths if len(w) >= n for c in [_shingles(w, n)]]
                    code = np.concatenate(code) if code else np.zeros(0, np.int64)
                    value, n = np.unique(code, return_counts=True)
                    keep = _passes(passed.value, value, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(n[keep])], names=["code", "n"])

        return run

    # Written before it is joined, as a sum by the code would bind a code that very many windows have to one task.
    often = checkpointed(texts.mapInArrow(counted(_filter(shingles.select("code"), bits)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    # A window can only occur where each of its shingles does; its prefix is the rarest of them.
    rare = shingles.join(often, "code").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "code", "position")).alias("least"))
    prefixes = checkpointed(
        rare.join(single, ["w1", "w2"]).where(F.col("m") == F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))).select("w1", "w2", "words", F.col("least.code").alias("code"), F.col("least.position").alias("position"))
    )

    def found(passed):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, own in slices(batch, 2):
                    row, code, at, near, before = [], [], [], [], []
                    for i, t in enumerate(own):
                        w = words_of(t)
                        for n in widths:
                            if len(w) < n:
                                continue
                            c = _shingles(w, n)
                            for k in np.flatnonzero(_passes(passed.value, c, bits)).tolist():
                                first = max(0, k - WINDOW + 1)
                                row.append(i)
                                code.append(int(c[k]))
                                at.append(k)
                                before.append(k - first)
                                near.append([x.decode() for x in w[first : k + WINDOW]])
                    rows = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array(code, pa.int64()), pa.array(at, pa.int64()), pa.array(before, pa.int32()), pa.array(near, array)], names=["h1", "h2", "code", "at", "before", "near"]
                    )

        return run

    places = texts.mapInArrow(found(_filter(prefixes.select("code"), bits)), "h1 long, h2 long, code long, at long, before int, near array<string>").distinct()
    n, start = F.size("words"), F.col("before") - F.col("position")
    hits = places.join(prefixes, "code").where((start >= 0) & (start + n <= F.size("near"))).where(F.slice("near", F.greatest(start, F.lit(0)) + 1, n) == F.col("words"))
    hits = checkpointed(hits.select("h1", "h2", "w1", "w2", (F.col("at") - F.col("position")).alias("begin"), n.alias("n")).distinct())
    # Words inside any of a text's spans, which are taken in order of their beginnings.
    spans = F.array_sort(F.collect_set(F.struct("begin", "n")))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["begin"] + x["n"]).alias("end"), (acc["total"] + F.greatest(x["begin"] + x["n"] - F.greatest(acc["end"], x["begin"]), F.lit(0))).alias("total"))
    words_hit = hits.groupBy("h1", "h2").agg(F.aggregate(spans, none, step)["total"].alias("n_hit"), F.max(F.col("n") == WINDOW).alias("whole"))
    names = hits.select("h1", "h2", "w1", "w2").distinct().join(held.select("w1", "w2", "item"), ["w1", "w2"]).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return checkpointed(words_hit.join(names, ["h1", "h2"]))


def _with_hits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with h1, h2) and what is found in their texts; joined by a mix of the hashes, so that the rows of one text can be split over tasks."""
    mix = F.col("h1").bitwiseXOR(F.col("h2")).alias("mix")
    return rows.select("*", mix).join(found.select(mix, F.col("h1").alias("f1"), "n_hit", "whole", "items").withColumnRenamed("mix", "fmix"), (F.col("mix") == F.col("fmix")) & (F.col("h1") == F.col("f1")), "left")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(id, n_words, n_hit, items) for every row of docs: its words, those inside an occurrence of a benchmark window, and the sorted ids, as strings, of the items that have one.

    A-Z is lower-cased; words are runs of a-z, digits and characters above U+007F. An item with 1 to 12 words is one window; one with none has no windows. Null text has no words. Items with a null id are left out; rows that repeat an id add windows to it. An empty benchmark hits nothing. Repeated documents each have a row; texts of any length are searched whole; other columns, of whatever names, are left out.

    The benchmark's size is measured first. Up to broadcast_bytes it is one broadcast index; beyond that windows are joined with documents. Both ways give the same rows.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counted = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
    index = _index(benchmark, item_id, item_text, broadcast_bytes)
    if index is None:
        keyed = rows.select("id", *_text_key("text"), F.coalesce("text", F.lit("")).alias("text"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, 3):
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(words_of(t)) for t in texts], pa.int64())], names=["id", "h1", "h2", "n_words"])

        words = keyed.mapInArrow(count, T.StructType([rows.schema["id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n_words", T.LongType())]))
        out = _with_hits(words, _joined(rows, benchmark, "text", item_id, item_text, filter_bits))
        return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                marks, items, _ = _found(held.value, texts)
                columns = [pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64()), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_words", "n_hit", "items"])

    return rows.mapInArrow(run, counted)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows, with all their columns, in which no window of WINDOW words occurs and of which fewer than 1 in SHARE words are hit.

    One passage is enough, however long the text around it: a long document that holds a benchmark item word by word is as contaminated as a short one. The share tells only for items that are shorter than a window, whose few words may stand in any text by chance. Null and empty texts stay; repeated rows are judged each; empty tables give all rows of docs.
    With a benchmark of up to broadcast_bytes, rows are filtered where they are searched and nothing is shuffled; a larger one is joined, and rows are joined with the texts that are hit.
    """
    index = _index(benchmark, item_id, item_text, broadcast_bytes)
    if index is None:
        whole = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), *_text_key(text), F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)).alias("n_words"))
        out = _with_hits(whole, _joined(docs, benchmark, text, item_id, item_text, filter_bits))
        return out.where(F.col("n_hit").isNull() | (~F.col("whole") & (F.col("n_hit") * SHARE < F.col("n_words")))).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast(index)

    def clean(texts: list[bytes]) -> np.ndarray:
        marks, _, whole = _found(held.value, texts)
        n, words = np.array([m.sum() for m in marks], np.int64), np.array([len(m) for m in marks], np.int64)
        return ~whole & ((n == 0) | (n * SHARE < words))

    return keep_rows(docs, text, clean)


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, i, spans.n FROM spans JOIN windows USING (n, s)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
