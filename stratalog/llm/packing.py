"""Packing of documents into sequences of equal length, related documents together.

Documents are tokenized and cut into chunks of one window at most. Whole windows are sequences already. The rests are sorted by min-hashes of their tokens, in which rare tokens weigh more, and the sorted rows are cut into shards of bounded size as they come, so that rests that share much meet at every size of the input; in each, a BM25 inverted index over token ids, with the document frequencies and mean length of all rests, returns, for a seed, the unused documents that are closest to it, which fill the seed's window greedily. A document that doesn't fit is cut, and its rest is the next seed. So only a shard's last window is not full; it is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, Paths, Words, plain, spans_of
from .common import checkpointed, slices

WINDOW = 4096
END_ID = 2
#: Tokens to a shard, from which it is closed; the number of shards follows from the number of tokens.
SHARD_TOKENS = 1 << 20
#: Shards that a task sorts and packs one after another: so many until there are MOST_TASKS tasks, and beyond that as many as it takes.
SHARDS_A_TASK = 4
MOST_TASKS = 100_000
K1, B = 1.2, 0.75
#: Min-hashes of a rest, the first of which count most in the order.
HASHES = 4
#: Spans whose ids a worker keeps before it starts anew.
KEPT_SPANS = 100_000
#: Text bytes encoded at a time.
TEXT_BYTES = 2 << 20


class Encoder(Paths):
    """Ids of spans without ASCII blanks, as little-endian bytes; no token of the tokenizer reaches over a blank.

    New spans are encoded many at a time by the compiled tables; those with characters from U+0250 on by the library itself.
    """

    def __init__(self, path: str):
        super().__init__(KEPT_SPANS)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.bpe = Bpe(path)
        self.words = Words(self.bpe)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def learn(self, spans: list[bytes]) -> None:
        missing = self.missing(spans)
        if not missing:
            return
        words = b"\n".join(missing).decode().split("\n")
        known = [w if w.isascii() or max(w) < "\u0250" else "" for w in words]
        flat, counts = self.bpe.spans(known)
        raw, ends = flat.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
        self.update(zip(missing, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        for i, w in enumerate(known):
            if not w:
                self[missing[i]] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        easy = [i for i, t in enumerate(texts) if plain(t)]
        rest = sorted({*range(len(texts))}.difference(easy))
        out: list[bytes] = [b""] * len(texts)
        flat, counts = self.words.encode([texts[i] for i in easy])
        raw, ends = flat.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
        for i, a, b in zip(easy, [0, *ends], ends, strict=False):
            out[i] = raw[a:b]
        for i, own in zip(rest, self.of([spans_of(texts[i]) for i in rest]), strict=True):
            out[i] = b"".join(own)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class InvertedIndex:
    """BM25 over the token ids of a shard's documents; idf by token id and mean length are those of all shards, or without them the shard's own."""

    def __init__(self, docs: list[np.ndarray], all_idf: np.ndarray | None = None, mean: float | None = None):
        n = len(docs)
        length = np.array([len(d) for d in docs], np.int64)
        code, tf = np.unique(np.repeat(np.arange(n), length) << 32 | np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64), return_counts=True)
        doc, term = code >> 32, code & 0xFFFFFFFF
        terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if all_idf is None else all_idf[terms]
        if mean is None:
            mean = length.mean() if n else 1
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(1, mean)))
        order = np.argsort(term, kind="stable")
        self.n, self.idf, self.df = n, idf, df
        self.postings, self.weights = doc[order].astype(np.int32), weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.own, self.own_at = term, np.searchsorted(doc, np.arange(n + 1))
        # The same by document, of those that are still asked for.
        self.docs, self.rows, self.terms, self.row_weights = np.arange(n), self.own_at[:-1], term, weight

    def drop(self, unused: np.ndarray) -> None:
        """Leaves out used documents from what scores() reads, once they are half of it."""
        kept = unused[self.docs]
        if len(kept) < 2 * np.count_nonzero(kept):
            return
        sizes = np.diff(np.append(self.rows, len(self.terms)))
        held = np.repeat(kept, sizes)
        self.docs, self.terms, self.row_weights = self.docs[kept], self.terms[held], self.row_weights[held]
        self.rows = np.concatenate([[0], np.cumsum(sizes[kept])[:-1]]).astype(np.int64) if len(self.docs) else np.zeros(0, np.int64)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document, but for dropped ones, for all of the seed's terms that others have too."""
        own = self.own[self.own_at[seed] : self.own_at[seed + 1]]
        own = own[self.df[own] > 1]
        out = np.zeros(self.n)
        if not len(own) or not len(self.docs):
            return out
        # Few postings are gathered by term; for many, one pass over what the documents hold is cheaper.
        if 4 * self.df[own].sum() < len(self.terms):
            lists = [slice(self.at[t], self.at[t + 1]) for t in own]
            return np.bincount(np.concatenate([self.postings[s] for s in lists]), np.concatenate([self.weights[s] for s in lists]), self.n)
        asked = np.zeros(len(self.df))
        asked[own] = 1
        out[self.docs] = np.add.reduceat(asked[self.terms] * self.row_weights, self.rows)
        return out


class Corpus:
    """What all rests have in common: idf by token id, mean length, and the order of tokens for each min-hash."""

    def __init__(self, df: np.ndarray, n: int, total: int):
        self.total = total
        self.idf, self.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(1, n)
        # The first of a text's tokens in a random order, in which a token's chance to be early grows with its idf. Tokens that no two rests share come last.
        draws = [np.where(df > 1, np.random.default_rng(k).exponential(size=len(df)) / np.maximum(self.idf, 1e-9), np.inf) for k in range(HASHES)]
        self.ranks = [np.where(df > 1, d.argsort(kind="stable").argsort(kind="stable"), len(df)).astype(np.uint32) for d in draws]

    def key(self, ids: np.ndarray, row: int) -> bytes:
        """Min-hashes as bytes in their order, and a mix of the row's number, by which a large group of copies can be cut."""
        mixed = (row * 0x9E3779B97F4A7C15) & (1 << 64) - 1
        return np.array([r[ids].min() for r in self.ranks], ">u4").tobytes() + mixed.to_bytes(8, "big")


def _corpus(chunks: DataFrame, kind: np.dtype, window: int) -> Corpus:
    """Document frequencies of all tokens over all rests; one row per token is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = total = 0
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                ids = np.frombuffer(chunk, kind)
                if len(ids) == window:
                    continue
                if (size := int(ids.max()) + 1) > len(df):
                    df, at = (np.concatenate([x, np.zeros(size - len(df), np.int64)]) for x in (df, at))
                places = np.arange(len(ids))
                at[ids] = places
                df[ids[at[ids] == places]] += 1
                n, total = n + 1, total + len(ids)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *own.tolist()], pa.int64()), pa.array([total, n, *df[own].tolist()], pa.int64())], names=["token", "n"])

    found = chunks.select("chunk").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(found.column("token").to_pylist(), found.column("n").to_pylist(), strict=True))
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1, np.int64)
    df[list(counts)] = list(counts.values())
    return Corpus(df, n, total)


def fill(docs: list[np.ndarray], window: int = WINDOW, all_idf: np.ndarray | None = None, mean: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every id is in exactly one piece."""
    index = InvertedIndex(docs, all_idf, mean)
    left = np.array([len(d) for d in docs], np.int64)
    unused = left > 0
    start = np.zeros(len(docs), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    following = iter(range(len(docs)))
    seed = None

    def take(d: int, most: int, into: list[tuple[int, int, int]]) -> int:
        n = int(min(left[d], most))
        into.append((d, int(start[d]), n))
        start[d] += n
        left[d] -= n
        unused[d] = False
        return n

    while True:
        if seed is None:
            seed = next((d for d in following if unused[d]), None)
            if seed is None:
                break
        row: list[tuple[int, int, int]] = []
        room = window - take(seed, window, row)
        cut = seed if left[seed] else None
        if room:
            index.drop(unused)
            score = np.where(unused, index.scores(seed), 0)
            near = np.flatnonzero(score)
            near = near[np.argsort(-score[near], kind="stable")]
            over = None
            for d in near.tolist():
                if left[d] <= room:
                    room -= take(d, room, row)
                    if not room:
                        break
                elif over is None:
                    over = d
            # What still has room takes the closest document that is too long, else whatever comes next.
            while room and (over := over if over is not None else next((d for d in following if unused[d]), None)) is not None:
                room -= take(over, room, row)
                cut = over if left[over] else cut
                over = None
        out.append(row)
        seed = cut
    return out


def _halved(row: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A sequence that isn't full, cut into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in row)
    if total == window:
        return [row]
    out: list[list[tuple[int, int, int]]] = []
    rest = list(row)
    while rest:
        room = 1 << (sum(n for _, _, n in rest).bit_length() - 1)
        own: list[tuple[int, int, int]] = []
        while room:
            d, s, n = rest.pop(0)
            m = min(n, room)
            own.append((d, s, m))
            room -= m
            if m < n:
                rest.insert(0, (d, s + m, n - m))
        out.append(own)
    return out


#: Bits of a sequence_id for its number in the shard, and for the shard's number in the task; the task's is above them. Whole windows have the highest bit, and their row's number.
SEQUENCE_BITS, SHARD_BITS = 20, 16
WHOLE = 1 << 62

_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit integers.

    A document's ids are those of its text without special tokens, then end_id; null text is empty, so every row gives at least one id. start counts the document's ids before the piece. Sequences have window ids, but for those at a shard's end, whose lengths are powers of two. Rows that repeat are packed each by itself; texts of any length are packed whole; ties in the order go by a mix of the row's number; other columns, of whatever names, are left out; an empty table gives an empty one. `tokenizer` is the path of the file on every machine.

    Chunks of at most a window are written to the checkpoint folder, as they are read for the document frequencies and then for the packing. Whole windows are sequences where they are, without a shuffle. Rests are sorted over all tasks by their min-hashes, which a mix of the row's number ends, so that no key gathers them; each task then cuts its sorted rows into shards of shard_tokens, one after another. The driver holds no bounds and no rows, only one count per token.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        width = code.kind.itemsize
        end = np.array([end_id], code.kind).tobytes()
        for batch in batches:
            for part, texts in slices(batch, 1, TEXT_BYTES):
                row, starts, chunks, totals = [], [], [], []
                for i, own in enumerate(code.encode(texts)):
                    ids = own + end
                    for s in range(0, len(ids), window * width):
                        row.append(i)
                        starts.append(s // width)
                        chunks.append(ids[s : s + window * width])
                        totals.append(len(ids) // width)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(chunks, pa.binary())], names=["id", "start", "doc_tokens", "chunk"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = encoder(tokenizer).kind
        for batch in batches:
            n = batch.num_rows
            ids = [np.frombuffer(c, kind_of).astype("<u4").tobytes() for c in batch.column(3).to_pylist()]
            number = np.array(batch.column(4).to_pylist(), np.int64) | WHOLE
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(n, window)), pa.array(ids, pa.binary()), batch.column(2), pa.array(number), pa.array(np.zeros(n, np.int64))], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = encoder(tokenizer).kind
        for batch in batches:
            keys = [common.value.key(np.frombuffer(c, kind_of), r) for c, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keys, pa.binary())], names=["id", "start", "doc_tokens", "chunk", "key"])

    def shard(t: pa.Table, number: int) -> pa.RecordBatch:
        """The pieces of a shard's rests."""
        kind_of, corpus = encoder(tokenizer).kind, common.value
        starts, totals = t.column("start").to_pylist(), t.column("doc_tokens").to_pylist()
        ids = [np.frombuffer(c, kind_of) for c in t.column("chunk").to_pylist()]
        packed = fill(ids, window, corpus.idf, corpus.mean)
        rows = packed[:-1] + (_halved(packed[-1], window) if packed else [])
        pieces = [(k, s, n, (number << SEQUENCE_BITS) + q, o) for q, row in enumerate(rows) for (k, s, n), o in zip(row, np.cumsum([0, *(n for _, _, n in row)]).tolist(), strict=False)]
        at = [k for k, *_ in pieces]
        columns = [
            t.column("id").take(pa.array(at, pa.int64())).combine_chunks(),
            pa.array([starts[k] + s for k, s, *_ in pieces], pa.int64()),
            pa.array([n for _, _, n, _, _ in pieces], pa.int64()),
            pa.array([ids[k][s : s + n].astype("<u4").tobytes() for k, s, n, _, _ in pieces], pa.binary()),
            pa.array([totals[k] for k in at], pa.int64()),
            pa.array([q for *_, q, _ in pieces], pa.int64()),
            pa.array([o for *_, o in pieces], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).kind.itemsize
        number = TaskContext.get().partitionId() << SHARD_BITS
        held: list[pa.RecordBatch] = []
        tokens = 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)) // width
            start = 0
            while start < batch.num_rows:
                before = int(sizes[start - 1]) if start else 0
                end = int(np.searchsorted(sizes, before + shard_tokens - tokens)) + 1
                part = batch.slice(start, end - start)
                held.append(part)
                tokens += int(sizes[min(end, batch.num_rows) - 1]) - before
                start = end
                if tokens >= shard_tokens:
                    yield shard(pa.Table.from_batches(held), number)
                    held, tokens, number = [], 0, number + 1
        if held:
            yield shard(pa.Table.from_batches(held), number)

    # The number tells rows apart in the checkpoint, whose order doesn't change; keys mix it.
    chunks = checkpointed(rows.mapInArrow(tokenize, f"id {kind}, start long, doc_tokens long, chunk binary")).select("*", F.monotonically_increasing_id().alias("row"))
    kind_of = encoder(tokenizer).kind
    corpus = _corpus(chunks, kind_of, window)
    common = docs.sparkSession.sparkContext.broadcast(corpus)
    full = F.octet_length("chunk") == window * kind_of.itemsize
    schema = f"id {kind}, {_PIECES}"
    shards = max(1, -(-corpus.total // shard_tokens))
    tasks = min(MOST_TASKS, max(-(-shards // SHARDS_A_TASK), min(shards, docs.sparkSession.sparkContext.defaultParallelism)))
    rests = chunks.where(~full).mapInArrow(keyed, f"id {kind}, start long, doc_tokens long, chunk binary, key binary")
    dealt = rests.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(place, schema)
    return chunks.where(full).mapInArrow(whole, schema).unionByName(dealt)


def op6_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, tokenizer).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
