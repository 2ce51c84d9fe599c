"""Token counts by a compiled transducer, without running the tokenizer over texts.

A tokenizer file (normalizer NFC, blank runs, lower case; split pattern of contractions, letter runs, single digits and runs of the rest; BPE with word ends) is compiled into a cascade of deterministic machines that read bytes:
 - The first machine folds case and marks each byte: blank, first byte of a pretoken, or inside one. Spans (runs without ASCII blanks) of characters that need more than a byte's context, such as contractions, special strings and most scripts, are one symbol run each.
 - The second is a transition table (state, byte) -> state. Its states are the beginnings of pretokens; the transition that leaves a pretoken, into the next one or a blank, goes back to the start state and emits the number of tokens that the pretoken's merges leave, the annotation of the state that is left. Transitions are compiled when a text first needs them.
A text is cut into chunks of CHUNK bytes, and all chunks are read at once, byte by byte, each without knowledge of what comes before it. What a chunk does is a state map: from any state it first reads its head, the bytes up to its first cut; from there on the state is known, so the map holds the head, the count emitted behind it and the state at the end. Maps compose associatively, and a parallel prefix scan over all chunks, which starts anew at each text, gives the tokens up to each chunk's end; the last chunk's is the text's count.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _KIND, _LOWER, _PLAIN, BLANK, NUMBER, Bpe
from .common import slices

CHUNK = 256
#: Bytes of the longest pretoken, and of the longest run of one symbol, that the table has states for; longer ones are symbols of their own, which emit what their merges leave.
LONG = 256
#: States of the table; when it is full it starts anew. One piece of text can't fill an empty one.
STATES = 1 << 21
#: Bytes that are read at a time. A longer text is cut at blanks, where every machine is in its start state.
PIECE = 1 << 20
#: Bytes of a span that is read in one piece.
SPAN = 1 << 18
LIMIT = 2048

_ODD = 5
_ODD_BYTES = np.ones(256, bool)
_ODD_BYTES[list(_PLAIN)] = False
_FOLD = np.frombuffer(_LOWER, np.uint8)
_ASCII_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@cache
def settled(c: str) -> bool:
    """Whether a character's class and case can't differ between versions of Unicode: it is assigned since 3.2 and has its class from then."""
    then, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    return then != "Cn" and then[0] == now[0]


class Maps(NamedTuple):
    """State maps of chunks, as arrays: the head's place and length, the count behind it, the state at the end, whether there is a cut at all, and whether a text begins here."""

    head: np.ndarray
    size: np.ndarray
    count: np.ndarray
    state: np.ndarray
    synced: np.ndarray
    first: np.ndarray

    def at(self, i) -> Maps:
        return Maps(*(x[i] for x in self))


class Marks(NamedTuple):
    """What the first machine makes of bytes: symbols, cuts, and which bytes move the second machine; starts and lengths of pretokens, each byte's pretoken, and which pretokens are odd or too long."""

    symbol: np.ndarray
    cut: np.ndarray
    move: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    of: np.ndarray
    odd: np.ndarray
    long: np.ndarray


class Transducer:
    """The compiled machines of a tokenizer file. State 0 is between pretokens; state 1 is where an unknown path ends."""

    DEAD = 1

    def __init__(self, path: str, states: int = STATES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.bpe = Bpe(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.states, self.bits = states, max(4, (2 * states - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n = 2
        #: Tokens that are emitted when a pretoken ends in a state; -1 where none has ended yet.
        self.emits = np.full(self.states, -1, np.int64)
        self.emits[:2] = 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.empty(1 << self.bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that transitions lead to; DEAD where there is none."""
        key = state << 8 | symbol
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.next[at], self.DEAD).astype(np.int64)
        rest = np.flatnonzero((held != key) & (held >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == key[rest]
            out[rest[hit]] = self.next[at[hit]]
            more = ~hit & (held >= 0)
            rest, at = rest[more], at[more]
        return out

    def _put(self, key: np.ndarray, state: np.ndarray) -> None:
        """Adds transitions, of different keys that the table doesn't have."""
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            won = free & (self.keys[at] == key)
            self.next[at[won]] = state[won]
            key, state, at = key[~won], state[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def compile(self, words: list[bytes], counts: np.ndarray) -> None:
        """Adds the paths of different pretokens, all of them one byte further at a time, and what their last states emit."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        lengths = lengths[order]
        starts = np.cumsum(lengths) - lengths
        state = np.zeros(len(words), np.int64)
        for depth in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -depth, "left"))
            key = state[:live] << 8 | raw[starts[:live] + depth]
            to = self.go(state[:live], raw[starts[:live] + depth])
            new = np.flatnonzero(to == self.DEAD)
            if len(new):
                fresh, back = np.unique(key[new], return_inverse=True)
                ids = self.n + np.arange(len(fresh))
                self.n += len(fresh)
                self._put(fresh, ids.astype(np.int32))
                to[new] = ids[back]
            state[:live] = to
        self.emits[state] = np.asarray(counts, np.int64)[order]

    def tokens_of(self, spans: list[bytes]) -> list[int]:
        """Tokens of whole spans, from the merge tables; those with characters that versions of Unicode may class otherwise are the library's to tell."""
        texts = [s.decode() for s in spans]
        sure = [all(map(settled, set(t))) for t in texts]
        out = self.bpe.spans([t if ok else "" for t, ok in zip(texts, sure, strict=True)])[1].tolist()
        rest = [i for i, ok in enumerate(sure) if not ok]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        return out

    def mark(self, whole: bytes) -> Marks:
        """The first machine, over bytes that begin and end between spans."""
        raw = np.frombuffer(whole, np.uint8)
        kind = _KIND[_FOLD[raw]]
        blank = _KIND[raw] == BLANK
        odd = _ODD_BYTES[raw]
        after = raw[1:]
        sign = (raw[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7))
        special = (raw[:-1] == 0x3C) & (after == 0x7C)
        odd[:-1] |= sign | special
        symbol = _FOLD[raw]
        if odd.any():
            span = np.cumsum(blank, dtype=np.int32)
            in_odd = np.zeros(int(span[-1]) + 1, bool)
            in_odd[span[odd]] = True
            inside = in_odd[span] & ~blank
            cased = np.zeros(len(in_odd), bool)
            cased[span[:-1][special]] = True
            cased[span[(raw == 0xCC) | (raw == 0xCD)]] = True
            symbol = np.where(inside, np.where(cased[span], raw, _ASCII_FOLD[raw]), symbol)
            kind = np.where(inside, np.uint8(_ODD), kind)
        kind = np.where(blank, np.uint8(BLANK), kind)
        begin = np.empty(len(raw), bool)
        begin[:1] = True
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begin &= ~blank
        starts = np.flatnonzero(begin)
        of = np.cumsum(begin, dtype=np.int32) - 1
        lengths = np.bincount(of[~blank], minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
        long_ = lengths > LONG
        move = ~blank
        if long_.any():
            move &= ~long_[of]
        return Marks(symbol, begin | blank, move, starts, lengths, of, kind[starts] == _ODD, long_)

    def _words(self, m: Marks, which: np.ndarray) -> list[bytes]:
        return [m.symbol[s : s + n].tobytes() for s, n in zip(m.starts[which].tolist(), m.lengths[which].tolist(), strict=True)]

    def _tokens(self, m: Marks, which: np.ndarray) -> np.ndarray:
        """Tokens of pretokens by their merges."""
        out = np.zeros(len(which), np.int64)
        odd = m.odd[which]
        if odd.any():
            out[odd] = self.tokens_of(self._words(m, which[odd]))
        plain = which[~odd]
        if len(plain):
            lengths = m.lengths[plain]
            ends = np.cumsum(lengths)
            raw = m.symbol[np.repeat(m.starts[plain] - (ends - lengths), lengths) + np.arange(ends[-1])]
            ids = self.bpe.first[raw]
            ids[ends - 1] = self.bpe.final[raw[ends - 1]]
            out[~odd] = self.bpe.merge(ids, lengths)[1]
        return out

    def learn(self, m: Marks, which: np.ndarray) -> None:
        """Compiles the paths of these pretokens, repeats among them."""
        words = self._words(m, which)
        first = list({w: i for i, w in enumerate(words)}.values())
        # The same bytes are the same pretoken wherever they stand, for odd ones have bytes that others don't.
        self.compile([words[i] for i in first], self._tokens(m, which[first]))

    def follow(self, m: Marks, place: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states that bytes place..place+size lead to, from given states, without a cut between."""
        out = state.copy()
        live = np.flatnonzero(size > 0)
        k = 0
        while len(live):
            out[live] = self.go(out[live], m.symbol[place[live] + k])
            k += 1
            live = live[size[live] > k]
        return out

    def read(self, m: Marks, begins: np.ndarray, ends: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, state, places of pretokens without a path) of all chunks, read side by side from behind their heads."""
        width = int((ends - begins).max()) if len(begins) else 0
        lanes = len(begins)
        count, state, missed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), []
        at = begins + np.arange(width)[:, None]
        inside = (at < ends) & (at >= begins + head)
        at = np.where(inside, at, 0)
        symbol, cut, move = m.symbol[at], m.cut[at] & inside, m.move[at] & inside
        for k in range(width):
            left = self.emits[state]
            closed = cut[k]
            if left.min() < 0:
                unknown = np.flatnonzero(closed & (left < 0))
                missed.append(begins[unknown] + k - 1)
                left = np.maximum(left, 0)
            count += np.where(closed, left, 0)
            state[closed] = 0
            live = np.flatnonzero(move[k] & (state != self.DEAD))
            to = self.go(state[live], symbol[k][live])
            dead = to == self.DEAD
            if dead.any():
                missed.append(begins[live[dead]] + k)
            state[live] = to
        return count, state, np.concatenate(missed) if missed else np.zeros(0, np.int64)

    def compose(self, m: Marks, a: Maps, b: Maps) -> Maps:
        """The maps of neighbours, pair by pair; associative. A map that begins a text takes nothing from what is before it."""
        reached = self.follow(m, b.head, np.where(b.first | ~a.synced, 0, b.size), a.state)
        joined = a.synced & ~b.first
        open_ = ~a.synced & ~b.first
        return Maps(
            np.where(b.first, b.head, a.head),
            np.where(b.first, b.size, np.where(a.synced, a.size, a.size + b.size)),
            b.count * (b.synced | b.first) + np.where(joined, a.count + np.where(b.synced, self.emits[reached], 0), 0),
            np.where(joined & ~b.synced, reached, b.state),
            np.where(open_, b.synced, b.synced | a.synced),
            a.first | b.first,
        )

    def scan(self, m: Marks, maps: Maps) -> Maps:
        """Inclusive prefix scan: neighbours are composed in pairs, the half as many are scanned, and what stands between is filled in."""
        n = len(maps.head)
        if n < 2:
            return maps
        half = n // 2
        odd = self.scan(m, self.compose(m, maps.at(np.arange(half) * 2), maps.at(np.arange(half) * 2 + 1)))
        between = np.arange(2, n, 2)
        filled = self.compose(m, odd.at(between // 2 - 1), maps.at(between))
        out = Maps(*(np.empty(n, x.dtype) for x in maps))
        for x, whole, o, f in zip(out, maps, odd, filled, strict=True):
            x[0], x[1::2], x[2::2] = whole[0], o, f
        return out

    def maps(self, m: Marks, texts: np.ndarray, chunk: int = CHUNK) -> tuple[Maps, np.ndarray]:
        """(maps, text) of the chunks of texts, given as (begin, end) of each in the marked bytes; paths that are missing are compiled on the way."""
        sizes = texts[:, 1] - texts[:, 0]
        n = np.maximum(1, -(-sizes // chunk))
        text = np.repeat(np.arange(len(texts)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins = texts[text, 0] + step * chunk
        ends = np.minimum(begins + chunk, texts[text, 1])
        cuts = np.append(np.flatnonzero(m.cut), len(m.cut))
        head = np.minimum(cuts[np.searchsorted(cuts, begins)], ends) - begins
        count, state = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        # Pretokens that reach over a chunk's or a text's end are read in parts only; they are looked up whole.
        last = np.flatnonzero((ends > begins) & m.move[np.maximum(ends - 1, 0)])
        over = np.unique(m.of[ends[last] - 1])
        lost = over[self.emits[self.follow(m, m.starts[over], m.lengths[over], np.zeros(len(over), np.int64))] <= 0]
        if len(lost):
            self.learn(m, lost)
        again = np.arange(len(begins))
        while len(again):
            count[again], state[again], missed = self.read(m, begins[again], ends[again], head[again])
            if len(missed):
                self.learn(m, np.unique(m.of[missed]))
            again = np.unique(np.searchsorted(begins, missed, "right") - 1)
        if m.long.any():
            which = np.flatnonzero(m.long)
            # A long symbol emits where it ends.
            home = np.searchsorted(begins, m.starts[which] + m.lengths[which] - 1, "right") - 1
            np.add.at(count, home, self._tokens(m, which))
            # Bytes of a long symbol leave the start state as it is; a head made of them is no path.
            inner = (head > 0) & ~m.move[np.minimum(begins, len(m.move) - 1)]
            head = np.where(inner, 0, head)
            synced = (head < ends - begins) | inner | (step == 0)
        else:
            synced = (head < ends - begins) | (step == 0)
        return Maps(begins, head, count, state, synced, step == 0), text

    def _pieces(self, text: bytes) -> list[bytes]:
        """A text in pieces of about PIECE bytes, cut at blanks."""
        out, at = [], 0
        while len(text) - at > PIECE:
            end = max(text.rfind(b, at, at + PIECE) for b in (b" ", b"\n", b"\t"))
            if end <= at:
                end = min((x for b in (b" ", b"\n", b"\t") if (x := text.find(b, at + PIECE)) >= 0), default=len(text))
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def prefix_counts(self, text: bytes, chunk: int = CHUNK) -> list[int]:
        """Tokens of what is closed at the end of each chunk, and of the whole text last."""
        m = self.mark(text + b"\n")
        maps, _ = self.maps(m, np.array([[0, len(text)]]), chunk)
        done = self.scan(m, maps)
        return [*done.count.tolist(), int(done.count[-1] + self.emits[done.state[-1]])]

    def counts(self, texts: list[bytes], chunk: int = CHUNK) -> list[int]:
        """The tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, bytes]] = []
        total = 0
        for i, text in enumerate(texts):
            for piece in self._pieces(text) if len(text) > PIECE else [text]:
                if total + len(piece) > PIECE and held:
                    self._count(held, out, chunk)
                    held, total = [], 0
                held.append((i, piece))
                total += len(piece)
        self._count(held, out, chunk)
        return out.tolist()

    def _count(self, pieces: list[tuple[int, bytes]], out: np.ndarray, chunk: int) -> None:
        if not pieces:
            return
        whole = [p for _, p in pieces]
        owner = np.array([i for i, _ in pieces], np.int64)
        if len(whole) == 1 and max(map(len, whole[0].split()), default=0) > SPAN:
            # A span without end is merged as it is, a piece at a time.
            spans = whole[0].split()
            out[owner[0]] += sum(self.tokens_of([s])[0] for s in spans if len(s) > SPAN)
            whole = [b" ".join(s for s in spans if len(s) <= SPAN)]
        size = sum(len(w) + 1 for w in whole)
        if self.n + size > self.states:
            self.clear()
        if size > self.states - 2:
            raise ValueError("a piece of text has more bytes than the table has states")
        m = self.mark(b"\n".join(whole) + b"\n")
        ends = np.cumsum([len(w) + 1 for w in whole]) - 1
        begins = ends - np.array([len(w) for w in whole])
        maps, text = self.maps(m, np.stack([begins, ends], 1), chunk)
        done = self.scan(m, maps)
        last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        np.add.at(out, owner, done.count[last] + self.emits[done.state[last]])


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's machine for a tokenizer file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. `tokenizer` is the path of the file on every machine.

    Null text is empty: 0 bytes and 0 tokens. Texts of any length are read in chunks; rows that repeat are counted each; other columns, of whatever names, are left out; an empty table gives an empty one. There is no shuffle.
    """
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, 1, PIECE):
                n = np.array(machine.counts(texts), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def op3_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return count_tokens(docs, tokenizer).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
