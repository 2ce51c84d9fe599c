"""A word-end BPE tokenizer file, compiled into tables that numpy applies to many spans at once.

The file's pipeline is: NFC, blank runs, lower case; a split pattern of contractions, letter runs, single numbers and runs of the rest; byte-level BPE whose last symbol of a pretoken is marked as word end. A span is a run without ASCII blanks; no token reaches over one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import regex

# Character classes of the split machine. The apostrophe may begin a contraction.
BLANK, NUMBER, OTHER, QUOTE, LETTER = range(5)
#: Contractions that the split pattern takes before anything else.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NONE = np.int64(1) << 40
#: Bytes above which a pretoken is merged with a heap instead of in rounds.
LONG = 256


def class_of(c: str) -> int:
    """Class of one character; letters, numbers and blanks are the Unicode properties L, N and White_Space."""
    if c == "'":
        return QUOTE
    if regex.match(r"\p{L}", c):
        return LETTER
    if regex.match(r"\p{N}", c):
        return NUMBER
    return BLANK if regex.match(r"\p{White_Space}", c) else OTHER


def normalize(text: str) -> str:
    """NFC, then lower case of each character by itself (a final sigma is not told apart)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split(span: str) -> list[str]:
    """The pretokens of a normalised span, by the split machine one character at a time.

    States: start; in letters; in others; and one for each proper prefix of a contraction. From the last ones, a character that doesn't go on to a contraction gives the apostrophe back as an other character, and the letters after it as letters.
    """
    out: list[str] = []
    state, open_ = "start", ""

    def close() -> None:
        nonlocal open_
        if open_:
            out.append(open_)
        open_ = ""

    for c in span:
        if state == "quote":
            longer = open_ + c
            if longer in CONTRACTIONS:
                out.append(longer)
                state, open_ = "start", ""
                continue
            if any(x.startswith(longer) for x in CONTRACTIONS):
                open_ = longer
                continue
            if len(open_) > 1:
                out.append("'")
                state, open_ = "letters", open_[1:]
            else:
                state = "others"
        kind = class_of(c)
        if kind == LETTER:
            if state != "letters":
                close()
            state, open_ = "letters", open_ + c
        elif kind == OTHER or (kind == QUOTE and state == "others"):
            if state != "others":
                close()
            state, open_ = "others", open_ + c
        else:
            close()
            state = "start"
            if kind == NUMBER:
                out.append(c)
            elif kind == QUOTE:
                state, open_ = "quote", c
    if state == "quote" and len(open_) > 1:
        out += ["'", open_[1:]]
    else:
        close()
    return out


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printing else next(spare)) for b in range(256)]


#: A full stop or comma between an ASCII letter and a blank is a pretoken, and a span, of its own.
_ENDS = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \n])")


def spans_of(text: bytes) -> list[bytes]:
    """The spans of a text, as few different ones as the tokenizer allows: without case where it makes no difference, and with plain ends of clauses apart.

    Case of ASCII letters tells only in special strings, and before combining marks (U+0300 to U+036F, lead bytes CC and CD), with which they may compose.
    """
    if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
        text = text.lower()
    return _ENDS.sub(rb" \1", text).split()


class Paths(dict):
    """What is known of spans, in two generations of at most `most` spans each: a span that isn't used while the younger one fills is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older, self.brief = most, {}, []

    def missing(self, spans: list[bytes]) -> list[bytes]:
        """Of spans that aren't in the younger generation, those that aren't known at all, each once. Those that the older generation has come back."""
        for span in self.brief:
            self.pop(span, None)
        wanted = set(spans)
        known = wanted.intersection(self.older)
        self.update(zip(known, map(self.older.__getitem__, known), strict=True))
        wanted -= known
        # Long spans are kept for the texts at hand only.
        self.brief = [s for s in wanted if len(s) > 64]
        return list(wanted)

    def learn(self, spans: list[bytes]) -> None:
        """Adds what is not known of these spans."""
        raise NotImplementedError

    def of(self, texts: list[list[bytes]]) -> list[list]:
        """What is known of each text's spans, after learning what isn't."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        get = self.get
        found = [list(map(get, spans)) for spans in texts]
        holes = [[i for i, x in enumerate(f) if x is None] if None in f else () for f in found]
        self.learn([spans[i] for spans, at in zip(texts, holes, strict=True) for i in at])
        for spans, f, at in zip(texts, found, holes, strict=True):
            for i in at:
                f[i] = self[spans[i]]
        return found


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: only BPE with word ends can be compiled")
        vocabulary = model["vocab"]
        symbols = _byte_symbols()
        self.first = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + "</w>"] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if not t["normalized"]}
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # Open addressing: pair -> rank.
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        self.probes = 1
        for (a, b), (rank, _) in self.merges.items():
            key = a << 32 | b
            at, n = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[at], self.ranks[at], self.probes = key, rank, max(self.probes, n)
        self.classes: np.ndarray | None = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        rest = np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            out[rest[hit]] = self.ranks[at[hit]]
            go = ~hit & (held >= 0)
            if not go.any():
                break
            rest, key, at = rest[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _class_table(self) -> np.ndarray:
        if self.classes is None:
            points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
            self.classes = np.full(0x110000, OTHER, np.uint8)
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+"), (QUOTE, "'")):
                for found in regex.finditer(pattern, points):
                    self.classes[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
        return self.classes

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pretokens after their merges. In a round each pretoken applies its merge of least rank wherever it occurs, the leftmost first."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_words = [], []
        long_ = lengths > LONG
        if long_.any():
            ends = np.cumsum(lengths)
            for w in np.flatnonzero(long_):
                merged = self._heap(ids[ends[w] - lengths[w] : ends[w]].tolist())
                done_ids.append(np.array(merged, np.int64))
                done_words.append(np.full(len(merged), w))
            keep = ~long_[word]
            ids, word = ids[keep], word[keep]
        rank = np.full(len(ids), NONE, np.int64)
        if len(ids) > 1:
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self._rank(ids[near], ids[near + 1])
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(head, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, head), size)
            rest = best < NONE
            if not rest.all():
                done_ids.append(ids[~rest])
                done_words.append(word[~rest])
                ids, word, rank, best = ids[rest], word[rest], rank[rest], best[rest]
                if not len(ids):
                    break
            hit = rank == best
            # Of pairs that overlap, as in a run of one symbol, every other one from the left.
            twice = hit[1:] & hit[:-1]
            if twice.any():
                at = np.arange(len(hit))
                since = at - np.maximum.accumulate(np.where(hit, -1, at))
                hit &= since % 2 == 1
            left = np.flatnonzero(hit)
            ids[left] = self.joined[rank[left]]
            stay = np.ones(len(ids), bool)
            stay[left + 1] = False
            place = np.cumsum(stay) - 1
            ids, word, rank = ids[stay], word[stay], rank[stay]
            new = place[left]
            again = np.concatenate([new, new[new > 0] - 1])
            rank[again] = NONE
            again = again[again < len(ids) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._rank(ids[again], ids[again + 1])
        flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        return flat[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lengths))

    def _heap(self, ids: list[int]) -> list[int]:
        """The merges of one long pretoken with a heap and linked neighbours; time grows as n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := self.merges.get((ids[k], ids[after[k]]))):
                    heappush(heap, (m[0], k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all spans one after another, and how many each has. Spans have no ASCII blanks.

        Spans with an apostrophe or a special string are split one by one; all others in one pass of the split machine, which without apostrophes cuts where the class changes and around numbers.
        """
        pieces: list[str] = []
        owner: list[int] = []
        fixed: dict[int, list[list[int] | str]] = {}
        for i, s in enumerate(spans):
            if "<|" in s and any(x in s for x in self.special):
                fixed[i] = self._specials(s)
            elif "'" not in s:
                pieces.append(s)
                owner.append(i)
            else:
                own = split(normalize(s))
                pieces += own
                owner += [i] * len(own)
        for i, parts in fixed.items():
            for k, part in enumerate(parts):
                if isinstance(part, str):
                    own = split(normalize(part))
                    parts[k] = self._plain(own)[0].tolist()
        flat, counts = self._plain(pieces)
        per = np.bincount(np.array(owner, np.int64), counts, len(spans)).astype(np.int64)
        if not fixed:
            order = np.argsort(np.repeat(np.array(owner, np.int64), counts), kind="stable") if "'" in "".join(spans) else slice(None)
            return flat[order], per
        places = np.repeat(np.array(owner, np.int64), counts)
        extra = [(i, x) for i, parts in fixed.items() for part in parts for x in part]
        every = np.concatenate([flat, np.array([x for _, x in extra], np.int64)])
        places = np.concatenate([places, np.array([i for i, _ in extra], np.int64)])
        return every[np.argsort(places, kind="stable")], np.bincount(places, minlength=len(spans))

    def _specials(self, text: str) -> list[list[int] | str]:
        """A span cut at its special strings, the leftmost first; these are ids already."""
        out: list[list[int] | str] = []
        while found := min(((text.find(s), -len(s), s) for s in self.special if s in text), default=None):
            out += [text[: found[0]], [self.special[found[2]]]]
            text = text[found[0] + len(found[2]) :]
        return [*out, text]

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces that the split machine cuts by class alone; an apostrophe counts as one more other character."""
        text = "\n".join(pieces)
        if not text:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        if not text.isascii():
            text = normalize(text)
            raw = np.frombuffer(text.encode(), np.uint8)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            kind = self._class_table()[points]
        else:
            raw = np.frombuffer(text.lower().encode(), np.uint8)
            points, width = raw, np.ones(len(raw), np.int64)
            kind = self._class_table()[raw]
        kind = np.where(kind == QUOTE, OTHER, kind)
        # A contraction has come from split() as a piece of its own, apostrophe and letters; it isn't cut.
        line = np.cumsum(points == 10)
        quoted = np.zeros(len(pieces), bool)
        quoted[[i for i, p in enumerate(pieces) if p in CONTRACTIONS]] = True
        kind = np.where(quoted[line] & (points != 10), LETTER, kind)
        begin = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)])
        token = np.cumsum(begin) - 1
        keep = kind != BLANK
        of_byte = np.repeat(token, width)
        full = np.repeat(keep, width)
        of_byte, raw = of_byte[full], raw[full]
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        last = np.concatenate([of_byte[1:] != of_byte[:-1], [True]])
        ids = np.where(last, self.final[raw], self.first[raw])
        lengths = np.diff(np.append(-1, np.flatnonzero(last)))
        flat, n = self.merge(ids, lengths)
        heads = np.flatnonzero(begin & keep)
        counts = np.bincount(line[heads], n, len(pieces)).astype(np.int64)
        return flat, counts


#: Bytes of texts that Words can read: ASCII without the apostrophe, and the two bytes of U+00C0 to U+00FF.
_PLAIN = bytes(b for b in range(0x80) if b != 0x27) + bytes(range(0x80, 0xC0)) + b"\xc3"
#: Lower case of these bytes: A-Z, and second bytes of U+00C0 to U+00DE but for the multiplication sign.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or (0x80 <= b <= 0x9E and b != 0x97) else b for b in range(256))
_KIND = np.array([BLANK if b in b" \t\n\x0b\x0c\r" else NUMBER if 0x30 <= b <= 0x39 else LETTER if 0x61 <= b <= 0x7A or b >= 0x80 else OTHER for b in range(256)], np.uint8)


def plain(text: bytes) -> bool:
    """Whether Words can read a text: its characters have one-byte classes and cases, and it has no contractions or special strings."""
    return not (text.translate(None, _PLAIN) or b"<|" in text or (not text.isascii() and (b"\xc3\x97" in text or b"\xc3\xb7" in text)))


class Words:
    """Ids of the pretokens of plain texts, by arrays alone.

    The split machine runs over all bytes of many texts at once. A pretoken of at most 23 bytes is, with its length, its own key, as three integers, in an open table; what the table doesn't have is merged in bulk and added. Longer pretokens are merged each time. A full table starts anew.
    """

    WIDE = 23
    BITS = 20

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._clear()
        bits = np.minimum(np.maximum(np.arange(self.WIDE + 1)[:, None] - 8 * np.arange(3), 0), 8) * 8
        self.mask = np.array([[(1 << int(b)) - 1 for b in row] for row in bits], np.uint64)

    def _clear(self) -> None:
        size = 1 << self.BITS
        self.entry = np.full(size, -1, np.int32)
        self.n = 0
        self.keys = np.empty((size // 2, 3), np.uint64)
        self.counts = np.empty(size // 2, np.int32)
        self.at = np.empty(size // 2, np.int64)
        self.pool = np.empty(1 << 20, np.uint32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= (keys[:, 1] + (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= (keys[:, 2] + (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        slot = self._slots(keys)
        got = self.entry[slot].astype(np.int64)
        rest = np.flatnonzero((got >= 0) & (self.keys[got] != keys).any(1))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.entry) - 1)
            now = self.entry[slot]
            got[rest] = now
            more = (now >= 0) & (self.keys[now] != keys[rest]).any(1)
            rest, slot = rest[more], slot[more]
        return got

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds different keys that aren't in the table."""
        m = len(keys)
        new = np.arange(self.n, self.n + m)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.keys[new], self.counts[new] = keys, counts
        self.at[new] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += m
        slot = self._slots(keys)
        while len(new):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = new[free]
            lost = self.entry[slot] != new
            new, slot = new[lost], (slot[lost] + 1) & (len(self.entry) - 1)

    def _merge(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pretokens at places of the bytes."""
        ends = np.cumsum(lengths)
        symbols = raw[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        ids = self.bpe.first[symbols]
        ids[ends - 1] = self.bpe.final[symbols[ends - 1]]
        return self.bpe.merge(ids, lengths)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after another, and how many each has."""
        whole = b"\n".join(texts).translate(_LOWER)
        raw = np.frombuffer(whole + bytes(32), np.uint8)
        kind = _KIND[raw[: len(whole)]]
        cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)])) if len(whole) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(cut, len(whole)))
        full = kind[cut] != BLANK
        starts, lengths = cut[full], lengths[full]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        per_text = np.searchsorted(starts, text_ends, "left")
        short = lengths <= self.WIDE
        every = bool(short.all())
        s, n = (starts, lengths) if every else (starts[short], lengths[short])
        windows = np.ndarray((len(whole) + 24,), "<u8", raw, strides=(1,))
        keys = np.empty((len(s), 3), np.uint64)
        mask = self.mask[n]
        for i in range(3):
            keys[:, i] = windows[s + 8 * i]
        keys &= mask
        keys[:, 2] |= n.astype(np.uint64) << np.uint64(56)
        got = self._find(keys)
        gone = np.flatnonzero(got < 0)
        if len(gone):
            order = gone[np.lexsort(keys[gone].T)]
            new = np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(1)])
            firsts = order[new]
            if self.n + len(firsts) > len(self.keys):
                crowded = self.n == 0
                self._clear()
                return self._parts(texts) if crowded else self.encode(texts)
            ids, counts = self._merge(raw, s[firsts], n[firsts])
            got[order] = self.n + np.cumsum(new) - 1
            self._add(keys[firsts], ids, counts)
        count, at = self.counts[got].astype(np.int64), self.at[got]
        pool = self.pool
        if not every:
            ids, more = self._merge(raw, starts[~short], lengths[~short])
            pool = np.concatenate([self.pool[: self.used], ids.astype(np.uint32)])
            c, a = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
            c[short], a[short] = count, at
            c[~short], a[~short] = more, self.used + np.cumsum(more) - more
            count, at = c, a
        total = np.concatenate([[0], np.cumsum(count)])
        flat = pool[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        return flat, np.diff(total[np.concatenate([[0], per_text])])

    def _parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts with more different pretokens than an empty table holds: halves of them, and a single text without the table."""
        if len(texts) > 1:
            a, b = self.encode(texts[: len(texts) // 2]), self.encode(texts[len(texts) // 2 :])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        ids, counts = self.bpe.spans([w.decode() for w in texts[0].split()])
        return ids.astype(np.uint32), np.array([counts.sum()])
