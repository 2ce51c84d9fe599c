"""URL filters: rules by host and path, then naive Bayes over the words that hosts and paths are made of.

Host labels are often several words written as one. A unigram model of words, counted over all URLs, splits them by a Viterbi search for the likeliest words; a label's own count is left out when it is split, so that a name does not become a word by standing in many URLs. Multinomial naive Bayes over these words and the path's then tells blocked hosts from others.

It is trained on all URLs by distant labels: a URL that a rule decides is as the rule says, one whose host has a seed word is blocked, all others count as allowed. What gives a label is no evidence: a rule's own words and the seeds are left out of the URLs that they label, and a host is judged by counts over the other folds' hosts only, so that neither list is learnt back. What is learnt is the company that words keep. A seed word itself adds fixed odds, which the company of other words can outweigh.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checkpointed

# The rules of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# Words of hosts that mark advertising, gambling, adult and spam sites.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "gambling", "lottery", "pills", "poker", "porn", "replica", "sex", "spam", "viagra", "xxx")
#: Seeds and their usual company count so often, besides what the URLs hold.
SEED_COUNT = 50
#: Counts that a worker gathers before it hands them on.
KEPT_COUNTS = 50_000
#: Buckets that the classifier's tokens are counted in, all of them, by a hash of the whole token.
BUCKETS = 1 << 18
KEPT_HOSTS = 100_000
#: Hosts are dealt to so many folds by a hash; one is judged by the counts of the others.
FOLDS = 8
#: What a seed word in a host adds to the log odds.
SEED_ODDS = 4.0
#: What any other word adds or takes at most: the URLs of one host repeat its words, so that plain counts make a word of one large host look surer than it is.
MOST_ODDS = 2.0
#: Characters of all distinct host labels up to which their counts are broadcast; more are joined.
LABEL_CHARS = 16 << 20
#: Bits of the filter that substrings pass before they are joined; its size is fixed.
FILTER_BITS = 1 << 24

_SPLIT = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")
_DIGITS = re.compile(r"[0-9]+")


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty for null and without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(str.maketrans(UPPER, UPPER.lower())), path[:stop]


class Rules:
    """Rules by host; a rule fits its host and what ends in a dot and its host, and paths that start with its path."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, rule))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of two of one length, the first by name."""
        best = None
        while host:
            for start, verdict, rule in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Segmenter:
    """Viterbi over a unigram model; an unknown word costs more the longer it is.

    `own` has what labels count as whole labels. That part of a label's count is left out when the label itself is split, and when it comes up as a part of another label, which is then split further: a joined name never vouches for itself, however often it stands in URLs. A label that was counted is either whole or all known words, so that frequent words don't cut it up.
    """

    def __init__(self, counts: dict[str, int], own: dict[str, int] | None = None, total: int | None = None):
        own = own or {}
        self.total = sum(counts.values()) or 1 if total is None else total
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.rest = {w: counts[w] - n for w, n in own.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def cost(self, word: str) -> float:
        known = self.log.get(word)
        return known if known is not None else math.log(1 / self.total) - 1 - 2.3 * len(word)

    def alone(self, label: str) -> float:
        """The cost of a whole label, without its own count."""
        rest = self.rest.get(label)
        if rest is None:
            return self.cost(label)
        return math.log(rest / self.total) if rest else math.log(1 / self.total) - 1 - 2.3 * len(label)

    def split(self, label: str) -> list[str]:
        """The likeliest words that make up the label; of equal ones, the split with the longest last word. Words that are labels themselves are split in turn."""
        counted = label in self.rest
        part = (lambda w: self.log.get(w, -math.inf)) if counted else self.cost
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(label) + 1):
            starts = [end - n for n in self.lengths if n <= end and n < len(label)] if counted else range(1 if end == len(label) else 0, end)
            ways = [(best[start][0] + part(label[start:end]), -start) for start in starts]
            if end == len(label):
                ways.append((self.alone(label), 0))
            score, start = max(ways, default=(-math.inf, 0))
            best.append((score, -start))
        words, end = [], len(label)
        while end:
            words.append(label[best[end][1] : end])
            end = best[end][1]
        words.reverse()
        return words if len(words) < 2 else [x for w in words for x in (self.split(w) if w in self.rest else [w])]


def host_words(segmenter: Segmenter, host: str) -> list[str]:
    return [w for label in _SPLIT.split(host) if label for w in segmenter.split(label)]


def path_words(path: str) -> list[str]:
    """The path's words, with digits alike."""
    return ["/" + _DIGITS.sub("0", w) for w in _SPLIT.split(path.lower()) if w]


class Bayes:
    """Multinomial naive Bayes with add-one counts and no word beyond MOST_ODDS: by fold, the counts of every bucket over the other folds' hosts.

    counts has (fold, bucket) -> (allowed, blocked), rows and left_out fold -> (allowed, blocked); the prior is that of all rows. Words that were left out count in a class's total only, so that the others don't weigh more for it. A bucket without counts in the other folds tells nothing.
    """

    def __init__(self, counts: dict[tuple[int, int], tuple[int, int]], rows: dict[int, tuple[int, int]], left_out: dict[int, tuple[int, int]] | None = None, folds: int = FOLDS, buckets: int = BUCKETS):
        table = np.zeros((folds, buckets, 2))
        if counts:
            at = np.array(list(counts), np.int64)
            table[at[:, 0], at[:, 1]] = np.array(list(counts.values()), float)
        self.buckets, self.folds, self.weight = buckets, folds, []
        allowed, blocked = (sum(r[i] for r in rows.values()) for i in (0, 1))
        self.prior = math.log((blocked + 1) / (allowed + 1))
        for k in range(folds):
            other = table.sum(0) - table[k]
            seen = other.any(1)
            size = int(seen.sum()) + 1
            rest = [sum(n[i] for f, n in (left_out or {}).items() if f != k) for i in (0, 1)]
            clean, bad = other.sum(0) + rest + size
            self.weight.append(np.where(seen, np.clip(np.log((other[:, 1] + 1) / bad) - np.log((other[:, 0] + 1) / clean), -MOST_ODDS, MOST_ODDS), 0.0).astype(np.float32))

    def log_odds(self, host: str, words: list[str]) -> float:
        """Of a host with these words of host and path; seeds count by SEED_ODDS, each once."""
        k = fold(host, self.folds)
        seeds = set(words).intersection(SEEDS)
        return self.prior + SEED_ODDS * len(seeds) + float(sum(self.weight[k][token(w, self.buckets)] for w in words if w not in seeds))


def token(word: str, buckets: int = BUCKETS) -> int:
    """The bucket that a word is counted in."""
    return zlib.crc32(word.encode()) % buckets


def fold(host: str, folds: int = FOLDS) -> int:
    return zlib.crc32(b"fold " + host.encode()) % folds


def evidence(rules: Rules, host: str, path: str, words: list[str]) -> tuple[int, list[str], int]:
    """(label, words that count, how many don't) of a URL whose host has these words: 1 for blocked. Words that gave the label are left out."""
    own = words + path_words(path)
    found = rules.match(host, path)
    seeds = set(words).intersection(SEEDS)
    if found:
        name, _, start = found[0].partition("/")
        seeds.update(_SPLIT.split(name), path_words(start))
        label = found[1] == "block"
    else:
        label = bool(seeds)
    counted = [w for w in own if w not in seeds]
    return int(label), counted, len(own) - len(counted)


def _table(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for _, x, k in columns], names=[n for n, *_ in columns])


def unigrams(pages: DataFrame, url: str = "url") -> DataFrame:
    """(w, n): the words that stand apart in hosts and their counts, over all rows; written to the checkpoint folder. Repeated words are summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        out = lambda: _table([("w", list(counts), pa.string()), ("n", list(counts.values()), pa.int64())])
        for batch in batches:
            for u in batch.column(0).to_pylist():
                for w in _SPLIT.split(parts(u)[0]):
                    if w:
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > KEPT_COUNTS:
                yield out()
                counts = {}
        yield out()

    return checkpointed(pages.select(F.col(url).alias("url")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))


def with_seeds(own: dict[str, int], seeds=SEEDS) -> dict[str, int]:
    return own | {s: own.get(s, 0) + SEED_COUNT for s in seeds}


def _collected(labels: DataFrame) -> Segmenter:
    found = labels.toArrow()
    own = dict(zip(found.column("w").to_pylist(), found.column("n").to_pylist(), strict=True))
    return Segmenter(with_seeds(own), own)


def segmented(labels: DataFrame, total: int, bits: int = FILTER_BITS) -> DataFrame:
    """(w, words): the split of each label by the counts of all labels, without gathering these anywhere.

    The substrings of a label that may be labels themselves, by their length and a filter of fixed size over hashed labels, are joined with the counts; a label then has all counts that its Viterbi search can ask for, and is split by itself. `total` is the sum of all counts, seeds' included.
    """
    seeded = labels.unionByName(labels.sparkSession.createDataFrame([(s, 0) for s in SEEDS], "w string, n long")).groupBy("w").agg(F.sum("n").alias("own"))
    seeded = checkpointed(seeded.select("w", "own", (F.col("own") + F.when(F.col("w").isin(*SEEDS), SEED_COUNT).otherwise(0)).alias("n")))
    lengths = sorted(r.k for r in seeded.select(F.char_length("w").alias("k")).distinct().collect())
    slot = F.pmod(F.xxhash64("w"), F.lit(bits))
    pages = seeded.select((slot / 8192).cast("int").alias("page"), F.pmod(slot, F.lit(8192)).cast("int").alias("bit")).distinct().groupBy("page").agg(F.collect_list("bit").alias("bits"))
    held_bits = np.zeros(bits, bool)
    for r in pages.toLocalIterator():
        held_bits[r.page * 8192 + np.array(r.bits, np.int64)] = True
    held = labels.sparkSession.sparkContext.broadcast((np.packbits(held_bits), lengths))

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, sizes = held.value
        for batch in batches:
            for w in batch.column(0).to_pylist():
                found = set()
                for size in sizes:
                    if size > len(w):
                        break
                    for i in range(len(w) - size + 1):
                        part = w[i : i + size]
                        at = xxhash.xxh64_intdigest(part.encode(), 42)
                        at = (at - (1 << 64) if at >> 63 else at) % bits
                        if filter_[at >> 3] >> (7 - (at & 7)) & 1:
                            found.add(part)
                yield _table([("label", [w] * len(found), pa.string()), ("w", sorted(found), pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k["w"]: k["own"] for k in known if k["own"]}
                out.append(Segmenter({k["w"]: k["n"] for k in known}, own, total).split(label))
            yield _table([("w", batch.column(0).to_pylist(), pa.string()), ("words", out, pa.list_(pa.string()))])

    parts_ = labels.select("w").mapInArrow(substrings, "label string, w string").join(seeded, "w")
    known = parts_.groupBy("label").agg(F.collect_list(F.struct("w", "own", "n")).alias("known"))
    return known.mapInArrow(split, "w string, words array<string>")


def with_words(pages: DataFrame, page_id: str = "page_id", url: str = "url", label_chars: int = LABEL_CHARS) -> DataFrame:
    """(id, host, path, words) of every row: its URL's parts and the words of its host.

    The counts of host labels are broadcast while all distinct labels have at most label_chars characters; beyond that, labels are split by a join, hosts are put together from them, and rows are joined with hosts. Both ways give the same words.
    """
    labels = unigrams(pages, url)
    size, total = labels.agg(F.sum(F.char_length("w") + 8), F.sum("n")).first()
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    segmenter = _collected(labels) if (size or 0) <= label_chars else None
    held = pages.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for batch in batches:
            found = [parts(u) for u in batch.column(1).to_pylist()]
            words = []
            for host, _ in found:
                if len(memo) > KEPT_HOSTS:
                    memo.clear()
                if host not in memo:
                    memo[host] = host_words(held.value, host) if held.value else [x for x in _SPLIT.split(host) if x]
                words.append(memo[host])
            columns = [pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "host", "path", "words"])

    out = rows.mapInArrow(run, f"id {kind}, host string, path string, words array<string>")
    if segmenter is not None:
        return out
    # Here words are a host's labels as they are. They are split once for each host.
    split = segmented(labels, total + SEED_COUNT * len(SEEDS))
    hosts = out.select("host", "words").distinct().select("host", F.posexplode_outer("words").alias("at", "w")).join(split.withColumnRenamed("words", "own"), "w", "left")
    whole = checkpointed(hosts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("all")).select("host", F.flatten(F.filter(F.transform("all", lambda x: x["own"]), lambda x: x.isNotNull())).alias("words")))
    return out.drop("words").join(whole, "host").select("id", "host", "path", "words")


def train(rows: DataFrame, rules: Rules) -> Bayes:
    """Counts of all tokens by fold, class and bucket, over all rows of with_words(). Repeated tokens are summed up before the shuffle; what is collected is bounded by FOLDS * BUCKETS. Rows are counted in bucket -1, words that are left out in -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], list[int]] = {}
        out = lambda: _table([("f", [f for f, _ in counts], pa.int32()), ("w", [w for _, w in counts], pa.int64()), *((n, [c[k] for c in counts.values()], pa.int64()) for k, n in enumerate(("clean", "bad")))])
        for batch in batches:
            for host, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not host:
                    continue
                k, own, less = evidence(rules, host, path, words)
                f = fold(host)
                counts.setdefault((f, -2), [0, 0])[k] += less
                for b in (-1, *map(token, own)):
                    counts.setdefault((f, b), [0, 0])[k] += 1
            if len(counts) > KEPT_COUNTS:
                yield out()
                counts = {}
        yield out()

    summed = rows.select("host", "path", "words").mapInArrow(run, "f int, w long, clean long, bad long").groupBy("f", "w").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).toArrow()
    counts = {(f, w): (a, b) for f, w, a, b in zip(*(summed.column(i).to_pylist() for i in range(4)), strict=True)}
    of = lambda b: {f: c for (f, w), c in counts.items() if w == b}
    return Bayes({k: c for k, c in counts.items() if k[1] >= 0}, of(-1), of(-2))


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, label_chars: int = LABEL_CHARS) -> DataFrame:
    """(id, host, path, rule, verdict, log_odds, words) for every row.

    A rule decides where one fits; else log_odds over 0 blocks, and odds of 0 allow. Null urls and those without "://" have an empty host and path, fit no rule and are allowed; they aren't counted in training. Whole urls of any length count. Rows that repeat are judged each and count each in training; other columns, of whatever names, are left out; an empty table gives an empty one.
    """
    table = Rules(rules)
    rows = with_words(pages, page_id, url, label_chars)
    held = pages.sparkSession.sparkContext.broadcast((table, train(rows, table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, bayes = held.value
        for batch in batches:
            odds, found = [], []
            for host, path, words in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                odds.append(bayes.log_odds(host, words + path_words(path)) if host else 0.0)
                found.append(fixed.match(host, path) or (None, "block" if odds[-1] > 0 else "allow"))
            columns = [pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(odds, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, batch.column(3)], names=["id", "host", "path", "rule", "verdict", "log_odds", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, log_odds double, words array<string>")


def op9_url_filters(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filter_urls(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
