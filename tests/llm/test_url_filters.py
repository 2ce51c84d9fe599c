"""URL parts and rules against regular expressions, Viterbi against all splits, naive Bayes against its formula."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from stratalog.llm import url_filters as uf

URLS = [None, "", "no scheme", "://", "http://", "HTTP://Sub.EXAMPLE.com/en/7?x#y", "https://a.net/de/8", "x://example.net/de/85", "x://example.net#/de/8", "x://org/es/", "x://notorg/es/", "x://a.org?/es/", "a://b://c/d", "http://ÄB.com/en/", "http://com/en", "http://example.com.com/en/7", "x://.com/en/", "x://y.com./en/"]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("", "") if not m or (url or "").find("://") != m.start() else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])


def test_parts():
    assert [uf.parts(u) for u in URLS] == [plain(u) for u in URLS]


def test_rules():
    table = uf.Rules(uf.RULES)
    for url in URLS:
        host, path = plain(url)
        fits = [(len(r), r, v) for v, r in uf.RULES for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        want = max(fits, default=None)
        assert table.match(host, path) == (want and (want[1], want[2])), url


def test_viterbi_finds_the_likeliest_split():
    s = uf.Segmenter({"cheap": 50, "pills": 40, "che": 3, "ap": 3, "a": 20, "p": 5, "free": 30, "bets": 30, "bet": 30, "s": 9})
    for label in ("cheappills", "freebets", "a", "apill", "zz", "betsbets", "xfree"):
        cuts = [[label[a:b] for a, b in itertools.pairwise((0, *c, len(label)))] for n in range(len(label)) for c in itertools.combinations(range(1, len(label)), n)]
        best = max(sum(map(s.cost, c)) for c in cuts)
        assert sum(map(s.cost, s.split(label))) == pytest.approx(best) and "".join(s.split(label)) == label
    assert s.split("cheappills") == ["cheap", "pills"] and s.split("") == []


def plain_odds(pages, host, words):
    """Log odds from their definition: counts over the URLs of the other fold, without what gave a label."""
    counts, rows, less = {}, [0, 0], [0, 0]
    table = uf.Rules(uf.RULES)
    for h, path, own in pages:
        if not h:
            continue
        rule = table.match(h, path)
        bad = rule[1] == "block" if rule else any(w in uf.SEEDS for w in own)
        given = set(uf.SEEDS)
        if rule:
            given |= {x for x in re.split("[./]", rule[0].split("/")[0])} | {"/" + re.sub("[0-9]+", "0", x) for x in rule[0].split("/")[1:] if x}
        rows[bad] += 1
        if uf.fold(h) == uf.fold(host):
            continue
        for w in [*own, *uf.path_words(path)]:
            if w not in given:
                counts.setdefault(uf.token(w), [0, 0])[bad] += 1
            else:
                less[bad] += 1
    total = [less[k] + sum(c[k] for c in counts.values()) + len(counts) + 1 for k in (0, 1)]
    out = math.log((rows[1] + 1) / (rows[0] + 1))
    for w in words:
        if w not in uf.SEEDS and uf.token(w) in counts:
            c = counts[uf.token(w)]
            out += min(max(math.log((c[1] + 1) / total[1]) - math.log((c[0] + 1) / total[0]), -uf.MOST_ODDS), uf.MOST_ODDS)
    return out + uf.SEED_ODDS * len(set(words) & set(uf.SEEDS))


def test_log_odds_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = uf.filter_urls(pages).collect()
    every = [(r.host, r.path, r.words) for r in got]
    for r in got[:60]:
        assert r.log_odds == pytest.approx(plain_odds(every, r.host, [*r.words, *uf.path_words(r.path)]), abs=1e-4)
        if r.rule is None:
            assert r.verdict == ("block" if r.log_odds > 0 else "allow")


def test_hosts_without_a_seed_are_blocked_by_the_company_of_their_words(spark):
    """bonus and jackpot stand beside seeds in other hosts; college and library beside none."""
    rng = random.Random(4)
    bad = [f"{a}-{b}-n{i}.example.org" for i in range(30) for a, b in [rng.choice([("casino", "bonus"), ("poker", "jackpot"), ("bonus-jackpot", "bets")])]]
    good = [f"{a}-{b}-n{i}.example.org" for i in range(60) for a, b in [rng.choice([("college", "library"), ("garden", "news"), ("college", "news")])]]
    words = lambda hosts, path: [f"http://{h}/fr/{path}/{i}" for h in hosts for i in range(8)]
    new = ["http://bonus-jackpot.example.org/fr/win/1", "http://jackpot.example.org/fr/win/2", "http://garden.example.org/fr/read/3", "http://adult-college-library-college-library-news-garden.example.org/fr/read/read/read/4"]
    urls = words(bad, "win") + words(good, "read") + new
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.id]: r for r in uf.filter_urls(df).collect()}
    assert [got[u].verdict for u in new] == ["block", "block", "allow", "allow"]
    assert not set(got[new[0]].words) & set(uf.SEEDS) and "adult" in got[new[3]].words


def test_rules_are_not_learnt_back():
    table = uf.Rules(uf.RULES)
    assert uf.evidence(table, "m.shop.example.com", "/en/9", ["m", "shop", "example", "com"]) == (1, ["m", "shop", "example", "/0"], 2)
    assert uf.evidence(table, "a.net", "/de/9", ["a", "net"]) == (0, ["a", "/0"], 2)
    assert uf.evidence(table, "casino.a.net", "/fr/9", ["casino", "a", "net"]) == (1, ["a", "net", "/fr", "/0"], 1)
    assert uf.evidence(table, "b.net", "/fr/9", ["b", "net"]) == (0, ["b", "net", "/fr", "/0"], 0)


def test_joined_seed_words_are_blocked(spark):
    hosts = ["news.example.org", "blog.example.org", "cheap-pills.example.org", "casino-win.example.org", "garden.example.org"]
    urls = [f"http://{h}/fr/{i}" for i in range(20) for h in hosts] + ["http://cheappills.example.org/fr/3", "http://winnews.example.org/fr/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.id]: r for r in uf.filter_urls(df).collect()}
    blocked = {u for u, r in got.items() if r.verdict == "block"}
    assert blocked == {u for u in urls if "pills" in u or "casino" in u}
    assert got["http://cheappills.example.org/fr/3"].words == ["cheap", "pills", "example", "org"]


def test_a_joined_host_with_many_urls_is_split(spark):
    """However many URLs a joined name stands in, and however large the table."""
    hosts = ["news.example.org", "blog.example.org", "garden.example.org", "cheap-pills.example.org"]
    urls = [f"http://{h}/fr/{i}" for i in range(5000) for h in hosts] + [f"http://{h}.example.org/fr/{i}" for i in range(3000) for h in ("cheappills", "cheappillsblog")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.host: r for r in uf.filter_urls(df).collect()}
    assert got["cheappills.example.org"].words == ["cheap", "pills", "example", "org"]
    assert got["cheappillsblog.example.org"].words == ["cheap", "pills", "blog", "example", "org"]
    assert got["garden.example.org"].words == ["garden", "example", "org"]
    # Of other hosts, only one that has a word from their company is blocked with them.
    assert {h for h, r in got.items() if r.verdict == "block"} - {"blog.example.org"} == {h for h in got if "pills" in h}


def test_every_word_and_token_counts_whole(spark):
    """More words than 50,000, words over 24 and tokens over 64 characters."""
    tail, joined = "x" * 70 + "tail", "cheap" + "averyveryveryverylongbrandname"
    urls = [f"http://h{chr(97 + i % 26)}{i}.example.org/fr/{tail}" for i in range(50_500)] + [f"http://{h}.example.org/fr/1" for h in ("averyveryveryverylongbrandname", "cheap", joined)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    segmenter = uf._collected(uf.unigrams(df))
    assert len(segmenter.rest) == 50_505 and segmenter.split(joined) == ["cheap", "averyveryveryverylongbrandname"]
    bayes = uf.train(uf.with_words(df), uf.Rules(uf.RULES))
    assert all(w[uf.token("/" + tail)] != 0 for w in bayes.weight) and (np.array(bayes.weight) != 0).sum() > 8 * 40_000


def test_labels_that_are_joined_give_the_words_of_broadcast_ones(spark, sf_dir):
    hosts = ["cheappills.example.org", "cheap.pills.org", "newsgarden.a.net", "news.b.com", "garden.ä.com", "x" * 300 + ".org", "pillspillscheap.com", "a-b_c..d", "...", "PillsNews.org", "newsnewsnews.com"]
    rows = [(i, f"http://{h}/p/{i % 3}") for i, h in enumerate(hosts * 3)] + [(900, None), (901, "none"), (None, "http://cheap.org")]
    df = spark.createDataFrame(rows, "page_id long, url string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    by = lambda n: sorted((r.id is None, r.id or 0, r.host, r.path, r.rule or "", r.verdict, round(r.log_odds, 6), tuple(r.words)) for r in uf.filter_urls(df, label_chars=n).collect())
    assert by(0) == by(1 << 20)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r.url for r in pages.collect()}
    got = uf.op9_url_filters(pages).collect()
    assert len(got) == len(rows)
    table = uf.Rules(uf.RULES)
    for r in got:
        host, path = plain(rows[r.page_id])
        want = table.match(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want and want[0])
        assert r.verdict == (want[1] if want else r.verdict) and r.verdict in ("allow", "block")


def test_edges(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h"), (None, "http://a.b/" + "c/" * 50_000, "h"), (99, "http://" + "longhost" * 300 + ".org/x", "h")], "page_id long, url string, host string")
    got = uf.op9_url_filters(df).collect()
    assert len(got) == len(URLS) + 3
    assert all((r.host, r.path, r.rule) == ("", "", None) and r.verdict == "allow" for r in got if r.page_id == 0)
    assert uf.op9_url_filters(df.where("false")).count() == 0
