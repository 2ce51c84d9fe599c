"""Compiled token counts and ids against the library."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from stratalog.llm import packing, token_counts  # noqa: E402
from stratalog.llm.bpe import CONTRACTIONS, Bpe, Words, plain, split  # noqa: E402

PATH = P.path("word_bpe_49k.json")
POOL = [*"abcdefgstrevlmdLISAB'''  \n\t019.,!?-_", ". ", ", ", ".\n", "Ab, ", "'s", "'re", "'ll", "n't", "'ve", "'v", "'l", "'r", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", *"éÉßẞİΣςǰ中文²½Ⅷ٣ﬁ한ªʼn’\u00ad\x00\x7f\xa0\x85\x1c\x1f\u200b\ufeff×÷ñÿÀ", "J\u030c", "a\u0301", "😀", "👩‍👧"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(PATH)


def texts(seed, n, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts(library, machine):
    batch = texts(1, 600)
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    raw = [t.encode() for t in batch]
    assert machine.counts(raw) == want
    assert [machine.counts([t])[0] for t in raw] == want
    assert machine.counts(raw, chunk=7) == want


def test_ids(library):
    encoder = packing.Encoder(PATH)
    batch = texts(2, 600)
    want = [np.array(e.ids, encoder.kind).tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]
    assert encoder.encode([t.encode() for t in batch]) == want


def test_plain_texts(library):
    rng = random.Random(3)
    encoder = packing.Encoder(PATH)
    letters = "abcdeABCÉéßñÿÀ .,  \n\t01!?-_<>|\x1c\x00x"
    for _ in range(60):
        batch = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 10, 40, 200]))) for _ in range(8)]
        assert encoder.encode([t.encode() for t in batch]) == [np.array(e.ids, encoder.kind).tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]


def test_a_small_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(Words, "BITS", 6)
    words = Words(Bpe(PATH))
    rng = random.Random(4)
    batch = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 30))) for _ in range(n)) for n in (3, 0, 40, 200, 1, 25)]
    ids, counts = words.encode([t.encode() for t in batch])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_what_is_plain():
    assert all(plain(t.encode()) for t in ("", "abc. É", "\x00<a|"))
    assert not any(plain(t.encode()) for t in ("don't", "a<|b", "×", "÷", "œ", "\xa0", "中", "e\u0301"))


def test_split_machine_takes_contractions():
    assert split("don't") == ["don", "'t"] and split("''s") == ["''", "s"] and split("'rx") == ["'", "rx"] and split("a1b") == ["a", "1", "b"]
    assert all(split("x" + c) == ["x", c] for c in CONTRACTIONS) and split("'v") == ["'", "v"] and split("'") == ["'"]


def chunked(machine, text, chunk):
    raw = text.encode()
    m = machine.mark(raw + b"\n")
    return m, machine.maps(m, np.array([[0, len(raw)]]), chunk)[0]


def test_state_maps_compose_associatively(machine):
    rng = random.Random(5)
    for k in range(40):
        m, maps = chunked(machine, "".join(rng.choice(["ab", " ", "c", "\n", "9.", "don't", "éa", "中", "x" * 9]) for _ in range(rng.randint(20, 60))), rng.randint(1, 9))
        for i in range(len(maps.head) - 2):
            a, b, c = (maps.at(np.array([j])) for j in (i, i + 1, i + 2))
            left, right = machine.compose(m, machine.compose(m, a, b), c), machine.compose(m, a, machine.compose(m, b, c))
            # A state only counts where there is a cut before it.
            assert all(x.tolist() == y.tolist() for n, x, y in zip(left._fields, left, right, strict=True) if n != "state" or left.synced[0])


def test_prefix_scan_is_a_running_composition(machine, library):
    text = " ".join(texts(6, 60, 12))
    for chunk in (1, 7, 50, 256):
        m, maps = chunked(machine, text, chunk)
        done, so_far = machine.scan(m, maps), maps.at(np.array([0]))
        for i in range(1, len(maps.head)):
            so_far = machine.compose(m, so_far, maps.at(np.array([i])))
            assert (done.count[i], done.state[i]) == (so_far.count[0], so_far.state[0])
        counts = machine.prefix_counts(text.encode(), chunk)
        assert counts[-1] == len(library.encode(text, add_special_tokens=False).ids) and counts == sorted(counts)


def test_transitions_emit_what_merges_leave(machine):
    """A path of the table, byte by byte, ends in a state that emits its pretoken's tokens."""
    m = machine.mark(b"unbelievable ")
    machine.learn(m, np.array([0]))
    state = np.zeros(1, np.int64)
    for b in b"unbelievable":
        state = machine.go(state, np.array([b]))
        assert state[0] > machine.DEAD
    assert machine.emits[state[0]] == machine.bpe.spans(["unbelievable"])[1][0]
    assert machine.go(state, np.array([0x01]))[0] == machine.DEAD


def test_every_code_point(machine, library):
    """Alone, and between letters, as the library counts it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        batch = [f"a{c}b {c}" for c in points[at : at + 50_000]]
        want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
        got = machine.counts([t.encode() for t in batch])
        assert [(t, g, w) for t, g, w in zip(batch, got, want, strict=True) if g != w] == []


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 300)
    small = token_counts.Transducer(PATH, states=1024)
    batch = [t for t in texts(8, 80, 60) if len(t) < 150] + ["".join(random.Random(i).choices("abcde fgh", k=900)) for i in range(9)]
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    assert small.counts([t.encode() for t in batch]) == want and small.n < 1024


def test_long_symbols(machine, library, monkeypatch):
    """Pretokens and spans around the bound of what has states, at every place of a chunk."""
    monkeypatch.setattr(token_counts, "SPAN", 2000)
    batch = [f"{'x' * a}{'ab' * (n // 2)}{'c' * (n % 2)}{tail}" for n in (255, 256, 257, 511, 700) for a in (0, 1) for tail in ("", ".", " end", "'s", " " + "y" * 300)]
    batch += [" " * k + "é" * 200 + "." * 300 + "don't" * 70 + " q" for k in (0, 3, 255)] + ["中" * 900, "a1b2" * 900, "word " * 99 + "don't" * 600 + " word"]
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    for chunk in (256, 64, 100):
        assert machine.counts([t.encode() for t in batch], chunk) == want
        assert [machine.counts([t.encode()], chunk)[0] for t in batch] == want


def test_long_texts(machine, library):
    for text in ("ab" * 3000 + "'" * 500, "word " * 50_000, "x" * 100_000, "é." * 20_000):
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.counts([text.encode()]) == [want]
        assert machine.counts([text.encode()], chunk=1000) == [want]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Bpe(P.path("byte_bpe_50k.json"))


def test_query(spark, library):
    rows = [(1, "Hello, World's end."), (2, None), (3, ""), (4, "é" * 5), (4, "é" * 5), (None, "a b"), (7, "word " * 2049), (8, "word " * 2048)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op3_token_counts(df, PATH).collect())
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, want, strict=True))
    assert token_counts.op3_token_counts(df.where("false"), PATH).count() == 0


def test_ids_of_code_points(library):
    """Every character of the first blocks, and a 41st of the others."""
    encoder = packing.Encoder(PATH)
    points = [c for c in range(0x110000) if (c < 0x3000 or c % 41 == 0) and not 0xD800 <= c < 0xE000]
    batch = [f"a{chr(c)}b {chr(c)}" for c in points]
    want = [np.array(e.ids, encoder.kind).tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]
    got = encoder.encode([t.encode() for t in batch])
    assert [t for t, g, w in zip(batch, got, want, strict=True) if g != w] == []
