"""The encoder against an independent one, and the round trip."""

import base64
import random
import time
from pathlib import Path

import pytest

from sentria.llm import bpe, splitting

tiktoken = pytest.importorskip("tiktoken")
ALPHABET = "aaabehtz'slr  \n\t .,!-=中文éà12٣²\U0001f600ट्\xa0"


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder()


@pytest.fixture(scope="module")
def other():
    file = Path(bpe.tokenizer_dir(), "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.open("rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return list(memoryview(packed).cast("i")) if packed else []


def in_blocks(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(0, len(text), n)]


@pytest.mark.parametrize("block, part", [(1 << 16, 1 << 12), (7, 5), (3, 10), (16, 2)])
def test_same_ids_in_blocks(enc, other, block, part):
    rng = random.Random(1)
    for _ in range(700):
        text = "".join(rng.choice(ALPHABET) * rng.choice([1, 1, 1, 2, 9, 70]) for _ in range(rng.randint(0, 40)))
        want = other.encode_ordinary(text)
        assert ids(enc.packed(text)) == want
        assert ids(b"".join(enc.stream(in_blocks(text, block), part))) == want


def test_every_pretoken_is_transduced():
    """Of whatever length a text is, each distinct pretoken's ids come from the transducer."""
    fresh = bpe.Encoder(str(Path(bpe.tokenizer_dir(), "byte_bpe_50k.json")))
    fed = []
    feed = bpe.PieceStream.feed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe.PieceStream, "feed", lambda self, data: fed.append(data) or feed(self, data))
        for text in ("One word, two words.", "a", "x" * 70_000, "Twelve lines\n" * 12_000, "I'll go"):
            fresh.packed(text)
            for piece in fresh.pieces(text):
                assert piece.encode() in fed
    assert len(fed) == fresh.memo.made


def merges_of(pairs: list[tuple[bytes, bytes]]) -> bpe.Merges:
    m = bpe.Merges.__new__(bpe.Merges)
    byte = {bytes([c]): c for c in range(256)}
    m.id_of = {**byte, **{a + b: 256 + i for i, (a, b) in enumerate(pairs)}}
    m.bytes_of = [bytes([c]) for c in range(256)] + [a + b for a, b in pairs]
    m.left = [*range(256), *(m.id_of[a] for a, _ in pairs)]
    m.right = [*range(256), *(m.id_of[b] for _, b in pairs)]
    m.pairs = {(m.id_of[a], m.id_of[b]): 256 + i for i, (a, b) in enumerate(pairs)}
    m.order = [-1] * 256 + list(range(len(pairs)))
    m.max_token_len = max(map(len, m.id_of))
    ends = {}
    for k in m.id_of:
        if len(k) > 1:
            ends.setdefault(k[-2:], set()).add(len(k))
    m.end_lens = {k: (1, *sorted(v)) for k, v in ends.items()}
    m._ok = {}
    m.ahead = m._lookahead()
    m.lookahead = max(m.ahead)
    return m


def by_rank(m: bpe.Merges, data: bytes) -> list[int]:
    """Merge by merge, in their order, from the left."""
    out = list(data)
    for (a, b), t in m.pairs.items():
        new, i = [], 0
        while i < len(out):
            if out[i : i + 2] == [a, b]:
                new.append(t)
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new
    return out


def test_lookahead_of_any_merge_list():
    """Random merge lists: a token that is given out never changes, whatever follows."""
    rng = random.Random(4)
    early = 0
    for _ in range(150):
        tokens, pairs = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) <= 12:
                pairs.append((a, b))
                tokens.append(a + b)
        m = merges_of(pairs)
        # a merge list's tokens have to be what merging their bytes gives, as in a trained one
        if any(by_rank(m, a + b) != [m.id_of[a + b]] for a, b in pairs):
            continue
        for _ in range(12):
            data = bytes(rng.choice(b"aaabbc") for _ in range(rng.randint(0, 200)))
            stream, got = bpe.PieceStream(m), []
            stream.most = 1  # looks for final tokens after every byte
            for i in range(len(data)):
                got += stream.feed(data[i : i + 1])
                assert len(stream.held) <= m.lookahead + m.max_token_len + 1
            early += len(got)
            assert got + stream.close() == by_rank(m, data)
    assert early > 1000


def test_lookahead_of_the_vocabulary(enc, other):
    m = enc.merges
    assert 0 < m.lookahead < 2_000
    rng = random.Random(5)
    for _ in range(60):
        data = "".join(rng.choice(["ab", "the", "er", "ing", "x", "aaaa", "é", "ट्", "中"]) for _ in range(rng.randint(1, 60)))
        data = "".join(c for c in data if c.isalpha()) or "a"
        stream, got = bpe.PieceStream(m), []
        stream.most = 1
        for b in data.encode():
            got += stream.feed(bytes([b]))
        assert got + stream.close() == other.encode_ordinary(data)


def test_words_and_specials(enc, other):
    for text in ("", " ", "a", "It's 'llama <|endoftext|> x", "  lead and trail  ", "line\n\n next  \t\n", "don't  we'll I'M", "a" * 9000, " " * 5000 + "x", "。" * 300):
        assert ids(enc.packed(text)) == other.encode_ordinary(text)


def test_round_trip(enc):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        d = bpe.Decoder(enc.merges)
        assert "".join(map(d.feed, ids(enc.packed(text)))) + d.close() == text


def test_constant_memory(enc):
    stream = bpe.PieceStream(enc.merges)
    got = []
    for _ in range(40):
        got += stream.feed(b"abcabd" * 50)
        assert len(stream.held) + 1 == len(stream.last) <= stream.most + 301
    got += stream.close()
    assert b"".join(enc.merges.bytes_of[t] for t in got) == b"abcabd" * 2000


@pytest.mark.parametrize("limit, overlap", [(16, 4), (5, 2), (30, 0), (8, 7), (40, 30)])
def test_pieces_cover_and_fit(enc, limit, overlap):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab. \n中。!x'é") * rng.choice([1, 1, 2, 9, 40]) for _ in range(rng.randint(0, 60)))
        parts = splitting.pieces(enc, text, limit, overlap)
        if not text:
            assert parts == []
            continue
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        for a, b in zip(parts, parts[1:]):
            assert b[0] <= a[1] < b[1]
        for s, e, n in parts:
            assert n == enc.count(text[s:e]) and (n <= limit or e - s == 1)
        for (s, e, n), (s2, _, _) in zip(parts, parts[1:]):
            assert s2 == s or limit - overlap < 4 or overlap <= enc.count(text[s2:e]) <= overlap + 3


def test_pieces_cut_at_paragraphs(enc):
    text = "\n\n".join(("Word " * 20).strip() + "." for _ in range(12))
    parts = splitting.pieces(enc, text, 100, 10)
    assert len(parts) > 1
    for _, e, _ in parts[:-1]:
        assert text[:e].endswith("\n\n")
    for (_, e, _), (s, _, _) in zip(parts, parts[1:]):
        assert enc.count(text[s:e]) == 10


def test_overlap_is_exact(enc):
    rng = random.Random(6)
    words = ["harbour", "antidisestablishment", "the", "lamp,", "Straßenbahn", "(quietly)", "won't", "é", "гавань", "12,345.67", "so."]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(6_000))
    parts = splitting.pieces(enc, text, 200, 37)
    exact = 0
    for (a, e, _), (b, _, _) in zip(parts, parts[1:]):
        n = enc.count(text[b:e])
        exact += n == 37
        if n != 37:  # no place would do, and none shares fewer tokens beyond
            assert n == min(x for c in range(a, e) if (x := enc.count(text[c:e])) >= 37)
    assert len(parts) > 80 and exact >= 0.95 * len(parts)


def test_overlap_below_limit(enc):
    with pytest.raises(ValueError):
        splitting.pieces(enc, "some text", 8, 8)


def test_time_grows_with_the_text(enc):
    def took(n):
        text = "Word after word, we went on. " * n
        began = time.process_time()
        splitting.pieces(enc, text, 512, 64)
        return time.process_time() - began

    took(2_000)
    assert min(took(16_000) for _ in range(3)) < 3 * min(took(8_000) for _ in range(3))
