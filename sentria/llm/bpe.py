"""Byte-level BPE as a bounded-lookahead streaming transducer, and the way back.

Two stages, each with a lookahead that is known beforehand:

* ``stream_pretokens``: a text, given in blocks, is cut into pretokens. A match is emitted once it
  ends ``PRE_LOOKAHEAD`` characters before what has been read, since then neither a longer run nor a
  contraction can change it.
* ``PieceStream``: the bytes of a pretoken become tokens. The last token of the encoding of every
  prefix is the only one that is compatible with the last token of what stands before it, so the
  encoding of what has been read is a chain of last tokens. A token of the chain is emitted once as
  many bytes follow it as the merge list can look ahead from it (``Merges.ahead``, computed from the
  merge list alone): no bytes that are still to come can change it. The state is as long as the
  lookahead and the longest token, whatever the text's length.

Every pretoken of every text goes through the transducer. Results of short ones are kept in a
bounded memo as packed little-endian int32, so that a text is one join of byte strings; the memo
only saves repeated work. The vocabulary file is a parameter; it isn't part of this repository.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

PRE_LOOKAHEAD = 3
#: characters of a run that a stream of blocks holds before it gives out a part of it
PART = 1 << 12
MEMO_ENTRIES = 400_000
#: characters of the longest pretoken or word whose result is kept
MEMO_LENGTH = 48

#: The characters with the property White_Space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def tokenizer_dir() -> str:
    """Folder of the public tokenizers' files: $TOKENIZER_DIR, else /opt/tokenizers."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _ranges(test) -> str:
    """A character class body with all code points for which test holds."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and test(c)
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > start else ""))
            start = None
    return "".join(out)


_CLASSES: dict[str, str] = {}


def classes() -> dict[str, str]:
    """Character class bodies of letters, numbers and white space; built once in a process."""
    if not _CLASSES:
        cats = {c: unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)}
        _CLASSES.update(L=_ranges(lambda c: cats[c] == "L"), N=_ranges(lambda c: cats[c] == "N"), W=WHITE)
    return _CLASSES


_PATTERN: list[re.Pattern] = []


def pattern() -> re.Pattern:
    """The pretoken pattern of the byte_bpe vocabularies."""
    if not _PATTERN:
        k = classes()
        num, let, w = k["N"], k["L"], k["W"]
        _PATTERN.append(re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{let}]+| ?[{num}]+| ?[^{w}{let}{num}]+|[{w}]+(?![^{w}])|[{w}]+"))
    return _PATTERN[0]


class Merges:
    """Merge list of a byte-level BPE: ids by bytes, and how each token falls apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_alphabet()
        self.id_of: dict[bytes, int] = {}
        raw: dict[str, bytes] = {}
        for token, i in model["vocab"].items():
            try:
                raw[token] = bytes(byte_of[c] for c in token)
            except KeyError:
                continue  # a special token: not made of byte characters
            self.id_of[raw[token]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        n = max(self.id_of.values()) + 1
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[tuple[int, int], int] = {}
        rank = {}
        vocab = model["vocab"]
        specials = set(model["vocab"]) - set(raw)
        for r, (a, b) in enumerate(merges):
            t = vocab.get(a + b)
            if t is None or a in specials or b in specials:
                continue
            ia, ib = vocab[a], vocab[b]
            if t not in rank:
                rank[t], self.left[t], self.right[t] = r, ia, ib
            self.pairs[(ia, ib)] = t
        #: order in which merges are made; single bytes come before all
        self.order = [rank.get(t, -1) for t in range(n)]
        self.bytes_of = [b""] * n
        for k, i in self.id_of.items():
            self.bytes_of[i] = k
        # tokens that no merge makes are never given out
        self.id_of = {k: i for k, i in self.id_of.items() if len(k) == 1 or i in rank}
        self.max_token_len = max(map(len, self.id_of))
        ends: dict[bytes, set[int]] = {}
        for k in self.id_of:
            if len(k) > 1:
                ends.setdefault(k[-2:], set()).add(len(k))
        #: by a token's last two bytes, the lengths of such tokens, shortest first
        self.end_lens = {k: (1, *sorted(v)) for k, v in ends.items()}
        self._ok: dict[tuple[int, int], bool] = {}
        #: bytes that must follow each token before it is final
        self.ahead = self._lookahead()
        self.lookahead = max(self.ahead)

    def _lookahead(self) -> list[int]:
        """Sufficient lookahead of each token, from the merge list, in one pass from the first merge on.

        Let ``made[t]`` be how many bytes behind a place must be known to tell whether t is made there.
        t = (u, v) is made unless u or v isn't, or one of them was merged before with what stands
        beside it: v with some x (which needs the bytes of x and what tells whether (v, x) is made) or
        u with some z. Only earlier merges can do that, so each merge asks for numbers that are known.
        A made token is final once it is known that no merge at all takes it."""
        size = [len(b) for b in self.bytes_of]
        made = [0] * len(size)
        right_of = [0] * len(size)  # the greatest need of the merges so far that take a token from the right
        left_of = [0] * len(size)  # and from the left
        for (u, v), t in self.pairs.items():  # in the order of merges
            own = max(made[u] - size[v], made[v], right_of[v], left_of[u] - size[v], 0)
            made[t] = max(made[t], own)
            right_of[u] = max(right_of[u], size[v] + own)
            left_of[v] = max(left_of[v], own)
        return [max(need) for need in zip(made, right_of, left_of)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a can be followed by token b: no merge across their border comes before
        the merges that made them."""
        key = (a, b)
        known = self._ok.get(key)
        if known is None:
            if len(self._ok) > MEMO_ENTRIES:
                self._ok.clear()
            known = self._ok[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        order, left, right, pairs = self.order, self.left, self.right, self.pairs
        # Undo the merges of both sides from the last to the first; at each step the two tokens at the
        # border must not merge earlier than the merge undone last.
        bound = 1 << 60  # order of the merge undone last, plus one on the right side
        while True:
            m = pairs.get((a, b))
            if m is not None and order[m] < bound:
                return False
            oa, ob = order[a], order[b]
            if oa < 0 and ob < 0:
                return True
            if oa > ob:
                bound, a = oa, right[a]
            else:  # of equal merges the left one is made first, so the right one is undone first
                bound, b = ob + 1, left[b]


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceStream:
    """Tokens of one pretoken of any length, fed in parts, with constant memory."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.held = b""  # bytes that no emitted token covers
        self.last = [-1]  # by place in them, the last token of what ends there; -1 where no token of the chain can end
        self.before = -1  # the token emitted last
        #: how much is held before tokens are looked for that are final
        self.most = 2 * (merges.lookahead + merges.max_token_len)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.most):
            self._read(data[i : i + self.most])
            if len(self.held) > self.most:
                out += self._final()
        return out

    def _read(self, data: bytes) -> None:
        m, last = self.m, self.last
        held = self.held = self.held + data
        id_of, ends, ok, first = m.id_of, m.end_lens, m._ok, self.before
        for end in range(len(last), len(held) + 1):
            found = -1
            for n in ends.get(held[max(end - 2, 0) : end], (1,)):
                start = end - n
                if start < 0:
                    break
                t = id_of.get(held[start:end])
                if t is None:
                    continue
                prev = last[start] if start else first
                if prev < 0:
                    if start:
                        continue
                    found = t
                    break
                if ok[prev, t] if (prev, t) in ok else m.compatible(prev, t):
                    found = t
                    break
            last.append(found)

    def _chain(self) -> list[tuple[int, int]]:
        """(end, token) from the first byte held to the last one read."""
        out, end, size, last = [], len(self.held), self.m.bytes_of, self.last
        while end:
            t = last[end]
            out.append((end, t))
            end -= len(size[t])
        return out[::-1]

    def _final(self) -> list[int]:
        """Emits the tokens that what is still to come can't change."""
        n, out, cut = len(self.held), [], 0
        for end, t in self._chain():
            if n - end < self.m.ahead[t]:
                break
            out.append(t)
            cut = end
        if out:
            self.held, self.last, self.before = self.held[cut:], [-1, *self.last[cut + 1 :]], out[-1]
        return out

    def close(self) -> list[int]:
        out = [t for _, t in self._chain()]
        self.held, self.last, self.before = b"", [-1], -1
        return out


class _Memo(dict):
    """Packed ids by pretoken, made by the transducer."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.made = 0  # pretokens that went through the transducer

    def __missing__(self, piece: str) -> bytes:
        self.made += 1
        stream = PieceStream(self.merges)
        out = pack(stream.feed(piece.encode("utf-8", "surrogatepass")) + stream.close())
        if len(piece) <= MEMO_LENGTH:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[piece] = out
        return out


class _Words(dict):
    """Packed ids of a space and the word after it. A single space between characters that aren't
    white always begins a pretoken, so words are encoded by themselves; long ones aren't kept."""

    def __init__(self, findall, memo: _Memo):
        super().__init__()
        self.findall, self.memo = findall, memo

    def __missing__(self, word: str) -> bytes:
        out = b"".join(map(self.memo.__getitem__, self.findall(" " + word)))
        if len(word) <= MEMO_LENGTH:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[word] = out
        return out


_WHITES = "".join(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
_OTHER_WHITES = _WHITES.replace(" ", "")


def _words(text: str) -> list[str]:
    """A text cut at each lone space between characters that aren't white; the space is left out."""
    parts = text.split(" ")
    if "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_WHITES):
        out = [parts[0]]
        for p in parts[1:]:
            q = out[-1]
            if not p or not q or p[0] in _WHITES or q[-1] in _WHITES:
                out[-1] = f"{q} {p}"
            else:
                out.append(p)
        return out
    return parts


def pack(ids: Iterable[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Encoder:
    """Texts to packed ids."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.memo = _Memo(self.merges)
        self.pattern = pattern()
        self.words = _Words(self.pattern.findall, self.memo)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian int32."""
        head, *rest = _words(text)
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(head))) + b"".join(map(self.words.__getitem__, rest))

    def stream(self, blocks: Iterable[str], part: int = PART) -> Iterator[bytes]:
        """Packed ids as soon as they are final, of a text that comes in blocks, with constant memory: of
        a run that is longer than ``part`` parts are read as they come."""
        run = None
        for piece, ends in stream_pretokens(blocks, self.pattern, part):
            if run is None and ends:
                yield self.memo[piece]
                continue
            run = run or PieceStream(self.merges)
            yield pack(run.feed(piece.encode("utf-8", "surrogatepass")))
            if ends:
                yield pack(run.close())
                run = None

    def ids(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


def stream_pretokens(blocks: Iterable[str], pat: re.Pattern, part: int = PART) -> Iterator[tuple[str, bool]]:
    """(part, whether the pretoken ends with it) of a text that comes in blocks. Only runs longer than
    ``part`` come in several parts."""
    k = classes()
    kinds = [re.compile(f"[{k['L']}]*"), re.compile(f"[{k['N']}]*"), re.compile(f"[^{k['W']}{k['L']}{k['N']}]*"), re.compile(f"[{k['W']}]*")]
    buf, kind = "", None
    for block in blocks:
        buf += block
        while True:
            if kind is not None:  # inside a long run
                end = kind.match(buf).end()
                white = kind is kinds[3]
                if end < len(buf) - 1:
                    keep = end - 1 if white and end else end
                    yield buf[:keep], True
                    buf, kind = buf[keep:], None
                else:
                    keep = max(0, end - 1)
                    yield buf[:keep], False
                    buf = buf[keep:]
                    break
            pos, last = 0, None
            for m in pat.finditer(buf):
                if m.end() > len(buf) - PRE_LOOKAHEAD:
                    last = m
                    break
                yield m.group(), True
                pos = m.end()
            buf = buf[pos:]
            if last is not None and len(buf) > part + PRE_LOOKAHEAD:
                body = buf[1:] if buf[0] == " " and last.end() - last.start() > 1 and not buf[1] in " \n\t" else buf
                kind = next((x for x in kinds if x.match(body).end() > part), None)
                if kind is not None:
                    if len(body) < len(buf):
                        yield buf[0], False
                    buf = body
                    continue
            break
    if kind is not None:
        # the rest of the run; white space before nothing is all of it
        end = kind.match(buf).end()
        if kind is kinds[3] and 0 < end < len(buf):
            end -= 1
        yield buf[:end], True
        buf = buf[end:]
    for m in pat.finditer(buf):
        yield m.group(), True


class Decoder:
    """Ids to text, one at a time: an incremental byte-to-text state machine. A code point is given
    out with the token that completes it; broken bytes come out as U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.machine.decode(self.bytes_of[token])

    def close(self) -> str:
        return self.machine.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    """The encoder of a vocabulary; built once in a worker process."""
    path = f"{folder or tokenizer_dir()}/{name}.json"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
