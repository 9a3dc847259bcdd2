"""Token counts of every beginning of a piece, by dynamic programming.

Ids are the encoding of a word exactly if each two neighbours are the encoding of what they
spell, since merges go by rank and no merge of lower rank crosses a border that holds in the
end. So the last token of a beginning is the one that ends there and goes with the last
token of what is before it, and its count is one more than the count before it. A word's last
byte carries the end-of-word mark, so each byte has an entry without it, to build on, and
each beginning looks up its last token with it.

Words are those of the pre-tokenizer on the normalised text. Normalised text is built from
segments that the normaliser treats apart; only inside one (a character with its
combining marks) are beginnings normalised anew.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

from tilewright.llm.common import Cache

#: Fixed value of the tokenizer: the mark on the last byte of a word.
END = "</w>"


def byte_letters() -> dict[str, int]:
    """The printable letters of byte-level vocabularies and the bytes they stand for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def apart(char: str) -> bool:
    """Whether normalising a text before this character and from it on gives the same as at once."""
    if char < "\u0300":
        return True
    jamo = "\u1161" <= char <= "\u1175" or "\u11a8" <= char <= "\u11c2"
    kind = unicodedata.category(char)
    return not (jamo or kind[0] == "M" or kind == "Cn")


class Word:
    """Counts of the beginnings of one growing word."""

    def __init__(self, table: PrefixTable):
        self.t, self.bytes = table, bytearray()
        self.last, self.count = [-1], [0]  # last token and count of each beginning without the end mark

    def _step(self, at: int, ending: bool) -> tuple[int, int]:
        vocabulary = self.t.ending if ending else self.t.inner
        near, found = bytes(self.bytes[max(0, at - self.t.longest) : at]), []
        for size in range(1, len(near) + 1):
            tail = near[-size:]
            if tail not in self.t.tails:
                break
            if (token := vocabulary.get(tail)) is not None:
                found.append((size, token))
        for size, token in reversed(found):
            if self.t.pairs[self.last[at - size], token]:
                return token, self.count[at - size] + 1
        raise ValueError("bytes without a token")

    def add(self, data: bytes) -> None:
        for b in data:
            self.bytes.append(b)
            token, count = self._step(len(self.bytes), False)
            self.last.append(token)
            self.count.append(count)

    def whole(self) -> int:
        """Tokens of the word as it is now."""
        return self._step(len(self.bytes), True)[1] if self.bytes else 0

    def least(self) -> int:
        """No longer word has fewer tokens: each passes one of the last places."""
        return min(self.count[-self.t.longest :])

    def cut(self, size: int) -> None:
        del self.bytes[size:], self.last[size + 1 :], self.count[size + 1 :]


class PrefixTable:
    """Counts for a byte-level vocabulary with end-of-word marks and ranked merges."""

    def __init__(self, path: str, model):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.letters = letters = byte_letters()
        self.spelled, self.inner, self.ending = {}, {}, {}
        self.special = [t["content"] for t in data["added_tokens"]]
        self.rank = {}
        vocabulary = data["model"]["vocab"]
        for k, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((vocabulary[a], vocabulary[b]), (k, vocabulary[a + b]))
        single = [{}, {}]
        for name, token in vocabulary.items():
            if name in self.special:
                continue
            ending = name.endswith(END) and name != END
            plain = name[: -len(END)] if ending else name
            raw = bytes(letters[c] for c in plain)
            self.spelled[token] = (raw, ending)
            (self.ending if ending else self.inner)[raw] = token
            if len(raw) == 1:
                single[ending][raw[0]] = token
        self.single = single
        self.longest = max(len(raw) for raw, _ in self.spelled.values())
        self.tails = {raw[k:] for raw, _ in self.spelled.values() for k in range(len(raw))}
        self.normal = model.normalizer.normalize_str
        self.split = model.pre_tokenizer.pre_tokenize_str
        self.normals = Cache(self.normal, limit=8 << 20)
        self.pairs = Cache(self._pair)

    def merged(self, raw: bytes, ending: bool) -> list[int]:
        """Ids of a few bytes, by the merges themselves."""
        ids = [self.single[0][b] for b in raw]
        if ending:
            ids[-1] = self.single[1][raw[-1]]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _pair(self, pair: tuple[int, int]) -> bool:
        raw, ending = self.spelled[pair[1]]
        if pair[0] < 0:
            return self.merged(raw, ending) == [pair[1]]
        return self.merged(self.spelled[pair[0]][0] + raw, ending) == list(pair)

    def _parts(self, piece: str) -> Iterator[tuple[int, int, bool]]:
        """Parts of the piece: start, end, and whether a special token ends there."""
        at = 0
        while at < len(piece):
            found = [(k, -len(s)) for s in self.special if (k := piece.find(s, at)) >= 0]
            k, less = min(found, default=(len(piece), 0))
            yield at, k - less, less < 0
            at = k - less

    def _tokens(self, words: list[bytes]) -> int:
        total = 0
        for raw in words:
            word = Word(self)
            word.add(raw)
            total += word.whole()
        return total

    def _split(self, text: str) -> list[bytes]:
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in self.split(text)]

    def _walk(self, part: str) -> Iterator[tuple[int, int]]:
        """Per beginning of a part without special tokens: its tokens, and a bound that no longer one is below."""
        starts = [k for k, c in enumerate(part) if k == 0 or apart(c)] + [len(part)]
        segments = [self.normals[part[a:b]] for a, b in zip(starts, starts[1:])]
        text = "".join(segments)
        spans = [span for _, span in self.split(text)]
        done, k, at = 0, 0, 0  # tokens of the words before word k; place in the normalised text
        word, now = Word(self), 0  # what is there of word k, and its tokens
        for a, b, segment in zip(starts, starts[1:], segments):
            for end in range(a + 1, b):  # inside a segment: what it begins with is normalised by itself
                tail, start = self.normal(part[a:end]), spans[k][0] if k < len(spans) else at
                if at - start > 3:  # a run of one class goes on or ends; three characters tell
                    near = text[at - 3 : at]
                    first, *rest = self._split(near + tail)
                    size = len(word.bytes)
                    word.add(first[len(near.encode()) :])
                    yield done + word.whole() + self._tokens(rest), 0
                    word.cut(size)
                else:
                    yield done + self._tokens(self._split(text[min(start, at) : at] + tail)), 0
            for c in segment:
                if k < len(spans) and at == spans[k][1]:
                    done, k, word, now = done + word.whole(), k + 1, Word(self), 0
                if k < len(spans) and at >= spans[k][0]:
                    word.add(c.encode())
                at += 1
            if k < len(spans) and at > spans[k][0]:
                start, stop = spans[k]
                if at < stop <= start + 3 and text[start] == "'":  # "'r" of "'re" is two words
                    now = self._tokens(self._split(text[start:at]))
                else:
                    now = word.whole()
            yield done + now, done + word.least()

    def _beginnings(self, piece: str) -> Iterator[tuple[int, int]]:
        base = 0
        for start, end, special in self._parts(piece):
            total = 0
            body = end - special  # the last character of a special token makes it one token
            inner = max(k for k in (piece.rfind(s, start, end) for s in self.special) if k >= 0) if special else end
            for k, (count, least) in enumerate(self._walk(piece[start:body])):
                if start + k + 1 == inner:
                    total = count
                yield base + count, base + (0 if special else least)
            if special:
                base += total + 1
                yield base, base

    def counts(self, piece: str) -> Iterator[int]:
        """Tokens of the first 1, 2, ... code points."""
        return (count for count, _ in self._beginnings(piece))

    def fitting(self, piece: str, budget: int) -> int:
        """Code points of the longest beginning with at most ``budget`` tokens; stops where no longer one can fit."""
        best = 0
        for k, (count, least) in enumerate(self._beginnings(piece), 1):
            if count <= budget:
                best = k
            elif least > budget:
                break
        return best
