"""Token counts of any stretch of a text by a byte-level merge vocabulary, without encoding the stretch."""

from __future__ import annotations

import base64
import bisect
import functools
from itertools import accumulate

import regex

#: Fixed value: the pre-token pattern that goes with byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def installed(name: str) -> str:
    """Where a vocabulary file of the installed collection lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """Ranks of byte strings, from a file of lines `base64 rank`. Pre-tokens counted are remembered, up to `limit`."""

    def __init__(self, path: str, pattern: str = PATTERN, limit: int = 500_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.limit = limit

    def size(self, piece: str) -> int:
        """Tokens of one pre-token."""
        n = self.known.get(piece)
        if n is None:
            n = self._merge(piece.encode())
            if len(self.known) >= self.limit:
                self.known.clear()  # what was remembered saves time only
            self.known[piece] = n
        return n

    def _merge(self, data: bytes) -> int:
        """Merge neighbours, the least rank first and the leftmost of equals, until no two make a token."""
        get, none = self.ranks.get, float("inf")
        if get(data) is not None:
            return 1
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            found.pop(i)
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], none)
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], none)
        return len(parts)

    def count(self, text: str, start: int = 0, stop: int | None = None) -> int:
        """Tokens of a stretch, encoded by itself."""
        return sum(self.size(m.group()) for m in self.find.finditer(text, start, len(text) if stop is None else stop))


class VocabularyTokens:
    """Counts stretches of one text from prefix sums of its pre-tokens' sizes.

    Pre-tokens follow from where the last one ended and from what comes after. A stretch is cut by itself from its beginning
    up to where one of its pre-tokens ends where one of the text ends; from there on both are the same, up to the last
    two before its end, which are cut anew, as the end may change them. What lies between is one subtraction.
    """

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.text, self.vocabulary = text, vocabulary
        found = list(vocabulary.find.finditer(text))
        self.ends = [0, *(m.end() for m in found)]
        self.places = {e: i for i, e in enumerate(self.ends)}
        self.sums = [0, *accumulate(vocabulary.size(m.group()) for m in found)]

    def count(self, start: int, stop: int) -> int:
        if stop <= start:
            return 0
        total, at = 0, start
        last = max(0, bisect.bisect_right(self.ends, stop - 2) - 2)  # index of a place that the end cannot reach
        if at not in self.places:
            for m in self.vocabulary.find.finditer(self.text, start, stop):
                total += self.vocabulary.size(m.group())
                at = m.end()
                if at in self.places:
                    break
            else:
                return total
        first = self.places[at]
        if last > first:
            total += self.sums[last] - self.sums[first]
            at = self.ends[last]
        return total + self.vocabulary.count(self.text, at, stop)


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str = PATTERN) -> Vocabulary:
    """One vocabulary a worker."""
    return Vocabulary(path, pattern)
