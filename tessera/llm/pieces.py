"""A SentencePiece model of the BPE kind: its character map, its merges and its decoding, with offsets kept throughout.

A text is normalised by the compiled character map: at each place the longest key that matches is replaced, and every
character made remembers the byte of the text it came from. Merges then work on the normalised text, and each piece is
projected back to the bytes it covers.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from array import array
from itertools import chain

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of a protobuf message: integers, four bytes as they are, or byte strings."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys and the strings they are replaced by."""

    def __init__(self, blob: bytes = b""):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.made = blob[4 + size :]
        self.firsts = self._firsts()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> tuple[int, bool] | None:
        """The node that a byte leads to, and whether a key ends there."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        if unit & 0x800000FF != byte:
            return None
        return at ^ self._offset(unit), bool(unit & 0x100)

    def _firsts(self) -> set[int]:
        """First bytes of keys: characters that begin with another byte stay as they are."""
        return {b for b in range(1, 256) if self._child(self._offset(self.units[0]), b)} if self.units else set()

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a place, and what it becomes."""
        if not self.units:
            return None
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            step = self._child(node, text[i])
            if step is None:
                break
            node, ends = step
            if ends:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.made[best[1] : self.made.index(b"\0", best[1])]


def _starts(text: str) -> np.ndarray:
    """Byte offset of each character, and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    sizes = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])


class Normalizer:
    """Text to (normalised text, for each of its characters and its end the byte of the text it came from)."""

    def __init__(self, spec: bytes, user_defined: list[str] = ()):
        told = dict(fields(spec))
        self.map = CharMap(told.get(2, b""))
        self.dummy, self.strip, self.escape = (bool(told.get(n, 1)) for n in (3, 4, 5))
        self.defined = re.compile("|".join(map(re.escape, sorted(user_defined, key=len, reverse=True)))) if user_defined else None
        self.identity = not self.map.units and not self.strip

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        if self.identity:  # only spaces change, one character for one
            head = (SPACE if self.escape else " ") if self.dummy else ""
            starts = _starts(text)
            return head + (text.replace(" ", SPACE) if self.escape else text), np.concatenate([starts[:1], starts]) if head else starts
        return self._general(text)

    def _general(self, text: str) -> tuple[str, np.ndarray]:
        data, out, source = text.encode(), [], []
        space = SPACE if self.escape else " "
        at, spaced, begun = 0, self.strip, False
        while at < len(data):
            made, size = self._one(data, at)
            if not begun and not (self.strip and made == " "):  # leading spaces go before the mark of the beginning is set
                begun = True
                if self.dummy:
                    out.append(space)
                    source.append(at)
            if begun:
                while spaced and made.startswith(" "):
                    made = made[1:]
                if made:
                    out.append(made.replace(" ", space))
                    source += [at] * len(made)
                    spaced = made.endswith(" ")
                spaced = spaced and self.strip
            at += size
        norm = "".join(out)
        if self.strip:
            kept = len(norm.rstrip(space))
            if kept < len(norm):
                at = source[kept]
                norm, source = norm[:kept], source[:kept]
        return norm, np.array([*source, at if begun or not self.strip else 0], dtype=np.int64)

    def _one(self, data: bytes, at: int) -> tuple[str, int]:
        """What stands at a place, normalised, and the bytes it took."""
        lead = data[at]
        if self.defined is not None:
            m = self.defined.match(data[at : at + 1024].decode(errors="ignore"))
            if m:
                return m.group(), len(m.group().encode())
        if lead in self.map.firsts:
            found = self.map.longest(data, at)
            if found:
                return found[1].decode(), found[0]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size].decode(), size


class _Known(dict):
    """Parts met, each as (id, characters) pairs of 32-bit integers: made when first asked for, all forgotten at `limit`."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, part: str) -> bytes:
        value = array("i", chain.from_iterable(zip(*self.make(part), strict=True))).tobytes()
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()  # what was remembered saves time only
            self[part] = value
        return value


class Pieces:
    """Encodes and decodes exactly as the library does without sampling and without begin and end ids.

    No piece joins a character other than the space mark to a space mark after it, so a text is cut before each run of
    marks and the parts are merged by themselves; a text is left whole where a vocabulary has such pieces. Parts met are
    remembered up to `limit`.
    """

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next((v for n, v in model if n == 2), b"")))
        denormalizer = dict(fields(next((v for n, v in model if n == 5), b"")))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or denormalizer.get(2):
            raise ValueError(f"{path} is no BPE model with spaces before words")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for n, v in model:
            if n == 1:
                told = dict(fields(v))
                self.pieces.append(told[1].decode())
                scores.append(struct.unpack("<f", told[2])[0] if 2 in told else 0.0)
                self.kinds.append(told.get(3, NORMAL))
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = {p: -scores[i] for p, i in self.ids.items()}
        self.names = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k not in (NORMAL, USER_DEFINED, UNUSED)}
        self.byte_ids = [self.names[f"<0x{b:02X}>"] for b in range(256)] if self.byte_fallback else []
        self.unused = {p for p, i in self.ids.items() if self.kinds[i] == UNUSED}
        defined = [p for p, i in self.ids.items() if self.kinds[i] == USER_DEFINED]
        self.defined = re.compile("(" + "|".join(map(re.escape, sorted(defined, key=len, reverse=True))) + ")") if defined else None
        self.normalize = Normalizer(next((v for n, v in model if n == 3), b""), defined)
        self.named = {**self.ids, **self.names}.get
        across = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:])) or defined
        self.parts = (lambda s: [s]) if across else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.known = _Known(self._part, limit)
        self._surfaces()

    # -- encoding

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals, until no two make a piece."""
        get, none = self.scores.get, np.inf
        found = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            symbols[i] += symbols.pop(i + 1)
            found.pop(i)
            if i < len(found):
                found[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                found[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge(self, symbols: list[str], frozen: set[int] = frozenset()) -> list[str]:
        """The same for many symbols, with a heap; also where some are frozen, or pieces made are marked unused."""
        if len(symbols) <= 256 and not frozen and not self.unused:
            return self._merge_short(symbols)
        scores, joined = self.scores, {}
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a in frozen or b in frozen:
                return
            both = symbols[a] + symbols[b]
            score = scores.get(both)
            if score is not None:
                heapq.heappush(heap, (score, a, b, both))
                if both in self.unused:
                    joined[both] = symbols[a], symbols[b]

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(both):
                continue  # one of them was merged since
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return list(chain.from_iterable(self._resegment(s, joined) for s in symbols if s)) if joined else [s for s in symbols if s]

    def _resegment(self, piece: str, joined: dict) -> list[str]:
        """A piece that is marked unused falls back into the two it was made of."""
        if piece not in self.unused or piece not in joined:
            return [piece]
        return [p for half in joined[piece] for p in self._resegment(half, joined)]

    def _ids(self, pieces: list[str]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids and the number of characters each covers; of the bytes of an unknown character the last covers it."""
        named = list(map(self.named, pieces))
        if None not in named:
            return tuple(named), tuple(map(len, pieces))
        ids, sizes = [], []
        for p, i in zip(pieces, named, strict=True):
            if i is not None:
                ids.append(i)
                sizes.append(len(p))
            elif self.byte_fallback:
                data = p.encode()
                ids += [self.byte_ids[b] for b in data]
                sizes += [0] * (len(data) - 1) + [len(p)]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(p)  # unknown characters side by side are one
            else:
                ids.append(self.unknown)
                sizes.append(len(p))
        return tuple(ids), tuple(sizes)

    def _part(self, part: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        if self.defined is None:
            return self._ids(self._merge(list(part)))
        symbols, frozen = [], set()
        for n, s in enumerate(self.defined.split(part)):
            if n % 2:
                frozen.add(len(symbols))
            symbols += [s] if n % 2 else list(s)
        return self._ids(self._merge(symbols, frozen))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the end byte of the text that each piece covers."""
        norm, source = self.normalize(text)
        pairs = np.frombuffer(b"".join(map(self.known.__getitem__, self.parts(norm))), dtype=np.int32).reshape(-1, 2)
        ids, ends = pairs[:, 0], np.cumsum(pairs[:, 1])
        if not self.byte_fallback and len(ids) > 1:  # unknown characters side by side in two parts are one
            lone = np.flatnonzero((ids[1:] != self.unknown) | (ids[:-1] != self.unknown)) + 1
            ids, ends = ids[np.concatenate([[0], lone])], np.concatenate([ends[lone - 1], ends[-1:]])
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        starts = source[begins]
        stops = source[ends]
        return ids, starts, np.where(ends == begins, starts, stops)

    # -- decoding

    def _surfaces(self) -> None:
        out: list[bytes] = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            out.append(b"" if k == CONTROL else self.unknown_surface.encode() if i == self.unknown else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode())
        self.surfaces = out

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Of the pieces before any text, one leading space goes (all go where the model strips
        spaces); bytes make the characters that they can, and each other byte a replacement character."""
        surfaces, kinds, head = self.surfaces, self.kinds, []
        n = 0
        if self.normalize.dummy or self.normalize.strip:
            for i in ids:  # up to the first piece that is no control piece
                n += 1
                if kinds[i] == CONTROL:
                    continue
                if kinds[i] == BYTE:
                    n -= 1
                    break
                s = surfaces[i]
                if self.pieces[i].startswith(SPACE) and i != self.unknown:
                    s = s[1:]
                    if self.normalize.strip and not s:
                        continue
                head.append(s)
                break
        data = b"".join(head) + b"".join(map(surfaces.__getitem__, ids[n:]))
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(data)

    @staticmethod
    def _decode_bytes(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """One model a worker."""
    return Pieces(path)
