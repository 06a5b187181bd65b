"""Byte-level BPE by pre-token: a proven table of whole tokens first, the tokenizer's own merges for the rest.

A byte-level BPE cuts a text into pre-tokens by a fixed pattern and merges within each pre-token alone, so a text's
ids are its pre-tokens' ids in order. `whole_tokens` proves, with the library itself, which vocabulary strings are
one pre-token and encode alone as one token; these are looked up. Any other pre-token is merged once and remembered in
a table of bounded size.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pre-token pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which all Unicode versions, and the two classes below, agree; other texts go to the library whole.
STABLE = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-Ƞ‐-‧‰-⁞₠-€]*+")
#: The same pattern with the classes of `re`, equal on stable code points and faster.
_find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_gap = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search
#: Characters that the faster library cuts by itself, at most.
LONGEST = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable bytes as themselves, others from 256 on."""
    plain = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer") or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path} is no plain byte-level BPE")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, spec


def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _pre_token_strings(path: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token of stable code points."""
    _, spec = _load(path)
    letters, added = byte_letters(), {a["content"] for a in spec["added_tokens"]}
    found: dict[str, int] = {}
    for written, i in spec["model"]["vocab"].items():
        try:
            text = bytes(letters[c] for c in written).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if written not in added and STABLE.fullmatch(text) and _find(text) == [text]:
            found[text] = i
    return found


@functools.lru_cache(maxsize=4)
def _proof(path: str) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Vocabulary strings that the library encodes, alone, as just their own id; and the ids of those it does not."""
    names = _pre_token_strings(path)
    ids = dict(zip(names, _ids(_load(path)[0], list(names)), strict=True))
    return {t: i for t, i in names.items() if ids[t] == [i]}, {t: ids[t] for t, i in names.items() if ids[t] != [i]}


def whole_tokens(path: str) -> dict[str, int]:
    """The proven table: strings that count one token wherever they are a pre-token."""
    return _proof(path)[0]


@functools.lru_cache(maxsize=4)
def merger(path: str):
    """The merges of the same vocabulary in a faster library, or None where they need not be equal.

    That library merges by the rank of the merged token and takes a piece that is itself in the vocabulary whole. The
    first is the same where merges are listed in the order of the tokens they make, without gaps; the second is
    proven by there being no vocabulary string that the tokenizer's own library encodes otherwise.
    """
    import tiktoken

    _, spec = _load(path)
    model, letters = spec["model"], byte_letters()
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))) or _proof(path)[1]:
        return None
    added = {a["content"] for a in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = 1 << 18) -> Iterator[str]:
    """Cut a long text where a pre-token must begin: at a space between two ASCII letters."""
    begin = 0
    while len(text) - begin > size:
        cut = _gap(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


class Texts:
    """Tells which texts are decided by pre-tokens; the others are encoded whole by the library."""

    def __init__(self, path: str):
        self.tokenizer, spec = _load(path)
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.faster = merger(path)

    def plain(self, text: str) -> bool:
        """No special string in it, and only stable code points."""
        return STABLE.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def ids(self, text: str) -> list[int]:
        if self.faster is None or not self.plain(text):
            return _ids(self.tokenizer, [text])[0]
        return [i for part in stretches(text) for i in self._merged_ids(part)]

    def _merged_ids(self, part: str) -> list[int]:
        """The faster library steps back through white space and breaks off after a million steps: what `stretches` left
        longer than `LONGEST` is cut into pre-tokens here."""
        if len(part) <= LONGEST:
            return self.faster.encode_ordinary(part)
        merge = self.faster._core_bpe.encode_single_piece
        return [i for t in _find(part) for i in merge(t.encode())]


class Counter(Texts):
    """Counts tokens by the whole-token shortcut."""

    def __init__(self, path: str, limit: int = 1_200_000):
        super().__init__(path)
        self.limit = limit
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        self.known = dict(self.whole)

    def _merged(self, tokens: list[str]) -> list[int]:
        if self.faster is None:
            return list(map(len, _ids(self.tokenizer, tokens)))
        merge = self.faster._core_bpe.encode_single_piece
        return [len(merge(t.encode())) for t in tokens]

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(_ids(self.tokenizer, [text])[0])
        total = 0
        for part in stretches(text):
            tokens = _find(part)
            missing = set(tokens).difference(self.known)
            if missing:
                if len(self.known) + len(missing) > self.limit + len(self.whole):
                    self.known = dict(self.whole)  # what was remembered saves time only
                    missing = set(tokens).difference(self.known)
                names = list(missing)
                self.known.update(zip(names, self._merged(names), strict=True))
            total += sum(map(self.known.__getitem__, tokens))
        return total
