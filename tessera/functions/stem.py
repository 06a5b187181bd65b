"""Porter's stemmer of 1980, from its published rules, for distinct words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ship import ship_package

# The suffix tables of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_MEASURE = re.compile("vc")
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_RUNS.sub(r"\1", _shape(stem))))


def _cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _by_table(word: str, table: list[tuple[str, str]]) -> str:
    fits = [(s, r) for s, r in table if word.endswith(s)]
    if fits:
        suffix, new = max(fits, key=lambda x: len(x[0]))
        stem = word[: -len(suffix)]
        if _measure(stem) > 0:
            return stem + new
    return word


# Words that the extended variant stems by a table.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _short(word: str, extended: bool) -> bool:
    """Whether a stem is short, so that it takes an e: consonant, vowel, consonant, or (extended) a vowel and a consonant."""
    return _cvc(word) or (extended and _shape(word) == "vc")


def _plural(w: str, extended: bool) -> str:
    if extended and w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str, extended: bool) -> str:
    if extended and w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    suffix = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
    if suffix is None:
        return w
    w = w[: -len(suffix)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _double(w):
        return w[:-1] if w[-1] not in "lsz" else w
    return w + "e" if _measure(w) == 1 and _short(w, extended) else w


def _final_y(w: str, extended: bool) -> str:
    stem = w[:-1]
    turns = len(stem) > 1 and _shape(stem)[-1] == "c" if extended else "v" in _shape(stem)
    return stem + "i" if w.endswith("y") and turns else w


def _second(w: str, extended: bool) -> str:
    if not extended:
        return _by_table(w, _STEP2)
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2], True)
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        return w[:-1]
    return _by_table(w, [x for x in _STEP2 if x[0] not in ("abli", "alli")] + [("bli", "ble"), ("fulli", "ful")])


def porter(word: str, extended: bool = False) -> str:
    """The stem of a lower-case word; words of two letters or fewer are their own.

    By the algorithm as it was published in 1980, or with the extensions that later implementations added: irregular words,
    four-letter words in -ies and -ied, y after any consonant, and the endings -bli, -fulli and -logi.
    """
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _final_y(_past(_plural(word, extended), extended), extended)
    w = _by_table(_second(w, extended), _STEP3)
    fits = [s for s in _STEP4 if w.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        stem = w[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1], extended)):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: DataFrame, column: str = "term", extended: bool = False) -> DataFrame:
    """(term, stem) of the distinct values of a column: only the vocabulary crosses to Python."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "stem": [porter(w, extended) for w in b["term"]]})

    return words.select(F.col(column).alias("term")).filter("term is not null").distinct().mapInPandas(run, "term string, stem string")


@functools.lru_cache(maxsize=100_000)
def _known(word: str, extended: bool) -> str:
    return porter(word, extended)


def stem_lists(rows: DataFrame, column: str, extended: bool = False) -> DataFrame:
    """The rows with the words of a list column replaced by their stems, where the rows lie: nothing is shuffled, and a batch's
    distinct words are stemmed once."""
    ship_package(rows.sparkSession)
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            words = lists.flatten().dictionary_encode()
            stemmed = pa.array([_known(w, extended) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), stemmed)
            yield pa.RecordBatch.from_arrays([made if n == column else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in types.items()))
