"""Documents to token-budgeted, overlapping chunks. Each document is independent, so nothing is shuffled."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.plans.ship import ship_package

SCHEMA = (
    "chunk_id string, doc_id string, source string, title string, url string, section_path string, chunk_index int, start_offset int, "
    "end_offset int, token_count int, checksum string, chunk_text string, page_start int, page_end int, error string"
)

_TOKEN = re.compile(r"\w+|[^\w\s]")
_HEADING = re.compile(r"#{1,6}\s+(.+)")
_BULLET = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Policy:
    version: str = "v1"
    target_tokens: int = 550
    overlap_tokens: int = 80
    min_tokens: int = 200
    max_tokens: int = 750


#: For corpora of one fact a paragraph.
FACTS = Policy(target_tokens=280, overlap_tokens=60, min_tokens=100, max_tokens=420)


@dataclass(frozen=True)
class Piece:
    start: int
    stop: int
    section: str
    kind: str


class Tokens:
    """Token counts of any stretch of one text by bisection in the tokens' places. A stretch that begins or ends
    within a word counts that word's part."""

    def __init__(self, text: str):
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.stops = [a for a, _ in spans], [b for _, b in spans]

    def count(self, start: int, stop: int) -> int:
        return max(0, bisect.bisect_left(self.starts, stop) - bisect.bisect_right(self.stops, start))


def normalize(text: str) -> str:
    lines = [line.rstrip() for line in re.sub(r"\r\n?", "\n", text).split("\n")]
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip() + "\n"


def heading(line: str) -> str | None:
    s = line.strip()
    if m := _HEADING.fullmatch(s):
        return m[1].strip()
    letters = [c for c in s if c.isalpha()]
    if len(letters) >= 8 and len(s) <= 80 and s[-1] not in ".!?;" and sum(map(str.isupper, letters)) > 0.6 * len(letters):
        return s
    return None


def _kind(line: str) -> str:
    if not line.strip():
        return "blank"
    if heading(line) is not None:
        return "heading"
    return "bullets" if _BULLET.match(line) else "table" if line.count("|") >= 2 else "para"


def structure(text: str) -> list[Piece]:
    """Headings, bullet lists, tables and paragraphs. A list goes on over bullets and lines indented by two, a table
    over rows, a paragraph up to a blank line. The section path is the first three headings and the latest."""
    goes_on = {
        "heading": lambda line: False,
        "bullets": lambda line: bool(_BULLET.match(line)) or line.startswith("  "),
        "table": lambda line: line.count("|") >= 2,
        "para": lambda line: True,
    }
    pieces: list[Piece] = []
    path: list[str] = []
    at, open_kind = 0, None
    for raw in text.splitlines(keepends=True):
        line, start, at = raw.rstrip("\n"), at, at + len(raw)
        if not line.strip():
            open_kind = None
        elif open_kind and goes_on[open_kind](line):
            last = pieces[-1]
            pieces[-1] = Piece(last.start, at, last.section, last.kind)
        else:
            open_kind = _kind(line)
            if open_kind == "heading":
                path = [*path[:3], heading(line)]
            pieces.append(Piece(start, at, " / ".join(path), open_kind))
    return pieces


def _windows(text: str, piece: Piece, tokens: Tokens, most: int) -> list[Piece]:
    """Cut by characters, at the tokens-per-character rate of the piece, at a space if one lies in the last two fifths."""
    n, size = tokens.count(piece.start, piece.stop), piece.stop - piece.start
    if n <= most:
        return [piece]
    width, out, at = int(max(1.0, size / max(1, n)) * most), [], piece.start
    while at < piece.stop:
        cut = min(piece.stop, at + width)
        if cut < piece.stop:
            space = text.rfind(" ", at, cut)
            cut = space if space > at + int(width * 0.6) else cut
        out.append(Piece(at, cut, piece.section, piece.kind))
        at = cut
    return out


def fit(text: str, piece: Piece, tokens: Tokens, most: int) -> list[Piece]:
    """The piece in parts of at most `most` tokens: paragraphs by whole sentences where they allow it."""
    if tokens.count(piece.start, piece.stop) <= most:
        return [piece]
    if piece.kind != "para":
        return _windows(text, piece, tokens, most)
    gaps = [m.span() for m in _SENTENCE_END.finditer(text, piece.start, piece.stop)]
    starts = [piece.start, *(b for _, b in gaps)]
    stops = [*(a for a, _ in gaps), piece.stop]
    sentences = [(a, b) for a, b in zip(starts, stops, strict=True) if a < b]
    if len(starts) < 2:
        return _windows(text, piece, tokens, most)
    groups: list[list[int]] = []
    for a, b in sentences:
        if groups and tokens.count(groups[-1][0], b) <= most:
            groups[-1][1] = b
        else:
            groups.append([a, b])
    return [w for a, b in groups for w in _windows(text, Piece(a, b, piece.section, piece.kind), tokens, most)]


def pack(pieces: list[Piece], tokens: Tokens, policy: Policy) -> list[tuple[int, int, str, int]]:
    """(start, stop, section, tokens) of chunks: as many pieces as the target holds, and at least one. The next chunk
    goes back over the fewest last pieces that make the overlap, but ahead by one piece at least."""
    chunks, first = [], 0
    while first < len(pieces):
        begin = pieces[first].start
        last = first
        while last + 1 < len(pieces) and tokens.count(begin, pieces[last + 1].stop) <= min(policy.target_tokens, policy.max_tokens):
            last += 1
        stop = pieces[last].stop
        chunks.append((begin, stop, pieces[first].section, tokens.count(begin, stop)))
        if last + 1 == len(pieces):
            break
        back = last
        while back > first and tokens.count(pieces[back].start, stop) < policy.overlap_tokens:
            back -= 1
        first = max(back, first + 1)
    return chunks


def chunk_document(doc_id: str, source: str, text: str, policy: Policy, title: str | None = None, url: str | None = None, facts: bool = False, vocabulary: V.Vocabulary | None = None) -> list[dict]:
    """Chunk rows of one document. Blank chunks, and chunks of several lines below `min_tokens`, are dropped after they
    are numbered, so numbers may have gaps; `facts` makes one chunk of each piece and drops none for its size. Tokens are
    those of `vocabulary`, or else words and marks."""
    text = normalize(text)
    if not text.strip():
        return []
    first = next((s for line in text.splitlines() if (s := line.strip())), "")
    marked = _HEADING.fullmatch(first)
    stem = re.sub(r"\.[^./\\]*$", "", re.split(r"[/\\]", source)[-1])
    title = title or (marked[1].strip() if marked else first if first and len(first) <= 120 else stem)
    link = re.search(r"(?im)^[ \t]*Source:\s*(https?://\S+)[ \t]*$", text)
    if facts and (wiki := re.search(r"(?im)^[ \t]*WikipediaID:\s*(\d+)[ \t]*$", text)):
        doc_id = wiki[1]
    tokens = V.VocabularyTokens(text, vocabulary) if vocabulary else Tokens(text)
    pieces = [part for p in structure(text) for part in fit(text, p, tokens, policy.max_tokens)]
    plan = [(p.start, p.stop, p.section, tokens.count(p.start, p.stop)) for p in pieces] if facts else pack(pieces, tokens, policy)
    rows = []
    for i, (start, stop, section, n) in enumerate(p for p in plan if p[3] or not facts):
        body = text[start:stop].strip()
        if not body or (not facts and n < policy.min_tokens and "\n" in body):
            continue
        checksum = hashlib.sha1(body.encode()).hexdigest()
        key = "|".join((policy.version, doc_id, section, str(start), str(stop), checksum))
        rows.append({
            "chunk_id": hashlib.sha1(key.encode()).hexdigest()[:16], "doc_id": doc_id, "source": source, "title": title, "url": url or (link[1] if link else None),
            "section_path": section, "chunk_index": i, "start_offset": start, "end_offset": stop, "token_count": n, "checksum": checksum, "chunk_text": body,
            "page_start": None, "page_end": None, "error": None,
        })
    return rows


def chunk_corpus(documents: DataFrame, policy: Policy | None = None, facts: bool = False, skip_bad: bool = False, vocabulary: str | None = None, pattern: str = V.PATTERN) -> DataFrame:
    """Chunks of documents (doc_id, source, text; title and url where they have them).

    A document that fails ends the job, or with `skip_bad` gives one row with only doc_id, source and the error. Sizes are
    tokens of the file `vocabulary` (lines of base64 and rank, readable on every node, with its pre-token pattern); without
    one, words and marks are counted.
    """
    ship_package(documents.sparkSession)
    policy = policy or (FACTS if facts else Policy())
    optional = [F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("title", "url")]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = V.load(vocabulary, pattern) if vocabulary else None
        for batch in (b.iloc[i : i + 200] for b in batches for i in range(0, len(b), 200)):  # bounds the chunks that a worker holds
            rows: list[dict] = []
            for d in batch.itertuples(index=False):
                try:
                    rows += chunk_document(d.doc_id, d.source, d.text, policy, d.title, d.url, facts, known)
                except Exception as e:
                    if not skip_bad:
                        raise
                    rows.append({"doc_id": d.doc_id, "source": d.source, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in ("chunk_index", "start_offset", "end_offset", "token_count", "page_start", "page_end")})

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"), *optional).mapInPandas(run, SCHEMA)
