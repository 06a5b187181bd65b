"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, as a Java class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
ASCII_WORD = "[A-Za-z0-9]+"
# What begins a list item and what is a row of a table.
BULLET = r"^\s*([-*•]|(\d+[\.\)]))\s+"
TABLE_ROW = r".*\|.*\|.*"

# Words that are no keywords.
NO_KEYWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "while",
    "is", "are", "was", "were", "be", "been", "being",
    "to", "of", "in", "on", "for", "from", "with", "as", "at", "by", "into", "about",
    "it", "this", "that", "these", "those",
    "i", "you", "we", "they", "he", "she", "them", "his", "her", "our", "your",
    "what", "why", "how", "who", "whom", "which",
    "do", "does", "did", "doing",
    "can", "could", "should", "would", "may", "might", "must",
)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Unix line ends, no trailing space on lines, two blank lines in a row at most, one final line end."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(t, r"^\s+|\s+\z", ""), F.lit("\n"))


def count_tokens(text: Column) -> Column:
    """Words, and marks that belong to no word, counted one each."""
    return F.regexp_count(text, F.lit(WORD_OR_MARK))


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order. Found before they are lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)), F.lower)


def without_words(tokens: Column, words: list[str]) -> Column:
    """Tokens not in a word list; repetitions stay."""
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def keywords(query: Column) -> Column:
    """Lower-cased tokens of three letters or more that are no function words."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*NO_KEYWORDS))


def phrases(query: Column) -> Column:
    """Double-quoted parts."""
    return F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))


def contains_sequence(tokens: Column, wanted: Column) -> Column:
    """Whether `wanted` (not empty) stands in `tokens` without gaps."""
    n, m = F.size(tokens), F.size(wanted)
    starts = F.when((m > 0) & (m <= n), F.sequence(F.lit(1), n - m + 1))
    return F.coalesce(F.exists(starts, lambda i: F.slice(tokens, i, m) == wanted), F.lit(False))


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+", -1)


def heading(line: Column) -> Column:
    """The heading that a line is: a markdown heading's text, or a short line mostly in capitals; else null."""
    s = strip(line)
    marked = F.regexp_extract(s, r"^(#{1,6})\s+(.+)$", 2)
    letters, capitals = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    loud = (F.length(s) <= 80) & ~s.rlike(r"[.!?;]$") & (letters >= 8) & (capitals / letters > 0.6)
    return F.when(marked != "", strip(marked)).when((s != "") & loud, s)


def guess_title(normalized: Column, stem: Column) -> Column:
    """From the first line with text: its heading, or itself up to 120 characters; else the file's stem."""
    first = strip(F.regexp_extract(normalized, r"(?m)^.*\S.*$", 0))
    marked = F.regexp_extract(first, r"^(#{1,6})\s+(.+)$", 2)
    return F.when(marked != "", strip(marked)).when((first != "") & (F.length(first) <= 120), first).otherwise(stem)


def source_url(normalized: Column) -> Column:
    """Of the first line `Source: http...`; null without one."""
    found = F.regexp_extract(normalized, r"(?im)^[ \t]*Source:\s*(https?://\S+)[ \t]*$", 1)
    return F.when(found != "", found)


def wikipedia_id(normalized: Column) -> Column:
    found = F.regexp_extract(normalized, r"(?im)^[ \t]*WikipediaID:\s*(\d+)[ \t]*$", 1)
    return F.when(found != "", found)


def truncate(text: Column, limit: int) -> Column:
    """Stripped; beyond `limit` characters cut one short of it, and three dots added."""
    if limit <= 0:
        return F.lit("")
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit - 1)), rf"{SPACE}+$", ""), F.lit("...")))


def preview(text: Column, limit: int) -> Column:
    """One line, with an ellipsis where it is cut."""
    t = F.regexp_replace(strip(text), "\n", " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit - 1)), rf"{SPACE}+$", ""), F.lit("…")))


def squeeze(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def strip_citations(text: Column) -> Column:
    """Without visible tags such as [C1, C2]."""
    return squeeze(F.regexp_replace(text, r"(?i)\[(C\d+(?:\s*,\s*C\d+)*)\]", ""))


def citation_tag(tag: Column) -> Column:
    """Upper case, without brackets."""
    t = strip(F.coalesce(tag, F.lit("")))
    return F.upper(F.when(t.rlike(r"^\[.+\]$"), strip(F.regexp_extract(t, r"^\[(.*)\]$", 1))).otherwise(t))


def path_key(path: Column) -> Column:
    """One form for paths of any system: trimmed, back slashes."""
    return F.replace(strip(path), F.lit("/"), F.lit("\\"))


def chunk_id(version: Column | str, doc_id: Column, section: Column, start: Column, stop: Column, text: Column) -> Column:
    """Sixteen hexadecimal digits that depend on policy, document, place and content."""
    version = F.lit(version) if isinstance(version, str) else version
    return F.left(F.sha1(F.concat_ws("|", version, doc_id.cast("string"), section, start.cast("string"), stop.cast("string"), F.sha1(text))), F.lit(16))


def prefixed(text: Column, prefix: str, limit: int) -> Column:
    """With an instruction in front, cut to `limit` characters in all."""
    return F.concat(F.lit(prefix), F.left(text, F.lit(max(0, limit - len(prefix)))))
