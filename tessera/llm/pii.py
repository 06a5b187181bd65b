"""Personal data: exact spans by pattern, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_CLASS, may_hold, table, texts, tidy
from .components import components
from .spans import let, replaced, running

# The patterns of the four kinds. Possessive quantifiers and the look-behinds change no match; they keep
# matching linear in the text and free of recursion.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: The entities that stand for a whole kind, and for personal data of any kind.
WHOLE = (*KINDS, "any")
_SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"
#: What lies between the words of a text once their outer punctuation is taken off. A run of punctuation is looked at once.
BETWEEN = r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]*+(?:\s[^\p{L}\p{N}]*+|$)"
#: The same of a single word.
OUTER = r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"



def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_extract(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), "^[0-9]{1,4}$", 0).cast("int"), F.lit(999)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    if kind == "card":
        figure = lambda i: F.substring(F.reverse(digits), i + F.lit(1), F.lit(1)).cast("int")
        doubled = lambda i: F.when(i % 2 == 0, figure(i)).otherwise(figure(i) * 2 - F.when(figure(i) > 4, 9).otherwise(0))
        luhn = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), F.lit(0), lambda a, i: a + doubled(i))
        return F.when((n >= 16) & (n <= 19), luhn % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def _located(text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """(start, value) of every match, or of those that `keep` (value, number) chooses: matches and what lies between them,
    whose lengths (in code points) add up to positions."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def places(matches: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(matches) - 1)
        chosen = numbers if keep is None else F.filter(numbers, lambda i: keep(F.get(matches, i), i))

        def found(own: Column, gap: Column) -> Column:
            lengths = F.zip_with(F.slice(gap, F.lit(1), F.size(matches)), matches, lambda g, m: g + F.length(m))
            return F.zip_with(own, running(lengths, lambda a, b: a + b, own), lambda i, at: F.struct((at + F.get(gap, i)).alias("start"), F.get(matches, i).alias("value")))

        none = F.array().cast("array<struct<start:int,value:string>>")
        return F.when(F.size(matches) > 0, let(chosen, lambda own: F.when(F.size(own) > 0, let(gaps, lambda gap: found(own, gap))).otherwise(none))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _span(kind: str | Column, start: Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"))


def _found(text: Column, kind: str) -> Column:
    """Valid spans of one kind."""
    # the cheap conditions spare most texts the search
    hint = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}[kind]
    good = F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(hint, F.transform(good, lambda s: _span(kind, s["start"], s["value"]))).otherwise(F.array().cast(_SPANS))


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, base: the valid spans of the four kinds, by kind as listed, then start."""
    return texts(documents).withColumn("base", F.concat(*[_found(F.col("text"), k) for k in KINDS]))


def _rows(documents: DataFrame) -> DataFrame:
    """`base_spans`, with two hashes of each text by which results find its row again."""
    return base_spans(documents).select("doc_id", "text", "base", F.xxhash64("text").alias("d0"), F.xxhash64(F.lit("second"), "text").alias("d1"))


def _in_order(text: Column) -> Column:
    """A text's lower-cased words without their outer punctuation; words of punctuation alone are left out."""
    return F.split(F.lower(text), BETWEEN)


def _terms(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def entities(span: Column) -> Column:
    """What a span tells: its value and the family that recurs where the value does not (mail domain, /16 network, first six
    digits of a card, first four of a telephone number)."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    family = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4)))
    return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit(" family:"), family))


def _copies(texts: DataFrame, bands: int = 16) -> DataFrame:
    """(id, group) for those of the distinct texts (id, w: words in order) that are near copies of another.

    Two texts are near copies if their sets of three-word shingles have a Jaccard similarity of a half; groups are closed
    under that. Candidates share one of `bands` pairs of least hashes with the least id of that pair (at a similarity of
    a half with probability 0.99), and are then compared shingle by shingle.
    """
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))
    sets = table(texts.select("id", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, F.lit(3))))).alias("set")), "shingles")
    least = sets.select("id", F.explode("set").alias("s")).groupBy("id").agg(*[F.min(F.xxhash64(F.lit(k), "s")).alias(f"h{k}") for k in range(2 * bands)])
    keys = table(least.select("id", F.explode(F.array(*[F.xxhash64(F.lit(k), f"h{2 * k}", f"h{2 * k + 1}") for k in range(bands)])).alias("key")), "bands")
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    links = keys.join(first, "key").filter("id <> first").select("id", "first").distinct()
    both = links.join(sets, "id").join(sets.select(F.col("id").alias("first"), F.col("set").alias("other")), "first")
    shared = F.size(F.array_intersect("set", "other"))
    return components(both.filter(shared * 3 >= F.size("set") + F.size("other")).select("id", "first"), "id", "first").withColumnRenamed("component", "group")


def _pairs(rows: DataFrame, min_together: int) -> tuple[DataFrame, float]:
    """(entity, n_e, term, n_et, apart) of entities and terms that meet in `min_together` texts that are no near copies,
    and the logarithm of the number of pairs that were looked at.

    n_e and n_et count documents; `apart` counts texts, one of each group of near copies that holds the entity.
    Entities of a whole kind are columns of one row a term, so that their many documents' words are summed once.
    """
    with_base = rows.filter(F.size("base") > 0).groupBy("d0", "d1").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("base").alias("base"))
    own = F.array_distinct(F.flatten(F.transform("base", entities)))
    held = table(with_base.select(F.col("d0").alias("id"), "copies", _in_order(F.col("text")).alias("w"), own.alias("entities"), F.array_distinct(F.transform("base", lambda s: s["kind"])).alias("kinds")), "held")
    if len(held.select("id").take(min_together)) < min_together:
        return held.limit(0).select(F.lit("").alias("entity"), F.lit(0).cast("long").alias("n_e"), F.lit("").alias("term"), F.lit(0).cast("long").alias("n_et"), F.lit(0).cast("long").alias("apart")), 0.0
    groups = table(held.select("id").join(_copies(held), "id", "left").select("id", F.coalesce("group", "id").alias("group")), "groups")
    sized = table(held.select("id", "copies", "entities", "kinds", F.size(_terms(F.col("w"))).alias("n")).join(groups, "id"), "sized")
    # the first text of each group speaks for it
    each = sized.select("id", "copies", "group", "n", F.explode("entities").alias("entity"))
    several = each.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count_distinct("group").alias("groups")).filter(F.col("groups") >= min_together)
    each = each.join(several.drop("groups"), "entity")
    speaks = each.groupBy("entity", "group").agg(F.min("id").alias("id")).select("entity", "id", F.lit(True).alias("speaks"))
    each = table(each.join(speaks, ["entity", "id"], "left").select("entity", "n_e", "id", "copies", "n", F.coalesce("speaks", F.lit(False)).alias("speaks")), "each")
    low = each.join(held.select("id", _terms(F.col("w")).alias("terms")), "id").select("entity", "n_e", "copies", "speaks", F.explode("terms").alias("term"))
    low = low.groupBy("entity", "n_e", "term").agg(F.sum("copies").alias("n_et"), F.count_if("speaks").alias("apart"))
    kinds = sized.select("id", "copies", "group", "n", F.explode(F.concat("kinds", F.array(F.lit("any")))).alias("kind"))
    first = kinds.groupBy("kind", "group").agg(F.min("id").alias("id"))
    speakers = first.groupBy("id").agg(F.collect_set("kind").alias("speaks"))
    whole = held.join(speakers, "id", "left").select("copies", F.concat("kinds", F.array(F.lit("any"))).alias("kinds"), F.coalesce("speaks", F.array().cast("array<string>")).alias("speaks"), F.explode(_terms(F.col("w"))).alias("term"))
    whole = whole.groupBy("term").agg(*[F.struct(F.sum(F.when(F.array_contains("kinds", k), F.col("copies")).otherwise(0)).alias("n_et"), F.count_if(F.array_contains("speaks", k)).alias("apart")).alias(k) for k in WHOLE])
    counted = kinds.groupBy("kind").agg(F.sum("copies").alias("n_e"))  # five rows at most
    whole = whole.select("term", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.n_et").alias("n_et"), F.col(f"{k}.apart").alias("apart")) for k in WHOLE])).alias("k")).select("term", "k.*")
    whole = whole.filter(F.col("apart") >= min_together).join(F.broadcast(counted), "kind").select(F.col("kind").alias("entity"), "n_e", "term", "n_et", "apart")
    looked = each.filter("speaks").agg(F.sum("n").alias("n")).unionAll(kinds.join(first, ["kind", "group", "id"]).agg(F.sum("n"))).agg(F.sum("n")).first()[0]
    return table(low.filter(F.col("apart") >= min_together).unionByName(whole), "pairs"), math.log(max(looked or 0, 2))


def disclosing_terms(rows: DataFrame, alpha: float, min_together: int) -> DataFrame:
    """(entity, term, bits) of the terms that disclose an entity.

    Entities are protected values, their families (`entities`), each kind of personal data, and any of them. With p(.)
    estimated as shares of all documents, a term t discloses an entity e if
    * their pointwise mutual information reaches `alpha` times the information content of e, that is
      log p(e,t)/(p(e)p(t)) >= -alpha log p(e), which says p(e|t) >= p(e)^(1-alpha);
    * more of its documents hold e than do not: p(e|t) > 1/2;
    * they meet in at least `min_together` texts that are no near copies of each other (`_copies`); and
    * so many such texts are no chance: with q = p(e|t), those texts times the divergence of (q, 1-q) from
      (p(e), 1-p(e)) a meeting reach the logarithm of the number of pairs looked at, so that of terms independent of
      all entities less than one is expected to pass in the whole corpus.
    Terms are lower-cased words stripped of outer punctuation, of three characters or more.
    """
    pairs, looked = _pairs(rows, min_together)
    words = rows.select(F.explode(_terms(_in_order(F.col("text")))).alias("term"))
    wanted = table(pairs.select("term").distinct(), "wanted")
    # words are counted where they lie; what is shuffled is each task's distinct words that may be wanted
    n_term = may_hold(words, "term", wanted, "term").groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    total = rows.agg(F.count("*").alias("total"))
    p, q = F.col("n_e") / F.col("total"), F.col("n_et") / F.col("n_t")
    information = -F.log(p)
    against = F.when(q < 1, (1 - q) / q * F.log((1 - q) / (1 - p))).otherwise(0.0)
    told = pairs.join(n_term, "term").crossJoin(F.broadcast(total))  # total is one row
    enough = (p < 1) & (q > 0.5) & (F.log(q / p) >= alpha * information) & (F.col("apart") * (F.log(q / p) + against) >= looked)
    return told.filter(enough).select("entity", "term", F.log2(q / p).alias("bits"))


def _placed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))


def _remaining(text: Column, base: Column) -> Column:
    """The text with base spans overwritten, so that no word is found in them."""
    return replaced(text, _placed(base), lambda s: F.repeat(F.lit("\x01"), s["stop"] - s["start"]))


def _announced(rest: Column, listed: Column) -> Column:
    """The distinct words of three characters or more that follow a listed term, words of punctuation alone skipped. What
    stands behind a base span is not announced by what stands before it."""
    bare = lambda w: F.when(w.contains("\x01"), "\x01").otherwise(F.regexp_replace(w, OUTER, ""))
    words = F.filter(F.transform(F.regexp_extract_all(F.lower(rest), F.lit(WORD_CLASS), F.lit(0)), bare), lambda w: w != "")

    def after(w: Column) -> Column:
        cues = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(listed, F.get(w, i)))
        next_words = F.transform(cues, lambda i: F.coalesce(F.get(w, i + 1), F.lit("")))
        return F.array_distinct(F.filter(next_words, lambda v: (F.length(v) >= 3) & ~F.array_contains(listed, v)))

    return let(words, lambda w: F.when(F.size(w) > 1, after(w)).otherwise(F.array().cast("array<string>")))


def disclosed_values(rows: DataFrame, marked: DataFrame, alpha: float) -> DataFrame:
    """(d0, d1, values) of texts: the words that a disclosing term announces there and that disclose the announcement.

    Being announced is an entity like any other: with c the documents in which a disclosing term announces a word and p(.)
    shares of all documents, a word v discloses it if p(c|v) >= p(c)^(1-alpha) and p(c|v) > 1/2, p(c|v) being the share of v's
    documents in which it is announced. A password or key that stands nowhere else passes, however often its document
    was copied; a common word that happens to follow a term does not. Words that fail by the texts with a term alone,
    which bound the share from above, are not counted in the others. `marked` has d0, d1, copies, announced, words.
    """
    each = table(marked.select("d0", "d1", "copies", F.explode("announced").alias("value")), "announced")
    told = each.groupBy("value").agg(F.sum("copies").alias("n_cv"))
    near = marked.select("copies", F.explode("words").alias("value")).groupBy("value").agg(F.sum("copies").alias("n_near"))
    told = table(told.join(near, "value", "left").filter(F.col("n_cv") > 0.5 * F.coalesce("n_near", F.lit(0))).select("value", "n_cv"), "candidates")
    words = rows.select(F.explode(_terms(_in_order(F.col("text")))).alias("value"))
    n_value = may_hold(words, "value", told, "value").groupBy("value").agg(F.count("*").alias("n_v")).join(told, "value")
    total, spoken = rows.agg(F.count("*").alias("total")), marked.filter(F.size("announced") > 0).agg(F.sum("copies").alias("n_c"))
    share = F.col("n_cv") / F.greatest("n_v", "n_cv")
    p = F.col("n_c") / F.col("total")
    alike = n_value.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(spoken))  # one row each
    passed = table(alike.filter((share > 0.5) & (F.log(share) >= (1 - alpha) * F.log(p))).select("value"), "values")
    return each.join(passed, "value").groupBy("d0", "d1").agg(F.collect_set("value").alias("values"))


def _term_spans(text: Column, base: Column, listed: Column, values: Column) -> Column:
    """Spans of the listed terms and values in what the base spans leave of a text, by kind, then start."""
    bare = lambda w: F.regexp_replace(w, OUTER, "")

    def find(rest: Column, low: Column) -> Column:
        both = F.concat(listed, values)
        hits = _located(rest, WORD_CLASS, lambda _, i: F.array_contains(both, bare(F.get(low, i))))
        lead = lambda w: F.length(F.regexp_extract(w, r"^[^\p{L}\p{N}]*+", 0))
        kind = lambda w: F.when(F.array_contains(listed, bare(F.lower(w))), "term").otherwise(F.lit("value"))
        return F.array_sort(F.transform(hits, lambda w: _span(kind(w["value"]), w["start"] + lead(w["value"]), bare(w["value"]))))

    return let(_remaining(text, base), lambda rest: let(F.regexp_extract_all(F.lower(rest), F.lit(WORD_CLASS), F.lit(0)), lambda low: find(rest, low)))


@tidy
def sanitize(documents: DataFrame, alpha: float = 0.8, min_together: int = 3) -> DataFrame:
    """Spans of personal data in every whole text, their sanitised text, and terms that disclose them.

    The four pattern kinds give the base spans, which always stay. Words that disclose a protected entity
    (`disclosing_terms`, estimated over all documents) are added as spans of the kind "term" wherever they stand outside
    base spans, also in documents that don't name the entity, as they tell it there too. What such a term announces, such as
    the key after `token =`, is a span of the kind "value" (`disclosed_values`), at each place in that document.
    `sanitised` generalises base spans and values to their kind in brackets and removes terms.

    Built-in expressions only. Texts are scanned for the patterns twice, for the counts and for the result, which costs less
    than a written copy of them; words are split once for the counts, and twice more if a term discloses something. Possessive patterns, sums by blocks and cuts
    from blocks keep the work on a text of n characters with m spans near n + m^1.5. Corpus counts are summed before they
    are shuffled. Documents with one text are held as one with a count.

    Returns doc_id, text, base, terms (arrays of kind, start, stop, value; code points, stop exclusive), sanitised. A
    null text counts as empty and has no spans. Repeated rows and null ids are kept as they are; other columns are left
    out; an empty table gives an empty result.
    """
    rows = _rows(documents)
    told = table(disclosing_terms(rows, alpha, min_together).select("term").distinct(), "disclosing")
    if told.isEmpty():
        hit = rows.limit(0).select("d0", "d1", *[F.array().cast("array<string>").alias(c) for c in ("listed", "values")])
    else:
        words = rows.select("d0", "d1", F.explode(_terms(_in_order(F.col("text")))).alias("term"))
        hit = may_hold(words, "term", told, "term").join(told, "term").groupBy("d0", "d1").agg(F.collect_set("term").alias("listed"))
        hit = table(hit, "listed")
        texts_hit = rows.join(hit, ["d0", "d1"]).groupBy("d0", "d1").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("text", "base", "listed")])
        marked = table(texts_hit.select("d0", "d1", "copies", _announced(_remaining(F.col("text"), F.col("base")), F.col("listed")).alias("announced"), _terms(_in_order(F.col("text"))).alias("words")), "marked")
        hit = hit.join(disclosed_values(rows, marked, alpha), ["d0", "d1"], "left").select("d0", "d1", "listed", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    joined = rows.join(table(hit, "hit"), ["d0", "d1"], "left")
    terms = F.when(F.col("listed").isNotNull(), _term_spans(F.col("text"), F.col("base"), F.col("listed"), F.col("values"))).otherwise(F.array().cast(_SPANS))
    out = joined.select("doc_id", "text", "base", terms.alias("terms"))
    name = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    return out.select("doc_id", "text", "base", "terms", replaced(F.col("text"), _placed(F.concat("base", "terms")), name).alias("sanitised"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_digest(sanitized: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, all spans written as kind:start:end, and their number."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "terms")
    return sanitized.select("doc_id", *map(n, KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
