"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read


#: Target shares of expected tokens, and how much staying near rate 1 counts against them.
MIXTURE = {"high": 0.90, "low": 0.07, "toxic": 0.03}
RIDGE = 5e-5
#: The same in the pipeline, whose first stage has taken most documents of the lesser domains away: half of what is left of
#: the toxic ones. Asking for the others' former shares would repeat the few that are left many times over.
AFTER_QUALITY, STAGE_RIDGE = {"high": 0.995, "toxic": 0.005}, 1e-3


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies: under $TESSERA_TOKENIZERS, or in the installed collection."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import by_document, repeated_lines

    documents = read(spark, sf_dir, "documents")
    return by_document(documents, repeated_lines(documents, exact_words=1))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_spans, span_digest

    return span_digest(repeated_spans(read(spark, sf_dir, "documents")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(read(spark, sf_dir, "documents")).drop("text_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import sanitize, span_digest

    return span_digest(sanitize(read(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, the domain posteriors by name, and the rate to six decimals."""
    from .mixing import mix, quality_domains

    rates, report = mix(read(spark, sf_dir, "documents"), quality_domains(read(spark, sf_dir, "labels")), MIXTURE, ridge=RIDGE)
    shares = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(report["domains"])]
    return rates.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import digest, encode

    return digest(encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op8_pii": op8_pii,
    "op7_packing": op7_packing,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_piece_codec": op11_piece_codec,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}
#: Components by reachability, which SQL can afford on small tables.
_REACHED = "r(id, root) AS (SELECT id, id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a)"

_UNITS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n_line FROM documents),
starts AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n_line) - length(line) - 1 AS line_at FROM lines),
cut AS (SELECT doc_id, n_line, line_at, string_split(regexp_replace(line, '([.!?]+)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM starts),
parts AS (SELECT doc_id, n_line, line_at, unnest(parts) AS part, generate_subscripts(parts, 1) AS n_part FROM cut),
placed AS (SELECT *, line_at + sum(length(part)) OVER (PARTITION BY doc_id, n_line ORDER BY n_part) - length(part) AS part_at FROM parts),
units AS (SELECT doc_id, part_at + length(part) - length(regexp_replace(part, '^\s+', '')) AS start, part_at + length(regexp_replace(part, '\s+$', '')) AS stop,
  lower(trim(regexp_replace(part, '\s+', ' ', 'g'))) AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY n_line, n_part) AS idx FROM placed WHERE regexp_matches(part, '\S')),
seen AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, idx) > 1 AS again, len(string_split(unit, ' ')) AS words FROM units),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM seen WHERE again),
spans AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, sum(words) AS words, count(*) AS n FROM runs GROUP BY doc_id, run)"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_REACHED},
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = id AS kept FROM c LEFT JOIN n ON a = id""",
    "op2_line_dedup": rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, doc_id * 1000000 + line_no AS place, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM lines),
k AS (SELECT *, array_to_string(w, ' ') AS k FROM w WHERE len(w) > 0), d AS (SELECT k, any_value(w) AS w, min(place) AS place FROM k GROUP BY k),
i AS (SELECT k, w, place, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5), v AS (SELECT k, place, i, array_to_string(list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), ' ') AS v FROM i),
near AS (SELECT a.k FROM v a JOIN v b ON a.i = b.i AND a.v = b.v AND a.k <> b.k AND b.place < a.place UNION SELECT a.k FROM v a JOIN d b ON a.v = b.k AND len(b.w) >= 5 AND b.place < a.place
  UNION SELECT b.k FROM v a JOIN d b ON a.v = b.k AND len(b.w) >= 5 AND a.place < b.place),
found AS (SELECT k.doc_id, k.line_no, n.k IS NOT NULL AS near FROM k JOIN d ON d.k = k.k LEFT JOIN near n ON n.k = k.k WHERE n.k IS NOT NULL OR d.place < k.place),
g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (near) AS n_near, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed_lines FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(removed_lines, '') AS removed_lines FROM documents LEFT JOIN g USING (doc_id)""",
    "op3_substring_dedup": f"""WITH {_UNITS},
u AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (again) AS n_repeated FROM seen GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS removed_chars, count(*) FILTER (words >= 20) AS n_passages, string_agg(start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_spans, 0) AS n_spans, coalesce(removed_chars, 0) AS removed_chars, coalesce(n_passages, 0) AS n_passages, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN u USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "op4_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
x AS (SELECT id, unnest(s) AS t FROM v), n AS (SELECT id, len(s) AS n FROM v),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE 100 * common >= 75 * (m.n + o.n - common)), {_REACHED}
SELECT r.id AS doc_id, any_value(n.n)::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN n ON n.id = r.id GROUP BY r.id""",
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w FROM documents),
g AS (SELECT lang, d, unnest(list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(list_slice(w, i, i + d - 1), ' '))) AS phrase FROM p, range(1, 6) t(d)),
f AS (SELECT lang, d, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, d, phrase HAVING count(*) >= 100), n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT f.*, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, d), ' ') AS y FROM f, range(1, 5) t(k) WHERE d > 1 AND k < d),
s AS (SELECT c.lang, c.d, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = m.lang AND f.d > m.d AND f.a >= m.a AND contains(' ' || f.phrase || ' ', ' ' || m.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000""",
    "op13_divergence": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT row, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT row) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v))::BIGINT AS p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) JOIN v USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 50""",
}
