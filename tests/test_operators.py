"""Operators on small fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import stem
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers, chunking, evaluation, fusion, lexical, qa, vectors
from tessera.plans import providers, runtime
from tessera.plans.retriever import Retriever
from tessera.sources import readers, sinks


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "qid int, chunk_id string, score double, rank int")


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_min_max_blend(spark):
    dense = _ranked(spark, [(1, "x", 0.9, 1), (1, "y", 0.5, 2), (1, "z", 0.1, 3)])
    lex = _ranked(spark, [(1, "y", 4.0, 1), (1, "w", 2.0, 2)])
    got = fusion.blend(dense, lex, 10).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == [("y", 0.7), ("x", 0.6), ("w", 0.0), ("z", 0.0)]
    same = _ranked(spark, [(1, "a", 3.0, 1), (1, "b", 3.0, 2)])
    assert {r["score"] for r in fusion.blend(same, lex.limit(0), 10, 1.0).collect()} == {1.0}


def test_rank_fusion(spark):
    a = _ranked(spark, [(1, "x", 0.0, 1), (1, "y", 0.0, 2), (1, "z", 0.0, 3)])
    b = _ranked(spark, [(1, "y", 0.0, 1), (1, "w", 0.0, 2)])
    got = {r["chunk_id"]: round(r["score"], 6) for r in fusion.reciprocal_ranks([a, b]).collect()}
    assert got == {"y": 0.032522, "x": 0.016393, "w": 0.016129, "z": 0.015873}


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "insulin dose insulin"), ("b", "insulin glucose"), ("c", "diet plan sugar glucose")], "chunk_id string, chunk_text string")
    index = lexical.build_index(chunks)
    queries = spark.createDataFrame([(1, "insulin glucose glucose"), (2, '"insulin glucose" glucose'), (3, "unseen"), (4, " ")], "qid int, query string")
    got = {(r["qid"], r["chunk_id"]): round(r["score"], 6) for r in lexical.search(index, queries, 10).collect()}
    assert (got[1, "a"], got[1, "b"], got[1, "c"]) == (0.671434, 1.313245, 0.561961)
    assert got[2, "b"] == pytest.approx(2.5 * got[1, "b"], abs=1e-5) and got[2, "a"] == got[1, "a"]
    assert not any(q in (3, 4) for q, _ in got)


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("c", "")], "chunk_id string, chunk_text string")
    index = lexical.build_index(chunks)
    assert index.corpus.first().asDict() == {"n_docs": 3, "avgdl": pytest.approx(4 / 3)}
    index.save(str(tmp_path))
    queries = spark.createDataFrame([(1, "two")], "qid int, query string")
    again = lexical.LexicalIndex.load(spark, str(tmp_path))
    assert lexical.search(again, queries, 5).collect() == lexical.search(index, queries, 5).collect()


def test_percentiles(spark):
    x = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    r = x.agg(V.nearest_rank(F.col("v"), 50).alias("a"), V.nearest_rank(F.col("v"), 95).alias("b"), V.interpolated(F.col("v"), 0.5).alias("c"), V.interpolated(F.col("v"), 0.95).alias("d"), V.lower_rank(F.col("v"), 50).alias("e")).first()
    assert (r["a"], r["b"], r["c"], round(r["d"], 2), r["e"]) == (3.0, 4.0, 2.5, 3.85, 2.0)
    two = spark.createDataFrame([(10.0,), (20.0,)], "v double")
    assert two.agg(V.nearest_rank(F.col("v"), 50)).first()[0] == 10.0
    assert two.limit(0).agg(V.nearest_rank(F.col("v"), 50)).first()[0] is None


def test_recall_and_mrr(spark):
    rows = [(1, "g1", 1.0, 1), (2, "a", 1.0, 1), (2, "b", 0.9, 2), (2, "g2", 0.8, 3), (3, "a", 1.0, 1)] + [(4, c, 1.0 - i / 10, i + 1) for i, c in enumerate("abcd")] + [(4, "g4", 0.1, 5)]
    golden = spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g3"), (4, "g4")], "qid int, chunk_id string")
    r = evaluation.recall_mrr(_ranked(spark, rows), golden, (3,)).first()
    assert (r["n_queries"], r["recall"], r["mrr"]) == (4, 0.5, 0.333333)
    with pytest.raises(Exception, match="repeat a chunk"):
        evaluation.recall_mrr(_ranked(spark, [(1, "g1", 1.0, 1), (1, "g1", 0.5, 2)]), golden).collect()


def test_filters_are_a_conjunction(spark):
    rows = spark.createDataFrame([("X", "a", 1), ("X", "b", None), ("Y", "a", 3)], "doc_id string, source string, n int")
    got = rows.filter(vectors.matches({"doc_id": "X", "source": ["a", "b"], "n": lambda c: c > 0})).collect()
    assert [(r["doc_id"], r["source"]) for r in got] == [("X", "a")]
    assert rows.filter(vectors.matches({"n": None})).count() == 1


def test_vector_ties_and_metrics(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<float>")
    for strategy in ("expression", "gemm"):
        assert [r["chunk_id"] for r in vectors.dense_topk(v, q, 2, strategy=strategy).orderBy("rank").collect()] == ["a", "b"]
        assert [r["score"] for r in vectors.dense_topk(v, q, 3, "l2", strategy=strategy).orderBy("rank").collect()] == [0.0, 0.0, -2.0]
    with pytest.raises(ValueError):
        vectors.dense_topk(v, q, 1, "hamming")


def test_text_functions(spark):
    assert _one(spark, "a  \r\n\r\n\r\n\r\n\r\nb", T.normalize_text) == "a\n\n\nb\n"
    assert _one(spark, "café été, x²!", T.count_tokens) == 5
    for line, want in (("## Dose ", "Dose"), ("INSULIN THERAPY", "INSULIN THERAPY"), ("INSULIN THERAPY.", None), ("DOSE", None), ("", None)):
        assert _one(spark, line, T.heading) == want and chunking.heading(line or " ") == want
    assert _one(spark, "  see [C1, c2] there  ", T.strip_citations) == "see there"
    assert _one(spark, " [c3] ", T.citation_tag) == "C3"
    assert _one(spark, "x\nSource: https://a.b/c \n", T.source_url) == "https://a.b/c"
    assert _one(spark, "abcdef", lambda c: T.truncate(c, 4)) == "abc..."
    assert _one(spark, "a/b.txt", T.path_key) == "a\\b.txt"
    assert _one(spark, "What is the dose of insulin?", T.keywords) == ["dose", "insulin"]
    long = "x" * 121 + "\nshort\n"
    assert _one(spark, long, lambda c: T.guess_title(c, F.lit("stem"))) == "stem"


def test_porter_published_examples():
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    for word, want in (p.split(":") for p in pairs.split()):
        assert stem.porter(word) == want, word


def test_packing_of_pieces():
    def plan(sizes, target, overlap, most):
        text = " ".join("w" for n in sizes for _ in range(n))
        at, pieces = 0, []
        for n in sizes:
            pieces.append(chunking.Piece(at, at + 2 * n - 1, "", "para"))
            at += 2 * n
        policy = chunking.Policy(target_tokens=target, overlap_tokens=overlap, max_tokens=most)
        starts = {p.start: i for i, p in enumerate(pieces)}
        stops = {p.stop: i for i, p in enumerate(pieces)}
        return [(starts[a], stops[b]) for a, b, _, _ in chunking.pack(pieces, chunking.Tokens(text), policy)]

    assert plan([4, 4, 4, 4], 10, 3, 15) == [(0, 1), (1, 2), (2, 3)]
    assert plan([12, 4], 10, 3, 15) == [(0, 0), (1, 1)]


def test_section_path_and_kinds():
    text = chunking.normalize("# A\n# B\n# C\n# D\n# E\n\n- one\n  more\n- two\n\na | b | c\nd | e | f\n\nplain\n# no heading within\n")
    pieces = chunking.structure(text)
    assert [p.section for p in pieces[:5]] == ["A", "A / B", "A / B / C", "A / B / C / D", "A / B / C / E"]
    assert [p.kind for p in pieces[5:]] == ["bullets", "table", "para"]


def test_tiny_chunks():
    policy = chunking.Policy(min_tokens=200)
    assert len(chunking.chunk_document("d", "s.txt", "one two three four five", policy)) == 1
    assert chunking.chunk_document("d", "s.txt", "one two three\nfour five", policy) == []
    assert len(chunking.chunk_document("d", "s.txt", "WikipediaID: 42\n\nfact one\nand more", policy, facts=True)) == 2
    assert chunking.chunk_document("d", "s.txt", "WikipediaID: 42\n\nfact", policy, facts=True)[0]["doc_id"] == "42"
    assert chunking.chunk_document("d", "s.txt", " \n ", policy) == []


def test_chunks_slice_back_and_keep_the_limit(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(400))
    rows = chunking.chunk_corpus(spark.createDataFrame([("d", "a/b.txt", text), ("e", "c.txt", None)], "doc_id string, source string, text string")).collect()
    body = chunking.normalize(text)
    assert rows and all(body[r["start_offset"] : r["end_offset"]].strip() == r["chunk_text"] for r in rows)
    assert max(r["token_count"] for r in rows) <= 750 and len({r["chunk_id"] for r in rows}) == len(rows)
    paragraphs = "\n\n".join(f"Paragraph {i} has " + "some words " * 30 for i in range(40))
    rows = chunking.chunk_document("d", "s.txt", paragraphs, chunking.Policy())
    assert max(r["token_count"] for r in rows) <= 550 and all(b["start_offset"] < a["end_offset"] for a, b in zip(rows, rows[1:], strict=False))


def test_hard_cut_of_one_long_sentence():
    rows = chunking.chunk_document("d", "s.txt", "word " * 3000, chunking.Policy())
    assert len(rows) > 3 and max(r["token_count"] for r in rows) <= 760


def test_bad_documents_can_be_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff text")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.md").write_text("# T\n")
    (tmp_path / "d.exe").write_text("x")
    got = {r["source"]: r for r in readers.read_documents(spark, str(tmp_path), skip_bad=True).collect()}
    assert set(got) == {"a.txt", "b.docx", "c.md"} and got["a.txt"]["text"] == "good  text" and got["b.docx"]["error"]
    with pytest.raises(Exception):
        readers.read_documents(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="unsupported"):
        readers.extract_text(".exe", b"x")


def test_html():
    html = "<html><head><title>T</title><style>x</style></head><body><main><h1>Big <b>one</b></h1><script>bad</script><p>Para</p><ul><li>a</li><li>b</li></ul></main><p>out</p></body></html>"
    title, text = readers.html_markdown(html, "http://u")
    assert title == "Big one" and text == "Source: http://u\n# Big one\n\n# Big one\n\nPara\n\n- a\n- b\n"
    assert readers.html_markdown("", "u") == ("", "Source: u\n")


def test_manifest_and_ranks(spark):
    lines = spark.createDataFrame([(1, '{"saved_path":"a/x.txt","title":"old"}'), (2, "{bad"), (3, '{"saved_path":"a\\\\x.txt","title":"new","source_url":"u"}')], "line int, value string")
    manifest = readers.read_manifest(lines)
    assert [r["title"] for r in manifest.collect()] == ["new"]
    docs = spark.createDataFrame([("d", "a/x.txt"), ("e", "b/y.md")], "doc_id string, source string")
    assert {r["source"]: (r["title"], r["url"]) for r in readers.with_manifest(docs, manifest).collect()} == {"a/x.txt": ("new", "u"), "b/y.md": ("y", None)}
    ranks = readers.read_ranks(spark.createDataFrame([(1, "q1 : 9"), (2, "q1 : 3, x,1"), (3, "none")], "line int, value string"))
    assert [(r["qid"], r["rank"]) for r in ranks.orderBy("at").collect()] == [("q1", 3), ("q1", 1)]


def test_citation_columns(spark):
    t = spark.createDataFrame([("1", "d", "p", "T", "S", "text", 5)], "id string, document_id string, path string, title string, section string, content string, extra int")
    r = readers.with_citations(t).first()
    assert (r["chunk_id"], r["doc_id"], r["source"], r["url"], r["metadata"]) == ("1", "d", "p", None, {"extra": "5"})
    with pytest.raises(Exception, match="duplicate chunk_id"):
        readers.with_citations(t.union(t)).collect()
    with pytest.raises(Exception, match="is null"):
        readers.with_citations(t.withColumn("title", F.lit(None).cast("string"))).collect()


def test_parse_outputs():
    ok = answers.parse_output('{"mode":"answer","segments":[{"text":"ok [C1]","citations":["[c1]","C1"]}]}', {"C1": "a"})
    assert ok["mode"] == "answer" and ok["segments"] == [{"text": "ok", "citations": ["C1"], "resolved_chunk_ids": ["a"]}] and ok["parse_warnings"] == ["segment_1_visible_citation_tags_removed"]
    assert answers.parse_output('{"mode":"answer","segments":[{"text":"t","citations":["C2"]}]}', {"C1": "a"})["parse_warnings"] == ["segment_1_invalid_tags:C2"]
    for bad in ('{"mode":"abstain","needs":[]}', '{"mode":"answer","segments":[],"x":1}', '{"mode":"answer","segments":[{"text":"","citations":["C1"]}]}', "[]", "", None, '{"mode":"answer","needs":["x"],"segments":[{"text":"a","citations":["C1"]}]}'):
        assert answers.parse_output(bad, {"C1": "a"})["mode"] == "parse_error", bad
    assert "json_wrapped_in_code_fence" in answers.parse_output('```\n{"mode":"abstain","needs":["n"]}\n```', {})["parse_warnings"]
    assert "json_extracted_from_surrounding_text" in answers.parse_output('Sure: {"mode":"abstain","needs":["n"]}', {})["parse_warnings"]


def test_context(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in (1, 2, 3)] + [(1, 4, "user", "q"), (2, 1, "user", " q ")], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r["x"] for r in answers.conversations(turns).select("conv_id", answers.contextual_query(F.col("question"), F.col("history")).alias("x")).collect()}
    assert got == {1: "t2 t3 q", 2: "q"}


def test_abstain(spark):
    queries = spark.createDataFrame([(1, "insulin dose"), (2, "insulin dose"), (3, "other words")], "qid int, query string")
    results = spark.createDataFrame([(1, "a", 0.3, "insulin dose"), (2, "a", 0.9, "insulin dose"), (2, "b", 0.88, "x")], "qid int, chunk_id string, score double, chunk_text string")
    got = {r["qid"]: r["reasons"] for r in answers.abstain(queries, results).collect()}
    assert got == {1: ["top1_below_threshold", "score_gap_too_small"], 2: ["score_gap_too_small"], 3: ["no_retrieved_chunks"]}


def test_answers_end_to_end(spark):
    chunks = spark.createDataFrame([("a", "insulin dose for adults", "T"), ("b", "glucose plan", "U"), ("c", "sugar diet", "V")], "chunk_id string, chunk_text string, title string")
    v = vectors.embed(chunks, providers.hashed_embedding(16))
    asked = spark.createDataFrame([(1, "insulin dose")], "qid int, query string")
    q = vectors.embed(asked.select(F.col("qid").cast("string").alias("chunk_id"), F.col("query").alias("chunk_text")), providers.hashed_embedding(16))
    queries = asked.join(q.select(F.col("chunk_id").cast("int").alias("qid"), "embedding"), "qid")
    r = Retriever(chunks, v, lexical.build_index(chunks))
    assert [x["chunk_id"] for x in r.reranked(queries, 3).orderBy("rank").collect()][0] == "a"
    assert {x["chunk_id"] for x in r.dense(queries, 3, {"title": ["U", "V"]}).collect()} == {"b", "c"}

    def generate(system, user):
        if "PREVIOUS INVALID OUTPUT" not in user:
            return "not json"
        return '{"mode":"answer","segments":[{"text":"It is.","citations":["C1"]}]}'

    assert r.answer(queries, generate).first()["answer"] == "It is."
    assert r.answer(queries, generate, repair=False).first()["answer"] == answers.PARSE_ERROR_MESSAGE
    scored = fusion.rerank_model(fusion.hydrate(r.hybrid(queries, 3).drop("score"), chunks).join(asked, "qid"), providers.overlap_scorer, 2)
    assert scored.orderBy("rank").first()["chunk_id"] == "a"


def test_hydration_misses_are_errors(spark):
    with pytest.raises(Exception, match="no chunk"):
        fusion.hydrate(_ranked(spark, [(1, "gone", 1.0, 1)]), spark.createDataFrame([("a", "t")], "chunk_id string, chunk_text string")).collect()


def test_runtime():
    cache = runtime.Cache(2)
    for k in "abac":
        cache.get(k, lambda k=k: k)
    assert cache.stats() == {"hits": 1, "misses": 3, "size": 2, "capacity": 2}
    assert runtime.config_hash({"b": 1, "a": 2}) == runtime.config_hash({"a": 2, "b": 1})
    assert runtime.health({"x": lambda: True, "y": None})["status"] == "degraded"
    assert runtime.health({"y": None}, ("y",))["status"] == "error"
    assert runtime.valid_request(" ", 0, None) == ["query is blank", "top_k must be 1 to 20"]
    waits, answers_ = [], iter([TimeoutError(), b'{"a": 1}'])

    def send():
        x = next(answers_)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.post_json("u", {}, send=send, sleep=waits.append) == {"a": 1} and waits == [0.5]


def test_ladder_file(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 0.5, 0.4, 9)], "run_tag string, recall_at_5 double, mrr double, other int")
    for _ in range(2):
        sinks.append_ladder(rows, str(tmp_path / "ladder"))
    back = spark.read.csv(str(tmp_path / "ladder"), header=True)
    assert back.columns == list(sinks.LADDER) and back.count() == 2 and back.first()["notes"] is None


def test_qa(spark):
    chunks = spark.createDataFrame([(str(i), "Repeated footer line\nown " + "x" * i) for i in range(25)], "chunk_id string, chunk_text string")
    assert [(r["line"], r["n"]) for r in qa.repeated_lines(chunks).collect()] == [("Repeated footer line", 25)]
    assert qa.fingerprint(chunks).first() == qa.fingerprint(chunks.repartition(7)).first()
    assert qa.set_fingerprint(chunks).first() == qa.set_fingerprint(chunks.repartition(7)).first()


def test_results_do_not_depend_on_partitions(spark):
    rows = [(str(i), f"word{i % 7} word{i % 5} same") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string")
    queries = spark.createDataFrame([(1, "word1 same"), (2, "word3")], "qid int, query string")
    a = lexical.search(lexical.build_index(chunks.repartition(1)), queries, 5).orderBy("qid", "rank").collect()
    b = lexical.search(lexical.build_index(chunks.repartition(9)), queries, 5).orderBy("qid", "rank").collect()
    assert a == b


def test_stream_of_requests(spark, tmp_path):
    from tessera.streaming.metrics import windowed_metrics

    log = spark.createDataFrame([(f"2024-01-01 0{h}:30:00", "answer", 10.0) for h in range(4)], "t string, mode string, total_ms double").select(F.to_timestamp("t").alias("ts"), "mode", "total_ms")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = windowed_metrics(stream).writeStream.outputMode("append").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3  # the last window is still open
    assert windowed_metrics(log).count() == 4
