"""Splitting, normalising, resolving, graph upserts, selection, cache, streams and the engine."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.engine import Engine, NotReady, UnknownJob
from tessera.functions import fixed
from tessera.operators import answer, chunking, graph, plugins, relations, resolution, retrieval, vectors
from tessera.sources import documents as sources
from tessera.streaming import upserts

TEXT = "Axon4j is a Database. Axon4j supports Cypher. The Graph Store uses Axon4j. GraphStore contains Chunks. Axon4J provides Search."


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=300), st.integers(1, 40), st.integers(0, 20))
def test_recursive_pieces_fit_and_cover(text, size, overlap):
    overlap = min(overlap, size - 1)
    pieces = chunking.split_recursively(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    rest = text
    for p in pieces:
        assert p in text
    assert set(text) - set(" \n") == set("".join(pieces)) - set(" \n"), rest


def test_fixed_windows_cover(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randrange(0, 400)))) for i in range(30)] + [(99, None), (100, "   ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in chunking.fixed_windows(df, 50, 10).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.text))
    for i, t in texts:
        want = [(s, t[s : s + 50]) for s in range(0, len(t or ""), 40) if t[s : s + 50].strip()]
        assert got.get(i, []) == want
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.fixed_windows(df, *bad)


def test_registry_grows_in_order(spark):
    rows = [(1, 0, "a", "", "b"), (1, 1, "a", "the_system_that_was_used", "b"), (1, 2, " a ", "quantum links", "b"), (1, 3, "a", "quantum links", "b"), (1, 4, "a", "Uses", "b"), (2, 0, "a", "quantum links", "b")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, subject string, relation string, object string")
    got = {(r.doc_id, r.pos): (r.relation, r.method) for r in relations.normalise(df, plugins.embed_string).collect()}
    assert got == {
        (1, 0): ("related_to", "fallback_empty"),
        (1, 1): ("related_to", "fallback_invalid"),
        (1, 2): ("quantum_links", "new_canonical"),
        (1, 3): ("quantum_links", "semantic_match"),
        (1, 4): ("uses", "exact_mapping"),
        (2, 0): ("quantum_links", "new_canonical"),
    }


TRIPLES = [(0, "Axon4j", "is_a", "database"), (1, "axon4j", "supports", "Cypher"), (2, "Graph Store", "uses", "Axon4j"), (3, "GS", "uses", "Axon4j"), (4, "Axon4j", "supports", "cypher"), (5, "Axon4j", "supports", "Cypher")]


def test_resolution(spark):
    df = spark.createDataFrame(TRIPLES, "pos long, subject string, relation string, object string")
    every = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    out, names, decisions, f = resolution.resolve(df, every)
    method = {frozenset((r.x.name, r.y.name)): r.method for r in decisions.collect()}
    assert method[frozenset(("Axon4j", "axon4j"))] == "exact"
    assert method[frozenset(("Graph Store", "GS"))] == "acronym"
    assert method[frozenset(("Axon4j", "database"))] == "identity_conflict"
    canonical = {r.name: r.canonical for r in names.collect()}
    assert canonical["axon4j"] == "Axon4j" and canonical["database"] == "database"
    assert {(r.subject, r.relation) for r in out.collect()} == {("Axon4j", "is_a"), ("Axon4j", "supports"), (canonical["GS"], "uses")}
    shuffled = resolution.features(df.repartition(5)).orderBy("first_seen").collect()
    assert shuffled == f.orderBy("first_seen").collect()
    empty = resolution.resolve(df.limit(0), every)
    assert [t.count() for t in empty] == [0, 0, 0, 0]


def test_pair_scorer_and_review(spark):
    df = spark.createDataFrame([("borderline", 0.9, 80.0, 0.6, 0.1, 0.8, 1, 2), ("borderline", 0.9, 60.0, 0.4, 0.1, 0.8, 1, 3)], "method string, semantic double, lexical double, token double, context double, combined double, p long, q long")
    df = df.select("*", F.lit(False).alias("merge"), F.struct(F.col("p").alias("first_seen")).alias("x"), F.struct(F.col("q").alias("first_seen")).alias("y"))
    out = resolution.cross_accept(df, lambda p: p.withColumn("cross_encoder", F.when(F.col("q") == 2, 0.9).otherwise(0.75)))
    assert {r.q: r.method for r in out.collect()} == {2: "cross_encoder", 3: "cross_encoder_rejected"}
    seen = resolution.review(out, lambda p: p.withColumn("same", F.lit(True)).withColumn("confidence", F.lit(0.95)))
    assert [(r.q, r.merge) for r in seen.collect()] == [(3, True)]
    assert {r.method for r in resolution.cross_accept(df, None).collect()} == {"cross_encoder_unavailable"}


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(3)]) for i in range(9)] + [(9, None)], "vec_id long, embedding array<float>")
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(rows, k=3).collect()}
    assert pairs == {(a, b) for a in range(9) for b in range(9) if a != b and a % 3 == b % 3}
    assert vectors.similar_pairs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.top_k(rows, [1.0, 0.0, 0.0], 0)
    chunks = spark.createDataFrame([("f", i, f"t{i}") for i in range(1, 6)], "source_file string, chunk_id long, text string")
    hits = chunks.filter("chunk_id = 1").withColumn("score", F.lit(1.0))
    assert [(r.chunk_id, r.is_neighbor) for r in vectors.expand_neighbours(hits, chunks).collect()] == [(1, False), (2, True)]
    assert vectors.expand_neighbours(hits, chunks, top=0).count() == 1 and vectors.expand_neighbours(hits.limit(0), chunks).count() == 0
    with pytest.raises(ValueError):
        vectors.expand_neighbours(hits, chunks, radius=-1)


def test_graph_and_selection(spark):
    t = spark.createDataFrame([(0, " a ", "uses", "b", "f1"), (1, "b", "part of", "c", "f2"), (2, "a", "Uses", "b", "f3"), (3, "", "x", "c", "f"), (4, "c", "uses", "a", "f"), (5, "a", "is", "a", "f")], "pos long, subject string, relation string, object string, source_file string")
    e = graph.edges(t)
    assert {tuple(r) for r in e.collect()} == {("a", "USES", "b"), ("b", "PART_OF", "c"), ("c", "USES", "a"), ("a", "IS", "a")}
    n = {r.name: r.source_file for r in graph.nodes(t).collect()}
    assert n == {"a": "f1", "b": "f1", "c": "f2"}
    seeds = spark.createDataFrame([("a",)], "name string")
    found = [(r.entities, r.relationships) for r in graph.paths(e, seeds).collect()]
    assert all(len(set(x)) == len(x) and ("a" in (x[0], x[-1])) for x, _ in found) and len(found) == 4
    ranked = retrieval.rank_paths(graph.paths(e, seeds), seeds, "who uses b?", 2)
    chosen = retrieval.select_greedily(ranked, "who uses b?", 2).collect()
    assert [r["rank"] for r in chosen] == [1, 2] and chosen[0].text == "a USES b"
    names, links = answer.payload(retrieval.select_greedily(ranked, "who uses b?", 9))
    assert names.count() == 3 and links.count() == 3
    assert graph.violations(t, "subject").count() == 1


def test_cache(spark, tmp_path):
    good = '{"cache_version":3,"source_file":"s","file_hash":"h","chunk_size":10,"overlap":2,"total_chunks":1,"chunks":[{"chunk_id":1,"text":"x","status":"success","triples":[{"subject":"a","relation":"r","object":"b"}]}]}'
    flat = '{"cache_version":1,"source_file":"t","file_hash":"k","chunk_size":10,"overlap":2,"total_chunks":2,"chunks":[{"chunk_id":1,"text":"x","status":"failed","triples":[]}],"triples":[{"subject":"c","relation":"r","object":"d"}]}'
    for i, text in enumerate((good, flat, "{broken", "[]")):
        (tmp_path / f"{i}.json").write_text(text)
    rows = sources.read_processed(spark, str(tmp_path)).filter("source_file is not null")
    assert {r.source_file: r.complete for r in sources.is_complete(rows).collect()} == {"s": True, "t": False}
    assert {(r.source_file, r.subject) for r in sources.triples_of(rows).collect()} == {("s", "a"), ("t", "c")}
    wanted = rows.select("file_hash", "chunk_size", "overlap", "total_chunks")
    assert [r.source_file for r in sources.compatible(rows, wanted).collect()] == ["s"]
    files = sources.files(spark, str(tmp_path), lambda raw: ["", raw.decode()[:3], " "]).collect()
    assert len(files) == 4 and all(len(r.file_hash) == 64 and len(r.text) <= 3 for r in files)


def test_extraction_retries(spark):
    waits = []

    def fail(_):
        raise RuntimeError("429 quota")

    assert plugins.with_retries(fail, "x", sleep=waits.append) == (None, "429 quota") and waits == [4.0, 8.0]
    df = spark.createDataFrame([(1, 1, TEXT), (1, 2, " ")], "doc_id long, chunk_id int, text string")
    out = {r.chunk_id: r for r in plugins.extract(df).collect()}
    assert out[2].status == "success" and out[2].triples == [] and ("Axon4j", "supports", "Cypher") in [tuple(t) for t in out[1].triples]
    bad = plugins.extract(df, fail, attempts=1).filter("chunk_id = 1").first()
    assert bad.status == "failed" and bad.error == "429 quota"


def test_embedders_agree(spark):
    df = spark.createDataFrame([("Axon4j stores 5.9 graphs",), ("",)], "t string")
    for r in df.select("t", plugins.hashed_embedding(F.col("t")).alias("v")).collect():
        assert r.v == pytest.approx(plugins.embed_string(r.t))


@pytest.mark.parametrize("draft, reply, fix, keep, want", [("fine", "", "", True, ("fine", "NOT_RUN")), ("Insufficient evidence", "UNSUPPORTED", "new", True, ("new", "UNSUPPORTED")), ("no information", "SUPPORTED", "new", True, ("no information", "SUPPORTED")), ("no information", "??", " ", True, ("no information", "NEEDS_CORRECTION")), ("no information", "??", " ", False, (" ", "NEEDS_CORRECTION"))])
def test_answer_states(draft, reply, fix, keep, want):
    out = answer.answer("q", "c", lambda q, c: draft, lambda q, c, d: reply, lambda q, c, d: fix, keep)
    assert (out["answer"], out["validation_status"]) == want


def test_streams(spark, tmp_path):
    chunks = spark.createDataFrame([("f", 1, " one "), ("f", 2, " "), ("f", None, "x")], "source_file string, chunk_id long, text string")
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    upserts.upsert_chunks(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    chunks.limit(1).withColumn("text", F.lit("two")).write.mode("append").parquet(str(tmp_path / "in"))
    upserts.upsert_chunks(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.chunk_key, r.text) for r in upserts.chunks_at(spark, str(tmp_path / "out")).collect()] == [("f::1", "two")]
    upserts.compact(upserts.chunks_at(spark, str(tmp_path / "out")), str(tmp_path / "small"))
    assert upserts.chunks_at(spark, str(tmp_path / "small")).first().text == "two"
    facts = spark.createDataFrame([("a", "uses", "b"), ("a", "uses", "b")], "subject string, relation string, object string")
    facts.write.parquet(str(tmp_path / "facts"))
    upserts.upsert_edges(spark.readStream.schema(facts.schema).parquet(str(tmp_path / "facts")), str(tmp_path / "edges"), str(tmp_path / "ck2")).awaitTermination()
    assert [tuple(r) for r in upserts.edges_at(spark, str(tmp_path / "edges")).collect()] == [("a", "USES", "b")]


def test_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "FEW", 10)
    rng = random.Random(4)
    rows = [(f"n{i:03d}", [rng.choice((0.0, 0.6, 0.8)) for _ in range(4)]) for i in range(100)]
    odd = [("short", [1.0]), ("null", None), ("part", [1.0, None, 0.0, 0.0]), ("nan", [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    got = {}
    for r in vectors.similar_pairs(spark.createDataFrame(rows + odd, "vec_id string, embedding array<double>"), k=4, threshold=0.5).collect():
        got.setdefault(r.a, set()).add((r.b, r.similarity))
    for name, v in rows:
        best = sorted((-round(sum(x * y for x, y in zip(v, w)), 6), other) for other, w in rows)[:4]
        assert got.get(name, set()) == {(o, -s) for s, o in best if o != name and -s >= 0.5}
    assert not set(got) & {"short", "null", "part", "nan", None}


def test_sinks(spark, tmp_path):
    triple = "array<struct<subject:string,relation:string,object:string>>"
    chunks = spark.createDataFrame([("f", 2, "two", "failed", "boom", []), ("f", 1, "one", "success", None, [("a", "r", "b"), ("", "r", "c")])], f"source_file string, chunk_id int, text string, status string, error string, triples {triple}")
    kept = spark.createDataFrame([("f", 1, 0, "a", "related_to", "b")], "source_file string, chunk_id int, pos long, subject string, relation string, object string")
    documents = spark.createDataFrame([("f", 6, 10, 2), ("g", 0, 10, 2)], "source_file string, total_characters long, chunk_size int, overlap int")
    sources.save_normalised(kept, chunks, documents, "hashed", str(tmp_path / "n"))
    out = {r.source_file: r for r in spark.read.json(str(tmp_path / "n")).collect()}
    f = out["f"]
    assert (f.total_chunks, f.successful_chunks, f.failed_chunks, f.raw_total_triples, f.normalized_total_triples) == (2, 1, 1, 2, 1)
    assert [(c.chunk_id, c.raw_triple_count, c.normalized_triple_count, c.error) for c in f.chunks] == [(1, 2, 1, None), (2, 0, 0, "boom")]
    assert f.normalization.match_threshold == fixed.RELATION_MATCH and out["g"].total_chunks == 0 and not out["g"].chunks
    df = spark.createDataFrame([(*t, "f") for t in TRIPLES], "pos long, subject string, relation string, object string, source_file string")
    resolved, names, decisions, _ = resolution.resolve(df, lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))))
    summary = sources.totals(df, resolved, spark.createDataFrame([("f", 2)], "source_file string, total_chunks long"))
    sources.save_resolved(resolved, names, decisions, summary, str(tmp_path / "r"))
    read = lambda n: spark.read.json(str(tmp_path / "r" / n)).collect()
    assert [(r.total_chunks, r.input_triples, r.resolved_unique_triples) for r in read("totals")] == [(2, 6, 3)]
    assert {r.canonical: r.members for r in read("entity_clusters")}["Axon4j"] == ["Axon4j", "axon4j"]
    assert {r.reason for r in read("resolution_decisions") if r.method == "identity_conflict"} == {"explicit_parent_child_relation"}


def test_cache_of_chunks(spark, tmp_path):
    home = str(tmp_path / "home")
    wanted = spark.createDataFrame([("h", 10, 2, 2)], "file_hash string, chunk_size int, overlap int, total_chunks int")
    assert sources.cached_chunks(spark, home, wanted).count() == 0 and sources.load_state(spark, home) is None
    row = lambda n, text, status: ("h", 10, 2, 2, n, text, status, None, [])
    columns = ", ".join(c for c in sources.CACHED.split(", ") if c.split(" ")[0] not in ("cache_version", "saved"))
    sources.save_chunks(spark.createDataFrame([row(1, "x", "failed"), row(2, "y", "success")], columns), home, 1)
    sources.save_chunks(spark.createDataFrame([row(1, "x", "success")], columns), home, 2)
    assert {(r.chunk_id, r.status) for r in sources.cached_chunks(spark, home, wanted).collect()} == {(1, "success"), (2, "success")}
    assert sources.cached_chunks(spark, home, wanted.withColumn("overlap", F.lit(3))).count() == 0
    sources.save_state(spark, home, {"a": 1})
    sources.save_state(spark, home, {"a": 2})
    assert sources.load_state(spark, home) == {"a": 2}


def test_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|  |three")
    parse = lambda raw: raw.decode().split("|")
    rows = lambda **how: [(r.source_file, r.page, r.text) for r in sources.pages(spark, str(tmp_path), parse, **how).collect()]
    assert rows() == [("a.bin", 1, "one"), ("a.bin", 3, "three")]
    assert rows(keep_empty=True) == [("a.bin", 1, "one"), ("a.bin", 2, ""), ("a.bin", 3, "three")]


def test_models_and_replies(spark):
    class Reply:
        content = [{"type": "text", "text": "a"}, {"type": "image", "text": "no"}, " b", {"text": ""}]

    assert plugins.response_text(Reply()) == "a\n b" and plugins.response_text("  x ") == "x" and plugins.response_text(7) == "7"
    made = []
    assert plugins.once("test", lambda: made.append(1) or "m") == plugins.once("test", lambda: made.append(1)) == "m" and made == [1]
    df = spark.createDataFrame([("abc", 1), (None, 2)], "representation string, n int")
    out = plugins.embed_with(df, lambda: lambda texts: [[float(len(t))] for t in texts], "lengths", batch=1).collect()
    assert [(r.n, r.embedding) for r in sorted(out, key=lambda r: r.n)] == [(1, [3.0]), (2, [0.0])]


def test_paths_stop_when_short_ones_fill_the_limit(spark):
    e = spark.createDataFrame([("s", "R", f"x{i}") for i in range(5)] + [(f"x{i}", "R", f"y{i}") for i in range(5)], "src string, rel string, dst string")
    seeds = spark.createDataFrame([("s",)], "name string")
    assert [len(r.relationships) for r in graph.paths(e, seeds, limit=5).collect()] == [1] * 5
    assert [len(r.relationships) for r in graph.paths(e, seeds, limit=7).collect()] == [1] * 5 + [2] * 2


def test_engine(spark):
    engine = Engine(spark)
    with pytest.raises(UnknownJob):
        engine.status("x")
    job = engine.ingest(spark.createDataFrame([(1, TEXT), (2, "Paris contains Museums.")], "doc_id long, text string"))
    assert engine.status(job)["status"] == "completed" and engine.status(job)["counts"]["relationships"] >= 4
    out = engine.query(job, "What does Axon4j support?")
    assert out["vector_evidence"] and out["graph"]["links"] and out["validation_status"] in ("NOT_RUN", "SUPPORTED", "UNSUPPORTED")
    for bad in ("", " ", "x" * 2001):
        with pytest.raises(ValueError):
            engine.query(job, bad)
    assert engine.current_document()["job"] == job and answer.prompt("generate", "q?", "ev").endswith("Question: q?\nAnswer:")
    assert graph.wrong_dimension(engine.tables[job]["nodes"], plugins.DIMENSIONS).count() == 0
    engine.jobs["y"] = {"status": "running"}
    with pytest.raises(NotReady):
        engine.query("y", "q")
    assert fixed.CACHE_VERSION == 3 and engine.health()["status"] == "ok"


def test_engine_keeps_documents_apart(spark, tmp_path):
    engine = Engine(spark, home=str(tmp_path / "home"))
    job = engine.ingest(spark.createDataFrame([(4656, "Berlin uses Trams."), (6694, "Tokyo uses Metros.")], "doc_id long, text string"))
    assert {(r.src, r.dst) for r in engine.tables[job]["edges"].collect()} == {("Berlin", "Trams"), ("Tokyo", "Metros")}


def test_engine_reuses_and_takes_up(spark, tmp_path):
    home = str(tmp_path / "home")
    docs = spark.createDataFrame([(1, "Berlin uses Trams."), (2, "Oslo uses Boats.")], "doc_id long, text string")
    seen = []
    first = Engine(spark, home=home, progress=lambda job, phase, state: seen.append((phase, state)))
    assert first.current_document() is None
    job = first.ingest(docs)
    assert seen[0] == ("upload", "running") and seen[-1] == ("verify", "completed") and len(seen) == 18
    second = Engine(spark, home=home, extractor=lambda text: [{"subject": "New", "relation": "uses", "object": "Things"}])
    assert second.current_document() == {"job": job, "counts": first.status(job)["counts"]}
    again = second.ingest(docs)
    assert second.status(again)["status"] == "completed" and second.status(again)["counts"] == first.status(job)["counts"]
    more = second.ingest(docs.unionByName(spark.createDataFrame([(3, "Rome uses Buses.")], docs.schema)))
    edges = lambda e, j: {(r.src, r.dst) for r in e.tables[j]["edges"].collect()}
    assert edges(second, more) == {("Berlin", "Trams"), ("Oslo", "Boats"), ("New", "Things")}
    asked = []
    third = Engine(spark, home=home, model=lambda text: asked.append(text) or ("No information." if "Verdict" not in text else "UNSUPPORTED"))
    current = third.current_document()["job"]
    out = third.query(current, "What does Berlin use?")
    assert current == more and out["validation_status"] == "UNSUPPORTED" and len(asked) == 3 and asked[0].startswith("Answer the question")
    third.clear()
    assert third.current_document() is None and Engine(spark, home=home).current_document() is None
    with pytest.raises(ValueError):
        Engine(spark, size=5, overlap=5)
