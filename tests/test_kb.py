"""Ranking, graph, store, evaluation and streaming on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import guards
from lorekeep.operators import coherence, discover, evaluate, graph, memory, provenance, retrieve
from lorekeep.sources import readers
from lorekeep.sources.store import TopicStore


def test_ranking(spark):
    c = spark.createDataFrame([("a", "A", 10**8, 1800.0, "20240101", True), ("b", "B", None, 119.0, "bad", None), ("c", "C", 0, 120.0, "20100101", False), ("d", "D", 5, 10.0, None, True), ("e", "E", 5, None, None, True)], "video_id string, title string, view_count long, duration_seconds double, upload_date string, has_captions boolean")
    assert abs(sum(discover.WEIGHTS.values()) - 1) < 1e-12
    assert [r["video_id"] for r in c.where(discover.duration_ok(F.col("duration_seconds"))).collect()] == ["a", "b", "c", "e"]
    d = dict(c.select("video_id", discover.duration_score(F.col("duration_seconds"), False)).collect())
    assert (d["a"], round(d["b"], 4), round(d["c"], 4)) == (1.0, 0.9917, 0.2)
    r = dict(c.select("video_id", discover.recency(F.col("upload_date"), "2024-01-01", 0.5)).collect())
    assert r["a"] == 1.0 and r["b"] == 0.5 and r["c"] < 0.01
    caps = spark.createDataFrame([("c", True)], "video_id string, has_captions boolean")
    ranked = discover.discover(c.withColumn("has_captions", F.lit(None).cast("boolean")), caps, discover.DEPTHS["quick"], "2024-01-01").collect()
    assert ranked[0]["video_id"] == "c" and len(ranked) == 4


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "ghost")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "node string")
    known = graph.known_edges(e, nodes)
    assert known.count() == 5
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(nodes, known, iterations=12).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["x"]
    assert graph.shortest_path(known, "a", "d") == ["a", "c", "d"]
    assert graph.shortest_path(known, "a", "a") == ["a"] and graph.shortest_path(known, "a", "x") is None and graph.shortest_path(known, "q", "a") is None
    groups = {r["node"]: r["community"] for r in graph.communities(nodes, known).collect()}
    assert groups["x"] == groups["y"] != groups["a"] and len(groups) == 7
    with pytest.raises(Exception):
        g = graph.Graph(nodes, spark.createDataFrame([], "claim_id string"), known)
        g.insert_claims(spark.createDataFrame([("",)], "claim_id string")).claims.collect()


def test_coherence_and_drift(spark):
    v = spark.createDataFrame([(i, [1.0, 0.01 * i, 0.0, 0.0]) for i in range(4)] + [(9, [0.0, 0.0, 1.0, 0.0])], "id long, embedding array<double>")
    pairs = coherence.similar_pairs(v, 0.95, block_rows=2).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(i, j) for i in range(4) for j in range(i + 1, 4)]
    near = {r["id"]: round(r["sim"], 3) for r in coherence.nearest_similarity(v, block_rows=2).collect()}
    assert near == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 9: 0.0}
    kpi = coherence.coherence_kpi(v)
    assert 0 < kpi["integrated"] < 1 and kpi["workspace"] == 0.8
    assert coherence.coherence_kpi(v.limit(0))["label"] == "Disjoint"
    with pytest.raises(ValueError):
        coherence.kb_health(v.limit(0))
    assert coherence.kb_health(v)["near_copies"] == 6
    h = spark.createDataFrame([("g", i, 0.9 if i < 10 else 0.55) for i in range(20)] + [("s", i, 0.8) for i in range(20)] + [("t", 0, 0.1)], "k string, o int, s double")
    assert {r["k"]: r["drifted"] for r in coherence.drift(h, ["o"], "s", ["k"]).collect()} == {"g": True, "s": False, "t": None}


def test_retrieval(spark):
    chunks = spark.createDataFrame([(f"v{i % 2}:{i}", f"v{i % 2}", t) for i, t in enumerate(["apples and pears", "rust memory safety", "memory in rust programs", "cooking pasta", "garden tools"])], "chunk_id string, video_id string, text string")
    q = spark.createDataFrame([(1, "rust memory"), (2, "???")], "query_id int, text string")
    best = retrieve.bm25_topk(q, retrieve.bm25_index(chunks)).collect()
    assert {r["chunk_id"] for r in best} == {"v1:1", "v0:2"} and {r["query_id"] for r in best} == {1}
    e = retrieve.HashingEmbedder(64)
    found = retrieve.Retriever(chunks, e.embed(chunks.select("chunk_id", "text")), e).search(q.where("query_id = 1"), 2).collect()
    assert {r["chunk_id"] for r in found} == {"v1:1", "v0:2"}
    assert retrieve.mmr(spark.createDataFrame([], "query_id int, chunk_id string, video_id string, score double, rank int"), chunks, 0).count() == 0
    fused = retrieve.rrf(*[spark.createDataFrame([(1, c, i) for i, c in enumerate(x)], "query_id int, chunk_id string, rank int") for x in ("ABC", "CAD")]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fused][0] == "A" and [r["chunk_id"] for r in fused].index("C") < [r["chunk_id"] for r in fused].index("B")


def test_guards(spark):
    from lorekeep.plans.text_queries import GUARD_TEXTS

    df = spark.createDataFrame([(t,) for t in [*GUARD_TEXTS, None]], "t string")
    inbound = [r[0] for r in df.select(guards.scan_inbound(F.col("t"))["reasons"]).collect()]
    assert [len(x) for x in inbound[:12]] == [1] * 12 and [x[0] for x in inbound[:12]] == [n for n, _ in guards.INBOUND]
    out = [r[0] for r in df.select(guards.scan_outbound(F.col("t"), F.lit(3))["reasons"]).collect()]
    assert out[15] == ["citation: 7"] and out[16] == [] and out[12] == ["harm: explicit-violence-instruction"]


def test_provenance(spark):
    rows = spark.createDataFrame([("t", i, f"v:{i}", "v", i * 1.5, 100 + i) for i in range(1, 6)], "topic string, seq long, chunk_id string, video_id string, start_seconds double, ingested_at long")
    chain = provenance.build_chain(rows)
    check = lambda c: tuple(provenance.verify_chain(c).first())[1:]
    assert check(chain) == (5, None, None)
    assert check(chain.withColumn("video_id", F.when(F.col("seq") == 3, "x").otherwise(F.col("video_id")))) == (5, 3, "digest")
    assert check(chain.withColumn("previous", F.when(F.col("seq") == 2, "x").otherwise(F.col("previous")))) == (5, 2, "link")
    got = [r[0] for r in spark.createDataFrame([("",), ("a",), ("vid-001:0",)], "t string").select(provenance.fnv1a64(F.col("t"))).collect()]
    assert [int(x) for x in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x25D5CED728425B84]


def test_evaluation(spark, tmp_path):
    golden = {"topic": "rust", "items": [{"id": "1", "question": "q", "expected_substrings": ["Fast"], "forbidden_substrings": ["slow"]}, {"id": "2", "question": " ", "mode": "apply", "min_citations": 0}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    items = evaluate.load_golden(spark, str(tmp_path / "g.json"))
    assert sorted(r["problem"] for r in evaluate.validate_golden(items).collect()) == ["apply without a task", "blank question", "no citations needed, yet abstaining not accepted"]
    answers = spark.createDataFrame([("1", "it is FAST", 1, False), ("2", "", 0, True)], "id string, text string, n_citations int, abstained boolean")
    res = evaluate.score_items(items, answers)
    assert {r["id"]: (r["passed"], r["reasons"]) for r in res.collect()} == {"1": (True, []), "2": (False, ["abstained"])}
    assert tuple(evaluate.report(res).first()) == (2, 1, 1, 1, 0.5)
    assert tuple(evaluate.report(res.limit(0)).first()) == (0, 0, 0, 0, 0.0)


def test_sources(spark):
    lines = spark.createDataFrame([('{"id":"a","url":"u1"}',), ("broken",), ('{"id":"b","view_count":7}',), ('{"title":"x"}',)], "value string")
    assert [r["url"] for r in readers.parse_playlist(lines).collect()] == ["u1", "b"]
    assert [(r["video_id"], r["title"], r["view_count"]) for r in readers.parse_candidates(lines).orderBy("video_id").collect()] == [("a", "a", None), ("b", "b", 7)]
    assert readers.html_main_text("<body><p>no</p><article>A <b>b</b><main>C</main></article></body>") == "A\n\nb\n\nC\n\nC"
    assert readers.html_main_text("<p>one<p>two &amp; x</p>rest") == "one\n\ntwo & x" and readers.html_main_text(None) == ""
    feed = "<rss><channel><title>T</title><item><enclosure url='a.mp4' type='video/mp4'/></item><item><enclosure url='b.mp3' type='audio/mpeg'/></item></channel></rss>"
    assert tuple(spark.createDataFrame([(feed,)], "x string").select(readers.podcast_feed(F.col("x")).alias("f")).select("f.*").first()) == ("T", "b.mp3")
    assert readers.push_batch_size(384) == 9
    files = spark.createDataFrame([("/a/x.vtt",), ("/a/x.en.vtt",), ("/b/y.vtt",), ("/b/z.txt",)], "path string")
    assert {r["folder"]: r["path"] for r in readers.caption_files(files).collect()} == {"/a": "/a/x.en.vtt", "/b": "/b/y.vtt"}
    assert tuple(spark.range(1).select(readers.estimated_frames(F.lit(3600.0)).alias("e")).select("e.frames").first()) == (60,)


def test_import_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.exe").write_bytes(b"x")
    rows, counts = readers.import_dir(spark, str(tmp_path))
    assert [r["ok"] for r in rows.collect()] == [True, False] and {r["ok"]: r["n"] for r in counts.collect()} == {True: 1, False: 1}


def test_store_and_stream(spark, tmp_path):
    from lorekeep.streaming.ingest import hourly_scores, ingest_documents

    store = TopicStore(spark, str(tmp_path / "kb"))
    assert store.chunks("t").count() == 0
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "One sentence. Two."), (2, "Other text.")], "doc_id long, text string").write.parquet(src)
    for n in (2, 3):
        ingest_documents(spark, src, store, "t", str(tmp_path / "cp")).awaitTermination()
        assert store.chunks("t").count() == n
        spark.createDataFrame([(3, "Third.")], "doc_id long, text string").write.mode("append").parquet(src)
    assert store.embedded("t", "1").count() == 1
    store.ingest("t", store.chunks("t").drop("topic", "seq"), store.embeddings("t").drop("topic", "seq"), 99)
    assert store.chunks("t").count() == 3
    store.compact("t")
    store.compact("t")
    assert spark.read.parquet(str(tmp_path / "kb" / "chunks")).count() == 3
    with pytest.raises(ValueError):
        store.ingest("t", store.chunks("t").drop("topic", "seq"), spark.createDataFrame([("x", [1.0])], "chunk_id string, embedding array<float>"), 100)
    store.forget("t")
    assert store.topics().count() == 0
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0)], "ts string, event_type string, value double")
    assert [(r["n"], r["mean_value"]) for r in hourly_scores(e).collect()] == [(2, 2.0)]


def test_chat_and_quiz(spark):
    turns = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], f"t{i} " + "é" * 150) for i in range(14)] + [(1, 20, "system", "x")], "session_id int, turn_no int, role string, content string")
    q = spark.createDataFrame([(1, "now?"), (2, "first?")], "session_id int, question string")
    got = dict(memory.condense_history(turns, q).collect())
    assert got[2] == "first?" and got[1].startswith("[Prior conversation (condensed)]:\nUser: t4 ") and got[1].endswith("\n\n[Current question]: now?")
    line = got[1].split("\n")[1][len("User: ") :]
    assert len(line[:-1].encode()) <= 200 and line.endswith("…")
    cards = spark.createDataFrame([(i, e) for i, e in enumerate([0, 1, 2, 9])], "card_id int, excerpt int")
    hits = spark.createDataFrame([(0, "a"), (1, "b")], "rank int, chunk_id string")
    assert sorted((r["card_id"], r["chunk_id"]) for r in memory.cards_to_hits(cards, hits).collect()) == [(0, "a"), (1, "a"), (2, "b")]
    assert memory.quiz_order(cards, 1, 2).count() == 2
    assert tuple(memory.trajectory_stats(spark.createDataFrame([], "outcome_score double")).first()) == (0, 0.0)


def test_distances_follow_a_chain_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(53)], "src string, dst string")
    assert {r["node"]: r["hops"] for r in graph.distances(edges, "n0").collect()} == {f"n{i}": i for i in range(54)}
