"""Queries of retrieval, ranking, graph, coherence and bookkeeping over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.functions.vectors import cosine, l2_normalised
from lorekeep.operators import analytics, chunking, coherence, discover, evaluate, graph, memory, provenance, retrieve
from lorekeep.plans.registry import register
from lorekeep.plans.text_queries import CHUNK_SQL, table
from lorekeep.session import checkpoint_folder
from lorekeep.sources import readers

# ---------------------------------------------------------------- retrieval


def _questions(spark, sf_dir) -> DataFrame:
    """Every test item whose id is divisible by 100, its whole text being the question."""
    return table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


_KB: dict[tuple, str] = {}


def _stored_texts(spark, sf_dir) -> tuple[str, DataFrame, retrieve.Postings]:
    """(folder, chunks, postings) of the documents, stored on first use and read from then on."""
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    written = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(source).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, written)
    if key not in _KB:
        root = f"{checkpoint_folder(spark)}/lorekeep-{spark.sparkContext.applicationId}/kb-{uuid.uuid4().hex}"
        chunking.chunk_documents(table(spark, sf_dir, "documents")).write.parquet(f"{root}/chunks")
        retrieve.bm25_index(spark.read.parquet(f"{root}/chunks")).save(f"{root}/index", int(spark.conf.get("spark.sql.shuffle.partitions")))
        _KB[key] = root
    root = _KB[key]
    return root, spark.read.parquet(f"{root}/chunks"), retrieve.Postings.load(spark, f"{root}/index")


_EMBEDDED: set[str] = set()


def _knowledge_base(spark, sf_dir):
    """(chunks, vectors, postings, embedder) of the documents; vectors are made by the first query that wants them."""
    root, chunks, index = _stored_texts(spark, sf_dir)
    embedder = retrieve.HashingEmbedder(128, normalise=False)
    if root not in _EMBEDDED:
        embedder.embed(chunks.select("chunk_id", "text"), "text").select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{root}/vectors")
        _EMBEDDED.add(root)
    return chunks, spark.read.parquet(f"{root}/vectors"), index, embedder


_BM25 = CHUNK_SQL.rstrip() + r""",
ids AS (SELECT doc_id::VARCHAR || ':' || idx::VARCHAR AS chunk_id, doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM chunks),
questions AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM ids),
post AS (SELECT chunk_id, len(ws) AS len, unnest(ws) AS term FROM ids), tf AS (SELECT chunk_id, len, term, count(*) AS tf FROM post GROUP BY ALL),
want AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM questions),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
           FROM want JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, chunk_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM scored)
"""


@register("q_bm25", _BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse WHERE rank < 50")
def q_bm25(spark, sf_dir):
    hits = retrieve.bm25_topk(_questions(spark, sf_dir), _stored_texts(spark, sf_dir)[2])
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_DENSE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
dense AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.e, round(greatest(0, list_cosine_similarity(q.e, v.e)), 12) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM dense)
"""


def _asked(v: DataFrame) -> DataFrame:
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))


@register("q_dense_topk", _DENSE + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 20")
def q_dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = retrieve.dense_topk(_asked(v), v, 20)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("q_rrf", """
WITH a AS (SELECT label AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1 AS rank FROM embeddings),
b AS (SELECT label AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) - 1 AS rank FROM embeddings),
u AS (SELECT * FROM a WHERE rank < 30 UNION ALL SELECT * FROM b WHERE rank < 30),
f AS (SELECT query_id, chunk_id, sum((1.0::DOUBLE / (61 + rank))::DECIMAL(24, 18))::DOUBLE AS score FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM f)
SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM r WHERE rank < 50
""")
def q_rrf(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lists = [retrieve.top_by(e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.get("embedding", F.lit(i)).alias("s")), "query_id", "s", "chunk_id", 30) for i in (0, 1)]
    return retrieve.rrf(*lists).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("q_mmr", _DENSE.replace("WITH v", "WITH RECURSIVE v") + """,
cand AS (SELECT query_id, chunk_id, chunk_id % 7 AS source, e, score, rank, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9) AS rel FROM ranked WHERE rank < 30),
pick AS (
  SELECT query_id, 0 AS step, []::BIGINT[] AS chosen FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL
  SELECT query_id, step + 1, list_append(chosen, best) FROM (
    SELECT p.query_id, p.step, p.chosen, (SELECT c.chunk_id FROM cand c WHERE c.query_id = p.query_id AND NOT list_contains(p.chosen, c.chunk_id)
        AND (SELECT count(*) FROM cand s WHERE s.query_id = p.query_id AND list_contains(p.chosen, s.chunk_id) AND s.source = c.source) < 3
      ORDER BY round(0.7 * c.rel - 0.3 * coalesce((SELECT max(list_cosine_similarity(c.e, s.e)) FROM cand s WHERE s.query_id = p.query_id AND list_contains(p.chosen, s.chunk_id)), 0), 12) DESC, c.rank LIMIT 1) AS best
    FROM pick p WHERE p.step < 8) WHERE best IS NOT NULL),
done AS (SELECT query_id, arg_max(chosen, step) AS chosen FROM pick GROUP BY query_id),
flat AS (SELECT query_id, unnest(chosen) AS chunk_id, unnest(range(len(chosen))) AS rank FROM done)
SELECT query_id, chunk_id, rank FROM flat
""")
def q_mmr(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = retrieve.dense_topk(_asked(v), v, 30).withColumn("video_id", F.col("chunk_id") % 7)
    return retrieve.mmr(hits, v, 8).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


_PICK = """
pick AS (
  SELECT query_id, 0 AS step, []::VARCHAR[] AS chosen FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL
  SELECT query_id, step + 1, list_append(chosen, best) FROM (
    SELECT p.query_id, p.step, p.chosen, (SELECT c.chunk_id FROM cand c WHERE c.query_id = p.query_id AND NOT list_contains(p.chosen, c.chunk_id)
        AND (SELECT count(*) FROM cand s WHERE s.query_id = p.query_id AND list_contains(p.chosen, s.chunk_id) AND s.source = c.source) < 3
      ORDER BY round(0.7 * c.rel - 0.3 * coalesce((SELECT max(sim) FROM near s WHERE s.query_id = p.query_id AND s.a = c.chunk_id AND list_contains(p.chosen, s.b)), 0), 12) DESC, c.rank LIMIT 1) AS best
    FROM pick p WHERE p.step < 10) WHERE best IS NOT NULL),
done AS (SELECT query_id, arg_max(chosen, step) AS chosen FROM pick GROUP BY query_id),
flat AS (SELECT query_id, unnest(chosen) AS chunk_id, unnest(range(len(chosen))) AS rank FROM done)
"""
_FUSED = _BM25.rstrip() + r""",
word AS (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM ids UNION ALL SELECT 'q' || query_id::VARCHAR, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) FROM questions),
hashed AS (SELECT chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM word),
dims AS (SELECT chunk_id, (h // 2) % 128 AS b, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM dims GROUP BY chunk_id),
dots AS (SELECT q.query_id, c.chunk_id, sum(a.v * c.v) AS dot FROM questions q JOIN dims a ON a.chunk_id = 'q' || q.query_id::VARCHAR JOIN dims c ON c.b = a.b AND c.chunk_id NOT LIKE 'q%' GROUP BY ALL),
cosines AS (SELECT q.query_id, i.chunk_id, round(greatest(0, coalesce(dot / (a.n * c.n), 0)), 12) AS score FROM questions q CROSS JOIN ids i LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = i.chunk_id LEFT JOIN norms a ON a.chunk_id = 'q' || q.query_id::VARCHAR LEFT JOIN norms c ON c.chunk_id = i.chunk_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM cosines),
lists AS (SELECT query_id, chunk_id, rank FROM dense WHERE rank < 50 UNION ALL SELECT query_id, chunk_id, rank FROM sparse WHERE rank < 50),
rrf AS (SELECT query_id, chunk_id, sum((1.0::DOUBLE / (61 + rank))::DECIMAL(24, 18))::DOUBLE AS score FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM rrf)
"""
_NEAR_CHUNKS = """,
cand AS (SELECT f.query_id, f.chunk_id, i.doc_id AS source, f.score, f.rank, f.score / greatest(max(f.score) OVER (PARTITION BY f.query_id), 1e-9) AS rel FROM {hits} f JOIN ids i ON i.chunk_id = f.chunk_id WHERE f.rank < 50),
near AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, coalesce(sum(p.v * q.v) / (any_value(nx.n) * any_value(ny.n)), 0) AS sim FROM cand x JOIN cand y ON x.query_id = y.query_id JOIN norms nx ON nx.chunk_id = x.chunk_id JOIN norms ny ON ny.chunk_id = y.chunk_id
         LEFT JOIN dims p ON p.chunk_id = x.chunk_id LEFT JOIN dims q ON q.chunk_id = y.chunk_id AND q.b = p.b GROUP BY 1, 2, 3),"""


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", "video_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("q_hybrid", _FUSED + _NEAR_CHUNKS.replace("{hits}", "fused") + _PICK + "SELECT f.query_id, f.chunk_id, c.source::VARCHAR AS video_id, round(c.score, 9) AS score, f.rank FROM flat f JOIN cand c ON c.query_id = f.query_id AND c.chunk_id = f.chunk_id")
def q_hybrid(spark, sf_dir):
    """Flagship: BM25 and hashed dense vectors over all chunks, fused and made diverse, for several questions at once."""
    chunks, vectors, index, embedder = _knowledge_base(spark, sf_dir)
    return _ranked(retrieve.Retriever(chunks, vectors, embedder, index=index).search(_questions(spark, sf_dir), 10))


_RERANKED = _FUSED + """,
asked AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ws FROM questions),
over AS (SELECT f.query_id, f.chunk_id, len(list_intersect(a.ws, i.ws)) / greatest(len(a.ws), 1)::DOUBLE AS score FROM fused f JOIN asked a ON a.query_id = f.query_id JOIN ids i ON i.chunk_id = f.chunk_id WHERE f.rank < 50),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM over)
"""


@register("q_rerank", _RERANKED + _NEAR_CHUNKS.replace("{hits}", "again") + _PICK + "SELECT f.query_id, f.chunk_id, c.source::VARCHAR AS video_id, round(c.score, 9) AS score, f.rank FROM flat f JOIN cand c ON c.query_id = f.query_id AND c.chunk_id = f.chunk_id")
def q_rerank(spark, sf_dir):
    """q_hybrid with candidates scored anew before they are made diverse."""
    chunks, vectors, index, embedder = _knowledge_base(spark, sf_dir)
    return _ranked(retrieve.Retriever(chunks, vectors, embedder, retrieve.OverlapReranker(), index).search(_questions(spark, sf_dir), 10))


@register("q_l2_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))), lambda z: z * z))), 9) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 3 * x) AS e FROM embeddings)")
def q_l2_norm(spark, sf_dir):
    unit = l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)), 9).alias("norm"))


@register("q_trajectory_topk", """
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings WHERE label % 2 = 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10
""")
def q_trajectory_topk(spark, sf_dir):
    bank = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "ask").otherwise("apply").alias("mode"), F.col("embedding").alias("query_embedding"))
    q = bank.where("id = 0").select("query_embedding").first()[0]
    return retrieve.trajectory_topk(bank, list(q), "ask", 10).select("id", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- words and maps

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = rf"w AS (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS word FROM documents), k AS (SELECT lang, word FROM w WHERE strlen(word) >= 4 AND word NOT IN ({_STOP}))"


@register("q_tf_topn", f"WITH {_WORDS}, c AS (SELECT word, count(*) AS freq FROM k GROUP BY word ORDER BY freq DESC, word LIMIT 100) SELECT word, freq, greatest(12.0, least(72.0, round(72 * sqrt(freq / (SELECT max(freq) FROM c)::DOUBLE)))) AS font FROM c")
def q_tf_topn(spark, sf_dir):
    top = analytics.top_words(table(spark, sf_dir, "documents"), 100)
    most = top.agg(F.max("freq").alias("most"))
    return top.crossJoin(F.broadcast(most)).select("word", "freq", analytics.font_size(F.col("freq"), F.col("most")).alias("font"))


@register("q_tf_by_cluster", f"WITH {_WORDS}, c AS (SELECT lang, word, count(*) AS freq FROM k GROUP BY lang, word), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rank FROM c) SELECT lang, word, freq, rank FROM r WHERE rank <= 5")
def q_tf_by_cluster(spark, sf_dir):
    return analytics.top_words(table(spark, sf_dir, "documents"), 5, by=["lang"]).select("lang", "word", "freq", F.col("rank").cast("long").alias("rank"))


@register("q_pca_map")
def q_pca_map(spark, sf_dir):
    return analytics.rescaled(analytics.project_2d(table(spark, sf_dir, "embeddings"), "vec_id"), ["x", "y"], 40.0, 960.0)


@register("q_rescale", "SELECT p_partkey, round(12 + (p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) * 60, 6) AS x FROM part")
def q_rescale(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return analytics.rescaled(p, ["x"], 12.0, 72.0).select("p_partkey", F.round("x", 6).alias("x"))


@register("q_subsample", """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT count(*) AS t FROM documents),
q AS (SELECT source, n, greatest(1, floor(n * 60.0 / t)) AS q FROM n, t), s AS (SELECT greatest(0, 60 - sum(q)) AS spare FROM q),
p AS (SELECT source, q + (row_number() OVER (ORDER BY n DESC, source) <= spare)::INTEGER AS q FROM q, s),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents)
SELECT doc_id, r.source FROM r JOIN p ON r.source = p.source WHERE r <= q
""")
def q_subsample(spark, sf_dir):
    # The limit of the sample is the operator's point.
    return analytics.subsample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.col("doc_id"), 60).select("doc_id", "source")


# ---------------------------------------------------------------- coherence

_NEAR = "SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + 0.01 * embedding[i % 64 + 1]::DOUBLE) FROM embeddings WHERE vec_id % 50 = 0"


def _near(spark, sf_dir):
    """The vectors, and slightly turned copies of every fiftieth: the table itself holds no near copies."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.zip_with("embedding", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)), lambda x, y: x + 0.01 * y)
    return e.unionByName(e.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), turned.alias("embedding")))


@register("q_flagged_pairs", f"WITH v AS ({_NEAR}) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95")
def q_flagged_pairs(spark, sf_dir):
    return coherence.similar_pairs(_near(spark, sf_dir), coherence.NEAR_COPY).select("a", "b", F.round("sim", 6).alias("sim"))


@register("q_sim_edges", f"""
WITH v AS ({_NEAR}), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS w FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.35),
c AS (SELECT id AS a, lead(id) OVER (ORDER BY id) AS b FROM v)
SELECT a, b, round(w, 6) AS weight FROM p UNION ALL SELECT a, b, 0.01 FROM c WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = c.a AND p.b = c.b)
""")
def q_sim_edges(spark, sf_dir):
    return coherence.similarity_graph(_near(spark, sf_dir), least=0.35).select("a", "b", F.round("weight", 6).alias("weight"))


@register("q_nn_dist", f"WITH v AS ({_NEAR}), m AS (SELECT a.id, max(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id) SELECT count(*) AS n, round(avg((1 - s) / 2), 6) AS mean_distance FROM m")
def q_nn_dist(spark, sf_dir):
    return coherence.nearest_similarity(_near(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.avg((1 - F.col("sim")) / 2), 6).alias("mean_distance"))


@register("q_workspace", """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT i, avg(e[i]) AS m FROM x, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM p)
SELECT round(avg((list_cosine_similarity(e, c) >= 0.1)::INTEGER), 6) AS score FROM x, c
""")
def q_workspace(spark, sf_dir):
    return coherence.workspace_score(table(spark, sf_dir, "embeddings"), least=0.1).select(F.round("score", 6).alias("score"))


@register("q_contradiction", """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT e, coalesce(lead(e) OVER (ORDER BY vec_id), (SELECT e FROM x ORDER BY vec_id LIMIT 1)) AS f FROM x)
SELECT round(avg((list_inner_product(e, f) < 0)::INTEGER), 6) AS rate FROM n
""")
def q_contradiction(spark, sf_dir):
    return coherence.contradiction_rate(table(spark, sf_dir, "embeddings"), "vec_id").select(F.round("rate", 6).alias("rate"))


@register("q_health", f"""
WITH v AS ({_NEAR}), n AS (SELECT e, coalesce(lead(e) OVER (ORDER BY id), (SELECT e FROM v ORDER BY id LIMIT 1)) AS f FROM v),
p AS (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM p)
SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg((list_inner_product(e, f) < 0)::INTEGER) FROM n), 6) AS contradiction_rate,
  (SELECT count(*) FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95) AS near_copies, round((SELECT avg((list_cosine_similarity(e, c) >= 0.5)::INTEGER) FROM v, c), 6) AS workspace, 0.0::DOUBLE AS integrated, 'Disjoint' AS label
""")
def q_health(spark, sf_dir):
    """Health and coherence in one row; the vectors are so loosely connected that the first two places of the score are zeros."""
    v = _near(spark, sf_dir)
    health = coherence.kb_health(v)
    kpi = coherence.coherence_kpi(v, connectivity=health["fiedler"])
    row = (v.count(), round(health["contradiction_rate"], 6), health["near_copies"], round(kpi["workspace"], 6), round(kpi["integrated"], 2), kpi["label"])
    return spark.createDataFrame([row], "n long, contradiction_rate double, near_copies long, workspace double, integrated double, label string")


@register("q_kpi_label", "SELECT event_id, CASE WHEN s < 0.30 THEN 'Disjoint' WHEN s < 0.60 THEN 'Loose' WHEN s < 0.85 THEN 'Coherent' ELSE 'HighlyIntegrated' END AS label, CASE WHEN s > 0.30 THEN 'full' WHEN s < 0.015 THEN 'skip' ELSE 'probe' END AS frames FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS s FROM events)")
def q_kpi_label(spark, sf_dir):
    s = (F.col("event_id") % 101) / F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", coherence.interpretation(s).alias("label"), coherence.frame_decision(s).alias("frames"))


@register("q_drift", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
h AS (SELECT event_type, n, avg(CASE WHEN r <= n // 2 THEN value::DECIMAL(30, 12) END) AS before, avg(CASE WHEN r > n // 2 THEN value::DECIMAL(30, 12) END) AS after FROM r GROUP BY event_type, n)
SELECT event_type, n, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS fall, CASE WHEN n >= 4 THEN before - after > 0.08 END AS drifted FROM h
""")
def q_drift(spark, sf_dir):
    d = coherence.drift(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", ["event_type"])
    return d.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("before", "after", "fall")], "drifted")


@register("q_hash_variance", """
WITH h AS (SELECT event_type AS g, event_id * 2654435761 % 4294967296 AS h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
SELECT a.g, round(avg(bit_count(xor(a.h, b.h))) / 64.0, 9) AS variance FROM h a JOIN h b ON a.g = b.g AND a.r < b.r GROUP BY a.g
""")
def q_hash_variance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.expr("event_id * 2654435761L % 4294967296L").alias("h"), "event_id")
    return coherence.hamming_variance(e, "g", "h").select("g", F.round("variance", 9).alias("variance"))


# ---------------------------------------------------------------- ranking

AS_OF = "2024-06-01"
_CAND = "SELECT p_partkey::VARCHAR AS video_id, (p_retailprice * 1000)::BIGINT AS views, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 97.0::DOUBLE END AS dur, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE strftime(DATE '2020-01-01' + (p_partkey % 1500)::INTEGER, '%Y%m%d') END AS up, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cap FROM part"
_SCORE = """least(1, log10(views + 1) / 8) * 0.25 + CASE WHEN up = 'unknown' THEN 0.5 ELSE exp(-greatest(date_diff('day', strptime(up, '%Y%m%d')::DATE, DATE '2024-06-01'), 0) * 0.4 / 365.0) END * 0.20
 + CASE WHEN dur IS NULL THEN 0.5 WHEN dur <= 0 THEN 0 WHEN dur < 120 THEN dur / 120.0 WHEN dur <= 600 THEN 0.2 + 0.8 * (dur - 120) / 480 WHEN dur <= 3600 THEN 1 WHEN dur >= 14400 THEN 0 ELSE (14400 - dur) / 10800 END * 0.15 + 0.175"""


def _candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    up = F.when(k % 7 == 0, "unknown").otherwise(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")), "yyyyMMdd"))
    return p.select(k.cast("string").alias("video_id"), F.col("p_name").alias("title"), (F.col("p_retailprice") * 1000).cast("long").alias("view_count"), F.when(k % 11 == 0, None).otherwise(F.col("p_size") * 97.0).alias("duration_seconds"), up.alias("upload_date"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("has_captions"))


@register("q_curriculum", f"WITH c AS ({_CAND}) SELECT video_id, round({_SCORE} + CASE WHEN cap IS NULL THEN 0.5 WHEN cap THEN 1 ELSE 0 END * 0.05, 6) AS score FROM c WHERE dur IS NULL OR dur BETWEEN 30 AND 14400")
def q_curriculum(spark, sf_dir):
    c = _candidates(spark, sf_dir).where(discover.duration_ok(F.col("duration_seconds")))
    return discover.score_candidates(c, AS_OF, discover.DEPTHS["medium"]).select("video_id", F.round("score", 6).alias("score"))


@register("q_caption_gate", f"""
WITH c AS ({_CAND}), f AS (SELECT *, {_SCORE} AS base FROM c WHERE dur IS NULL OR dur BETWEEN 30 AND 14400),
g AS (SELECT video_id FROM f ORDER BY base + 0.025 DESC, video_id LIMIT 20),
l AS (SELECT f.video_id, base, CASE WHEN g.video_id IS NOT NULL THEN f.video_id::BIGINT % 2 = 0 END AS cap FROM f LEFT JOIN g ON f.video_id = g.video_id),
s AS (SELECT video_id, base + CASE WHEN cap IS NULL THEN 0.5 WHEN cap THEN 1 ELSE 0 END * 0.05 AS score, coalesce(cap, false) AS own FROM l),
k AS (SELECT * FROM s WHERE own OR (SELECT count(*) FROM s WHERE own) < 10)
SELECT video_id, round(score, 6) AS score, row_number() OVER (ORDER BY own DESC, score DESC, video_id) AS rank FROM k ORDER BY own DESC, score DESC, video_id LIMIT 20
""")
def q_caption_gate(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("has_captions", F.lit(None).cast("boolean"))
    caps = c.select("video_id", (F.col("video_id").cast("long") % 2 == 0).alias("has_captions"))
    d = discover.discover(c, caps, discover.DEPTHS["medium"], AS_OF)
    return d.select("video_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- bookkeeping


@register("q_list_topic", CHUNK_SQL + "SELECT c.doc_id::VARCHAR AS video_id, count(*) AS n_chunks, max(length(o.text))::DOUBLE AS seconds, coalesce(any_value(CASE WHEN o.doc_id % 3 > 0 THEN 'T' || o.source END), '—') AS title, coalesce(any_value(CASE WHEN o.doc_id % 3 > 1 THEN o.lang END), '—') AS published_at FROM chunks c JOIN documents o ON o.doc_id = c.doc_id GROUP BY c.doc_id")
def q_list_topic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    third = F.col("doc_id") % 3
    manifest = docs.where(third > 0).select(F.col("doc_id").cast("string").alias("video_id"), F.concat(F.lit("T"), "source").alias("title"), F.when(third > 1, F.col("lang")).alias("published_at"))
    return analytics.listing(chunking.chunk_documents(docs), manifest)


@register("q_status", "SELECT lang, count(*) AS vectors, count(DISTINCT source) AS videos, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang)")
def q_status(spark, sf_dir):
    return analytics.topic_totals(table(spark, sf_dir, "documents"), "lang", "source", F.octet_length("text"))


@register("q_manifest_last", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'skip' ELSE 'full' END AS action FROM events GROUP BY user_id")
def q_manifest_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    last = provenance.last_state(e, "user_id")
    state = F.when(F.col("status") == "purchase", "indexed").otherwise("pending")
    return last.select("user_id", "status", "seq", provenance.resume_action(state, F.lit(False)).alias("action"))


@register("q_new_items", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.quality = 1 OR l.toxic = 1))")
def q_new_items(spark, sf_dir):
    manifest = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "indexed").when(F.col("toxic") == 1, "failed").otherwise("pending").alias("status"))
    return provenance.new_items(table(spark, sf_dir, "documents").select("doc_id"), manifest, "doc_id")


@register("q_compare_union", """
WITH a AS (SELECT vec_id AS chunk_id FROM embeddings WHERE label IN (0, 1)), b AS (SELECT vec_id AS chunk_id FROM embeddings WHERE label IN (1, 2) OR vec_id % 5 = 0)
SELECT chunk_id, 'a' AS side FROM a UNION ALL SELECT chunk_id, 'b' FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM a)
""")
def q_compare_union(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return memory.compare_union(e.where("label in (0, 1)").select("chunk_id"), e.where("label in (1, 2) or chunk_id % 5 = 0").select("chunk_id"))


@register("q_push_batches", "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 53 AS batch_no FROM embeddings")
def q_push_batches(spark, sf_dir):
    return readers.push_batches(table(spark, sf_dir, "embeddings"), 64, "vec_id").select("vec_id", "batch_no")


@register("q_spaced", "SELECT doc_id, r AS response, d AS days, DATE '2024-06-01' + d AS due FROM (SELECT doc_id, r, CASE r WHEN 'knew' THEN 14 WHEN 'unsure' THEN 4 ELSE 1 END AS d FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'knew' WHEN quality = 1 THEN 'unsure' ELSE 'wrong' END AS r FROM labels))")
def q_spaced(spark, sf_dir):
    r = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "knew").when(F.col("quality") == 1, "unsure").otherwise("wrong")
    a = table(spark, sf_dir, "labels").select("doc_id", r.alias("response"))
    return memory.spaced_schedule(a, F.lit(AS_OF).cast("date")).select("doc_id", "response", "days", "due")


@register("q_quiz_tally", "SELECT CASE WHEN quality = 1 THEN 'knew' ELSE 'wrong' END AS response, count(*) AS n FROM labels GROUP BY 1")
def q_quiz_tally(spark, sf_dir):
    return memory.quiz_tally(table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "knew").otherwise("wrong").alias("response")))


@register("q_trajectory_stats", "SELECT count(*) AS n, round(coalesce(avg(quality), 0), 9) AS avg_score FROM labels")
def q_trajectory_stats(spark, sf_dir):
    return memory.trajectory_stats(table(spark, sf_dir, "labels").select(F.col("quality").alias("outcome_score"))).select("n", F.round("avg_score", 9).alias("avg_score"))


@register("q_eval", """
SELECT lang, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE toxic = 1) AS abstained, round(avg(passed::INTEGER), 6) AS score
FROM (SELECT lang, toxic, CASE WHEN toxic = 1 THEN quality = 0 ELSE (contains(lower(text), 'the') OR contains(lower(text), 'en')) AND NOT contains(lower(text), 'stupid') AND n_chars % 5 >= 1 END AS passed
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang
""")
def q_eval(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    items = j.select(F.col("doc_id").cast("string").alias("id"), "lang", F.array(F.lit("The"), F.lit("EN")).alias("expected_substrings"), F.array(F.lit("Stupid")).alias("forbidden_substrings"), F.lit(1).alias("min_citations"), (F.col("quality") == 0).alias("abstain_acceptable"))
    answers = j.select(F.col("doc_id").cast("string").alias("id"), "text", (F.col("n_chars") % 5).cast("int").alias("n_citations"), (F.col("toxic") == 1).alias("abstained"))
    r = evaluate.score_items(items.drop("lang"), answers).join(items.select("id", "lang"), "id")
    return r.groupBy("lang").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("abstained").alias("abstained"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("score"))


@register("q_chat_footer", r"SELECT conv_id AS session_id, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\[([0-9]+)\]', 1)) ELSE 0 END)::BIGINT AS citations, count(*) AS turns FROM conversations GROUP BY conv_id")
def q_chat_footer(spark, sf_dir):
    return memory.session_footer(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content")))


@register("q_chat_context", """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT *, list_filter(range(0, length(substr(text, 1, 200)) + 1), lambda k: strlen(substr(text, 1, k)) <= 200) AS fit FROM t WHERE r > greatest(0, n // 2 - 5) * 2),
s AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || CASE WHEN strlen(text) <= 200 THEN text ELSE substr(text, 1, fit[-1]) || '…' END, chr(10) ORDER BY r) AS said FROM c GROUP BY conv_id)
SELECT conv_id AS session_id, '[Prior conversation (condensed)]:' || chr(10) || said || chr(10) || chr(10) || '[Current question]: why?' AS prompt FROM s
""")
def q_chat_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), "role", F.col("text").alias("content"))
    asked = turns.where(F.col("role").isin("user", "assistant")).select("session_id").distinct().withColumn("question", F.lit("why?"))
    return memory.condense_history(turns, asked)


@register("q_fnv", """
SELECT k, list_reduce([14695981039346656037::UHUGEINT] || list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: unicode(c)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR AS h
FROM (SELECT doc_id AS k, source || '-' || lang || ':' || n_chars::VARCHAR AS t FROM documents UNION ALL SELECT -1, '' UNION ALL SELECT -2, 'a' UNION ALL SELECT -3, 'vid-001:0')
""")
def q_fnv(spark, sf_dir):
    """64-bit chunk numbers of an id for each document, and of the pinned values."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.concat("source", F.lit("-"), "lang", F.lit(":"), F.col("n_chars").cast("string")).alias("t"))
    rows = ids.unionByName(spark.createDataFrame([(-1, ""), (-2, "a"), (-3, "vid-001:0")], "k long, t string"))
    return rows.select("k", provenance.fnv1a64(F.col("t")).alias("h"))


_CHAIN_ROWS = "SELECT role AS topic, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS seq, conv_id::VARCHAR || ':' || turn::VARCHAR AS chunk_id, conv_id::VARCHAR AS video_id, turn AS ing FROM conversations"


@register("q_witness_verify", f"""
WITH RECURSIVE x AS ({_CHAIN_ROWS}), chain AS (
  SELECT topic, seq, repeat('0', 64) AS previous, sha256(seq::VARCHAR || chr(10) || chunk_id || chr(10) || video_id || chr(10) || (ing * 1500)::VARCHAR || chr(10) || ing::VARCHAR || chr(10) || repeat('0', 64)) AS digest FROM x WHERE seq = 1
  UNION ALL
  SELECT x.topic, x.seq, c.digest, sha256(x.seq::VARCHAR || chr(10) || chunk_id || chr(10) || video_id || chr(10) || (ing * 1500)::VARCHAR || chr(10) || ing::VARCHAR || chr(10) || c.digest) FROM chain c JOIN x ON x.topic = c.topic AND x.seq = c.seq + 1)
SELECT topic, count(*) AS entries, CASE topic WHEN 'user' THEN 4 END::BIGINT AS first_bad_seq, CASE topic WHEN 'user' THEN 'digest' END AS reason, arg_max(digest, seq) AS last_digest FROM chain GROUP BY topic
""")
def q_witness_verify(spark, sf_dir):
    """Chains of the turns by role; one entry of one chain is tampered with before it is verified."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    place = W.partitionBy("role").orderBy("conv_id", "turn")
    rows = c.select(F.col("role").alias("topic"), F.row_number().over(place).cast("long").alias("seq"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") * 1.5).alias("start_seconds"), F.col("turn").alias("ingested_at"))
    chain = provenance.build_chain(rows)
    last = chain.groupBy("topic").agg(F.max_by("digest", "seq").alias("last_digest"))
    spoilt = chain.withColumn("video_id", F.when((F.col("topic") == "user") & (F.col("seq") == 4), "forged").otherwise(F.col("video_id")))
    return provenance.verify_chain(spoilt).join(last, "topic")


# ---------------------------------------------------------------- graph

_EDGES = "SELECT 's' || s_suppkey::VARCHAR AS src, 'n' || s_nationkey::VARCHAR AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'n' || c_nationkey::VARCHAR FROM customer"


def _edges(spark, sf_dir):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"))
    return s.unionByName(n).unionByName(c)


def _nodes(e):
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()


@register("q_pagerank", f"""
WITH RECURSIVE e AS ({_EDGES}), v AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), n AS (SELECT count(*)::DOUBLE AS n FROM v),
o AS (SELECT src, count(*) AS o FROM e GROUP BY src), s AS (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE / o AS share FROM e JOIN o ON e.src = o.src JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst),
sinks AS (SELECT list(id) AS ids FROM v WHERE id NOT IN (SELECT src FROM s)),
r AS (SELECT 0 AS i, list_transform(range(n::BIGINT), lambda x: 1.0::DOUBLE / n) AS m FROM n
  UNION ALL
  SELECT i + 1, (SELECT list(0.15 / n + 0.85 * (coalesce(g.gain, 0) + list_sum(list_transform(ids, lambda k: r.m[k])) / n) ORDER BY v.id) FROM v LEFT JOIN (SELECT dst, sum(share * r.m[src]) AS gain FROM s GROUP BY dst) g ON g.dst = v.id, n, sinks) FROM r WHERE i < 100)
SELECT node, round(m[id], 6) AS rank FROM v, r WHERE i = 100
""")
def q_pagerank(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.pagerank(_nodes(e), e).select("node", F.round("rank", 6).alias("rank"))


@register("q_degree", f"WITH e AS ({_EDGES}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def q_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@register("q_shortest_path", f"""
WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), d AS (SELECT 's1' AS node, 0 AS hops UNION SELECT u.b, hops + 1 FROM d JOIN u ON u.a = d.node WHERE hops < 8)
SELECT node, min(hops)::INTEGER AS hops FROM d GROUP BY node
""")
def q_shortest_path(spark, sf_dir):
    return graph.distances(_edges(spark, sf_dir), "s1")


@register("q_known_edges", f"WITH e AS ({_EDGES}), k AS (SELECT 's' || s_suppkey::VARCHAR AS node FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'n' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 3 <> 0) SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def q_known_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    own = _nodes(e).where("(node like 's%' and cast(substring(node, 2) as int) % 2 = 0) or (node like 'n%' and cast(substring(node, 2) as int) % 3 <> 0)")
    return graph.known_edges(e, own).select("src", "dst")


_CLAIMS = "SELECT substr(sha256(text || chr(0) || role || chr(0) || conv_id::VARCHAR || chr(0) || turn::VARCHAR), 1, 16) AS claim_id, role AS claimant, conv_id, turn, 'u' || (turn % 4)::VARCHAR AS ref FROM conversations"


@register("q_claims_by_entity", f"WITH c AS ({_CLAIMS}) SELECT DISTINCT entity_id, claim_id, conv_id::VARCHAR AS video_id, turn::DOUBLE AS ts FROM (SELECT claimant AS entity_id, * FROM c UNION ALL SELECT ref, * FROM c) WHERE entity_id IN ('system', 'u1', 'u3')")
def q_claims_by_entity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    claims = c.select(text.claim_id(F.col("text"), F.col("role"), F.col("conv_id"), F.col("turn")).alias("claim_id"), F.col("role").alias("claimant"), "text", F.lit("asserts").alias("stance"), F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("string").alias("chunk_id"), F.col("turn").cast("double").alias("ts"), F.array(F.concat(F.lit("u"), (F.col("turn") % 4).cast("string"))).alias("references"))
    g = graph.Graph(spark.createDataFrame([], "entity_id string, kind string, name string, aliases array<string>"), claims, spark.createDataFrame([], "src string, dst string, kind string, source_claim_id string"))
    who = spark.createDataFrame([("system",), ("u1",), ("u3",)], "entity_id string")
    return g.timeline(who).select("entity_id", "claim_id", "video_id", "ts")


@register("q_find_entity", "SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower('land ' || n_nationkey::VARCHAR), 'an') ORDER BY n_regionkey DESC, n_nationkey::VARCHAR LIMIT 1")
def q_find_entity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    entities = n.select(F.col("n_nationkey").cast("string").alias("entity_id"), F.lit("place").alias("kind"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Land "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    ranks = n.select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").alias("rank"))
    return graph.Graph(entities, None, None).find_entity("AN", ranks).select("name")


# ---------------------------------------------------------------- host engine


@register("host_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def host_pricing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@register("host_segments", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def host_segments(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
