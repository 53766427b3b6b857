"""Entities, claims and relations; ranks, communities and paths."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.session import checkpoint_folder


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key: upserts as a merge."""
    place = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the greatest by the other columns."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*").select(rows.columns)


@dataclass
class Graph:
    """entities (entity_id, kind, name, aliases), claims (claim_id, claimant, text, stance, video_id, chunk_id, ts,
    references), relations (src, dst, kind, source_claim_id)."""

    entities: DataFrame
    claims: DataFrame
    relations: DataFrame

    def upsert_entities(self, rows: DataFrame) -> Graph:
        """An entity replaces one of the same id; of several rows of an id the last by name, kind and aliases stays."""
        old = self.entities.join(rows.select("entity_id").distinct(), "entity_id", "left_anti")
        return Graph(old.unionByName(_one_each(rows, "entity_id")), self.claims, self.relations)

    def insert_claims(self, rows: DataFrame) -> Graph:
        """A claim replaces one of the same id; empty ids are an error."""
        rows = rows.withColumn("claim_id", F.when(F.col("claim_id") != "", F.col("claim_id")).otherwise(F.raise_error(F.lit("empty claim id"))))
        old = self.claims.join(rows.select("claim_id").distinct(), "claim_id", "left_anti")
        return Graph(self.entities, old.unionByName(_one_each(rows, "claim_id")), self.relations)

    def claim_edges(self) -> DataFrame:
        """(src, dst, kind): claimant to claim, claim to referenced entity; only entities that are known have edges."""
        known = self.entities.select("entity_id").distinct()
        made = self.claims.select(F.col("claimant").alias("entity_id"), "claim_id").join(known, "entity_id", "left_semi")
        refers = self.claims.select("claim_id", F.explode("references").alias("entity_id")).join(known, "entity_id", "left_semi")
        return made.select(F.col("entity_id").alias("src"), F.col("claim_id").alias("dst"), F.lit("claimant").alias("kind")).unionByName(refers.select(F.col("claim_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("reference").alias("kind")))

    def insert_relations(self, rows: DataFrame) -> Graph:
        """Relations with an unknown end are left out; parallel ones stay."""
        return Graph(self.entities, self.claims, self.relations.unionByName(known_edges(rows, self.entities.select(F.col("entity_id").alias("node")))))

    def entity(self, entity_id: str) -> DataFrame:
        return self.entities.where(F.col("entity_id") == entity_id)

    def find_entity(self, name: str, ranks: DataFrame) -> DataFrame:
        """First entity by rank whose name or an alias holds the text."""
        q = F.lower(F.lit(name))
        hit = (F.instr(F.lower("name"), q) > 0) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.instr(F.lower(a), q) > 0)
        return self.entities.where(hit).join(ranks.select(F.col("node").alias("entity_id"), "rank"), "entity_id", "left").orderBy(F.desc_nulls_last("rank"), "entity_id").limit(1)

    def claims_by_entity(self, entity_ids: DataFrame) -> DataFrame:
        """(entity_id, claim...) of claims an entity made or is referred to in, each once."""
        uses = self.claims.select("claim_id", F.col("claimant").alias("entity_id")).unionByName(self.claims.select("claim_id", F.explode("references").alias("entity_id"))).distinct()
        return uses.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").join(self.claims, "claim_id")

    def claims_in_video(self, video_id: str) -> DataFrame:
        return self.claims.where(F.col("video_id") == video_id)

    def timeline(self, entity_ids: DataFrame) -> DataFrame:
        return self.claims_by_entity(entity_ids).orderBy("entity_id", "ts", "claim_id")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column node)."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


#: Nodes and distinct edges that one task ranks in memory (some 100 MB).
SMALL_GRAPH = 1_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, cut_every: int = 3, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, rank): fixed iterations, parallel edges count, the mass of nodes without edges is shared by all.

    Parallel edges are combined with their share once.  A graph that was counted
    to have at most ``small`` nodes and edges is ranked in one task, all
    iterations in memory; of a larger one each iteration moves one row per
    distinct edge, partitioned by source.  Both do the same sums.
    """
    nodes = _cut(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    if n <= small:
        paired = _cut(known_edges(edges, nodes).groupBy("src", "dst").agg(F.count("*").alias("m")))
        if paired.count() <= small:
            return _pagerank_in_memory(nodes, paired, iterations, damping)
    counted = known_edges(edges, nodes).groupBy("src", "dst").agg(F.count("*").alias("m"))
    out = counted.groupBy("src").agg(F.sum("m").alias("out"))
    flow = _cut(counted.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")).repartition("src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = _cut(nodes.join(flow.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    for i in range(iterations):
        # One row, broadcast: the mass of the sinks.
        lost = sinks.join(ranks, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        gained = flow.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("gain"))
        ranks = nodes.join(gained, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (i + 1) % cut_every == 0:
            ranks = _cut(ranks)
    return ranks


def _pagerank_in_memory(nodes: DataFrame, paired: DataFrame, iterations: int, damping: float) -> DataFrame:
    kind = nodes.schema["node"].dataType.simpleString()

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["m"].isna()]["src"].sort_values().to_numpy()
        links = pdf[pdf["m"].notna()].sort_values(["dst", "src"])
        at = pd.Index(own)
        src, dst, m = at.get_indexer(links["src"]), at.get_indexer(links["dst"]), links["m"].to_numpy(float)
        out = np.bincount(src, m, len(own))
        share, sink = m / out[src] if len(m) else m, out == 0
        ranks = np.full(len(own), 1.0 / len(own))
        for _ in range(iterations):
            ranks = (1 - damping) / len(own) + damping * (np.bincount(dst, share * ranks[src], len(own)) + ranks[sink].sum() / len(own))
        return pd.DataFrame({"node": own, "rank": ranks})

    rows = nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("long").alias("m")).unionByName(paired)
    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(rank, f"node {kind}, rank double")


def communities(nodes: DataFrame, edges: DataFrame, topic_col: str | None = None, sweeps: int = 50) -> DataFrame:
    """(topic, community, node, label): greedy modularity by local moves, one topic's graph in one group.

    A node moves to the neighbouring community with the largest positive gain
    k_uc/m - k_u K_c/(2 m^2); nodes go in id order and the smallest community
    wins ties, so the outcome is fixed.  Topics are dealt apart; the operator is
    meant for graphs of one knowledge base, which a task holds.  label names the
    member of highest degree, the last of equals.
    """
    nodes = nodes.select(*([F.col(topic_col).alias("topic")] if topic_col else [F.lit("all").alias("topic")]), F.col("node").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.coalesce(F.col("name").cast("string"), F.col("node").cast("string")).alias("name") if "name" in nodes.columns else F.col("node").cast("string").alias("name"))
    links = edges.select(*([F.col(topic_col).alias("topic")] if topic_col else [F.lit("all").alias("topic")]), F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(None).cast("string").alias("name"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        topic = pdf["topic"].iloc[0]
        names = {r.src: r.name_ for r in pdf[pdf["dst"].isna()].rename(columns={"name": "name_"}).itertuples()}
        around: dict[str, dict[str, int]] = {u: {} for u in sorted(names)}
        m = 0
        for r in pdf[pdf["dst"].notna()].itertuples():
            if r.src in names and r.dst in names:
                m += 1
                around[r.src][r.dst] = around[r.src].get(r.dst, 0) + 1
                around[r.dst][r.src] = around[r.dst].get(r.src, 0) + 1
        degree = {u: sum(v.values()) for u, v in around.items()}
        home, mass = {u: i for i, u in enumerate(around)}, {i: degree[u] for i, u in enumerate(around)}
        for _ in range(sweeps if m else 0):
            moved = False
            for u, near in around.items():
                pull: dict[int, int] = {}
                for v, w in near.items():
                    if v != u:
                        pull[home[v]] = pull.get(home[v], 0) + w
                best, at = 0.0, home[u]
                for c in sorted(pull):
                    if c != home[u] and (gain := pull[c] / m - degree[u] * mass[c] / (2 * m * m)) > best + 1e-12:
                        best, at = gain, c
                if at != home[u]:
                    mass[home[u]] -= degree[u]
                    mass[at] += degree[u]
                    home[u] = at
                    moved = True
            if not moved:
                break
        groups: dict[int, list[str]] = {}
        for u in around:
            groups.setdefault(home[u], []).append(u)
        rows = []
        for k, own in enumerate(sorted(groups.values(), key=lambda g: g[0])):
            top = max(range(len(own)), key=lambda i: (degree[own[i]], i))
            rows += [(topic, k, u, names[own[top]]) for u in own]
        return pd.DataFrame(rows, columns=["topic", "community", "node", "label"])

    return nodes.unionByName(links).groupBy("topic").applyInPandas(fold, "topic string, community int, node string, label string")


def shortest_path(edges: DataFrame, src: str, dst: str, max_hops: int | None = None) -> list[str] | None:
    """Nodes of a shortest path of the undirected graph, least by name among equals; None if there is none.

    Frontier joins: each round keeps a row for every node first reached, with
    the smallest path to it.
    """
    sym = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    sym = _cut(sym.unionByName(sym.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if not sym.where(F.col("a") == src).limit(1).count() and src != dst:
        return None
    if src == dst:
        return [src]
    front = edges.sparkSession.createDataFrame([(src, [src])], "node string, path array<string>")
    seen = front.select("node")
    for _ in itertools.count() if max_hops is None else range(max_hops):
        grown = front.join(sym, front["node"] == sym["a"]).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = _cut(grown.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = front.where(F.col("node") == dst).first()
        if hit:
            return list(hit["path"])
        if front.isEmpty():
            return None
        seen = _cut(seen.unionByName(front.select("node")))
    return None


def distances(edges: DataFrame, src: str, max_hops: int | None = None) -> DataFrame:
    """(node, hops) of all nodes reached from src."""
    sym = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    sym = _cut(sym.unionByName(sym.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    front = edges.sparkSession.createDataFrame([(src, 0)], "node string, hops int")
    seen = front
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        front = _cut(front.join(sym, front["node"] == sym["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front))
    return seen
