"""Operator 9: near-duplicate vectors by small-world graphs.

Equal vectors of a label are one node with a count. The nodes of a label are dealt to shards of
bounded size, each with a graph of its own; every shard's nodes query every shard of their label.
A beam that is full of links is widened for its query. Nodes with AUDIT-th hashes are held
against brute force in every shard that they ask; while these miss a link or their nearest node
too often, the beams of all queries of that pair of shards are widened. Links are verified by
cosine in double precision; a task passes on counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.components import components
from sedge.llm.hnsw import Graph, build
from sedge.shipping import ship

COSINE = 0.98
SHARD = 4096
BEAM = 64
#: By how much a beam is widened.
WIDER = 8
#: One query in so many is audited; 1 audits all. Of their links and nearest nodes so many must be found.
AUDIT = 20
RECALL = 0.98
#: Similarities in single precision may be off by so much; verification is in double.
SLACK = 1e-4
QUERIES = 512
#: A beam of at least this share of a shard holds the whole shard: that is one matrix product.
DENSE = 8


def links_of(queries: np.ndarray, x: np.ndarray, graph: Graph, least: float, audited: np.ndarray, beam: int = BEAM, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine of at least `least`, as the graph finds them.

    The audited queries alone are held against brute force: all their links, and their nearest
    node, be it a link or not. While fewer than `recall` of either are found, all queries are
    searched again with a wider beam, at last one that holds every node.
    """
    a32 = queries.astype(np.float32)
    while True:
        qs, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        links = found = nearest = met = 0
        for k in range(0, len(queries), QUERIES):
            block = slice(k, k + QUERIES)
            q, n, top = find(a32[block], graph, least, beam)
            ok = np.einsum("id,id->i", queries[block][q], x[n]) >= least
            q, n = q[ok], n[ok]
            asked = np.flatnonzero(audited[block])
            if len(asked):
                true = queries[block][asked] @ x.T
                got = np.zeros(true.shape, bool)
                place = np.full(len(top), -1)
                place[asked] = np.arange(len(asked))
                mine = place[q] >= 0
                got[place[q[mine]], n[mine]] = True
                links, found = links + int((true >= least).sum()), found + int(got.sum())
                nearest, met = nearest + len(asked), met + int((top[asked] >= true.max(axis=1) - SLACK).sum())
            qs, ns = np.concatenate((qs, q + k)), np.concatenate((ns, n))
        if beam * DENSE >= len(x) or (found >= recall * links and met >= recall * nearest):
            break
        beam *= WIDER
    key = np.unique(qs * len(x) + ns)
    return key // len(x), key % len(x)


def find(q: np.ndarray, graph: Graph, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of a block of queries, and the best similarity met; beams that hold links alone are widened."""
    rows, qs, ns, top = np.arange(len(q)), [], [], np.full(len(q), -np.inf)
    while True:
        if beam * DENSE >= len(graph.x):
            sims = q[rows] @ graph.x.T
            top[rows] = sims.max(axis=1)
            r, n = np.nonzero(sims >= least - SLACK)
            qs.append(rows[r])
            ns.append(n)
            break
        ids, sims = graph.search(q[rows], beam)
        top[rows] = sims[:, 0]
        full = sims[:, -1] >= least - SLACK
        r, c = np.nonzero((sims >= least - SLACK) & (ids >= 0) & ~full[:, None])
        qs.append(rows[r])
        ns.append(ids[r, c])
        rows = rows[full]
        if not len(rows):
            break
        beam *= WIDER
    return np.concatenate(qs), np.concatenate(ns), top


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number that each of n nodes reaches by the pairs."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def link_vectors(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """Row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths agree, and their cosine
    in double precision is at least `cosine`. A vector that is null, zero, or holds a null or
    non-finite component links with nothing, nor does a row with a null vec_id (its
    component_id is null and it is kept). Rows that repeat a vec_id are vectors of their own
    with links of their own and one component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = v.filter("ok")
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    # a vec_id may have several vectors: number tells them apart
    nodes = C.checkpointed(nodes.withColumn("number", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.size("embedding").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = nodes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node", "number"), F.col("shards")))

    def make(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("number").to_numpy(), t.column("node").to_numpy()))
        node, number, n = (t.column(c).to_numpy()[order] for c in ("node", "number", "n"))
        flat = np.concatenate([np.asarray(c.flatten()) for c in t.column("embedding").chunks])
        x = flat.reshape(len(node), -1)[order]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = build(x.astype(np.float32), node)
        first = t.slice(0, 1)
        blobs = {"vectors": (node, number, n, x), "graph": [(a.astype(np.int32), b.astype(np.int32)) for a, b in g.layers]}
        blobs = {k: pa.array([C.pack(pickle.dumps(v, 5))], pa.binary()) for k, v in blobs.items()}
        return pa.table({"label": first.column("label").cast(pa.string()), "dim": first.column("dim"), "shard": first.column("shard"), "shards": first.column("shards"), **blobs})

    graphs = C.checkpointed(dealt.groupBy("label", "dim", "shard").applyInArrow(make, "label string, dim int, shard long, shards long, vectors binary, graph binary"))
    # a shard asks itself and those after it: a pair of shards is searched once, and only vectors travel to ask
    asking = graphs.select("label", "dim", F.col("shard").alias("asks"), F.col("vectors").alias("queries"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"))
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = asking.join(graphs.drop("shards"), ["label", "dim", "shard"]).repartition(n_tasks, "label", "dim", "shard", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asks, shard_, qb, vb, gb in zip(b.column("asks").to_pylist(), b.column("shard").to_pylist(), b.column("queries"), b.column("vectors"), b.column("graph"), strict=True):
                qn, qi, qc, qx = pickle.loads(C.unpack(qb.as_py()))
                gn, gi, gc, gx = pickle.loads(C.unpack(vb.as_py()))
                graph = Graph(gx.astype(np.float32), [(a.astype(np.int64), l.astype(np.int64)) for a, l in pickle.loads(C.unpack(gb.as_py()))])
                qs, ns = links_of(qx, gx, graph, cosine, C.mix(qn ^ qi) % C.U64(AUDIT) == 0)
                if asks == shard_:
                    key = np.unique(np.minimum(qs, ns) * len(gn) + np.maximum(qs, ns))
                    qs, ns = key // len(gn), key % len(gn)
                    qs, ns = qs[qs != ns], ns[qs != ns]
                    names, which, sides = gn, gi, (qs, ns)
                    found = np.bincount(qs, gc[ns], len(gn)) + np.bincount(ns, gc[qs], len(gn))
                else:
                    names, which, sides = np.concatenate((qn, gn)), np.concatenate((qi, gi)), (qs, ns + len(qn))
                    found = np.concatenate((np.bincount(qs, gc[ns], len(qn)), np.bincount(ns, qc[qs], len(gn))))
                low = forest(*sides, len(names))
                order = np.flatnonzero(found > 0)
                yield pa.RecordBatch.from_pydict({"number": which[order], "links": found[order].astype(np.int64), "node": names[order], "low": names[low[order]]})

    found = C.checkpointed(pairs.mapInArrow(C.lean(search), "number long, links long, node long, low long"))
    counts = found.groupBy("number").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = nodes.join(counts, "number", "left").join(whole, "node", "left")
    per_node = per_node.select("label", "embedding", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = good.join(per_node, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = v.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
