"""Registered queries against plain versions over whole tables: where the SQL of a query takes a part, that isn't enough."""

import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, spans
from lexloom.plans import registry


def rows(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def edges(sf):
    """(i, j) to the cosine of all vectors of one label, by brute force."""
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    v = np.array(t["embedding"], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s, ids, labels = v @ v.T, t["vec_id"], t["label"]
    return {(ids[a], ids[b]): s[a, b] for a in range(len(ids)) for b in range(len(ids)) if labels[a] == labels[b] and ids[a] < ids[b]}


def test_edges_of_all_vectors(spark, sf, edges):
    got = {(r["i"], r["j"]): r["score"] for r in rows(spark, sf, "g08_similarity_graph")}
    want = {k: s for k, s in edges.items() if round(s, 6) > 0.1}
    assert got.keys() == want.keys() and max(j for _, j in got) >= 200
    assert all(abs(got[k] - s) < 1e-6 for k, s in want.items())


def test_blocks_give_each_edge_once(spark):
    v = np.random.default_rng(4).normal(size=(60, 4)).tolist()
    data = [(i % 2, i, x) for i, x in enumerate(v)] + [(0, 100, [0.0] * 4), (0, 101, [1.0, 2.0]), (0, 102, None)]
    members = spark.createDataFrame(data, "cluster_id int, id long, vector array<double>")
    sets = [sorted((r["cluster_id"], r["i"], r["j"], r["score"]) for r in graph.similarity_edges(members, rows=n).collect()) for n in (7, 1024)]
    unit = [np.array(x) / np.linalg.norm(x) for x in v]
    want = [(a % 2, a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and round(unit[a] @ unit[b], 6) > 0.1]
    assert sets[0] == sets[1] and [x[:3] for x in sets[0]] == sorted(want)


def test_graphs_of_all_vectors(spark, sf, edges):
    def best(least, degree):
        at = defaultdict(list)
        for (i, j), s in edges.items():
            if round(s, 6) >= least:
                at[i].append((-round(s, 6), i, j))
                at[j].append((-round(s, 6), i, j))
        kept = [{x[1:] for x in sorted(v)[:degree]} for v in at.values()]
        return {e for e in edges if sum(e in k for k in kept) == 2}

    assert {(r["i"], r["j"]) for r in rows(spark, sf, "g11_sparsified")} == best(0.2, 5)
    ids = pq.read_table(f"{sf}/embeddings.parquet")["vec_id"].to_pylist()
    near = {i: {i} for i in ids}
    for i, j in best(0.55, 30):
        near[i].add(j)
        near[j].add(i)
    label, after = {i: i for i in ids}, []
    for _ in range(2):
        votes = {i: [label[b] for b in near[i]] for i in ids}
        label = {i: min(v, key=lambda c: (-v.count(c), c)) for i, v in votes.items()}
        after.append(label)
    assert {r["id"]: r["community"] for r in rows(spark, sf, "g11_communities")} == after[1]
    one = rows(spark, sf, "a28_graph_metadata")[0]
    assert (one["pairs_scored"], one["communities"], one["nodes"]) == (sum(round(s, 6) > 0.1 for s in edges.values()), len(set(after[0].values())), len(ids))


SPACE = " \t\n\r\f"


def test_evidence_of_all_documents_and_claims(spark, sf):
    docs, items = (pq.read_table(f"{sf}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    words = lambda x: {w for w in re.split(f"[{SPACE}]+", x.lower()) if w}
    claims = {i: words(t) for i, t in zip(items["item_id"], items["text"])}
    want, longest = {}, 0
    for d, text in zip(docs["doc_id"], docs["text"]):
        at = [m.span() for m in re.finditer("[^ \t\n\x0b\f\r]+", text)]
        for a in range(0, max(0, -(-(len(at) - 100) // 64)) * 64 + 1, 64) if at else ():
            first, last = at[a][0], at[min(a + 100, len(at)) - 1][1]
            chunk = words(text[first:last])
            for i, c in claims.items():
                if c & chunk:
                    want[i, d, first, last] = len(c & chunk) / len(c | chunk)
                    longest = max(longest, len(text))
    got = {(r["claim_id"], r["doc_id"], r["first"], r["last"]): r["score"] for r in rows(spark, sf, "i07_evidence_chunks")}
    assert got.keys() == want.keys() and all(abs(got[k] - s) < 1e-6 for k, s in want.items())
    assert longest >= 3000 and len({k[0] for k in got}) > 1


def test_evidence_by_a_scorer(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    claims = spark.createDataFrame([(7, "a"), (8, "xyz")], "claim_id long, text string")
    got = spans.chunk_evidence(docs, claims, 2, 1, lambda chunk, claim: F.length(chunk) * F.length(claim))
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1, 0, 3, 3), (7, 1, 2, 5, 3), (8, 1, 0, 3, 9), (8, 1, 2, 5, 9)]


def test_trees_of_all_vectors(spark, sf):
    ids = pq.read_table(f"{sf}/embeddings.parquet")["vec_id"].to_pylist()
    parent = {i: i // 3 for i in ids if i > 0}
    want = {(r, r): 0 for r in range(3)}
    for i in parent:
        at, level = i, 0
        while at in parent:
            at, level = parent[at], level + 1
            if at < 3:
                want[at, i] = min(level, want.get((at, i), level))
    assert {(r["root"], r["node"]): r["level"] for r in rows(spark, sf, "g14_descendants")} == want and max(i for _, i in want) >= 300
    chains = {0: {i for i in ids if i % 2 == 0}, 1: {i for i in ids if i % 2}, 2: {*ids}}
    inside = {(c, p, i, "parent" if i % 4 else "corefer") for c, m in chains.items() for i, p in parent.items() if i in m and p in m}
    assert {(r["chain_id"], r["parent"], r["child"], r["label"]) for r in rows(spark, sf, "d15_chain_edges")} == inside
    reached = {(c, i) for c, _, i, label in inside if label == "parent"}
    free = {(c, i) for c, m in chains.items() for i in m} - reached
    free |= {(c, i) for c, m in chains.items() if all((c, i) in reached for i in m) for i in m}
    assert {(r["chain_id"], r["node"]) for r in rows(spark, sf, "d15_chain_roots")} == free


def test_names_of_all_documents(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    have = {*docs["source"]}
    names = {s if d % 2 == 0 else s[2:12] for d, s in zip(docs["doc_id"], docs["source"])}
    want = {(n, n if n in have else min((s for s in have if s.endswith(n)), default=None)) for n in names}
    assert {(r["name"], r["source"]) for r in rows(spark, sf, "d13_soft_match")} == {x for x in want if x[1] and x[0]}
