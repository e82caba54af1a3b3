"""Small tests of what round 3 found: each failed before its finding was settled."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quarryline.llm import alignment, simhash
from quarryline.operators import graph
from quarryline.plans import projections as P
from quarryline.plans.queries import QUERIES
from quarryline.sources import store


def test_dead_code_counts_every_edge_and_use(spark, sf):
    """nothing that an edge of the trade graph or an event reaches is dead."""
    reached = P.edges(spark, sf).unionByName(P.uses(spark, sf)).where("kind in ('calls', 'imports')").select(F.col("dst").alias("id")).distinct()
    assert QUERIES["dead_code"](spark, sf).join(reached, "id", "left_semi").count() == 0
    alerts = QUERIES["alerts"](spark, sf).where("type = 'dead_code'").select(F.col("subject").alias("id"))
    assert alerts.join(reached, "id", "left_semi").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_write_makes_its_edges_once(spark, tmp_path):
    """the stored and the rejected edges of a write come from one pass over its edges."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(kind):
        made.add(1)
        return kind

    nodes = spark.createDataFrame([("a", "t", "A", "", "f"), ("b", "t", "B", "", "f")], store.NODES)
    edges = spark.createDataFrame([("a", "b", "calls", "f"), ("a", "x", "calls", "f"), ("y", "b", "calls", "f")], store.EDGES)
    rejects = store.Store(spark, f"file://{tmp_path}/s").write(nodes, edges.withColumn("kind", seen.asNondeterministic()("kind")))
    assert sorted(r["error"] for r in rejects.collect()) == ["source missing", "target missing"] and made.value == 3


def test_edges_are_made_distinct_as_numbers_and_weights_once(spark, sf):
    """the shuffles of the edges carry keys, not names; the two sides of the module map share one table."""
    assert "concat" not in _plan(P.edges(spark, sf)).partition("Exchange")[2]
    assert not [x for x in QUERIES["tectonic_map"](spark, sf).inputFiles() if "lineitem" in x]


def test_rank_steps_do_not_shuffle_links(spark):
    """a step of PageRank reads its links where they lie."""
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    ranks = graph._Ranks(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "gone")], "src string, dst string"), 0.85, 1)
    assert "InMemoryTableScan" in _plan(ranks.step(ranks.start()))
    got = {r["id"]: round(r["rank"], 6) for r in ranks.named(ranks.step(ranks.start())).collect()}
    assert got == {"a": 0.144444, "b": 0.427778, "c": 0.286111}
    ranks.free()


def test_communities_are_not_broadcast(spark, sf):
    """F5 to F8: no table of the size of the graph goes through the driver."""
    assert "Broadcast" not in _plan(QUERIES["communities"](spark, sf))


def test_near_dedup_links_by_simhash_first(spark, monkeypatch):
    """without a single prefix key, texts with fingerprints at two or fewer bits are linked if they are alike, and only those."""
    rng = random.Random(31)
    texts = []
    for k in range(24):
        w = [f"g{k}n{i}" for i in range(400)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w[:-1], "end"]), " ".join(rng.sample(w, 400))]
    texts += [texts[0], texts[0].upper(), None, "", " "]
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    fps = [simhash.majority(h) for h in sets]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            close = len(sets[a]) and (fps[a] ^ fps[b]).bit_count() <= 2 and simhash.jaccard(np.unique(sets[a]), np.unique(sets[b])) >= 0.8
            if close or (texts[a] or "") == (texts[b] or ""):
                root = [root[a] if r == root[b] else r for r in root] if root[a] < root[b] else [root[b] if r == root[a] else r for r in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert sum(i != r for i, r in want.items()) > 20  # most of it is SimHash's, three are equal texts
    every = simhash.keyed
    monkeypatch.setattr(simhash, "keyed", lambda *args: every(*args).limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()} == want


def test_chunks_are_encoded_together():
    """op11_alignment: the distinct chunks of texts go through tokenizer A in a few calls, not one encoding each, with the same ids."""
    al = alignment.Aligner(*(public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE)))

    class Counted:
        seen = 0

        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            def call(texts, **kw):
                Counted.seen += len(texts) if isinstance(texts, list) else 1
                return getattr(self.real, name)(texts, **kw)

            return call

    texts = [f"word{i} 日本{i}é\nline{i}  two <|endoftext|>" + " \t\n"[: i % 4] for i in range(300)]
    chunks = sorted({c for t in texts for c in alignment._CUT.split(" " + t)} | {" ", " \n\n", " x "})
    want = [x.ids for x in al.a.encode_batch(chunks, add_special_tokens=False)]
    al.a = Counted(al.a)
    al._learn(chunks)
    assert list(al.known) == chunks and Counted.seen < len(chunks) / 5
    assert al.facts[0, : len(chunks)].tolist() == [len(x) for x in want] and al._a_ids(chunks) == want
