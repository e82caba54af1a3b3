"""The pipeline stage by stage against brute force, each stage on what its predecessor kept."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarryline.llm import decontaminate, quality, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents like those of a corpus: copies, near copies, shared lines, benchmark passages, nulls, empty and short texts."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(400)]
    item = [f"q{i}" for i in range(40)]
    texts: list[str | None] = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(8, 160))
        if i % 10 == 3:
            body[4:4] = item[:20]
        texts.append("\n".join(" ".join(body[k : k + 12]) for k in range(0, len(body), 12)) + ("\nPlease SHARE this line" if i % 4 == 0 else ""))
    texts += texts[:8]
    for t in texts[8:24]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "  ", "short", "short"]
    d = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(i, int(i % 9 != 5), 0) for i in range(0, 70, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def line_brute(docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    return {i: "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < 10) for i, t in docs.items()}


def near_brute(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and ((docs[i] or "") == (docs[j] or "") or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if find(i) == i}


def clean_brute(docs, items):
    def dirty(t):
        d = decontaminate.word_hashes(decontaminate.words_of(t))
        for item in items:
            w = decontaminate.word_hashes(decontaminate.words_of(item))
            if len(d) and len(w) and any(decontaminate.overlap(d, w, s)[2] for s in range(-len(w) + 1, len(d))):
                return True
        return False

    return {i: t for i, t in docs.items() if not dirty(t)}


def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.written(stages["quality_classifier"](spark, docs, small))
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert by_id(kept) == {i: t for i, t in by_id(docs).items() if scores[i] >= 0.5} and kept.columns == columns
    lines = corpus_pipeline.written(stages["line_dedup"](spark, kept, small))
    assert by_id(lines) == line_brute(by_id(kept)) and lines.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = corpus_pipeline.written(stages["simhash_near_dedup"](spark, lines, small))
    assert by_id(near) == near_brute(by_id(lines)) and near.columns == columns and near.count() < lines.count()
    clean = corpus_pipeline.written(stages["benchmark_decontamination"](spark, near, small))
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert by_id(clean) == clean_brute(by_id(near), items) and clean.columns == columns and clean.count() < near.count()
    packed = stages["best_fit_packing"](spark, clean, small).collect()
    assert {r["doc_id"] for r in packed} == set(by_id(clean))
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) == int(np.ceil(sum(used.values()) / 4096))
    whole = {(r["doc_id"], r["piece"], r["length"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {(r["doc_id"], r["piece"], r["length"]) for r in packed}


def test_near_dedup_recall_by_length(spark):
    """All pairs of likeness 0.8 or more of short, middling and long texts share a group: recall 1 in each class."""
    rng = random.Random(23)
    texts, classes = [], []
    for kind, n in (("short", 9), ("middling", 60), ("long", 700)):
        for k in range(40):
            w = [f"{kind}{k}x{i}" for i in range(n)]
            v = list(w)
            for at in rng.sample(range(n), rng.choice([0, 1]) if n < 60 else rng.randint(1, n // 40)):
                v[at] = "new"
            v += [f"tail{k}"] * rng.choice([0, 1])
            classes.append((kind, len(texts)))
            texts += [" ".join(w), " ".join(v)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    tried = Counter()
    for kind, i in classes:
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        if 5 * len(a & b) >= 4 * len(a | b):
            tried[kind] += 1
            assert group.get(i, i) == group.get(i + 1, i + 1), (kind, i)
    assert min(tried.values()) >= 5 and len(tried) == 3
