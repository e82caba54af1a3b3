"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import common, decontaminate, fingerprint, language, lines, packing, quality, queries, simhash, substrings, suffixes, urls, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, sketch string"
ODD = [None, "", " ", "\n", "one", "one two", "A b\tc\r\nd  e f", "wörter über alles ß", "x" * 3000, "to be or not to be " * 300, "same text here for all of us", "same text here for all of us", "SAME text here for all of us"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 0, "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "naïve"]
    texts = [*ODD]
    passage = " ".join(rng.choices(words, k=90))
    for i in range(40):
        body = rng.choices(words, k=rng.randint(5, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split()
        texts.append(("\n" if i % 2 else " ").join(body) + ("\n Shared LINE \t" if i % 2 else ""))
    texts += [texts[-1] + " tail", texts[-2].replace("w1 ", "w2 ")]
    return frame(spark, texts)


def rows(df):
    return [r.asDict() for r in df.collect()]


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint_neighbours(spark, docs):
    texts = [t or "" for (t,) in docs.orderBy("doc_id").select("text").collect()]
    got = sorted(rows(fingerprint.edited_neighbours(docs)), key=lambda r: r["doc_id"])
    assert len(got) == len(texts)
    for i, r in enumerate(got):
        q = len(texts[i]) // 4
        assert r["edited"] == texts[i][: len(texts[i]) - q] + texts[(i + 1) % len(texts)][:q]
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text"]].add(tuple(r["sketch"]["hashes"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert all(bool(r["sketch"]["hashes"]) == bool(words_of(r["text"])) for r in got)


def test_fingerprint_merges_and_estimates(spark):
    """merge, containment and likeness against the shingle sets themselves."""
    rng = random.Random(1)
    long_ = [f"v{rng.randint(0, 10**6)}" for _ in range(6000)]
    pairs = [(long_[:1500], long_), (long_, long_[:1500]), (long_[:40], long_[20:60]), (long_[:30], long_), (long_[:60], long_[50:110]), ([], long_), ([], []), (["one"], ["one"]), (long_[:500], long_[400:900])]
    pairs += [(long_[k : k + 12], long_) for k in range(0, 1000, 25)]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").withColumn("x", fingerprint.sketch(F.col("a"))).withColumn("y", fingerprint.sketch(F.col("b")))
    x, y = F.col("x"), F.col("y")
    got = df.select("i", "x", "y", fingerprint.likeness(x, y).alias("like"), fingerprint.containment(x, y).alias("inside"), fingerprint.merge(x, y).alias("both"), fingerprint.encode(x).alias("code")).orderBy("i").collect()

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for (a, b), r in zip(pairs, got, strict=True):
        s, t = shingles(a), shingles(b)
        small = max(len(s), len(t)) <= fingerprint.SMALL
        true = len(s & t) / len(s | t) if s | t else 1.0
        assert abs(r["like"] - true) <= (1e-9 if small else 0.12)
        assert r["inside"] == 1.0 if s <= t and r["inside"] is not None else not s <= t or not small
        assert r["x"]["scale"] == (1 if len(s) <= fingerprint.SMALL else fingerprint.SCALE) and r["code"].startswith(f"{r['x']['scale']}:")
    assert sum(r["inside"] is None for r in got[9:]) < 12
    one = spark.createDataFrame([(" ".join(long_[:9]), " ".join(long_[5:500]), " ".join(long_[:500])), (" ".join(long_[:40]), " ".join(long_[36:90]), " ".join(long_[:90])), (" ".join(long_[:9]), " ".join(long_[5:20]), " ".join(long_[:20]))], "a string, b string, c string")
    for r in one.select(fingerprint.merge(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("m"), fingerprint.sketch(F.col("c")).alias("w")).collect():
        assert r["m"] == r["w"]


def test_fingerprint_clashing_columns(spark):
    df = spark.createDataFrame([(2, "b c", 7, 1), (1, "a", 8, 2), (1, "a", 8, 2), (None, None, 9, 3)], "doc_id long, text string, bucket int, copy int")
    got = rows(fingerprint.with_next(df, "text"))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["bucket"], r["copy"], r["next_text"] or "") for r in got) == [(0, "", 9, 3, "a"), (1, "a", 8, 2, "a"), (1, "a", 8, 2, "b c"), (2, "b c", 7, 1, "")]


def test_fingerprint_over_many_buckets(spark):
    df = frame(spark, [f"text number {i}" for i in range(500)], 100)
    got = {r["doc_id"]: r["edited"] for r in rows(fingerprint.edited_neighbours(df))}
    assert len(got) == 500
    for i in range(500):
        t, u = f"text number {i}", f"text number {(i + 1) % 500}"
        assert got[100 + i] == t[: len(t) - len(t) // 4] + u[: len(t) // 4]


def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(table.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in rows(language.identify(table, model))}
    truth = {r["doc_id"]: r["lang"] for r in table.where("doc_id % 2 = 1").collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in truth.items()]) > 0.95
    odd = rows(language.identify(frame(spark, ODD), model))
    assert all((r["lang_pred"] == "und") == (not language.words_of(t)) and 0 <= r["score"] <= 1 for r, t in zip(sorted(odd, key=lambda r: r["doc_id"]), ODD, strict=True))
    assert {r["lang_pred"] for r in rows(language.identify(frame(spark, ODD), language.fit([])))} == {"und"}


def test_language_labels_switches():
    de, en = "der die und nicht ist ein sich auf mit", "the of and that with this from were which"
    rng = random.Random(3)
    m = language.fit([("de", " ".join(rng.choices(de.split(), k=400))), ("en", " ".join(rng.choices(en.split(), k=400)))], rounds=40)
    (post,) = m.label([f"{en} {en} {de} {de}"])
    assert (post.argmax(1) == [1] * 18 + [0] * 18).all()


def test_language_pieces_equal_one_pass(monkeypatch):
    m = language.Model(["a", "b", "c"], {}, np.zeros((0, 3), np.float32), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]], np.float32), np.array([0.2, 0.3, 0.5], np.float32))
    monkeypatch.setattr(m, "emissions", lambda w: np.array([[1 + len(x), ord(x[0]) - 90, 3] for x in w], np.float32))
    monkeypatch.setattr(language, "PIECE", 4)
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["aa", "b", "cc", "dddd", "e"], k=n)) for n in (1, 3, 4, 5, 9, 17, 30)]
    for t, p in zip(texts, m.label(texts), strict=True):
        e = m.emissions(t.split())[None]
        q, _ = language.forward_backward(e, np.array([e.shape[1]]), m.trans, m.start)
        assert np.allclose(q[0], p, atol=1e-4)


def line_brute(texts, least):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for x in split for k in {key(line) for line in x} if k)
    return [(len(x), sum(seen[key(y)] >= least for y in x), "\n".join(y for y in x if seen[key(y)] < least)) for x in split]


def test_lines(docs):
    texts = [t for (t,) in docs.orderBy("doc_id").select("text").collect()]
    for batches in (1, 3, 7):
        got = sorted(rows(lines.drop_frequent_lines(docs, 3, batches)), key=lambda r: r["doc_id"])
        assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == line_brute(texts, 3)
    assert set(docs.columns) <= set(got[0])


def test_lines_by_shuffle(docs, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    texts = [t for (t,) in docs.orderBy("doc_id").select("text").collect()]
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in sorted(rows(lines.drop_frequent_lines(docs, 3)), key=lambda r: r["doc_id"])] == line_brute(texts, 3)


def window_brute(texts, n):
    split, first = [words_of(t) for t in texts], {}
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in enumerate(split):
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize(("n", "batches"), [(13, 3), (5, 4), (2, 1)])
def test_windows(docs, n, batches):
    texts = [t for (t,) in docs.orderBy("doc_id").select("text").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(windows.remove_repeated_windows(docs, n, batches)))
    assert got == window_brute(texts, n)


def test_windows_of_batches_cut_by_size():
    texts = ["a b " * 900_000, None, "one two three", "", "c d\t" * 1_500_000, "four", "e f\n" * 700_000]
    ids, shared = list(range(len(texts))), [[1, 2], None, None, None, [3], [4, 5], None]
    batch = pa.record_batch([pa.array([None, *ids]), pa.array([0, *ids]), pa.array(["", *texts]), pa.array([None, *shared], pa.list_(pa.int64()))], names=["doc_id", "rid", "text", "shared"]).slice(1)
    got = [r for out in windows._touched([batch]) for r in out.to_pylist()]
    assert [(r["doc_id"], r["rid"], r["text"], r["shared"]) for r in got] == [(i, i, t if s else None, s) for i, t, s in zip(ids, texts, shared, strict=True)]
    assert [(r["n_words"], r["kept_sha256"]) for r in got] == [(None, None) if s else (len(words_of(t)), sha(" ".join(words_of(t)))) for t, s in zip(texts, shared, strict=True)]
    texts = [t or "" for t in texts]
    starts = [[0, 5], None, None, None, [2_999_990], None, [10]]
    lists = lambda x: pa.array([[9], *x], pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array([0, *ids]), pa.array(["", *texts]), lists(starts), lists([s and [1] * len(s) for s in starts])], names=["doc_id", "text", "starts", "counts"]).slice(1)
    got = [r for out in windows._removed(13)([batch]) for r in out.to_pylist()]
    for r, t, s in zip(got, texts, starts, strict=True):
        w = words_of(t)
        gone = {j for k in s or [] for j in range(k, min(k + 13, len(w)))}
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_tokenizer_and_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    own = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    texts = [t or "" for (t,) in docs.orderBy("doc_id").select("text").collect()]
    for t in [*texts, "İ ΣΑΣ ﬁ é don't x²y ½ <|endoftext|>a b<|startoftext|> _a_ \x1c z\x85q", "日本語　テスト", "Ǆ ŉ \xad"]:
        assert own.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    limit = 64
    got = rows(packing.best_fit_packing(docs, limit=limit))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(k, len(ids[k : k + limit]), zlib.crc32(np.array(ids[k : k + limit], "<u4").tobytes())) for k in range(0, len(ids), limit)]
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    assert len(by_seq) <= 1.1 * sum(r["length"] for r in got) / limit + 1


def test_plan_bins_is_whole_and_tight():
    rng = random.Random(2)
    for _ in range(30):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        plan = packing.plan_bins(dict(counts), 100)
        used = Counter()
        for bin_, times in plan:
            assert sum(bin_) <= 100
            for n in bin_:
                used[n] += times
        assert used == counts


def test_quality(spark, sf):
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in rows(quality.scored(table, labels))}
    assert len(got) == table.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(got[r["doc_id"]] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows(quality.scored(frame(spark, ODD), labels)))
    assert quality.keep_good(frame(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_urls(spark):
    cases = ["http://A.org/x", "https://sub.Example.org/es/1?q", "http://example.org/en/123", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#f", "http://notorg/", "no scheme", None, "", "a://b.example.net", "http://com/fr/x"]
    df = spark.createDataFrame([(i, u, None if i == 2 else '<a href="http://x.com/de/">') for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in rows(urls.judge(df))}
    assert len(got) == len(cases)
    assert [got[i]["rule"] for i in range(len(cases))] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "com/fr/"]
    assert [got[i]["host"] for i in (0, 7, 10)] == ["a.org", "", "b.example.net"] and got[1]["path"] == "/es/1"
    assert [got[i]["verdict"] for i in range(6)] == ["allow", "block", "block", "allow", "allow", "block"]


def test_url_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("d", "c", 1.0)]
    seeds = {"a": (2.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 3.0), "d": (0.0, 1.0)}
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows(urls.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good double, bad double")))}
    names = sorted(seeds)
    for col, flip in ((0, False), (1, True)):
        s = np.array([seeds[h][col] for h in names])
        s /= s.sum()
        m = np.zeros((4, 4))
        for a, b, w in edges:
            m[names.index(b if flip else a), names.index(a if flip else b)] += w
        m /= np.maximum(m.sum(1, keepdims=True), 1e-12)
        x = s.copy()
        for _ in range(urls.ITERATIONS):
            x = (1 - urls.DAMPING) * s + urls.DAMPING * x @ m
        assert np.allclose(x, [got.get(h, (0, 0))[col] for h in names])


def test_golay_lists_share_a_codeword():
    assert len(np.unique(simhash._LEADER)) == 2048
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    lists = defaultdict(set)
    for r, c in zip(*simhash.codewords_near(w), strict=True):
        lists[r].add(c)
    for bit in range(23):
        other = defaultdict(set)
        for r, c in zip(*simhash.codewords_near(w ^ np.uint32(1 << bit)), strict=True):
            other[r].add(c)
        assert all(lists[r] & other[r] for r in range(300))


def test_golay_keys_find_two_errors():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 200).astype(np.uint64)

    def keys(x):
        out = defaultdict(set)
        for r, k in zip(*simhash.golay_keys(x), strict=True):
            out[r].add(k)
        return out

    mine = keys(fps)
    for _ in range(60):
        a, b = rng.choice(64, 2, replace=False)
        other = keys(fps ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)))
        assert all(mine[r] & other[r] for r in range(200))


def component_brute(ids, fps, bits=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [32, 2])
def test_simhash_components(spark, small):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(160):
        x = base[i % 6]
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.classes(df, small=small))}
    assert got == component_brute(list(fps), fps)


def test_simhash_query_rows(spark, docs):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: fp(t) for i, t in texts.items()}
    got = rows(simhash.classes(simhash.fingerprints(docs)))
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == component_brute(list(fps), fps)


def test_near_dedup(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(20):
        w = [f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(w))
        v = list(w)
        v[len(v) // 2] = "changed"
        texts += [" ".join(v), " ".join(w), " ".join(w[: len(w) // 2])]
    texts += [None, "", "short one", "short one"]
    kept = {r["doc_id"] for r in rows(simhash.near_dedup(frame(spark, texts)))}

    def shingles(t):
        w = words_of((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    for i, s in enumerate(sets):
        like = [j for j in range(i) if (len(s & sets[j]) / len(s | sets[j]) if s | sets[j] else 1.0) >= 0.8]
        if i in kept:
            assert not like, i
        else:
            assert any((len(s & sets[j]) / len(s | sets[j]) if s | sets[j] else 1.0) >= 0.75 for j in range(len(sets)) if j != i), i


def test_near_groups_around_a_hub(spark):
    """Variants of one text, each like it and unlike each other, one of them before it: all are one group."""
    base = [f"h{i}" for i in range(200)]
    variants = []
    for k in range(10):
        v = list(base)
        for j in range(4):
            v[5 + 19 * k // 2 + 24 * j] = f"v{k}x{j}"
        variants.append(" ".join(v))
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_groups(frame(spark, [variants[0], *variants[1:5], " ".join(base), *variants[5:]])))}
    assert got == dict.fromkeys(range(11), 0)


def test_every_pair_of_a_key_that_is_not_in_one_component(spark):
    members = spark.createDataFrame([(7, i, 0, 50) for i in range(24)], "key long, doc_id long, pos int, n long")
    pairs = simhash._across(members, spark.createDataFrame([(1, 0), (0, 0)], "node long, root long"))
    assert {(r["a"], r["b"]) for r in rows(pairs)} == {(a, b) for a in range(24) for b in range(a + 1, 24)} - {(0, 1)}


def test_pairs_of_a_crowd_are_made_once(spark, monkeypatch):
    """Under crowded keys too every pair comes out that may be like at the first key that it shares."""
    rng = random.Random(31)
    keys = {i: sorted(rng.sample(range(40), 10)) for i in range(30)}
    members = spark.createDataFrame([(k, i, at, 60) for i, ks in keys.items() for at, k in enumerate(ks)], "key long, doc_id long, pos int, n long")
    info = spark.createDataFrame([(i, ks) for i, ks in keys.items()], "doc_id long, keys array<long>")
    roots = spark.createDataFrame([(i, 0) for i in range(12)], "node long, root long")
    want = set()
    for a, b in combinations(keys, 2):
        both = [k for k in keys[a] if k in keys[b]]
        if both and not (a < 12 and b < 12) and min(60 - keys[a].index(both[0]), 60 - keys[b].index(both[0])) >= 120 * 0.8 / 1.8 - 1e-6:
            want.add((a, b))
    for crowd in (0, 5, 1000):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = [(r["a"], r["b"]) for r in rows(simhash._across(members, roots, 0.8, lambda ids: info.join(ids, "doc_id", "left_semi")))]
        assert len(got) == len(set(got)) and want <= set(got)
        assert crowd or set(got) == want


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 500])
def test_keys_that_stream_through_one_task(cut):
    """Rows kept of sorted keys are those of a plain grouping, wherever batches end; salted rows need room only."""
    rng = np.random.default_rng(cut)
    got = sorted((int(k), int(s), int(n), int(p), i) for i, (k, s, n, p) in enumerate(zip(rng.integers(0, 60, 150), rng.integers(0, 2, 150), rng.integers(5, 40, 150), rng.integers(0, 5, 150), strict=True)))
    table = pa.table({"doc_id": [r[4] for r in got], "n": [r[2] for r in got], "pos": pa.array([r[3] for r in got], pa.int32()), "key": [r[0] for r in got], "salt": pa.array([r[1] for r in got], pa.int32())})
    kept = {i for b in simhash._shared(iter(table.to_batches(max_chunksize=cut)), 0.8) for i in b["doc_id"].to_pylist()}
    brute = set()
    for k, s, n, p, i in got:
        run = [r for r in got if r[:2] == (k, s)]
        least = 0.8 * n if s else max(0.8 * n, min(r[2] for r in run))
        if (s or len(run) > 1) and least <= (n - p) * 2.25 - n + 1e-6:
            brute.add(i)
    assert kept == brute and 0 < len(brute) < 150


def test_sketch_bits_estimate_likeness():
    """Pairs of 0.8 are never ruled out and unlike ones are, for sets of any size."""
    rng = np.random.default_rng(5)
    for n in (9, 90, 2000):
        for _ in range(40):
            h = np.unique(rng.integers(0, 1 << 63, n + n // 9).astype(np.uint64))
            a, b, c = h[: n], h[n // 9 :], np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            bits = [simhash.sketch_bits(x).tobytes() for x in (a, b, c)]
            assert simhash.may_be_like([bits[0], bits[0]], [bits[1], bits[2]], 0.8).tolist() == [True, False]
    assert simhash.may_be_like([], [], 0.8).tolist() == []


@pytest.mark.parametrize("few", [False, True])
def test_joins_behind_a_bit_filter(spark, monkeypatch, few):
    """Semi- and anti-joins are the plain ones, null and repeated keys included, also where the filter is full."""
    monkeypatch.setattr(common, "FILTER_BITS", 64 if few else 1 << 23)
    docs = spark.createDataFrame([(i % 500 if i % 7 else None, f"t{i}") for i in range(900)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 900, 3), 0, 3]] + [(None,)], "doc_id long")
    for got, how in ((common.with_ids(docs, ids), "left_semi"), (common.without_ids(docs, ids), "left_anti")):
        assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in docs.join(ids, "doc_id", how).collect())
    assert common.without_ids(docs, ids.limit(0)).count() == 900 and common.with_ids(docs, ids.limit(0)).count() == 0


def test_near_groups_with_hot_buckets(spark, monkeypatch):
    """Dealing keys over salts leaves the groups as they are; rows without an id stay."""
    monkeypatch.setattr(simhash, "HOT_ROWS", 0)
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 3)] + [" ".join(f"y{k}-{i}" for i in range(30)) for k in range(10)]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, None)], "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert groups == {i: 0 for i in range(20)}
    assert sorted(r["doc_id"] for r in simhash.near_dedup(df).collect() if r["doc_id"] is not None) == [0, *range(20, 30)]
    assert simhash.near_dedup(df).where("doc_id is null").count() == 2


def test_prefix_keys_are_shared_by_all_like_sets():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, 1 << 20)
    for n in [*range(1, 40), *rng.integers(40, 900, 60).tolist()]:
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(4):
            gone = rng.integers(0, n // 5 + 1)
            b = np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * len(np.union1d(a, b)):
                assert len(np.intersect1d(simhash.prefix_keys(a, counts, 0.8), simhash.prefix_keys(b, counts, 0.8)))


def test_near_groups_of_short_and_long_texts(spark):
    """Nothing of likeness 0.8 is lost: a word appended to ten words, five words changed of 430."""
    rng = random.Random(12)
    texts, want = [], {}
    for k in range(60):
        w = [f"s{k}n{i}" for i in range(10 if k % 2 else 430)]
        v = [*w, "tail"] if k % 2 else list(w)
        for at in [] if k % 2 else rng.sample(range(5, 425, 10), 5):
            v[at] = "new"
        want |= {len(texts): len(texts), len(texts) + 1: len(texts)}
        texts += [" ".join(w), " ".join(v)]
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.near_groups(frame(spark, texts)))} == want


def test_near_groups_decide_by_whole_sets(spark):
    """Likeness just above and just below 0.8 in texts of many more shingles than a sketch holds."""
    rng = random.Random(14)
    texts, want = [], {}
    for k in range(60):
        w = [f"e{k}n{i}" for i in range(430)]
        v = list(w)
        for at in rng.sample(range(5, 425, 10), 9 + k % 2):
            v[at] = "new"
        if k % 2 == 0:
            want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
        texts += [" ".join(w), " ".join(v)]
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.near_groups(frame(spark, texts)))} == want


def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 3, 10])
        t = np.r_[np.array([rng.randint(1, k) for _ in range(n)], np.uint8), np.uint8(0)]
        out = []
        suffixes.sorted_suffixes(t, 10**6, lambda p, v: out.append((p.copy(), v.copy())))
        order, value = np.concatenate([p for p, _ in out[::-1]]), np.concatenate([v for _, v in out[::-1]])
        b = t.tobytes()
        assert order.tolist() == sorted(range(n + 1), key=lambda i: b[i:])
        for i in range(1, n + 1):
            x, y = b[order[i - 1] :], b[order[i] :]
            same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert value[i] == same


def string_brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("n", "shard", "memory"), [(400, 1 << 22, 1 << 26), (50, 300, 1 << 26), (20, 100, 50)])
def test_strings(docs, monkeypatch, n, shard, memory):
    monkeypatch.setattr(suffixes, "MEMORY", memory)
    texts = [t for (t,) in docs.orderBy("doc_id").select("text").collect()]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(substrings.remove_repeated_strings(docs, n, shard)))
    assert got == string_brute(texts, n)


def test_hot_anchors_are_dealt_anew(spark, monkeypatch):
    """One gram in many texts, periodic texts and long texts in pieces: the same result whatever is hot."""
    rng = random.Random(8)
    mid = "".join(rng.choices("abcdefgh", k=30))
    texts = ["".join(rng.choices("xyz", k=rng.randint(0, 40))) + mid + rng.choice(["", mid]) + "".join(rng.choices("xyz", k=rng.randint(0, 40))) for _ in range(60)]
    texts += ["ab" * 200, "ab" * 57 + "c", "a" * 333, texts[3], texts[3] + texts[5], "".join(rng.choices("pq", k=3000)), None, ""]
    df = frame(spark, texts)
    for shard in (1, 1 << 20):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(substrings.remove_repeated_strings(df, 24, shard)))
        assert got == string_brute(texts, 24)


def test_repeats_within_a_text_at_every_place(spark):
    """A period around the 65536th byte of a batch, where places of grams start again: its windows repeat each other there, too."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=65536 - 11)), "abcdefg" * 5]
    df = frame(spark, texts).coalesce(1)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(substrings.remove_repeated_strings(df, 24)))
    assert got == string_brute(texts, 24) and got[1][2:4] == (35, 1)


def test_long_texts_are_scanned_in_pieces(spark):
    rng = random.Random(10)
    docs = [(1, 2, "".join(rng.choices("abcd", k=5000))), (3, 4, "".join(rng.choices("abcd", k=90)))]
    df = spark.createDataFrame(docs, "u1 long, u2 long, text string")

    def windows_of(most):
        return sorted((r["anchor"], r["u1"], r["first"] + k) for r in rows(substrings.occurrences(df, 40, most)) for k in range(r["count"]))

    assert windows_of(200) == windows_of(1 << 19) and len(windows_of(200)) == 4961 + 51


def test_repeated_on_disk_equals_in_memory():
    rng = random.Random(7)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        for x, y in zip(suffixes.repeated(parts, 4, 1), suffixes.repeated(parts, 4), strict=True):
            assert x.tolist() == y.tolist()


def test_decontamination(spark):
    rng = random.Random(6)
    item = [f"q{i}" for i in range(30)]
    fuzzy = list(item)
    fuzzy[7], fuzzy[19] = "x", "y"
    far = [w if i % 2 else f"z{i}" for i, w in enumerate(item)]
    other = [f"o{rng.randint(0, 500)}" for _ in range(50)]
    texts = [" ".join(other[:20] + item + other[20:]), " ".join(other + fuzzy), " ".join(other + far), " ".join(other), None, "", "Tiny, item here!", " ".join(item[3:20]), " ".join(item[:8])]
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, "tiny item here"), (3, None), (4, "")], "item_id long, text string")
    df = frame(spark, texts)
    for limit in (10**6, 0):
        got = {r["doc_id"]: r for r in rows(decontaminate.decontaminate(df, bench, broadcast_words=limit))}
        assert [got[i]["contaminated"] for i in range(len(texts))] == [True, True, False, False, False, False, True, True, False]
        assert got[0]["overlap_start"] == 20 and got[0]["matched"] == 30 and got[1]["matched"] == 28
    assert {r["doc_id"] for r in rows(decontaminate.clean(df, bench))} == {2, 3, 4, 5, 8}


def test_masks_hit_every_overlap():
    for n, bits, masks in [*((n, bits, decontaminate.MASKS) for n, bits in ((13, 2), (15, 3), (20, 4), (25, 5))), *((n, n // 5, decontaminate.short_masks(n)) for n in range(1, 13))]:
        at = [int(m, 2) << k for m in masks for k in range(n - len(m) + 1)]
        changed = np.array([sum(1 << b for b in c) for c in combinations(range(n), bits)], np.int64)
        assert np.all((changed[:, None] & np.array(at)).min(axis=1) == 0), (n, bits)


def test_overlap_is_any_run_that_qualifies():
    rng = random.Random(21)
    for _ in range(3000):
        n = rng.randint(1, 40)
        rate = rng.choice([0.6, 0.75, 0.85])
        item, doc = np.arange(1, n + 1), np.array([i if rng.random() < rate else 0 for i in range(1, n + 1)])
        least = min(13, n)
        want = any(5 * int((doc[a:b] > 0).sum()) >= 4 * (b - a) for a in range(n) for b in range(a + least, n + 1))
        matched, start, words = decontaminate.overlap(doc, item, 0)
        assert bool(words) == want
        assert not words or (words >= least and matched == (doc[start : start + words] > 0).sum() and 5 * matched >= 4 * words)


def test_decontamination_of_partly_rewritten_items(spark):
    item, short = [f"p{i}" for i in range(51)], [f"k{i}" for i in range(10)]
    copied = [w if i % 19 < 13 else f"new{i}" for i, w in enumerate(item)]
    two = [f"z{i}" for i in range(9)] + [w if i not in (2, 7) else "new" for i, w in enumerate(item[:13])]
    third = ["new" if i in (2, 6) else w for i, w in enumerate(short)]
    far = ["new" if i % 3 == 2 else w for i, w in enumerate(item)]
    df = frame(spark, [" ".join(x) for x in (copied, two, third, far, third[:9])])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    for limit in (10**6, 0):
        got = {r["doc_id"]: r["contaminated"] for r in rows(decontaminate.decontaminate(df, bench, broadcast_words=limit))}
        assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_and_odd_tables(spark, tmp_path, name):
    for kind, texts in (("empty", []), ("odd", [*ODD, *ODD])):
        d = tmp_path / kind
        frame(spark, texts).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(1, "tiny item here")][: len(texts)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(str(d / "pages.parquet"))
        n = queries.QUERIES[name](spark, str(d)).count()
        assert n == len(texts)
