"""Alignment, circulant MinHash and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import alignment, minhash, queries, simhash, trie

SCHEMA = "doc_id long, text string, n long, key long, row long, a long, n_shingles long"
ODD = [None, "", " ", "\n", "one", "one two", "A b\tc\r\nd  e f", "wörter über alles ß", "x" * 3000, "a ", "a \n b", "<|endoftext|> </s> <s>", "▁x", "naïve é ﬁ Ａ   x\x85y \xa0z\x00q", "日本語 テキスト🙂 \n\n\n  hi   ", "it's we'll   don't \n 's", "same text here", "same text here"]


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, 8, 9, 10, 11) for i, t in enumerate(texts)], SCHEMA)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))


# --- op11 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P

    return alignment.Aligner(P.path(alignment.A_FILE), P.path(alignment.B_FILE))


def aligned_brute(tok, text):
    """(n_a, n_b, groups, links) by the whole text's tokens and their byte offsets."""
    if not text:
        return 0, 0, [], []
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    said_a, said_b = [tok.spell_a[i] for i in a], [tok.spell_b[i] for i in b]
    whole = (" " + text).encode()
    if b"".join(said_a) != whole or b"".join(said_b) != whole:
        return 0, 0, [], []
    ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:x], b[j:y]))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), groups, links


def align_brute(tok, texts):
    each = [aligned_brute(tok, t) for t in texts]
    count = Counter(p for e in each for p in e[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_alignment_equals_brute_force(spark, sf, tokenizers):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = rows(alignment.align(frame(spark, texts).repartition(5)))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r[c] for c in columns) for r in got] == align_brute(tokenizers, texts)
    assert got[ODD.index("▁x")]["n_a"] == 0 and got[ODD.index("x" * 3000)]["n_a"] > 0


def test_alignment_query_and_repeats(spark, sf, tokenizers):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["count_sum"] for r in queries.op11_alignment(spark, sf).collect()}
    assert got == {r["doc_id"]: x[5] for r, x in zip(docs, align_brute(tokenizers, [r["text"] for r in docs]), strict=True)}
    twice = frame(spark, ["a b c"]).unionAll(frame(spark, ["a b c", "d"])).withColumn("doc_id", F.lit(None).cast("long"))
    assert len(alignment.align(twice).collect()) == 3 and alignment.align(frame(spark, ["x"]).limit(0)).count() == 0


def test_alignment_with_groups_of_a_long_text(spark, tokenizers):
    text = " ".join(f"wörd{i % 1000}, next.\n" for i in range(120_000))
    r = alignment.alignments(frame(spark, [text]), with_groups=True).first()
    assert r["groups_sha256"] == hashlib.sha256(r["groups"].encode()).hexdigest() and r["n_groups"] == sum(r["times"]) == r["groups"].count(";") + 1
    said = b"".join(tokenizers.spell_a[int(x)] for g in r["groups"].split(";") for x in g.split("|")[0].split(","))
    assert said == (" " + text).encode()


def test_transducer_against_offsets():
    """Random segmentations of random bytes over small vocabularies, memory that starts afresh, and sides that differ."""
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(60)]
    t = alignment.Transducer(words, words[::-1])
    for k in range(400):
        whole = bytes(rng.choices(b"ab", k=rng.randint(0, 30)))
        sides = []
        for vocabulary in (words, words[::-1]):
            ids, at = [], 0
            while at < len(whole):
                fit = [i for i, w in enumerate(vocabulary) if whole.startswith(w, at)]
                if not fit:
                    break
                ids.append(rng.choice(fit))
                at += len(vocabulary[ids[-1]])
            sides.append(ids if at == len(whole) else None)
        a, b = sides
        if a is None or b is None:
            continue
        ends = [np.cumsum([0] + [len(v[i]) for i in ids]).tolist() for v, ids in ((words, a), (words[::-1], b))]
        assert t.groups(a, b) == [(ends[0].index(c), ends[1].index(c)) for c in sorted(set(ends[0]) & set(ends[1])) if c]
        if k % 50 == 49:
            t._clear()
    assert t.groups([0], []) is None and t.groups([], [0]) is None and t.groups([], []) == []
    other = next(i for i, w in enumerate(words[::-1]) if w[:1] != words[0][:1])
    assert t.groups([0], [other]) is None


# --- op12 ---------------------------------------------------------------------------------------------------------------


def near_brute(texts, n, share):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def near_texts(rng):
    """Copies, near copies on both sides of 0.85, chains, a crowd of near copies, stock phrases and short texts."""
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for n in (5, 9, 20, 60, 300):
        for _ in range(8):
            w = rng.choices(words, k=n)
            texts.append(" ".join(w))
            for _ in range(3):
                for at in rng.sample(range(n), max(1, n // rng.choice([15, 40, 90]))):
                    w[at] = rng.choice(words)
                texts.append(" ".join(w).upper())
    base = rng.choices(words, k=200)
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    phrases = [" ".join(rng.choices(words, k=12)) for _ in range(12)]
    texts += [" ".join(rng.choices(phrases, k=6)) for _ in range(120)]
    return texts


def test_minhash_equals_brute_force(spark):
    texts = near_texts(random.Random(11))
    got = rows(minhash.near_duplicates(frame(spark, texts).repartition(4), 3, 0.85))
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got] == near_brute(texts, 3, 85)
    five = rows(minhash.near_duplicates(frame(spark, texts)))
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in five] == near_brute(texts, 5, 80)


def test_minhash_ids(spark):
    """Rows without an id stay alone; rows of one id are one document, linked where any of its texts is."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(None, a), (None, a), (5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, "c d e"), (5, a)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3, 0.85).collect())
    assert got == Counter({(None, 38, None, True): 2, (5, 38, 5, True): 3, (6, 39, 5, False): 1, (7, 39, 5, False): 1, (8, 1, 8, True): 1})
    assert minhash.near_duplicates(df.limit(0), 3, 0.85).count() == 0


def test_circulant_signature_estimates_likeness():
    """Coordinates agree as often as the sets are alike; each is the first permutation turned by its number."""
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for same in (200, 900, 1800):
        x, y = np.r_[whole[:same], whole[2000 : 4000 - same]], np.r_[whole[:same], whole[4000 - same :]]
        x, y = np.unique(x), np.unique(y)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        a, b = minhash.signature(x), minhash.signature(y)
        assert abs((a == b).mean() - true) < 0.1
    place = int((whole[:1] * minhash._MIX)[0] >> np.uint64(44))
    table = np.random.default_rng(20240117).permutation(minhash.PLACES)
    assert minhash.signature(whole[:1]).tolist() == [table[(place + k) % minhash.PLACES] for k in range(minhash.COORDINATES)]
    keys = minhash.band_keys(a)
    assert len(keys) == 51 and len(set(keys.tolist())) == 51 and (keys == minhash.band_keys(a.copy())).all()
    assert minhash.fewest(0.85) == 6 and minhash.fewest(0.8) == 4


def test_minhash_long_text(spark):
    text = " ".join(f"w{i * i % 99991}" for i in range(400_000))
    got = rows(minhash.near_duplicates(frame(spark, [text, text + " end", "other words here and there now"]), 3, 0.85))
    assert [r["component_id"] for r in got] == [0, 0, 2] and got[0]["n_shingles"] == len(np.unique(simhash.shingle_hashes(text, 3)))


# --- op13 ---------------------------------------------------------------------------------------------------------------


def trie_brute(turns):
    """turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out, inner = [], {p[:-1] for p in members if p}
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if p not in inner]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, part long, depth long, owner long"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df):
    built = trie.prefix_trie(df, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, 5)
    return sorted((tuple(r[c] for c in NODE) for r in built.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    """Shared first turns, copies, absent bases, conversations with fewer turns than taken, nulls and repeated rows."""
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(1000), 70) + [0, 100, 300, 10_007, 4_000_000_000]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            text = rng.choice(["hi", "", None, "wörld ✓", f"text {rng.randint(0, 3)}"])
            turns.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), text, 1, 2, 3))
    turns += turns[:9] + [(None, 1, "user", "lost", 1, 2, 3)]
    turns += [(c, 0, "user", "the same first turn", 1, 2, 3) for c in range(5000, 5040)]
    assert trie_of(spark.createDataFrame(turns, TURNS).repartition(6)) == trie_brute([t[:4] for t in turns])


def test_trie_of_one_long_conversation(spark):
    """Most rows in one conversation, which is cut over several ranges; a very long text."""
    turns = [(7, t, "user", f"t{t % 3}", 0, 0, 0) for t in range(250)] + [(8, t, "user", f"t{t % 3}", 0, 0, 0) for t in range(200)] + [(9, 0, "user", "y" * 2_000_000, 0, 0, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(turns, TURNS).repartition(13)
        assert trie.numbered(df).where("conv_id = 7").select("part").distinct().count() > 2
        got = trie_of(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == trie_brute([t[:4] for t in turns])


def test_trie_empty(spark):
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "u", "x", 0, 0, 0)], TURNS)) == []


@pytest.mark.parametrize("name", ["op12_minhash", "op13_prefix_trie"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
