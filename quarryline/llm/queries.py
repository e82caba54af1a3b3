"""The opN queries: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, fingerprint, language, lines, minhash, packing, quality, simhash, substrings, trie, urls, windows
from .common import table


def _held_out(n: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == rest


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))
    near = fingerprint.likeness
    return x.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint.encode(F.col("sketch")).alias("fingerprint"), fingerprint.encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        near(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), near(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~_held_out(5, 0)))
    return language.identify(docs, model).select("doc_id", F.coalesce(_held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(_held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 0.85)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, 5)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_language, op3_line_dedup, op4_substring_dedup, op5_packing, op6_quality, op7_url_filter, op8_simhash, op9_suffix_dedup, op10_decontamination, op11_alignment, op12_minhash, op13_prefix_trie)}

#: A line's key in DuckDB: ASCII white space stripped, A-Z lower-cased.
_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""

_OP4 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, generate_subscripts(w, 1) AS i FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x WHERE i + 12 <= len(w)),
lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN lo USING (s) WHERE lo < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM hit GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(x.w[x.i], ' ' ORDER BY x.i) AS k FROM x ANTI JOIN hit ON x.doc_id = hit.doc_id AND x.i = hit.i GROUP BY x.doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.g), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The unsigned CRC-32 of an ASCII string in DuckDB: the table of its bytes, then a fold over them.
_CRC = """
WITH RECURSIVE bits AS (SELECT range AS i, 0 AS k, range AS v FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
t AS (SELECT i, v FROM bits WHERE k = 8),
own AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
fold AS (SELECT c, CAST(c AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS crc FROM own
  UNION ALL SELECT c, s[2:], xor(crc // 256, t.v) FROM fold JOIN t ON t.i = xor(crc % 256, ascii(s)) WHERE s <> ''),
head AS (SELECT c, c - c % 100 AS p, xor(crc, 4294967295) % 6 AS h FROM fold WHERE s = '')
"""

_OP13 = f"""{_CRC},
x AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
taken AS (SELECT head.c, 0 AS g, x.pos, x.role, x.text FROM head JOIN x ON x.c = head.p AND x.pos <= head.h UNION ALL SELECT head.c, 1, x.pos, x.role, x.text FROM head JOIN x USING (c) WHERE x.pos > head.h),
s AS (SELECT head.c, coalesce(list((role, text) ORDER BY g, pos) FILTER (WHERE g IS NOT NULL), []) AS turns FROM head LEFT JOIN taken USING (c) GROUP BY head.c),
o AS (SELECT c, len(turns) AS last, unnest(range(len(turns) + 1)) AS d, turns FROM s),
k AS (SELECT c, last, d, turns[1:d] AS path, turns[1:d - 1] AS up, CASE WHEN d > 0 THEN length(turns[d][2]) ELSE 0 END AS size FROM o),
n AS (SELECT d, path, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size, max(last) AS deepest, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last = d), '')) AS ends FROM k GROUP BY d, path),
sub AS (SELECT a.d, a.path, sum((b.n - 1) * b.size) AS saved, count(*) FILTER (WHERE b.deepest = b.d) AS leaves FROM n a JOIN n b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.d, a.path)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, p.c AS parent_conv_id, n.n AS n_convs, (SELECT count(*) FROM n b WHERE b.d = n.d + 1 AND b.up = n.path) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN sub USING (d, path) LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.up
"""

_OP12 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, m.root = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

ORACLES = {"op12_minhash": _OP12, "op13_prefix_trie": _OP13, "op3_line_dedup": _OP3, "op4_substring_dedup": _OP4}
