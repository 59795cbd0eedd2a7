"""The registered queries opN_<name>: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm import decontaminate, minhash, ngram_join, pieces, quality, repeats, resample, secrets, sharding, spelling, token_store, toxicity, url_filter
from veriskill.llm.common import table, written

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read_store(spark, folder)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit_grammar(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, grammar).select("doc_id", "held_out", "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = decontaminate.match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(matched).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), secrets.default_model(spark))
    return scanned.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), F.sha2(F.concat_ws(",", "secrets"), 256).alias("secrets_sha256"), F.crc32("redacted").alias("redacted_crc32"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.with_stats(table(spark, sf_dir, "documents")), "stats")
    forest = quality.fit_stats(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), number=3, least=85)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_sharding, op3_token_store, op4_suffix_dedup, op5_toxicity, op6_decontamination, op7_ngram_join, op8_secret_scan, op9_quality_rules, op10_pieces, op11_importance_resampling, op12_minhash, op13_spelling_variants)}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crcs)"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text that is not empty, beside a table `tab`."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1)"
    return f"CAST(xor(list_reduce({bytes_}, lambda a, y: xor(a >> 8, crcs[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS BIGINT)"


def _linked_sql(least: int) -> str:
    """(doc_id, n_shingles, component_id) over links of three-word shingle sets, from all pairs with a shingle in common."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""


#: SQL where it can express the query's rows and runs on whole tables in reasonable time.
ORACLES = {
    "op1_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m""",
    "op2_sharding": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crcs),
b AS (SELECT doc_id, coalesce(text, '') AS x, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1) AS bytes FROM documents),
d AS (SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size, sha256(x) AS key, CAST(CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(bytes, lambda a, y: xor(a >> 8, crcs[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) END AS BIGINT) AS text_crc32 FROM b, tab),
g AS (SELECT key, bytes, CAST(sum(bytes) OVER (ORDER BY key) AS BIGINT) AS upto FROM (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY key)),
lim AS (SELECT list(upto ORDER BY upto) AS ups, max(upto) AS total, greatest(max(bytes), (max(upto) + 7) // 8) AS low, max(bytes) + (max(upto) + 7) // 8 AS high FROM g),
bs(low, high) AS (SELECT low, high FROM lim UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (SELECT low, high, mid, total - list_reduce(range(7), lambda e, k: coalesce(list_max(list_filter(ups, lambda u: u <= e + mid)), e), CAST(0 AS BIGINT)) <= mid AS fits
    FROM (SELECT bs.low, bs.high, (bs.low + bs.high) // 2 AS mid, ups, total FROM bs, lim WHERE bs.low < bs.high))),
cuts(k, e) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT k + 1, coalesce(list_max(list_filter(ups, lambda u: u <= e + cap)), e) FROM cuts, lim, (SELECT min(high) AS cap FROM bs WHERE low >= high) WHERE k < 7),
p AS (SELECT d.*, (SELECT CAST(count(*) AS INTEGER) FROM cuts WHERE k > 0 AND g.upto > e) AS shard FROM d JOIN g USING (key))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, text_crc32)), 3, 2), doc_id, key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op6_decontamination": r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, n, k, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op7_ngram_join": _linked_sql(90),
    "op12_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({_linked_sql(85)})",
    "op11_importance_resampling": rf"""
WITH {_CRC_TABLE},
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
k AS (SELECT g, {_crc_sql("g")} % 10000 AS bucket FROM (SELECT g FROM df UNION SELECT g FROM bf), tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (g) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE) / ((CAST(s AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total FROM df JOIN k USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(CASE WHEN total < 0 THEN -((-total + n_features - 1) // n_features) ELSE total // n_features END, 0) AS BIGINT) AS weight,
        CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id)),
y AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM z) THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {_crc_sql("doc_id || ':' || w")} AS h FROM r, tab),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS g FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM n)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.g = b.g AND a.k = b.k AND a.word <> b.word
      UNION SELECT d.word, d.g FROM d JOIN n ON n.word = d.g UNION SELECT d.g, d.word FROM d JOIN n ON n.word = d.g),
q AS (SELECT p.word, p.other, o.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN n o ON o.word = p.other),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n.n THEN other END AS form, CASE WHEN other_n >= 5 * n.n THEN other_n END AS form_n FROM n LEFT JOIN q ON q.word = n.word AND k = 1),
c(word, root, root_n) AS (SELECT word, word, n FROM f UNION ALL SELECT c.word, f.form, f.form_n FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(root, root_n) AS root FROM c GROUP BY word) USING (word)""",
}
