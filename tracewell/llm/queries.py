"""The operators' queries over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    common,
    decontamination,
    divergence,
    hyperminhash,
    lattice,
    packing,
    prefix_trie,
    quality_qda,
    quality_rules,
    simhash,
    token_counts,
    token_files,
    tokens,
    url_filters,
    warc,
)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"), width=3)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, common.read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model, ["doc_id"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).drop("row")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = quality_qda.fit(docs, common.read(spark, sf_dir, "labels"))
    scored = quality_qda.classify(docs, model, ["doc_id"])
    return scored.withColumn("held_out", common.held_out(F.col("doc_id"), 3))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.read(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = common.shared_folder(spark)
    files = token_files.write(docs, tokens.vocabulary("word_bpe_49k.json"), folder, end_id=2)
    return token_files.read_back(spark, files)


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", common.held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    learns = common.learnable(F.col("doc_id"), 5)
    return lattice.score(docs, tokens.vocabulary("piece_bpe_32k.model"), learns)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(common.read(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(common.read(spark, sf_dir, "pages"), common.shared_folder(spark))
    return warc.read(spark, files)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.read(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(common.read(spark, sf_dir, "conversations"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(common.read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_quality_rules,
        op3_token_counts,
        op4_token_files,
        op5_lattice,
        op6_url_filters,
        op7_warc,
        op8_packing,
        op9_decontamination,
        op10_quality_classifier,
        op11_divergence,
        op12_prefix_trie,
        op13_hyperminhash,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_url_filters": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
valued AS (
  SELECT url, concat(regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
                     regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
                     regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)) AS rel,
              concat(regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
                     regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
                     regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)) AS href FROM tags),
raw AS (
  SELECT url, href AS t FROM valued WHERE regexp_matches(rel, '(?is)(^|\s)canonical(\s|$)')
  UNION ALL
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*[''"]?([^''">\s]+)', 1)
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
split AS (
  SELECT url, t, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, concat(regexp_extract(url, '(?s)^(.*?)://', 1), '://', regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS site,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS base, regexp_extract(t, '(?s)^([^?#]*)', 1) AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS rest
  FROM (SELECT url, regexp_replace(trim(t), '&(amp|#38|#x26);', '&', 'gi') AS t FROM raw WHERE t <> '')),
whole AS (
  SELECT *, CASE WHEN starts_with(t, '/') THEN own WHEN contains(base, '/') THEN concat(regexp_extract(base, '(?s)^(.*/)', 1), own) ELSE concat('/', own) END AS long FROM split),
dotless AS (
  SELECT *, concat(list_reduce(list_prepend('', string_split(long, '/')[2:]), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE concat(done, '/', x) END),
                   CASE WHEN regexp_matches(long, '(?s)/\.\.?$') THEN '/' ELSE '' END) AS short FROM whole),
targets AS (
  SELECT url AS a, b FROM (
    SELECT url, CASE WHEN NOT contains(url, '://') OR regexp_matches(t, '(?s)^[A-Za-z][A-Za-z0-9+.\-]*:') THEN CASE WHEN contains(t, '://') THEN t END
                     WHEN starts_with(t, '//') THEN concat(scheme, ':', t)
                     WHEN starts_with(t, '/') THEN concat(site, short, rest)
                     WHEN starts_with(t, '?') THEN concat(site, base, t)
                     WHEN own <> '' THEN concat(site, short, rest) END AS b FROM dotless) WHERE b IS NOT NULL),
addresses AS (
  SELECT u, concat(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) END) AS adr
  FROM (SELECT a AS u FROM targets UNION SELECT b FROM targets UNION SELECT url FROM pages) WHERE contains(u, '://')),
edges AS (
  SELECT DISTINCT x.adr AS a, y.adr AS b FROM targets t JOIN addresses x ON t.a = x.u JOIN addresses y ON t.b = y.u WHERE x.adr <> y.adr),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
ruled AS (
  SELECT adr, arg_max(r_verdict, length(r_host) * 10000 + length(r_path)) AS v
  FROM addresses, rules
  WHERE (regexp_extract(adr, '^[^/?]*') = r_host OR ends_with(regexp_extract(adr, '^[^/?]*'), concat('.', r_host)))
    AND starts_with(regexp_extract(adr, '^[^/?]*([^?]*)', 1), r_path)
  GROUP BY adr),
spread AS (
  SELECT node FROM reach LEFT JOIN ruled ON reach.other = ruled.adr GROUP BY node
  HAVING bool_or(coalesce(v, '') = 'block') AND NOT bool_or(coalesce(v, '') = 'allow')),
fits AS (
  SELECT DISTINCT p.host, p.path, arg_max(concat(r_host, r_path), length(r_host) * 10000 + length(r_path)) AS rule,
         arg_max(r_verdict, length(r_host) * 10000 + length(r_path)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) p, rules
  WHERE (p.host = r_host OR ends_with(p.host, concat('.', r_host))) AND starts_with(p.path, r_path)
  GROUP BY p.host, p.path)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN adr IN (SELECT node FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (host, path) LEFT JOIN addresses ON parts.url = addresses.u
""",
    "op7_warc": r"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM bodies)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST(concat('0x', substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM hashed
""",
    "op9_decontamination": r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lowered, lengths WHERE len(w) >= m)),
hits AS (SELECT r, m, i, item_id FROM grams JOIN windows USING (m, gram)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
        FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
""",
    "op11_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL) GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS n FROM words GROUP BY lang, term HAVING sum(docs) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
held AS (SELECT w.lang, w.source, w.term, w.n FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 2)) // (g.total + 2 * s.v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (s.total + 2 * s.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crcs AS (
  SELECT conv_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, ch: list_reduce(list_concat([xor(crc, ch)], [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]),
      lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)) AS raw
  FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (SELECT conv_id, xor(raw, 4294967295::BIGINT) % 9 AS h, conv_id - conv_id % 5 AS base FROM crcs),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
rows_ AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, sha256(concat(strlen(role), ':', role, text)) AS said FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
paths AS (
  SELECT conv_id, depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rows_
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY path),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)),
kids AS (SELECT above AS path, count(*) AS n_children FROM linked WHERE above IS NOT NULL GROUP BY above),
closed AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (path)),
under AS (
  SELECT a.path, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM closed a JOIN closed d ON starts_with(d.path, a.path) GROUP BY a.path),
enders AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN ends USING (conv_id, depth) GROUP BY path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM closed JOIN under USING (path) LEFT JOIN enders USING (path)
""",
    "op13_hyperminhash": r"""
WITH RECURSIVE lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
kinds AS (SELECT array_to_string(w, ' ') AS said, min(r) AS k, any_value(w) AS w FROM lowered WHERE len(w) > 0 GROUP BY said),
grams AS (SELECT DISTINCT k, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT k, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM kinds)),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
links AS (
  SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.k < b.k JOIN sizes x ON x.k = a.k JOIN sizes y ON y.k = b.k
  GROUP BY a.k, b.k, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k AS node, k AS other FROM kinds UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
placed AS (SELECT l.r, l.doc_id, s.k, s.n FROM lowered l JOIN kinds d ON array_to_string(l.w, ' ') = d.said AND len(l.w) > 0 JOIN sizes s ON s.k = d.k),
least AS (SELECT reach.node AS k, min(p.doc_id) AS component_id FROM reach JOIN placed p ON p.k = reach.other GROUP BY reach.node)
SELECT l.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_shingles, CASE WHEN p.k IS NULL THEN l.doc_id ELSE component_id END AS component_id,
       l.doc_id IS NOT DISTINCT FROM CASE WHEN p.k IS NULL THEN l.doc_id ELSE component_id END AS kept
FROM lowered l LEFT JOIN placed p USING (r) LEFT JOIN least ON least.k = p.k
""",
}
