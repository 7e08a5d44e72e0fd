"""The registered queries of this subpackage and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archives, audit, exact, langid, mixing, packing, pu, quoting, rules, simhash, suffixes, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.link_quotes(table(spark, sf_dir, "conversations"))


def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_report(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quote_linking": op1_quote_linking,
    "op2_archives": op2_archives,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_pu_quality": op7_pu_quality,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
}

OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS solid
  FROM d
), win AS (
  SELECT rid, i, ws[i:i + 4] AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again WHERE n > 1) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
         (length(solid) - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(solid, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), r AS (
  SELECT *, unnest([
    {'rule': 'symbols', 'v': CASE WHEN n_words > 0 THEN 1000 * greatest(n_symbols - 3, 0) // n_words ELSE 0 END},
    {'rule': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN 1000 * greatest(n_dup_lines - 2, 0) // n_lines ELSE 0 END},
    {'rule': 'repeats', 'v': CASE WHEN n_words > 0 THEN 1000 * greatest(n_repeat_words - 30, 0) // n_words ELSE 0 END},
    {'rule': 'capitals', 'v': CASE WHEN word_chars > 0 THEN 1000 * greatest(n_capitals - 5, 0) // word_chars ELSE 0 END}
  ]) AS x FROM b
), s AS (
  SELECT coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s, x.rule AS rule,
         CASE WHEN x.v < 128 THEN x.v ELSE 64 * (length(bin(x.v)) - 7) + (x.v >> (length(bin(x.v)) - 7)::BIGINT) END AS bucket, count(*)::BIGINT AS n
  FROM r WHERE NOT base_failed GROUP BY ALL
), each AS (
  SELECT l, s, rule, bucket, n FROM s
  UNION ALL SELECT l, NULL, rule, bucket, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT NULL, NULL, rule, bucket, sum(n) FROM s GROUP BY ALL
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY l, s, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l, s, rule) AS total FROM each
), q AS (
  SELECT l, s, rule, total, min(bucket) FILTER (4 * upto >= total) AS b1, min(bucket) FILTER (4 * upto >= 3 * total) AS b3 FROM run GROUP BY ALL
), t AS (
  SELECT l, s, rule, total,
         CASE WHEN b1 < 128 THEN b1 ELSE ((b1 - 64 * (b1 // 64 - 1) + 1) << (b1 // 64 - 1)::BIGINT) - 1 END AS q1,
         CASE WHEN b3 < 128 THEN b3 ELSE ((b3 - 64 * (b3 // 64 - 1) + 1) << (b3 // 64 - 1)::BIGINT) - 1 END AS q3
  FROM q
), pick AS (
  SELECT r.rid, r.x.v AS v,
         CASE WHEN own.total >= 50 THEN own.q1 WHEN own.total IS NOT NULL AND lg.total >= 50 THEN lg.q1 WHEN own.total IS NOT NULL THEN al.q1 END AS q1,
         CASE WHEN own.total >= 50 THEN own.q3 WHEN own.total IS NOT NULL AND lg.total >= 50 THEN lg.q3 WHEN own.total IS NOT NULL THEN al.q3 END AS q3
  FROM r
  LEFT JOIN t own ON own.l = coalesce(r.lang, chr(0)) AND own.s = coalesce(r.source, chr(0)) AND own.rule = r.x.rule
  LEFT JOIN t lg ON lg.l = coalesce(r.lang, chr(0)) AND lg.s IS NULL AND lg.rule = r.x.rule
  LEFT JOIN t al ON al.l IS NULL AND al.s IS NULL AND al.rule = r.x.rule
), fine AS (
  SELECT rid, bool_and(q1 IS NULL OR v <= q3 + 4 * (q3 - q1)) AS fine FROM pick GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM b JOIN fine USING (rid)
"""

OP1 = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), q AS (
  SELECT *, regexp_matches(t, '(?m)^[ \t]*>') AS quoted FROM m
), l AS (
  SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i
  FROM (SELECT rid, string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM q WHERE quoted)
), ll AS (
  SELECT rid, i, length(regexp_replace(regexp_extract(x, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS lev,
         regexp_replace(x, '^[ \t]*((?:>[ \t]?)+)', '') AS body
  FROM l
), nx AS (
  SELECT *, lead(lev) OVER w AS nlev, lag(lev) OVER w AS plev FROM ll WINDOW w AS (PARTITION BY rid ORDER BY i)
), bare AS (
  SELECT rid, trim(string_agg(body, chr(10) ORDER BY i)) AS own FROM nx
  WHERE lev = 0 AND NOT (coalesce(nlev, 0) > 0 AND regexp_matches(body, '(?i)^[ \t]*(?:on|le|am|el)\b.{0,200}\b(?:wrote|écrit|schrieb|escribió)[^\p{L}]*:[ \t]*$'))
  GROUP BY rid
), o AS (
  SELECT q.*, CASE WHEN quoted THEN coalesce(bare.own, '') ELSE t END AS own FROM q LEFT JOIN bare USING (rid)
), pas AS (
  SELECT rid, lev, string_agg(body, chr(10) ORDER BY i) AS txt
  FROM (SELECT *, sum((plev IS DISTINCT FROM lev)::INT) OVER (PARTITION BY rid ORDER BY i) AS g FROM nx) WHERE lev > 0 GROUP BY rid, g, lev
), src AS (
  SELECT 'q' AS kind, rid, lev, txt FROM pas UNION ALL SELECT 'o', rid, 0, own FROM o
), part AS (
  SELECT kind, rid, lev, 3 AS rank, txt AS x FROM src
  UNION ALL SELECT kind, rid, lev, 2, unnest(string_split_regex(txt, '\n[ \t]*\n')) FROM src
  UNION ALL SELECT kind, rid, lev, 1, unnest(string_split(txt, chr(10))) FROM src
), u AS (
  SELECT kind, rid, lev, rank, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS said FROM part
), uu AS (
  SELECT u.*, conv_id, turn FROM u JOIN m USING (rid)
  WHERE said <> '' AND (rank = 3 OR len(string_split(said, ' ')) >= 3 OR len(regexp_extract_all(said, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) >= 6) AND conv_id IS NOT NULL AND turn IS NOT NULL
), origin AS (
  SELECT conv_id, said, min(turn) AS origin FROM uu WHERE kind = 'o' GROUP BY ALL
), found AS (
  SELECT conv_id, turn, origin, row_number() OVER (PARTITION BY conv_id, turn ORDER BY lev, rank DESC, origin DESC) AS r
  FROM uu JOIN origin USING (conv_id, said) WHERE kind = 'q' AND origin < turn
), link AS (
  SELECT conv_id, turn, origin AS reply_to FROM found WHERE r = 1
), walk AS (
  SELECT conv_id, turn, [reply_to, turn] AS path FROM link
  WHERE NOT EXISTS (SELECT 1 FROM link k WHERE k.conv_id = link.conv_id AND k.turn = link.reply_to)
  UNION ALL SELECT k.conv_id, k.turn, list_append(w.path, k.turn) FROM walk w JOIN link k ON k.conv_id = w.conv_id AND k.reply_to = w.turn
), root AS (
  SELECT conv_id, turn, path[1] AS thread, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) AS position FROM walk
), seen AS (
  SELECT rid, count(*) AS n, max(lev) AS top FROM pas GROUP BY rid
)
SELECT o.conv_id, o.turn, role, own AS text, reply_to, coalesce(thread, o.turn) AS thread, coalesce(position, 0)::BIGINT AS position,
       coalesce(n, 0)::INT AS n_quotes, coalesce(top, 0)::INT AS quote_levels
FROM o LEFT JOIN link USING (conv_id, turn) LEFT JOIN root USING (conv_id, turn) LEFT JOIN seen USING (rid)
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP9 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), seg AS (
  SELECT doc_id, length(hx) // 2 - 99 - since AS more, since, substring(hx, 2 * since + 1, 1198) AS hs
  FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 99, 500)) AS since FROM d WHERE length(hx) >= 200)
), p AS (
  SELECT doc_id, since, hs, unnest(range(0, least(500, more))) AS j FROM seg
), w AS (
  SELECT doc_id, since + j AS i, row_number() OVER (PARTITION BY md5(substring(hs, 2 * j + 1, 200)) ORDER BY doc_id, since + j) AS nth FROM p
), s AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM w WHERE nth > 1
), g AS (
  SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s
), q AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g
), k AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM q
), c AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
         string_agg(substring(hx, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(hx, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)
), met AS (
  SELECT rid, i, m, item FROM dw JOIN bw USING (m, g)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM met) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o
  FROM x a, x b, x c, x d, x e WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5
), s AS (
  SELECT o, step, o[step] AS own, o[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, o, step, own,
         sum(n * (NOT fails[own] AND NOT gone)::INT) AS kept, sum(n * (fails[own] AND NOT gone)::INT) AS removed,
         sum(n * (fails[own] AND gone)::INT) AS redundant,
         sum(n * (fails[own] AND len(list_filter(fails, lambda y: y)) = 1)::INT) AS unique_fails,
         sum(n * good * (fails[own] AND NOT gone)::INT) AS good_lost, sum(n * toxic * (fails[own] AND NOT gone)::INT) AS toxic_lost
  FROM (SELECT m.*, s.*, len(list_filter(before, lambda y: fails[y])) > 0 AS gone FROM m, s) GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda y: 'ABCDE'[y]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

ORACLES = {"op1_quote_linking": OP1, "op2_archives": OP2, "op5_exact_dedup": OP5, "op9_suffix_dedup": OP9, "op10_quality_rules": OP10, "op11_decontamination": OP11, "op12_filter_audit": OP12}
