"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting: running sums in hash order, and the hash nearest to each budget.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, source_size::DOUBLE / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST)),
f AS (SELECT level AS final FROM l WHERE level * weight < 2 * source_size ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT final FROM f) * weight, 2.0 * source_size), 2.0 * source_size)::DOUBLE AS target FROM l),
h AS (SELECT source, h, sum(size) AS size FROM d GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM h),
b AS (SELECT source, source_size, target, c, least(greatest(target - c * source_size, 0), source_size) AS budget FROM t, (VALUES (0), (1)) v(c)),
k AS (
  SELECT r.source, r.h, sum(CASE WHEN upto <= budget OR (upto - size <= budget AND 2 * (budget - (upto - size)) >= size) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source GROUP BY ALL)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.order_minhash import compare_edited, spelled

    return compare_edited(table(spark, sf_dir, "documents"), texts=False).select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.warc import archive_and_read

    found = archive_and_read(table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.weak_labels import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "weak_posterior", "keep")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.passages import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.media import interleave

    found = interleave(table(spark, sf_dir, "documents")).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.simhash import NearDup, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), NearDup(width=4, max_bits=4, seed=42))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_sql() -> str:
    """The same judgement by counting every combination of a judged URL's frequent items."""
    from linkloom.llm import url_rules as u

    fits = "\n".join(
        f"    WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{verdict} {rule}'"
        for verdict, rule in sorted(u.RULES, key=lambda r: (-len(r[1]), r[1]))
    )
    return f"""
WITH cut AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{u.UPPER}', '{u.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed AS (SELECT *, CASE
{fits} END AS base,
    [x FOR x IN string_split(host, '.') IF x <> ''] AS l, [x FOR x IN string_split(path, '/') IF x <> ''] AS p,
    [x FOR x IN [regexp_extract(y, '^([^=]*)', 1) FOR y IN string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')] IF x <> ''] AS q FROM named),
urls AS (SELECT id, page_id, host, path, split_part(base, ' ', 2) AS rule, split_part(base, ' ', 1) AS verdict, [replace(t, ' ', '%20') FOR t IN list_distinct(
    [x FOR x IN ['top=' || l[-1], 'name=' || l[-2], 'file=' || p[-1], 'ext=' || nullif(regexp_extract(p[-1], '\\.([A-Za-z0-9]{{1,8}})$', 1), '')] IF x IS NOT NULL]
    || ['sub=' || x FOR x IN l[:-3]] || ['dir' || i || '=' || p[i] FOR i IN range(1, len(p))] || ['key=' || x FOR x IN q])] AS tokens FROM listed),
judged AS (SELECT id, tokens, verdict FROM urls WHERE verdict IS NOT NULL),
least AS (SELECT greatest(ceil({u.MIN_SUPPORT}::DOUBLE * count(*)), {u.MIN_COUNT}) AS c FROM judged),
extent AS (SELECT token, list_sort(list(id)) AS ids FROM (SELECT id, unnest(tokens) AS token FROM judged) GROUP BY token HAVING count(*) >= (SELECT c FROM least)),
items AS (SELECT min(token) AS item, list_sort(list(token)) AS members, ids FROM extent GROUP BY ids),
baskets AS (SELECT id, verdict, list_sort(list(item)) AS b FROM (SELECT item, unnest(ids) AS id FROM items) JOIN judged USING (id) GROUP BY id, verdict),
sets AS (SELECT verdict, [b[i + 1] FOR i IN range(len(b)) IF (m >> i) & 1 = 1] AS s FROM (SELECT verdict, b, unnest(range(1, 1 << len(b))) AS m FROM baskets)),
counted AS (SELECT s, verdict, count(*) AS c, sum(count(*)) OVER (PARTITION BY s) AS n FROM sets GROUP BY s, verdict),
kept AS (SELECT s, verdict, c / n AS confidence, c FROM counted WHERE c >= (SELECT c FROM least) AND c / n >= {u.MIN_CONFIDENCE}::DOUBLE),
rules AS (SELECT verdict, confidence, c, list_sort(flatten(list(members))) AS items FROM (SELECT *, unnest(s) AS item FROM kept) JOIN items USING (item) GROUP BY s, verdict, confidence, c),
best AS (
  SELECT id, arg_min(array_to_string(items, ' '), k) AS mined_rule, arg_min(verdict, k) AS mined FROM (
    SELECT u.id, r.items, r.verdict, ROW(-r.confidence, -r.c, -len(r.items), array_to_string(r.items, ' '), r.verdict) AS k
    FROM urls u JOIN rules r ON list_has_all(u.tokens, r.items) WHERE u.verdict IS NULL) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(verdict, mined, '{u.DEFAULT}') AS verdict, mined_rule FROM urls LEFT JOIN best USING (id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_order_minhash": op3_order_minhash,
    "op4_warc": op4_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_url_rules": op8_url_rules,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {
    "op2_source_mixing": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op8_url_rules": op8_sql(),
}
