"""DuckDB SQL for the linkage queries."""

from __future__ import annotations

from linkloom.functions import lexicon, text
from linkloom.operators.features import FEATURES as ALL_FEATURES
from linkloom.plans.queries import CFG, GRID
from linkloom.sources.projections import CYRILLIC, CYRILLIC_NAMES, STATE_NAMES


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def lookup(table: dict[str, str]) -> str:
    changed = {k: v for k, v in table.items() if k != v}
    return f"MAP({array(changed)}, {array(changed.values())})"


def folded(x: str) -> str:
    sql = f"translate(lower({x}), {quoted(text.MARKED)}, {quoted(text.PLAIN)})"
    for letter, spelling in text.UNDECOMPOSED.items():
        sql = f"replace({sql}, {quoted(letter)}, {quoted(spelling)})"
    return sql


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"[t FOR t IN string_split({x}, ' ') IF t <> '']"


def merged(x: str) -> str:
    sql = f"(' ' || array_to_string({x}, '  ') || ' ')"
    for phrase, code in lexicon.ordered_phrases():
        sql = f"replace({sql}, ' {phrase.replace(' ', '  ')} ', ' {code} ')"
    return f"CASE WHEN len({x}) < 2 THEN {x} ELSE {words(sql)} END"


def merged_compat(x: str) -> str:
    sql = f"(' ' || array_to_string({x}, ' ') || ' ')"
    for phrase, code in lexicon.PHRASES.items():
        sql = f"replace({sql}, CASE WHEN list_contains({x}, '{phrase.split()[0]}') THEN '{phrase}' ELSE chr(1) END, ' {code} ')"
    return f"CASE WHEN len({x}) < 2 THEN {x} ELSE {words(sql)} END"


def mapped(x: str, table: dict[str, str]) -> str:
    return f"[coalesce(map_extract({lookup(table)}, t)[1], t) FOR t IN {x}]"


RECORDS = f"""
base AS (
  SELECT c_custkey AS c, n_name AS country, coalesce(p_name, 'plain works') || ' ' || c_mktsegment AS stem, (c_custkey % 900 + 1)::VARCHAR AS number,
         {array(STATE_NAMES)}[(c_nationkey % {len(STATE_NAMES)} + 1)::INT] AS state, (c_custkey + 10000)::VARCHAR AS zip
  FROM customer LEFT JOIN part ON c_custkey = p_partkey JOIN nation ON c_nationkey = n_nationkey),
records AS (
  SELECT 1 AS src, 'S1-' || c AS entity_id, stem || ' Corporation' AS business_name, number || ' Main Street, ' || state || ', ' || zip AS business_address, country FROM base
  UNION ALL SELECT 2, 'S2-' || c, upper(stem || ' Corp.'), upper(number || ' Main St, ' || state || ', ' || zip), country FROM base WHERE c % 10 < 7
  UNION ALL SELECT 3, 'S3-' || c, array_to_string(list_reverse(string_split(stem || ' Corporation', ' ')), ' '), number || ' Main Street, ' || state, country FROM base WHERE c % 10 < 4
  UNION ALL SELECT 3, 'S3-' || c, stem || ' Corporation', ((c * 7) % 900 + 1)::VARCHAR || ' Station Road', country FROM base WHERE c % 10 = 9),
s1 AS (SELECT entity_id AS s1_id FROM records WHERE src = 1),
truth AS (
  SELECT 'S1-' || c AS s1_id, 'S2-' || c AS t_id FROM base WHERE c % 10 < 7
  UNION ALL SELECT 'S1-' || c, 'S3-' || c FROM base WHERE c % 10 < 4)"""
DOCUMENTS = """
lines AS (
  SELECT CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS src, doc_id, string_split(coalesce(text, ''), chr(10)) AS l, lang AS country,
         md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS h
  FROM documents),
records AS (
  SELECT src, 'S' || src || '-' || doc_id AS entity_id, l[1] AS business_name, coalesce(l[2], '') AS business_address, country, h FROM lines
  WHERE src > 1 OR doc_id IN (SELECT min(doc_id) FROM lines WHERE src = 1 GROUP BY h)),
s1 AS (SELECT entity_id AS s1_id FROM records WHERE src = 1),
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS t_id FROM records a JOIN records b ON a.h = b.h WHERE a.src = 1 AND b.src > 1)"""
TOKENS = f"""
normed AS (SELECT src, entity_id, {norm(folded("coalesce(business_name, '')"))} AS name_norm, {norm(folded("coalesce(business_address, '')"))} AS addr_norm, coalesce(country, '') AS country FROM records),
split1 AS (SELECT *, {words('name_norm')} AS nt0, {words('addr_norm')} AS aw0 FROM normed),
split2 AS (SELECT *, {merged('nt0')} AS nt1, {merged('aw0')} AS aw1 FROM split1),
tok AS (
  SELECT src, entity_id, name_norm, addr_norm, country, aw1,
         [t FOR t IN {mapped('nt1', lexicon.LEGAL_FORMS)} IF NOT list_contains({array(lexicon.NAME_NOISE)}, t)] AS nt,
         {mapped(mapped('aw1', lexicon.STREET_TYPES), lexicon.state_tokens())} AS aw,
         list_sort(list_distinct(regexp_extract_all(addr_norm, '[0-9]+'))) AS digits
  FROM split2)"""
KEYS = """
listed AS (
  SELECT src, entity_id, CASE WHEN lower(trim(country)) = '' THEN '' ELSE lower(trim(country)) || '|' END AS prefix,
         list_distinct(list_concat(list_concat(list_concat(['n' || t FOR t IN nt], ['a' || t FOR t IN aw]),
           list_concat(['B' || least(nt[i], nt[i + 1]) || '+' || greatest(nt[i], nt[i + 1]) FOR i IN range(1, len(nt))],
                       ['C' || least(aw[i], aw[i + 1]) || '+' || greatest(aw[i], aw[i + 1]) FOR i IN range(1, len(aw))])),
           list_concat(CASE WHEN len(digits) > 0 THEN ['D' || array_to_string(digits, '|')] ELSE [] END, ['z' || x FOR x IN digits IF length(x) IN (5, 6)]))) AS bodies
  FROM tok),
keys AS (SELECT src, entity_id, prefix || b AS key, substr(b, 1, 1) AS key_class, n_keys FROM (SELECT src, entity_id, prefix, len(bodies) AS n_keys, unnest(bodies) AS b FROM listed)),
df AS (SELECT key, count(*) AS df FROM keys WHERE src > 1 GROUP BY key),
nt AS (SELECT count(*) AS n FROM records WHERE src > 1)"""


def chosen(cap: int | None = None, soft: int | None = None) -> str:
    where = f" AND df <= {cap}" if cap else f" AND (df <= {soft} OR rarest > {soft})" if soft else ""
    return f"""
chosen AS (
  SELECT s1_id, key, df FROM (
    SELECT entity_id AS s1_id, key, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(df, 0), key) AS r, min(coalesce(df, 0)) OVER (PARTITION BY entity_id) AS rarest
    FROM keys LEFT JOIN df USING (key) WHERE src = 1 AND key_class <> 'D') WHERE r <= {CFG.k}{where}),
joined AS (SELECT s1_id, entity_id AS t_id, key, df FROM chosen JOIN keys USING (key) WHERE src > 1 AND key_class <> 'D'),
pairs AS (SELECT s1_id, t_id, round(sum(ln(1 + (SELECT n FROM nt) / (df + 1))), 6) AS key_score, count(*) AS key_count FROM joined GROUP BY ALL),
cand AS (
  SELECT s1_id, t_id, key_score, key_count FROM (
    SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY key_score DESC, key_count DESC, t_id) AS r FROM pairs) WHERE r <= {CFG.top_m})"""


def grams(x: str) -> str:
    return f"[g.x || '#' || g.n FOR g IN list_transform(range(1, len({x}) + 1), lambda i: {{'x': {x}[i], 'n': i - list_position({x}, {x}[i]) + 1}})]"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def over(a: str, b: str) -> str:
    least = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"(CASE WHEN {least} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {least} END)"


LEGAL = array(sorted(lexicon.LEGAL_FORMS))
STATES2 = array(sorted(t for t in lexicon.state_tokens() if len(t) == 2))
MEET = f"""
side AS (
  SELECT entity_id, name_norm, addr_norm, country, digits, nt, aw, coalesce(n_keys, 0) AS n_keys, [t FOR t IN list_distinct(nt) IF list_contains({LEGAL}, t)] AS legal, [t FOR t IN list_distinct(nt) IF NOT list_contains({LEGAL}, t)] AS core,
         list_sort([t FOR t IN list_distinct(aw) IF list_contains({STATES2}, t)]) AS states, [x FOR x IN digits IF length(x) IN (5, 6)] AS postals,
         list_sort([substr(name_norm, i, 2) FOR i IN range(1, length(name_norm))]) AS ng, list_sort([substr(addr_norm, i, 2) FOR i IN range(1, length(addr_norm))]) AS ag
  FROM tok LEFT JOIN (SELECT DISTINCT entity_id, n_keys FROM keys) USING (entity_id)),
met AS (SELECT c.*, a, b FROM cand c JOIN side a ON a.entity_id = s1_id JOIN side b ON b.entity_id = t_id)"""
FEATURES = {
    "n_jaccard": jac("a.nt", "b.nt"), "a_jaccard": jac("a.aw", "b.aw"), "n_overlap": over("a.nt", "b.nt"), "a_overlap": over("a.aw", "b.aw"),
    "n_core_jaccard": f"CASE WHEN len(a.core) = 0 AND len(b.core) = 0 THEN {jac('a.nt', 'b.nt')} ELSE {jac('a.core', 'b.core')} END",
    "n_suffix_agree": f"CASE WHEN len(a.legal) = 0 AND len(b.legal) = 0 THEN 1.0 ELSE {jac('a.legal', 'b.legal')} END",
    "n_suffix_both": "CASE WHEN len(a.legal) > 0 AND len(b.legal) > 0 THEN 1.0 ELSE 0.0 END", "n_nontok": "CASE WHEN len(a.nt) = 0 AND len(b.nt) = 0 THEN 1.0 ELSE 0.0 END",
    "n_len_ratio": "least(length(a.name_norm), length(b.name_norm))::DOUBLE / greatest(length(a.name_norm), length(b.name_norm), 1)",
    "a_len_ratio": "least(length(a.addr_norm), length(b.addr_norm))::DOUBLE / greatest(length(a.addr_norm), length(b.addr_norm), 1)",
    **{f"{side}_charbigram": f"CASE WHEN len(a.{g}) = 0 OR len(b.{g}) = 0 THEN 0.0 ELSE len(list_intersect({grams(f'a.{g}')}, {grams(f'b.{g}')})) / sqrt(len(a.{g})::DOUBLE * len(b.{g})) END" for side, g in (("n", "ng"), ("a", "ag"))},
    "a_digit_jaccard": jac("a.digits", "b.digits"),
    "a_digit_contains": "CASE WHEN len(a.digits) > 0 AND len(b.digits) > 0 AND len(list_intersect(a.digits, b.digits)) = least(len(a.digits), len(b.digits)) THEN 1.0 ELSE 0.0 END",
    "a_postal_eq": "CASE WHEN len(list_intersect(a.postals, b.postals)) > 0 THEN 1.0 ELSE 0.0 END",
    "postal_hash_eq": "CASE WHEN len(a.postals) > 0 AND len(b.postals) > 0 AND a.postals[1]::BIGINT = b.postals[1]::BIGINT AND a.postals[1]::BIGINT <> 0 THEN 1.0 ELSE 0.0 END",
    "a_state_eq": "CASE WHEN len(list_intersect(a.states, b.states)) > 0 THEN 1.0 ELSE 0.0 END", "a_state_one_sided": "CASE WHEN a.states <> b.states THEN 1.0 ELSE 0.0 END",
    "a_empty_one": "CASE WHEN (a.addr_norm = '') <> (b.addr_norm = '') THEN 1.0 ELSE 0.0 END", "a_empty_both": "CASE WHEN a.addr_norm = '' AND b.addr_norm = '' THEN 1.0 ELSE 0.0 END",
    "country_eq": "CASE WHEN a.country = b.country THEN 1.0 ELSE 0.0 END",
    "key_score": "key_score", "key_count": "key_count::DOUBLE", "key_count_ratio": "key_count::DOUBLE / greatest(a.n_keys, b.n_keys, 1)",
    "n_jw": "jaro_winkler_similarity(a.name_norm, b.name_norm)",
    "a_jw": "CASE WHEN a.addr_norm = '' AND b.addr_norm = '' THEN 1.0 WHEN a.addr_norm = '' OR b.addr_norm = '' THEN 0.0 ELSE jaro_winkler_similarity(a.addr_norm, b.addr_norm) END",
}
SCORED = f"""
scored AS (SELECT s1_id, t_id, round(({FEATURES['n_jaccard']} + {FEATURES['n_overlap']} + {FEATURES['a_jaccard']} + {FEATURES['a_overlap']}) / 4, 6) AS score FROM met)"""
F05 = "CASE WHEN n_true = 0 THEN CASE WHEN n_found = 0 THEN 1.0 ELSE 0.0 END WHEN n_hit = 0 THEN 0.0 ELSE 1.25 * (n_hit / n_found) * (n_hit / n_true) / (0.25 * (n_hit / n_found) + n_hit / n_true) END"


def counts(threshold: str) -> str:
    return f"""
counts AS (
  SELECT s1_id, coalesce(n_true, 0)::DOUBLE AS n_true, coalesce(n_found, 0)::DOUBLE AS n_found, coalesce(n_hit, 0)::DOUBLE AS n_hit
  FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS n_found, count(truth.t_id) AS n_hit FROM scored LEFT JOIN truth USING (s1_id, t_id) WHERE score >= {threshold} GROUP BY 1) USING (s1_id)),
f05 AS (SELECT *, round({F05}, 6) AS f05 FROM counts)"""


BROKEN = """
rows AS (
  SELECT 'S1-' || c AS s1_id, [x FOR x IN [CASE WHEN c % 10 < 7 THEN 'S2-' || c END, CASE WHEN c % 10 < 4 THEN 'S3-' || c END, CASE WHEN c % 19 = 0 THEN 'S2-' || c END,
         CASE WHEN c % 23 = 0 THEN 'S1-' || c END, CASE WHEN c % 29 = 0 THEN 'X9-' || c END, CASE WHEN c % 31 = 0 THEN 'S2-9999' || c END] IF x IS NOT NULL] AS ids
  FROM (SELECT c, unnest(range(CASE WHEN c % 37 = 0 THEN 0 WHEN c % 17 = 0 THEN 2 ELSE 1 END)) FROM base)
  UNION ALL SELECT 'S1-x' || s_suppkey, [] FROM supplier),
ids AS (SELECT DISTINCT unnest(ids) AS offender FROM rows)"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


TO_TOKENS = (RECORDS, TOKENS)
TO_KEYS = (*TO_TOKENS, KEYS)
TO_PAIRS = (*TO_KEYS, chosen())
TO_MET = (*TO_PAIRS, MEET)
TO_SCORES = (*TO_MET, SCORED)
TO_F05 = (*TO_SCORES, counts("0.6"))
BUCKET = "('0x' || substr(md5({0}), 1, 8))::BIGINT % 100"
SPLIT = f"CASE WHEN {BUCKET} < {CFG.train_share} THEN 'train' WHEN {BUCKET} < {CFG.train_share + CFG.val_share} THEN 'val' ELSE 'rest' END"
LABELLED = f"labelled AS (SELECT s1_id, t_id, (truth.t_id IS NOT NULL)::INT AS label, {SPLIT.format('s1_id')} AS split FROM cand LEFT JOIN truth USING (s1_id, t_id))"
RECALL = """SELECT true_pairs, hits, round(hits / true_pairs, 6) AS recall, round(pairs / records, 6) AS mean_candidates FROM
  (SELECT count(*) AS true_pairs FROM truth), (SELECT count(*) AS hits FROM truth SEMI JOIN cand USING (s1_id, t_id)), (SELECT count(*) AS pairs FROM cand), (SELECT count(*) AS records FROM s1)"""
LISTS = "SELECT s1_id AS source1_entity_id, coalesce({0}, '') AS {0} FROM s1 LEFT JOIN (SELECT s1_id, string_agg(DISTINCT t_id, ',' ORDER BY t_id) AS {0} FROM {1} GROUP BY 1) USING (s1_id)"


def feature_sql(*names: str) -> str:
    return sql(*TO_MET, select="SELECT s1_id, t_id, " + ", ".join(f"round(({FEATURES[n]})::DOUBLE, 6) AS {n}" for n in names) + " FROM met")


SWEEP = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, round(avg(f), 6) AS macro_f05, sum(n_found)::BIGINT AS n_matches FROM (SELECT n_found, round({F05}, 6) AS f FROM (SELECT s1_id, coalesce(n_true, 0)::DOUBLE AS n_true, coalesce(n_found, 0)::DOUBLE AS n_found, coalesce(n_hit, 0)::DOUBLE AS n_hit FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n_found, count(truth.t_id) AS n_hit FROM scored LEFT JOIN truth USING (s1_id, t_id) WHERE score >= {t} GROUP BY 1) USING (s1_id)))"
    for t in GRID
)
REPORT = """
found AS (
  SELECT 'duplicate record' AS rule, s1_id AS offender FROM rows GROUP BY s1_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'duplicate id in a list', s1_id FROM rows WHERE len(ids) <> len(list_distinct(ids))
  UNION ALL SELECT 'self match', offender FROM ids WHERE offender LIKE 'S1-%'
  UNION ALL SELECT 'wrong prefix', offender FROM ids WHERE NOT regexp_matches(offender, '^S[123]-')
  UNION ALL SELECT 'missing record', s1_id FROM (SELECT s1_id FROM s1 EXCEPT SELECT s1_id FROM rows)
  UNION ALL SELECT 'extra record', s1_id FROM (SELECT s1_id FROM rows EXCEPT SELECT s1_id FROM s1)
  UNION ALL SELECT 'unknown id', offender FROM ids WHERE regexp_matches(offender, '^S[23]-') AND offender NOT IN (SELECT entity_id FROM records WHERE src > 1))"""

LINES = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer"
WHOLE = "coalesce(text, '')"
#: Each letter that the query writes in Cyrillic, spelled by its letter's name.
SPELLED = f"array_to_string([coalesce(map_extract(MAP({array(CYRILLIC)}, {array(CYRILLIC_NAMES)}), c)[1], c) FOR c IN string_split({WHOLE}, '')], '')"
PLAIN_FEATURES = tuple(f for f in ALL_FEATURES if f in FEATURES)

ORACLES: dict[str, str] = {
    "scan_source": sql(RECORDS, select="SELECT src, entity_id, business_name, business_address, country FROM records"),
    "scan_columns": sql(RECORDS, select="SELECT entity_id, country FROM records"),
    "scan_ids": sql(RECORDS, select="SELECT entity_id FROM records"),
    "scan_truth": sql(RECORDS, select="SELECT DISTINCT s1_id, t_id FROM truth"),
    "known_truth": sql(RECORDS, select="SELECT s1_id, t_id FROM truth"),
    "normalised_store": sql(*TO_TOKENS, select="SELECT entity_id, addr_norm FROM normed"),
    "normalised_rows": sql(RECORDS, select="SELECT count(*) AS n FROM records"),
    "result_file": sql(RECORDS, select="SELECT s1_id || chr(9) || coalesce(string_agg(DISTINCT t_id, ',' ORDER BY t_id), '') AS value FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY s1_id"),
    "metrics_file": sql(*TO_PAIRS, select=RECALL),
    "norm_text": f"SELECT doc_id, {norm(folded(WHOLE))} AS norm FROM documents",
    "strip_accents": f"SELECT doc_id, {folded(WHOLE)} AS plain FROM documents",
    "transliterate": f"SELECT doc_id, {norm(folded(SPELLED))} AS norm FROM documents",
    "ascii_flag": "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents",
    "tokens": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(nt0, ' ') AS toks, len(nt0)::INT AS n FROM split1"),
    "multiword": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(aw1, ' ') AS toks FROM tok"),
    "multiword_compat": sql(*TO_TOKENS, select=f"SELECT entity_id, array_to_string({merged_compat('aw0')}, ' ') AS toks FROM split1"),
    "name_tokens": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(nt, ' ') AS toks FROM tok"),
    "addr_tokens": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(aw, ' ') AS toks FROM tok"),
    "addr_tokens_split_states": sql(*TO_TOKENS, select=f"SELECT entity_id, array_to_string({mapped(mapped('aw1', lexicon.STREET_TYPES), lexicon.state_tokens(True))}, ' ') AS toks FROM tok"),
    "addr_without_noise": sql(*TO_TOKENS, select=f"SELECT entity_id, array_to_string([t FOR t IN aw IF NOT list_contains({array(lexicon.ADDRESS_NOISE)}, t)], ' ') AS toks FROM tok"),
    "name_specific": sql(*TO_TOKENS, select=f"SELECT entity_id, array_to_string([t FOR t IN nt IF NOT list_contains({array(lexicon.generic_tokens())}, t)], ' ') AS toks FROM tok"),
    "numeric_tokens": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(regexp_extract_all(addr_norm, '[0-9]+'), ',') AS runs, regexp_replace(addr_norm, '[^0-9]', '', 'g') AS digits FROM tok"),
    "digit_signature": sql(*TO_TOKENS, select="SELECT entity_id, array_to_string(digits, '|') AS sig FROM tok"),
    "postal": sql(*TO_TOKENS, select="SELECT entity_id, coalesce([x FOR x IN digits IF length(x) IN (5, 6)][1]::BIGINT, 0) AS postal FROM tok"),
    "blocking_keys": sql(*TO_KEYS, select="SELECT src, entity_id, key, key_class FROM keys"),
    "key_count": sql(*TO_KEYS, select="SELECT DISTINCT entity_id, n_keys::INT AS n_keys FROM keys"),
    "key_class_hist": sql(*TO_KEYS, select="SELECT src, key_class, count(*) AS n, count(DISTINCT key) AS n_distinct FROM keys GROUP BY ALL"),
    "key_df": sql(*TO_KEYS, select="SELECT key, df FROM df"),
    "key_rarest": sql(*TO_PAIRS, select="SELECT s1_id, key, df FROM chosen"),
    "df_hard_cap": sql(*TO_KEYS, chosen(5), select="SELECT s1_id, key, df FROM chosen"),
    "df_soft_cap": sql(*TO_KEYS, chosen(soft=5), select="SELECT s1_id, key, df FROM chosen"),
    "posting_join": sql(*TO_PAIRS, select="SELECT s1_id, t_id, key, df FROM joined"),
    "idf": sql(*TO_KEYS, select="SELECT key, round(ln(1 + (SELECT n FROM nt) / (df + 1)), 6) AS idf FROM df"),
    "shared_count": sql(*TO_PAIRS, select="SELECT s1_id, t_id, key_count FROM pairs"),
    "key_score": sql(*TO_PAIRS, select="SELECT s1_id, t_id, key_score FROM pairs"),
    "min_shared": sql(*TO_PAIRS, select="SELECT s1_id, t_id, key_count FROM pairs WHERE key_count >= 3"),
    "top_m": sql(*TO_PAIRS, select="SELECT s1_id, t_id, key_score, key_count FROM cand"),
    "link_documents": sql(DOCUMENTS, TOKENS, KEYS, chosen(), select="SELECT s1_id, t_id, key_score, key_count FROM cand"),
    "document_recall": sql(DOCUMENTS, TOKENS, KEYS, chosen(), select=RECALL),
    "mean_candidates": sql(*TO_PAIRS, select="SELECT count(*) AS records, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT s1_id, count(t_id) AS n FROM s1 LEFT JOIN cand USING (s1_id) GROUP BY 1)"),
    "records_with_candidates": sql(*TO_PAIRS, select="SELECT DISTINCT s1_id FROM cand"),
    "truth_pairs": sql(RECORDS, select="SELECT DISTINCT s1_id, t_id FROM truth"),
    "candidate_recall": sql(*TO_PAIRS, select=RECALL),
    "f_jaccard": feature_sql("n_jaccard", "a_jaccard"),
    "f_overlap": feature_sql("n_overlap", "a_overlap"),
    "f_core_jaccard": feature_sql("n_core_jaccard"),
    "f_suffix": feature_sql("n_suffix_agree", "n_suffix_both", "n_nontok"),
    "f_len_ratio": feature_sql("n_len_ratio", "a_len_ratio"),
    "f_bigram": feature_sql("n_charbigram", "a_charbigram"),
    "f_digits": feature_sql("a_digit_jaccard", "a_digit_contains"),
    "f_postal": feature_sql("a_postal_eq", "postal_hash_eq"),
    "f_state": feature_sql("a_state_eq", "a_state_one_sided"),
    "f_empty": feature_sql("a_empty_one", "a_empty_both"),
    "f_country": feature_sql("country_eq"),
    "f_key_ratio": feature_sql("key_score", "key_count", "key_count_ratio"),
    "f_jaro_winkler": feature_sql("n_jw", "a_jw"),
    "plain_features": feature_sql(*PLAIN_FEATURES),
    "positives": sql(*TO_PAIRS, select="SELECT DISTINCT s1_id, t_id FROM truth SEMI JOIN cand USING (s1_id, t_id)"),
    "model_reload": sql(*TO_PAIRS, select="SELECT count(*) AS pairs, 0::BIGINT AS changed, 0.5::DOUBLE AS threshold FROM cand"),
    "label_pairs": sql(*TO_PAIRS, LABELLED, select="SELECT s1_id, t_id, label FROM labelled"),
    "split_by_hash": sql(RECORDS, select=f"SELECT s1_id, {SPLIT.format('s1_id')} AS split FROM s1"),
    "split_counts": sql(*TO_PAIRS, LABELLED, select="SELECT split, count(*) AS pairs, count(DISTINCT s1_id) AS records, sum(label)::BIGINT AS positives, round(avg(label), 6) AS positive_rate FROM labelled GROUP BY 1"),
    "threshold_filter": sql(*TO_SCORES, select="SELECT s1_id, t_id, score FROM scored WHERE score >= 0.6"),
    "f05_entity": sql(*TO_F05, select="SELECT s1_id, n_true::BIGINT AS n_true, n_found::BIGINT AS n_found, n_hit::BIGINT AS n_hit, f05 FROM f05"),
    "f05_macro": sql(*TO_F05, select="SELECT count(*) AS records, round(avg(f05), 6) AS macro_f05 FROM f05"),
    "error_buckets": sql(*TO_F05, select="SELECT count(*) FILTER (f05 = 1) AS perfect, count(*) FILTER (n_true > 0 AND n_found = 0) AS missed, count(*) FILTER (n_true = 0 AND n_found > 0) AS fp_only FROM f05"),
    "threshold_sweep": sql(*TO_SCORES, select=SWEEP),
    "best_threshold": sql(*TO_SCORES, f"sweep AS ({SWEEP})", select="SELECT threshold, macro_f05 FROM sweep ORDER BY macro_f05 DESC, threshold DESC LIMIT 1"),
    "top1_policy": sql(*TO_SCORES, select="SELECT s1_id, t_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) AS r FROM scored) WHERE r = 1"),
    "match_lists": sql(*TO_SCORES, "kept AS (SELECT * FROM scored WHERE score >= 0.6)", select=LISTS.format("matched_entity_ids", "kept")),
    "candidate_lists": sql(*TO_PAIRS, select=LISTS.format("candidate_entity_ids", "cand")),
    "val_header": "SELECT * FROM (VALUES (0, 'comma separated', 'source1_entity_id,matched_entity_ids'), (1, 'wrong header', 'a' || chr(9) || 'b'), (2, 'empty file', '')) t(file, rule, example)",
    "val_malformed": f"SELECT line::VARCHAR AS offender FROM ({LINES}) WHERE c_custkey % 13 = 0",
    "parsed_lists": f"SELECT line, 'S1-' || c_custkey AS s1_id, 'S2-' || c_custkey || '+S3-' || c_custkey AS ids FROM ({LINES}) WHERE c_custkey % 13 <> 0",
    "val_dup_rows": sql(RECORDS, BROKEN, select="SELECT s1_id AS offender FROM rows GROUP BY 1 HAVING count(*) > 1"),
    "val_dup_ids": sql(RECORDS, BROKEN, select="SELECT DISTINCT s1_id AS offender FROM rows WHERE len(ids) <> len(list_distinct(ids))"),
    "val_prefix": sql(RECORDS, BROKEN, select="SELECT CASE WHEN offender LIKE 'S1-%' THEN 'self' ELSE 'prefix' END AS rule, offender FROM ids WHERE NOT regexp_matches(offender, '^S[23]-')"),
    "val_unknown": sql(RECORDS, BROKEN, select="SELECT offender FROM ids WHERE regexp_matches(offender, '^S[23]-') AND offender NOT IN (SELECT entity_id FROM records WHERE src > 1)"),
    "val_missing": sql(RECORDS, BROKEN, select="SELECT s1_id AS offender FROM s1 EXCEPT SELECT s1_id FROM rows"),
    "val_extra": sql(RECORDS, BROKEN, select="SELECT s1_id AS offender FROM rows EXCEPT SELECT s1_id FROM s1"),
    "matches_subset": sql(*TO_PAIRS, BROKEN, select="SELECT s1_id, t_id FROM (SELECT DISTINCT s1_id, unnest(ids) AS t_id FROM rows) ANTI JOIN cand USING (s1_id, t_id)"),
    "val_report": sql(RECORDS, BROKEN, REPORT, select="SELECT rule, 'error' AS severity, count(*) AS n, array_to_string(list_sort(list(offender))[:5], ', ') AS examples FROM found GROUP BY rule"),
    "val_verdict": sql(RECORDS, BROKEN, REPORT, select="SELECT CASE WHEN count(DISTINCT rule) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(DISTINCT rule) AS errors FROM found"),
}
