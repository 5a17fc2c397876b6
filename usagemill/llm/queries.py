"""The registered queries of this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm import bpe, byte_bpe, conversations, decontaminate, exact, language, licenses, merkle, simhash, substring_dedup, suffix_dedup, toxicity, urls
from usagemill.llm.tables import documents, labels

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def _digest(column: Column | str, name: str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.sha2(text.cast("binary"), 256).alias(name)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_report(documents(spark, folder))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, folder), labels(spark, folder))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeat_report(documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", _digest("kept", "kept_sha256"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder), licenses.known_licenses(spark))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicate_report(documents(spark, folder))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.substring_report(documents(spark, folder))
    return found.select("doc_id", "n_words", "n_removed", _digest("kept", "kept_sha256"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encoded_report(documents(spark, folder), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _digest(F.concat_ws(" ", F.col("ids").cast("array<string>")), "ids_sha256"),
        _digest("decoded", "decoded_sha256"),
    )


RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), RULES)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(documents(spark, folder))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.contamination_report(documents(spark, folder), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        _digest(F.concat_ws(",", "items"), "items_sha256"),
        "contaminated",
    )


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damage_report(spark.read.parquet(f"{folder}/conversations.parquet"))


RANKS = "byte_bpe_50k.tiktoken"


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = byte_bpe.encoded_report(documents(spark, folder), path, public_tokenizers.PATTERN, packed=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        _digest("ids", "ids_sha256"),
        _digest("decoded", "decoded_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_report(documents(spark, folder))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""

OP6_SQL = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM doc_words WHERE len(w) > 19)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS s FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY s) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM doc_words) ANTI JOIN cut USING (doc_id, s)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = r"""
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc_words AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
doc_starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc_words),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM doc_starts, sizes WHERE s + n - 1 <= len(w)),
hits AS (SELECT doc_id, item_id, s, n FROM places JOIN windows USING (n, phrase)),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS s FROM hits),
per_words AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
per_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN per_words USING (doc_id) LEFT JOIN per_items USING (doc_id)
"""

def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII expression, bit by bit."""
    bits = "list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte: {bits}, 4294967295), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE named AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
source AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(n.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hurt
  FROM conversations t JOIN named n ON n.conv_id IS NOT DISTINCT FROM t.conv_id),
damaged AS (
  SELECT c, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
         CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hurt = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM source WHERE hurt <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY n) AS seen, role[1] AS initial,
         lag(role[1]) OVER (PARTITION BY c ORDER BY n) AS earlier, rtrim(text, E' \t\n\x0B\f\r') AS body
  FROM ordered),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM marked),
sums AS (
  SELECT c, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
  FROM faults GROUP BY c),
puts AS (FROM (VALUES ('', '', '', 0, []), ('', 'u', 'I', 2, ['user:']), ('', 'a', 'II', 4, ['user:', 'assistant:']),
  ('s', 's', '', 0, []), ('s', 'u', 'I', 2, ['user:']), ('s', 'a', 'II', 4, ['user:', 'assistant:']), ('u', 'u', '', 0, []),
  ('u', 'a', 'I', 2, ['assistant:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 2, ['user:'])) v(state, after, letters, price, lines)),
edits AS (FROM (VALUES ('', 'K', 's', NULL), ('', 'K', 'u', NULL), ('s', 'K', 'u', NULL), ('a', 'K', 'u', NULL), ('u', 'K', 'a', NULL),
  ('', 'R', 'u', 'user'), ('s', 'R', 'u', 'user'), ('a', 'R', 'u', 'user'), ('u', 'R', 'a', 'assistant'),
  ('', 'D', '', NULL), ('s', 'D', 's', NULL), ('u', 'D', 'u', NULL), ('a', 'D', 'a', NULL)) v(state, letter, after, role)),
best AS (
  SELECT c, 0 AS n, '' AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM sums
  UNION ALL
  SELECT b.c, b.n + 1, e.after, b.cost + p.price + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CAST(letter <> 'D' AND fault = 'truncated' AS INT) AS total,
         b.audit || p.letters || letter AS done,
         list_concat(b.lines, p.lines, CASE WHEN letter = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)
  FROM best b JOIN faults f ON f.c = b.c AND f.n = b.n + 1 JOIN puts p ON p.state = b.state JOIN edits e ON e.state = p.after
  WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR initial = e.after)
  QUALIFY row_number() OVER (PARTITION BY b.c, e.after ORDER BY total, done) = 1),
ends AS (
  SELECT b.c, cost + price AS cost, audit || letters AS audit, list_concat(b.lines, p.lines) AS lines
  FROM best b JOIN sums s ON s.c = b.c AND s.last = b.n JOIN puts p ON p.state = b.state WHERE p.after IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY cost + price, audit || letters) = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM named LEFT JOIN sums USING (c) LEFT JOIN ends USING (c)
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


OP13_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, {" || ".join(map(_field_sql, ["doc_id", "source", "lang", "n_chars"]))} AS head,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || {_field_sql("text")}) AS leaf, sha256(head || {_field_sql("other")}) AS changed FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS place,
         row_number() OVER () AS item, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT 0 AS level, source, place AS i, leaf AS h, n FROM placed
  UNION ALL
  SELECT level + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1
  GROUP BY level, source, i // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM tree WHERE n = 1),
trunk AS (
  SELECT 0 AS level, place AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM trunk WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (
  SELECT item, level AS step, string_agg(h, '' ORDER BY i) FILTER (WHERE i < own) AS a, string_agg(h, '' ORDER BY i) FILTER (WHERE i > own) AS b
  FROM (SELECT item, t.level, t.i, t.h, place // CAST(pow(3, t.level) AS BIGINT) AS own
        FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.i // 3 = place // CAST(pow(3, t.level + 1) AS BIGINT)
        WHERE t.n > 1)
  GROUP BY item, level
  UNION ALL
  SELECT item, 1000 + level, string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), string_agg(h, '' ORDER BY i) FILTER (WHERE i > own)
  FROM (SELECT item, t.level, t.i, t.h, s.place // CAST(pow(3, t.level) AS BIGINT) AS own
        FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
        JOIN trunk t ON t.i // 3 = s.place // CAST(pow(3, t.level + 1) AS BIGINT)
        WHERE t.n > 1)
  GROUP BY item, level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY step) AS s FROM steps),
proofs AS (SELECT item, sha256(string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY s)) AS proof, count(*) AS last FROM numbered GROUP BY item),
fold AS (
  SELECT item, 0 AS s, changed AS h FROM placed
  UNION ALL
  SELECT f.item, f.s + 1, sha256(coalesce(a, '') || f.h || coalesce(b, '')) FROM fold f JOIN numbered k ON k.item = f.item AND k.s = f.s + 1)
SELECT doc_id, leaf, subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT h FROM trunk WHERE n = 1) r
LEFT JOIN proofs q ON q.item = p.item JOIN fold f ON f.item = p.item AND f.s = coalesce(last, 0)
"""

QUERIES: dict[str, Query] = {query.__name__: query for query in [op1_simhash, op2_toxicity, op3_suffix_dedup, op4_licenses, op5_exact_dedup, op6_substring_dedup, op7_bpe, op8_urls, op9_language, op10_decontamination, op11_conversations, op12_byte_bpe, op13_merkle_manifest]}

ORACLE: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_conversations": OP11_SQL, "op13_merkle_manifest": OP13_SQL}


def registered() -> dict[str, Query]:
    return dict(QUERIES)
