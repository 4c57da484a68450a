"""The thin opN_<name> queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, class_scores, conversation_trie, cotraining, decontaminate, histogram_shards, html_consensus, license_scan, perspectives, rule_cascade, structure_repair, trie_join, unigram_count


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it."""
    return perspectives.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = r"""
WITH m AS (SELECT conv_id, turn, role AS speaker, text, count(*) AS copies FROM
             (SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|im_', '< |im_') AS role,
                     replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations) GROUP BY ALL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.conv_id, perspective, turn, speaker, copies, text,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
             CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
                  ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
      FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM r),
e AS (SELECT *, (sum(length(rendered)) OVER w)::BIGINT AS char_end, row_number() OVER w - 1 AS seq FROM o
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, speaker, chat_role, rendered, char_end - length(rendered) AS char_start, char_end,
       CASE WHEN chat_role = 'assistant' THEN char_end - length(rendered) + length(head) ELSE char_end END AS loss_start, char_end AS loss_end, copies
FROM e
"""


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION ALL SELECT rid, w FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid AS a, rid AS z FROM d UNION SELECT a, y FROM r JOIN b ON z = x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON d.rid = n.rid JOIN r ON r.a = d.rid JOIN d o ON o.rid = r.z GROUP BY d.rid, d.doc_id, n.n
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    counted = unigram_count.count_column(spark, F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return _documents(spark, sf_dir).select("doc_id", counted.alias("c")).select("doc_id", "c.*")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near-equal bytes."""
    placed = histogram_shards.shard_by_bytes(_documents(spark, sf_dir).select("doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two co-trained views for all documents."""
    return cotraining.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-circuit cascade over all documents."""
    return rule_cascade.score(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *rule_cascade.DIGEST, "base_failed", "kept")


#: Words are cut at blanks; windows are compared as whole word lists.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + 7]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS pos FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
             len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters
      FROM w LEFT JOIN c ON w.rid = c.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words OR 10 * n_upper > 4 * n_letters
            OR 5 * n_stutters > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""

def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles are at least 80 percent alike."""
    return trie_join.similar_components(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    coded = byte_bpe.digest_column(spark, F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return _documents(spark, sf_dir).select("doc_id", coded.alias("c")).select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    found = license_scan.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_consensus.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op12_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by Brown classes of the training documents' words."""
    return class_scores.score(_documents(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired by their cheapest edits."""
    damaged = structure_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return structure_repair.repair(damaged, copies="copies")


#: crc32 by bytes of an ASCII text, with its table of 256 remainders computed here.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rest)"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of an ASCII text, where the table crc is at hand."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295)"


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return conversation_trie.build_rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = rf"""
WITH {CRC_SQL},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS source, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
j AS (SELECT ids.conv_id, pos, 1 AS part, role, text FROM ids JOIN o ON o.conv_id = source AND pos <= h UNION ALL SELECT o.conv_id, pos, 2, role, text FROM o JOIN ids ON o.conv_id = ids.conv_id AND pos > h),
s AS (SELECT ids.conv_id, coalesce(seq, []) AS seq FROM ids LEFT JOIN (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS seq FROM j GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM s),
g AS (SELECT depth, seq[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY ALL),
u AS (SELECT depth, path, conv_id, n_convs, (n_convs - 1) * CASE WHEN depth > 0 THEN strlen(path[depth].t) ELSE 0 END AS own, unnest(range(0, depth + 1)) AS up FROM g),
k AS (SELECT p.depth, p.path, count(*) AS n FROM g p JOIN g c ON c.depth = p.depth + 1 AND c.path[:p.depth] = p.path GROUP BY ALL),
f AS (SELECT u.*, k.n IS NULL AS leaf FROM u LEFT JOIN k ON k.depth = u.depth AND k.path = u.path),
t AS (SELECT up AS depth, path[:up] AS path, sum(leaf::BIGINT) AS n_leaves, sum(own) AS saved FROM f GROUP BY ALL)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN t ON t.depth = g.depth AND t.path = g.path LEFT JOIN k ON k.depth = g.depth AND k.path = g.path LEFT JOIN g p ON p.depth = g.depth - 1 AND p.path = g.path[:g.depth - 1]
"""


OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
f AS (SELECT *, left(role, 1) AS letter, NOT regexp_matches(text, '[^ 	-
]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS met,
             NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open_end, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
t AS (SELECT *, is_blank OR met AS gone, CASE WHEN open_end AND NOT is_blank AND NOT met THEN 3 ELSE 0 END AS more FROM f),
b AS (SELECT DISTINCT conv_id, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM t
      UNION ALL
      SELECT conv_id, i, [least(r[1], 3 + r[3], 6 + r[4]), least(r[2], 3 + r[3], 6 + r[4]), least(r[3], 3 + r[4]), least(r[4], 3 + r[3])] FROM (
        SELECT t.conv_id, t.i, [least(4 + v[1], CASE WHEN gone THEN 99999 WHEN letter = 's' THEN more + v[2] WHEN letter = 'u' THEN more + v[3] ELSE 99999 END, CASE WHEN gone THEN 99999 ELSE 3 + more + v[3] END),
               least(4 + v[2], CASE WHEN gone THEN 99999 WHEN letter = 'u' THEN more + v[3] ELSE 3 + more + v[3] END),
               least(4 + v[3], CASE WHEN gone THEN 99999 WHEN letter = 'a' THEN more + v[4] ELSE 3 + more + v[4] END),
               least(4 + v[4], CASE WHEN gone THEN 99999 WHEN letter = 'u' THEN more + v[3] ELSE 3 + more + v[3] END)]::BIGINT[] AS r
        FROM b JOIN t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = b.i - 1)),
w AS (SELECT conv_id, i AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM b WHERE i = 1
      UNION ALL
      SELECT conv_id, CASE WHEN a = 'I' THEN i ELSE i + 1 END, CASE a WHEN 'D' THEN s WHEN 'K' THEN kept ELSE wanted END, audit || a,
             CASE a WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, put || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, put || ':' || text) END
      FROM (SELECT *, CASE WHEN role IS NOT NULL AND 4 + v1[s] = v[s] THEN 'D' WHEN 3 + v[wanted] = v[s] THEN 'I' WHEN NOT gone AND kept > 0 AND more + v1[kept] = v[s] THEN 'K' ELSE 'R' END AS a FROM (
        SELECT w.*, b.v, c.v AS v1, t.role, t.text, t.gone, t.more, [3, 3, 4, 3][s] AS wanted, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS put,
               CASE WHEN letter = 's' AND s = 1 THEN 2 WHEN letter = 'u' AND s <> 3 THEN 3 WHEN letter = 'a' AND s = 3 THEN 4 ELSE 0 END AS kept
        FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN b c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1
        LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i WHERE b.v[s] > 0 OR t.i IS NOT NULL))),
e AS (SELECT w.* FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i WHERE t.i IS NULL AND b.v[s] = 0),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(is_blank::BIGINT) AS blank, sum((met AND NOT is_blank)::BIGINT) AS duplicate, sum((more > 0)::BIGINT) AS truncated,
             sum((i > 1 AND before || letter NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
"""


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item,
             regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
o AS (SELECT rid, i, n.n AS n, w[i:i + n.n - 1] AS win FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), n WHERE i + n.n - 1 <= len(w)),
h AS (SELECT rid, i, o.n, item FROM o JOIN p ON o.n = p.n AND o.win = p.win),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN t ON d.rid = t.rid
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perspectives": op1_perspectives,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_counts": op6_token_counts,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_class_scores": op12_class_scores,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE: dict[str, str] = {
    "op1_perspectives": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op13_structure_repair": OP13_SQL,
}
