"""The queries of this subpackage, one opN_<name> for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.conversations import repair_conversations
from quarry.llm.decontaminate import mark_contaminated
from quarry.llm.embedding_dedup import embedding_duplicates
from quarry.llm.html_extract import extract_main_text
from quarry.llm.language_profiles import identify_languages, learn_profiles
from quarry.llm.lattice import Pieces, encode_samples
from quarry.llm.lexical_search import lexical_top
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.quality import fit_quality, score_quality
from quarry.llm.sharding import assign_shards
from quarry.llm.suffix_dedup import remove_repeats
from quarry.llm.tables import table
from quarry.llm.token_counts import read_pieces, token_counts
from quarry.llm.urls import judge_urls


#: Vocabulary of the token counts and of the lattice, a file of public tokenizers, and the setting that names another one.
PIECES, PIECES_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.quarry.pieces"


def pieces_path(spark: SparkSession) -> str:
    return spark.conf.get(PIECES_SETTING, PIECES)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(pieces_path(spark)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op5_lattice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"), Pieces.from_model(pieces_path(spark)), k=2, ids=False)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "slot", "shard")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "coverage")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, learn_profiles(docs))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


_QUERIES = (op1_token_counts, op2_embedding_near_dedup, op3_suffix_dedup, op4_quality_classifier, op5_lattice_samples, op6_sharding, op7_html_extraction, op8_minhash_near_dedup, op9_url_filters, op10_decontamination, op11_language_id, op12_lexical_search, op13_conversation_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: op2: all pairs of a label by the dot product over the norms, and reachability by a recursive query.
OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r
), comp AS (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""

#: op8: word sets by string functions, all pairs that share a shingle, and reachability by a recursive query.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.r
), comp AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN comp USING (doc_id)
"""


#: op12: terms by a regular expression, counts by grouping; each row of documents is a document.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), all_docs AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0
), asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), words AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d
), tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY r, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), part AS (SELECT r, doc_id, term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS x FROM tf JOIN df USING (term) CROSS JOIN all_docs
), scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(x) AS BIGINT) AS score FROM part JOIN asked USING (term) GROUP BY item_id, r HAVING sum(x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
QUALIFY rank <= 10
"""


def _later(v: str, cost: int | str, letters: str) -> str:
    """A path as text, ten digits of cost and then its audit, with edits added."""
    return f"lpad(CAST(CAST({v}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {v}[11:] || '{letters}'"


#: op13: crc32 by bits, faults by windows, and the cheapest paths to each state as texts that a recursive query carries from turn to turn.
OP13_SQL = rf"""
WITH RECURSIVE raw AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS k FROM raw
), live AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE k <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM live
), turns AS (SELECT *, role[1:1] AS r, lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault FROM placed
), steps AS (SELECT c, i, r, fault IN ('b', 'd') AS x, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM turns
), paths AS (
  SELECT c, CAST(0 AS BIGINT) AS i, '0000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '0000000003I' AS v2, '0000000006II' AS v3 FROM (SELECT DISTINCT c FROM raw)
  UNION ALL
  SELECT c, i, w0, w1, least(w2, {_later("w0", 3, "I")}, {_later("w1", 3, "I")}, {_later("w3", 3, "I")}), least(w3, {_later("w2", 3, "I")}, {_later("w0", 6, "II")}, {_later("w1", 6, "II")}) FROM (
    SELECT p.c, s.i, {_later("v0", 4, "D")} AS w0,
      least({_later("v1", 4, "D")}, CASE WHEN NOT x AND r = 's' THEN {_later("v0", "more", "K")} END) AS w1,
      least({_later("v2", 4, "D")}, CASE WHEN NOT x AND r = 'u' THEN {_later("least(v0, v1, v3)", "more", "K")} END, CASE WHEN NOT x THEN {_later("least(v0, v1, v3)", "3 + more", "R")} END) AS w2,
      least({_later("v3", 4, "D")}, CASE WHEN NOT x AND r = 'a' THEN {_later("v2", "more", "K")} END, CASE WHEN NOT x THEN {_later("v2", "3 + more", "R")} END) AS w3
    FROM paths p JOIN steps s ON s.c = p.c AND s.i = p.i + 1)
), best AS (SELECT c, least(v0, v3) AS v FROM paths QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1
), letters AS (SELECT c, j, l, sum(CASE WHEN l = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY j) AS i FROM (SELECT c, unnest(range(len(v) - 10)) AS j, unnest(string_split(v[11:], '')) AS l FROM best WHERE len(v) > 10)
), said AS (SELECT a.c, j, l, role, text, row_number() OVER w - 1 AS m, sum(CASE WHEN l = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.c) AS sys
  FROM letters a LEFT JOIN turns t ON t.c = a.c AND t.i = a.i AND l <> 'I' WHERE l <> 'D' WINDOW w AS (PARTITION BY a.c ORDER BY j)
), lines AS (SELECT c, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (m - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM said GROUP BY c
), counted AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(v[1:10] AS BIGINT) AS cost, v[11:] AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) o JOIN best USING (c) LEFT JOIN counted USING (c) LEFT JOIN lines USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op8_minhash_near_dedup": OP8_SQL, "op12_lexical_search": OP12_SQL, "op13_conversation_repair": OP13_SQL}
