"""Thin queries: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fieldspark.llm import decontamination, divergence, licenses, line_runs, merkle, mixing, ngram_join, quality, quoting, secrets, tokens, toxicity, urls
from fieldspark.llm.common import table
from fieldspark.llm.registry import RUN, SQL, query  # noqa: F401

_CANON = """
  CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN q = '' THEN '' ELSE '?' || q END END"""
_URLS = f"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), ''),
      '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q
  FROM pages),
canon AS (SELECT *, {_CANON} AS c FROM parts),
known AS (SELECT DISTINCT c FROM canon WHERE starts_with(url, 'https://') AND regexp_matches(host, 'adult|casino|bets|spam') AND c <> ''),
fits AS (
  SELECT page_id, host, path, c,
    CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule, known.c IS NOT NULL AS listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN known.c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM fits LEFT JOIN known ON fits.c = known.c"""


@query("op5_url_filter", _URLS)
def op5_url_filter(spark, sf_dir):
    """Verdict on every page's url; the list holds the secure URLs on hosts with a listed word."""
    pages = table(spark, sf_dir, "pages")
    return urls.url_filter(pages, urls.listed_pages(pages))


def _license_sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in licenses.SENTENCES)
    cues = "|".join(licenses.CUES)
    hits = ", ".join(f"CASE WHEN regexp_matches(seq, ',{',(.*,)?'.join(parts)},') THEN '{name}' END" for name, parts in licenses.RULES)
    return f"""
WITH known(id, s) AS (VALUES {known}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, ',[ \\t]*\\r?\\n[ \\t]*', ', ', 'g'),
    '([a-z])[ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1 \\2', 'g'), '([.;:!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS pieces
  FROM documents WHERE regexp_matches(lower(text), '{cues}')),
piece AS (SELECT doc_id, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM cut),
ids AS (
  SELECT doc_id, string_agg(known.id, ',' ORDER BY i) AS ids, count(*) AS n
  FROM piece JOIN known ON trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) = known.s GROUP BY doc_id),
seqs AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS seq FROM documents LEFT JOIN ids USING (doc_id)),
hits AS (SELECT doc_id, n, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM seqs),
uniq AS (SELECT doc_id, n, ids, list_filter(h, lambda x, k: list_position(h, x) = k) AS h FROM hits)
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, h[1] AS licence, coalesce(array_to_string(h, ','), '') AS licences FROM uniq"""


@query("op6_license_scan", _license_sql())
def op6_license_scan(spark, sf_dir):
    """Licence sentences and matched rules of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op7_mix_sources")
def op7_mix_sources(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source_no")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    """Documents as read back from the written token files."""
    found = tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "n_symbols")


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    """Counts and verdict of every document; the chain learns from the labels table."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.learn_chain(docs, table(spark, sf_dir, "labels")))


@query("op8_benchmark_leaks")
def op8_benchmark_leaks(spark, sf_dir):
    """Documents that hold a benchmark item, one row per document and item."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """Score of every document; the network learns from the labels table without the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Secrets of every document; the digest is made from the operator's spans."""
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_literal")


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark, sf_dir):
    """Component of every document."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_chat_quotes")
def op3_chat_quotes(spark, sf_dir):
    """All conversations in reply order, without quotations."""
    return quoting.conversations(quoting.linked_messages(table(spark, sf_dir, "conversations")))


_FOLDED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLDED}) AS k FROM cut),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, pos, line, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k))
SELECT first(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (r) GROUP BY r"""


@query("op11_line_dedup", _LINES)
def op11_line_dedup(spark, sf_dir):
    """Counts and kept text of every document."""
    found = line_runs.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{}")) + ")"
_MERKLE = f"""
WITH RECURSIVE
-- the CRC of an id by its table of 256 entries, which eight shifts make
steps(byte, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rowid, * FROM documents),
digits(r, s, k, c) AS (
  SELECT rowid, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM docs WHERE doc_id IS NOT NULL UNION ALL
  SELECT r, s, k + 1, xor(c >> 8, t[xor(c & 255, ascii(s[k + 1])) + 1]) FROM digits, crcs WHERE k < length(s)),
leaves AS MATERIALIZED (
  SELECT docs.rowid AS r, doc_id, lang, {_LEAF.replace("{}", "text")} AS leaf,
    CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {_LEAF.replace(_FIELD.format("{}"), _FIELD.format(f"translate(text, {_FOLDED})"))} END AS altered
  FROM docs LEFT JOIN digits ON digits.r = docs.rowid AND k = length(s)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(lvl, lang, idx, n, digest) AS (
  SELECT 0, lang, idx, n, leaf FROM ranked UNION ALL
  SELECT lvl + 1, lang, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lvl, lang, idx // 8),
subroots AS MATERIALIZED (
  SELECT lang, digest, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
above(lvl, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM subroots UNION ALL
  SELECT lvl + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY lvl, idx // 8),
root AS (SELECT digest FROM above WHERE n = 1),
runs AS MATERIALIZED (
  SELECT lvl, lang, idx // 8 AS up, list(digest ORDER BY idx) AS children FROM tree WHERE n > 1 GROUP BY ALL),
runs_above AS MATERIALIZED (SELECT lvl, idx // 8 AS up, list(digest ORDER BY idx) AS children FROM above WHERE n > 1 GROUP BY ALL),
asked AS (
  SELECT ranked.*, s.idx AS lang_idx, s.digest AS subroot, s.height FROM ranked JOIN subroots s ON s.lang IS NOT DISTINCT FROM ranked.lang),
path AS MATERIALIZED (
  SELECT r, lvl AS step, children, ((asked.idx >> (3 * lvl)) & 7) + 1 AS pos
  FROM asked JOIN runs ON runs.lang IS NOT DISTINCT FROM asked.lang AND runs.up = asked.idx >> (3 * lvl + 3)
  UNION ALL
  SELECT r, height + lvl, children, ((lang_idx >> (3 * lvl)) & 7) + 1 FROM asked JOIN runs_above ON up = lang_idx >> (3 * lvl + 3)),
sides AS MATERIALIZED (
  SELECT r, step, array_to_string(children[1:pos - 1], '') AS l, array_to_string(children[pos + 1:], '') AS g FROM path),
folds(r, step, acc) AS (
  SELECT r, 0, coalesce(altered, leaf) FROM leaves UNION ALL
  SELECT r, step + 1, sha256(l || acc || g) FROM folds JOIN sides USING (r, step)),
ends AS (SELECT r, arg_max(acc, step) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof FROM sides GROUP BY r)
SELECT doc_id, leaf, subroot, root.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root.digest AS verified
FROM asked JOIN ends USING (r) LEFT JOIN proofs USING (r), root"""


@query("op12_merkle_manifest", _MERKLE)
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots, proof and verification of every document."""
    found = merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents")))
    return found.select("row.doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


_DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, {_FOLDED}))) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, c,
    1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(t.total, 0) + v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (c + 1) // (langs.total + v)::HUGEINT AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", _DIVERGENCE)
def op13_source_divergence(spark, sf_dir):
    """How far sources of a language differ, and by which terms."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))
