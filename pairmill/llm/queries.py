"""The queries of this subpackage and the SQL that expresses them, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairmill.llm import bpe_codec, embedding_dedup, fill_middle, html_extract, language_id, license_scan, mixing, ngram_lm, quality_rules, simhash, token_counts, token_files, turn_repair
from pairmill.session import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents")).drop("clean_text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_op1() -> str:
    r = quality_rules
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, {_q(r.SPACE)}), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM t),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, greatest(len(w) - {r.WINDOW - 2}, 1))) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + {r.WINDOW - 1})) AS c FROM g),
s AS (SELECT doc_id, least({r.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {r.WINDOW})) AS k FROM h WHERE c > 1),
rep AS (SELECT doc_id, sum(k) AS n_repeat_words FROM s GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS p FROM w),
f AS (SELECT doc_id, p, x, regexp_matches(x, {_q(r.NOT_EMPTY)}) AS has_word,
  len(regexp_extract_all(x, {_q(r.SYMBOL)})) AS sy, len(regexp_extract_all(x, '[|»›•]')) AS pi, length(x) AS n,
  regexp_matches(x, {_q(r.TERMINAL)}) AS term, regexp_matches(x, {_q(r.FIVE_WORDS)}) AS five, regexp_matches(x, {_q(r.NAVIGATION)}) AS nav, regexp_matches(x, {_q(r.BOILERPLATE)}) AS boil FROM l),
k AS (SELECT doc_id, sum(has_word::INT) - count(DISTINCT CASE WHEN has_word THEN x END) AS n_dup_lines,
  string_agg(x, chr(10) ORDER BY p) FILTER (NOT (has_word AND ((NOT term AND NOT five) OR nav OR (pi >= 2 AND pi * 60 >= n) OR (sy >= 3 AND sy * 12 >= n) OR (n <= {r.BOILERPLATE_CHARS} AND boil)))) AS clean
  FROM f GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, {_q(r.SYMBOL)})) AS n_symbols, length(t) AS n_chars,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(length(clean), 0) AS n_clean FROM w LEFT JOIN k USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PCT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT 100 * (n_chars - n_clean) > {r.MAX_LOST_PCT} * n_chars AS kept FROM v"""


def _sql_op2() -> str:
    r = license_scan
    facts = [(v, 0, k) for k, v in r.SENTENCES.items()] + [(v, i, k) for v, ids in r.CLAUSES.items() for i, k in enumerate(ids)]
    known = ", ".join(f"({_q(v)}, {i}, {_q(k)})" for v, i, k in facts)
    rules = ", ".join(f"({i}, {_q(n)}, {_q(lic)}, {_q(r.rule_pattern(ids))})" for i, (n, lic, ids) in enumerate(r.RULES))
    plain = f"trim(regexp_replace(x, {_q(r.NOT_PLAIN)}, ' ', 'g'))"

    def cut(source: str, at: str, end: str) -> str:
        """Parts of `x` of a table, numbered, with their normalised form."""
        return f"SELECT doc_id, {at}, x, {plain} AS s FROM (SELECT * EXCLUDE (x), unnest(parts) AS x, generate_subscripts(parts, 1) AS {at.split(', ')[-1]} FROM (SELECT *, string_split_regex(x, {_q(end)}) AS parts FROM ({source})))"

    gap = lambda a, b: f"(starts_with(s, {_q(a)}) AND ends_with(s, {_q(b)}) AND length(s) > {len(a) + len(b)})"
    gaps = "CASE " + " ".join(f"WHEN {gap(a, b)} THEN {_q(k)}" for a, b, k in r.GAPS) + " END"
    # each grain is cut out of what the grain before it left unknown
    unknown = lambda t, at: f"SELECT doc_id, {at}, x FROM {t} WHERE s NOT IN (SELECT s FROM known) AND {gaps} IS NULL"
    return f"""
WITH known(s, k, id) AS (VALUES {known}), rules(o, rule, license, pattern) AS (VALUES {rules}),
t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), {_q(r.LINES + r.COMMENT)}, '', 'g'), {_q(r.SPDX_TAG)}, {_q(r.SPDX_SAYS[0] + chr(92) + "1" + r.SPDX_SAYS[1])}, 'g'), {_q(r.NUMBER)}, '#', 'g') AS x FROM documents WHERE text IS NOT NULL),
a AS ({cut("SELECT doc_id, x FROM t", "a", r.COARSE_END)}), b AS ({cut(unknown("a", "a"), "a, b", r.CLAUSE_END)}), c AS ({cut(unknown("b", "a, b"), "a, b, c", r.SENTENCE_END)}),
f AS (SELECT doc_id, a, 0 AS b, 0 AS c, s FROM a UNION ALL SELECT doc_id, a, b, 0, s FROM b UNION ALL SELECT doc_id, a, b, c, s FROM c),
i AS (SELECT doc_id, a, b, c, k, id FROM f JOIN known USING (s) UNION ALL SELECT doc_id, a, b, c, 0, {gaps} FROM f WHERE {gaps} IS NOT NULL AND s NOT IN (SELECT s FROM known)),
s AS (SELECT doc_id, string_agg(id, ' ' ORDER BY a, b, c, k) AS seq, count(*) AS n FROM i GROUP BY doc_id),
m AS (SELECT doc_id, license, min(o) AS o FROM s JOIN rules ON regexp_matches(seq, pattern) GROUP BY doc_id, license),
l AS (SELECT doc_id, string_agg(rule, ' ' ORDER BY m.o) AS rules, string_agg(m.license, ' ' ORDER BY m.o) AS licenses FROM m JOIN rules ON m.o = rules.o GROUP BY doc_id)
SELECT doc_id, coalesce(seq, '') AS sentence_ids, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
}
SQL = {"op1_quality_rules": _sql_op1(), "op2_license_scan": _sql_op2()}


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(_table(spark, sf_dir, "documents"), bpe_codec.public_codec()).drop("ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.public_unigram())


QUERIES |= {
    "op3_simhash_dedup": op3_simhash_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_token_counts": op10_token_counts,
}


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), token_files.TokenizerFile.public(), path)
    return token_files.read_documents(spark, path)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.score_documents(docs, ngram_lm.train(docs))


QUERIES |= {
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op8_ngram_scores": op8_ngram_scores,
}


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(_table(spark, sf_dir, "documents"), texts=False)


def _sql_op12() -> str:
    h = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::UBIGINT"
    cut = lambda i, j: f"array_to_string(list_slice(u, {i}, {j}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '(?s).') AS u FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, t = '' OR regexp_matches(t, '<[PSM]>') OR {h(3)} % 100 >= 90 AS plain, {h(4)} % 100 < 20 AS spm,
  least({h(1)} % (len(u) + 1), {h(2)} % (len(u) + 1))::BIGINT AS a, greatest({h(1)} % (len(u) + 1), {h(2)} % (len(u) + 1))::BIGINT AS b FROM t),
p AS (SELECT *, {cut(1, "a")} AS pre, {cut("a + 1", "b")} AS mid, {cut("b + 1", "n")} AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


QUERIES |= {"op12_fill_middle": op12_fill_middle}
SQL |= {"op12_fill_middle": _sql_op12()}


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damage(turns), turns)


QUERIES |= {"op13_turn_repair": op13_turn_repair}


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


QUERIES |= {"op11_html_extract": op11_html_extract}
