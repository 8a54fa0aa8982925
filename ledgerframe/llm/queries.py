"""Registered queries of the operators: opN_<name>(spark, sf_dir).

Each applies its operator, with production parameters, to its whole table.
`SQL` holds DuckDB statements where SQL can express the operator; the others
are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (block_dedup, chat_format, decontaminate, hard_negatives, html_extract, license_scan, mixing, ngram_join,
               quality, sharding, spelling, suffix_dedup, token_counts)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.remove_later_repeats(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(chat_format.with_probe(spark, _table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.moved_labels(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op5_sharding_documents": op5_sharding,  # its earlier name, when op5_sharding placed three columns
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op3_sql() -> str:
    """The same recognition in DuckDB's regular expressions, which have no
    look-around: sentence ends are doubled, so that each sentence of a row of
    them has its own two."""
    L = license_scan
    names = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in L.known_sentences().items())
    rules = ", ".join(f"({i}, {_literal(n)}, {_literal(n + ' ' + r)}, {_literal('%' + '%'.join(f',{x},' for x in ids) + '%')})"
                      for i, (n, r, ids) in enumerate(L.RULES))
    lead, verb = f"([\1\2]|^)(?:{L._LEAD})?{L._VERB}([ \2])", "\\1licensed under\\2"
    steps = (*L.CUTS, (lead, verb), (lead, verb), (f"(licen[cs]e|[0-9]){L._TAIL}", "\\1"), ("[\1\2]", "\\0\\0"))
    marked = "CASE WHEN regexp_matches(low, " + _literal(L.MARKS) + ") THEN low ELSE '' END"
    for pattern, by in steps:
        marked = f"regexp_replace({marked}, {_literal(pattern)}, {_literal(by)}, 'g')"
    longest = sorted(L.known_sentences(), key=lambda k: (-len(k), k))
    known = "[\1\2](" + "|".join(k.replace(" ", "(?: |\2\2)") for k in longest) + ")[\1\2]"
    return f"""
WITH known(norm, id) AS (VALUES {names}),
rules(k, name, rule, pattern) AS (VALUES {rules}),
lowered AS (SELECT row_number() OVER () AS row, doc_id,
            translate(coalesce(text, ''), {_literal(L.UPPER)}, {_literal(L.LOWER)}) AS low FROM documents),
found AS (SELECT row, regexp_extract_all('\1' || {marked} || '\1', {_literal(known)}, 1) AS said FROM lowered),
lines AS (SELECT row, replace(unnest(said), '\2\2', ' ') AS norm, unnest(range(len(said))) AS line_no FROM found),
met AS (
  SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY line_no) AS sequence,
         ',' || string_agg(id, ',,' ORDER BY line_no) || ',' AS w
  FROM lines JOIN known USING (norm) GROUP BY row),
hit AS (SELECT m.row, r.k, r.name, r.rule FROM met m JOIN rules r ON m.w LIKE r.pattern),
named AS (
  SELECT row, string_agg(name, ',' ORDER BY k) AS licenses
  FROM (SELECT row, name, min(k) AS k FROM hit GROUP BY ALL) GROUP BY row),
ruled AS (SELECT row, string_agg(rule, ',' ORDER BY k) AS rules FROM hit GROUP BY row)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_known, coalesce(m.sequence, '') AS sequence,
       coalesce(n.licenses, '') AS licenses, coalesce(r.rules, '') AS rules
FROM lowered d LEFT JOIN met m USING (row) LEFT JOIN named n USING (row) LEFT JOIN ruled r USING (row)"""


def _op5_sql() -> str:
    """The claimed table as a list literal, indexed by the key's hash."""
    table = ", ".join(map(str, sharding.fill_table(sharding.shard_names())))
    return f"""
SELECT *,
       list_extract([{table}], (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT
                                % {sharding.TABLE_SIZE} + 1)::INT)::INT AS shard
FROM documents"""


SQL: dict[str, str] = {"op3_license_scan": _op3_sql(), "op5_sharding": _op5_sql()}
SQL["op5_sharding_documents"] = SQL["op5_sharding"]
