"""The p queries of this subpackage and the SQL beside them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import leakage, mixing, sentences, terms
from mapweave.session import table

# Fixed value: how the public byte-level vocabularies part texts, as the notes beside their files give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file(spark: SparkSession | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Path of a vocabulary file on the driver: in the folder that ``spark.mapweave.tokenizers`` names, or where the files usually lie."""
    usual = "/opt/tokenizers"
    return os.path.join(spark.conf.get("spark.mapweave.tokenizers", usual) if spark else usual, name)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "osc_changes", "object_type", "id", "vs", "tag_keys", "tag_vals")
    return terms.banded_terms(rows, ("object_type", "id", "vs"), ("tag_keys", "tag_vals")).select("field_name", "term", "band")


def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "osc_changes", "object_type", "id", "vs", "tag_keys", "tag_vals")
    return terms.term_counts(rows, ("object_type", "id", "vs"), ("tag_keys", "tag_vals"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return leakage.leaked_items(docs, table(spark, d, "eval_items", "item_id", "item_text"), "doc_id", "text", "item_id", "item_text")


def _mix(spark: SparkSession, d: str):
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    with open(tokenizer_file(spark), "rb") as f:
        return mixing.mix_sources(docs, table(spark, d, "mix_targets"), f.read(), PATTERN)


def p9_mix_draws(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_term_counts, p8_found, p9_mix_draws, p9_mix_shares, p10_found)}

# Full-width forms, the only compatibility characters in these tables that SQL's NFC leaves, fold by code point.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127)), "".join(map(chr, range(33, 127))).replace("'", "''")

_TERMS = f"""
with t as (select object_type, id, vs, 'tag_keys' as field_name, unnest(tag_keys) as raw from osc_changes union all select object_type, id, vs, 'tag_vals', unnest(tag_vals) from osc_changes),
n as (select object_type, id, vs, field_name, trim(regexp_replace(lower(translate(replace(replace(nfc_normalize(raw), chr(160), ' '), chr(12288), ' '), '{_WIDE[0]}', '{_WIDE[1]}')), '\\s+', ' ', 'g')) as term from t where raw is not null),
c as (select field_name, term, count(*) as n_occurrences, count(distinct (object_type, id, vs)) as n_records from n where term <> '' group by all),
k as (select count(*) as n_all_records from (select distinct object_type, id, vs from osc_changes))
select * from c, k"""

SQL = {
    "p1_term_counts": _TERMS,
    "p1_found": f"select field_name, term, case when n_records <= 2 then 'rare' else 'common' end as band from ({_TERMS}) where n_records <= 2 or n_records * 50 > n_all_records",
}
