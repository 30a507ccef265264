"""The registered queries of this subpackage and, where SQL can say it, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    chat, decontam, html_extract, hyperminhash, learned_ann, line_dedup, packing, quality, secret_scan, source_divergence, spelling, token_counts, url_filter,
)
from pulsegrid.session import table

#: Where the public vocabulary lies; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and items by document where most terms of a benchmark window stand together; rows as of op4_contamination."""
    docs = table(spark, sf_dir, "documents")
    near = decontam.proximity_matches(docs, table(spark, sf_dir, "benchmark"))
    found = near.groupBy("doc_id").agg(F.count_distinct("pos").alias("n_near"), F.count_distinct("item_id").alias("n_near_items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(found, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_near", "n_near_items")])


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.col("row.text").alias("text"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents")).drop("row")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, says)
    back = chat.read_back(chat.format_chat(chat.records_from_turns(rows.unionByName(own))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.RULES[: secret_scan.BASE]]
    of = lambda *k: F.filter("found", lambda s: s["kind"].isin(*k))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(told(of(*kinds)), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
    )


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extract_html, op2_near_duplicates, op3_filter_urls, op4_contamination, op5_dedup_lines,
        op6_pack_sequences, op7_quality_rules, op8_format_chat, op9_scan_secrets, op10_count_tokens,
        op11_spelling_variants, op12_source_divergence, op13_nearest_neighbours,
    )
}

#: Queries beside the numbered ones.
MORE = {"op4_proximity": op4_proximity}

_URL_SQL = r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') h0,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
h as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from u),
r as (select *, case
        when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
        when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case
    when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
    when regexp_matches('.' || host, '\.(ads|adserver|doubleclick|tracking)\.|\.casino|\.porn|\.xxx$')
      or regexp_matches(path, '(?s)^/cgi-bin/|/wp-login\.php|\.exe$|\.apk$|/cart/checkout') then 'block'
    else 'allow' end as verdict
from r
"""

_CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(13 + length(regexp_replace(role, '([\\<\[])', 'xx', 'g')) + length(regexp_replace(text, '([\\<\[])', 'xx', 'g'))) as bigint) as formatted_chars
from c group by conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": hyperminhash.SQL, "op3_filter_urls": _URL_SQL, "op4_contamination": decontam.SQL, "op5_dedup_lines": line_dedup.SQL,
    "op7_quality_rules": quality.sql(), "op8_format_chat": _CHAT_SQL, "op12_source_divergence": source_divergence.SQL,
}
