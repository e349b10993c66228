"""The registered queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import chat, decontam, html, langid, lexical, line_dedup, ngram_join, packing, quality, simhash, substring_dedup, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    return langid.identify(docs, langid.learn(docs.where("not held_out")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_capitals", "n_exclaims")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


#: Rules of op6: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    every = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(*chat.format_tree(every))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_decontamination, op4_best_fit_packing, op5_ngram_jaccard_join, op6_url_filters, op7_html_extraction, op8_line_dedup, op9_substring_dedup, op10_chat_formatting, op11_lexical_search, op12_embedding_whitening, op13_simhash_near_dedup)
}

_OP2 = r"""
with base as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) as l
  from documents),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from base),
tri as (
  select doc_id, i, x, lead(x, 1) over p as y, lead(x, 2) over p as z
  from words window p as (partition by doc_id order by i)),
twice as (
  select doc_id, i, count(*) over (partition by doc_id, x, y, z) as n from tri where z is not null),
covered as (
  select doc_id, count(distinct k) as n_repeat_words
  from (select doc_id, i + unnest([0, 1, 2]) as k from twice where n > 1) group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         len(l) as n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
         length(t) - length(replace(t, '!', '')) as n_exclaims
  from base left join covered using (doc_id)),
f as (
  select *,
    (case when n_words < 50 then 1 else 0 end
     + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
     + case when 10 * n_symbols > n_words then 4 else 0 end
     + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 8 else 0 end
     + case when 10 * n_dup_lines > 3 * n_lines then 16 else 0 end
     + case when 10 * n_capitals > 4 * word_chars then 32 else 0 end
     + case when 5 * n_exclaims > n_words then 64 else 0 end
     + case when 100 * n_repeat_words > 80 * n_words then 128 else 0 end)::integer as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 as base_failed, (failed & 127) = 0 as kept, failed, n_lines::bigint as n_lines, n_capitals::bigint as n_capitals, n_exclaims::bigint as n_exclaims
from f
"""

_OP11 = r"""
with term as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
own as (select doc_id, t, count(*) as tf from term group by doc_id, t),
size as (select doc_id, sum(tf)::bigint as n from own group by doc_id),
corpus as (select count(*) as docs, sum(n)::bigint as total from size),
freq as (select t, count(*) as df from own where t in (select t from asked) group by t),
part as (
  select item_id, own.doc_id,
         floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) as s
  from asked join own using (t) join freq using (t) join size on size.doc_id = own.doc_id cross join corpus),
score as (select item_id, doc_id, sum(s)::bigint as score from part group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score
from score where score > 0 qualify rank <= 50
"""

SQL: dict[str, str] = {"op2_quality_rules": _OP2, "op11_lexical_search": _OP11}
