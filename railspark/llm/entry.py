"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, exact_dedup, lm, near_dedup, packing, phrases, quality, records, substring_dedup, toxicity, warc, whitening
from .common import table

try:
    import public_tokenizers
    VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    WORDS = public_tokenizers.path("word_bpe_49k.json")
except ModuleNotFoundError:  # the vocabulary folder is a parameter of the operators
    VOCABULARY, RANKS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken"
    WORDS = "/opt/tokenizers/word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), VOCABULARY, RANKS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, ranks=RANKS)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", given), (-7, 1, "assistant", given)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.chains(rows.unionByName(more)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), WORDS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null; the operator has it as a decimal."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_host_quality, op3_attention_lm, op4_exact_dedup, op5_toxicity, op6_suffix_dedup, op7_near_dedup, op8_packing, op9_chat, op10_warc, op11_phrases, op12_records, op13_whitening)}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = {
    "op4_exact_dedup": f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n""",
    "op9_chat": """
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e as (select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'),
        '<</SYS>>', '<\\</SYS>>'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '[INST]', '[\\INST]'),
        '</s>', '<\\/s>'), '<s>', '<\\s>'), '<|', '<\\|') as x from c)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(x) + 23) as bigint) as formatted_chars
from e group by conv_id""",
    "op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
g as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest,
             case when octet_length(b) >= 1000 then max(page_id) over (partition by b) else page_id end as first from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to from g""",
    "op11_phrases": """
with t as (select coalesce(lang,'und') as lang, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as k from w where len(ws) > 0),
g as (select lang, ws[k] as w1, case when k + 1 <= len(ws) then ws[k + 1] end as w2, case when k + 2 <= len(ws) then ws[k + 2] end as w3 from i),
f1 as (select lang, w1, count(*) as f from g group by all),
f2 as (select lang, w1, w2, count(*) as f from g where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by all having count(*) >= 10),
tot as (select lang, sum(f) as n from f1 group by lang),
two as (select c.lang, c.w1 || ' ' || c.w2 as phrase, c.f as a, x.f as l, y.f as r
        from f2 c join f1 x on x.lang = c.lang and x.w1 = c.w1 join f1 y on y.lang = c.lang and y.w1 = c.w2
        where c.f >= 10 and not exists (select 1 from f3 b where b.lang = c.lang and b.w1 = c.w1 and b.w2 = c.w2 and 100 * b.f >= 50 * c.f)
          and not exists (select 1 from f3 b where b.lang = c.lang and b.w2 = c.w1 and b.w3 = c.w2 and 100 * b.f >= 50 * c.f)),
cuts as (select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 as phrase, c.f as a, x.f as l1, y.f as r1, u.f as l2, v.f as r2
         from f3 c join f1 x on x.lang = c.lang and x.w1 = c.w1 join f2 y on y.lang = c.lang and y.w1 = c.w2 and y.w2 = c.w3
         join f2 u on u.lang = c.lang and u.w1 = c.w1 and u.w2 = c.w2 join f1 v on v.lang = c.lang and v.w1 = c.w3),
scored as (select *, 1000000::hugeint * a * a // (l1::hugeint * r1) as s1, 1000000::hugeint * a * a // (l2::hugeint * r2) as s2 from cuts),
every as (select lang, phrase, a, l, r, 1000000::hugeint * a * a // (l::hugeint * r) as score from two
         union all select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from scored),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join tot using (lang) where rank <= 2000""",
}
