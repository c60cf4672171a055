"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitmix, chunks, collocations, decontaminate, mixing, quality, secrets, sharding, simhash, token_lengths, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.histogram(_table(spark, sf_dir, "documents"), ("source",))


def op6_bit_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmix.score(_table(spark, sf_dir, "documents"))


def op11_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_decontamination": op2_decontamination, "op5_quality_rules": op5_quality_rules, "op8_source_mixing": op8_source_mixing, "op9_simhash_dedup": op9_simhash_dedup, "op10_warc_archive": op10_warc_archive, "op7_chunk_dedup": op7_chunk_dedup, "op4_toxicity": op4_toxicity, "op3_token_counts": op3_token_counts, "op6_bit_mixing": op6_bit_mixing, "op11_histogram_sharding": op11_histogram_sharding, "op12_phrase_collocations": op12_phrase_collocations, "op13_embedding_whitening": op13_embedding_whitening}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_decontamination": f"""
with i as (select item_id, {_WORDS} as w from benchmark), s as (select *, least(10, len(w)) as n from i where len(w) > 0),
u as (select item_id, n, array_to_string(w[k:k + n - 1], ' ') as win from s, unnest(range(1, len(w) - n + 2)) r(k)),
d as (select doc_id, {_WORDS} as w from documents), sizes as (select distinct n from u),
p as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win from d cross join sizes, unnest(range(1, len(w) - n + 2)) r(k)),
m as (select distinct doc_id, p.n, k, item_id from p join u on u.n = p.n and u.win = p.win),
h as (select doc_id, count(distinct spot) as n_hit from m, unnest(range(k, k + n)) r(spot) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed from m group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)""",
    "op10_warc_archive": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
w as (select *, max(page_id) over (partition by h) as top from d),
q as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::bigint) as five from w)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::int + 1, 1)), '')), '') as payload_digest,
  case when page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to, cast(null as varchar) as error
from q""",
    "op11_histogram_sharding": r"""
with tab as (select list(c order by i) as t from (select i, list_reduce(range(0, 8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i::bigint) as c from range(256) r(i))),
d as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, strlen(text) + 16 as size, ('0x' || substr(md5(text), 1, 15))::bigint as k, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint) as bytes from d),
c as (select *, sum(size) over (order by k, doc_id nulls first rows unbounded preceding) - size as before, sum(size) over () as total, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295) as crc from b, tab),
s as (select *, ((2 * before + size) * 40 // (2 * total))::int as shard from c)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by k, doc_id nulls first) - 1)::bigint as slot, null::int as grown_shard from s""",
    "op12_phrase_collocations": r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from t), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
total as (select lang, sum(len(w)) as n from w group by 1),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from w, range(1, 5) r(k), unnest(range(1, len(w) - k + 2)) u(i)),
f as (select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as a from g group by all having count(*) >= 30),
inner_ as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as top from f, unnest(range(2, k)) r(m), unnest(range(1, k - m + 2)) u(i) group by 1, 2),
c as (select f.* from f left join inner_ using (lang, phrase) where k > 1 and (top is null or 100 * top < 80 * a)),
cut as (select lang, phrase, a, j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1:k], ' ') as y from c, unnest(range(1, k)) r(j)),
s as (select cut.lang, cut.phrase, cut.a, j, x.a as l, y.a as r, (2000000::hugeint * cut.a) // (x.a + y.a) as score from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o join total using (lang) where rank <= 2000""",
}
