"""The queries of the operators in this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_text, images, pii, quality, sharding, simhash, url_filter, warc
from .common import table

#: Rules (host, path) of op1, and the hosts it blocks where no rule fits.
BLOCK, ALLOW = [("net", "/"), ("example.com", "/de/")], [("example.net", "/en/"), ("org", "/fr/")]
BLOCKED_HOSTS = ["casino-win.example.net", "cheap-pills.example.net", "spam-farm.example.org", *(f"spam-{n}.example.com" for n in range(5_000))]
#: Shards of op5.
SHARDS = 16
#: The vocabulary file of op7; every executor has it at this path.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, with the Bloom filter cascade."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, BLOCK, ALLOW, BLOCKED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and tail probability."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, model, keep_text=False)


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from the vectors; every twentieth, cropped, brightened and blurred, is sought among all."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    drawn, edited = images.draw(vectors, "vec_id", "embedding"), images.draw(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", edit=True)
    return images.image_copies(edited, drawn)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    out = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.col("entities.type"))), ",").alias("types"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; shards are near equal in bytes."""
    rows, dims = sharding.documents_metadata(table(spark, sf_dir, "documents"))
    out = sharding.kd_shards(rows, dims, shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *dims)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Words that a proximity query takes from an item, and the span in which all have to stand.
NEAR_WORDS, NEAR_SPAN = 3, 6


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the first words of a benchmark item stand near each other, in any order."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(decontam.words_of(F.col("text")), 1, NEAR_WORDS), " ").alias("words"))
    return decontam.proximity_matches(table(spark, sf_dir, "documents"), items, NEAR_SPAN, query_id="item_id", query_text="words").select("doc_id", F.col("query_id").alias("item_id"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    small_batches(spark)
    return bpe_digests(bpe.bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE))


def bpe_digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page captures as archive records, a third of them revisits, each resolved to its earlier response."""
    out = warc.resolve_revisits(archive_records(table(spark, sf_dir, "pages")))
    return out.select(F.col("record_id").alias("page_id"), "canonical_url", "match_id", "validation", F.coalesce(F.size("merged_headers"), F.lit(-1)).alias("n_headers"))


def archive_records(pages: DataFrame) -> DataFrame:
    """Records from pages: one every ten minutes; every third is a 304; validators follow from the canonical URL, and change for every seventh."""
    n, name = F.col("page_id"), F.md5(F.coalesce(warc.canonical_url(F.col("url")), F.lit("")))
    tag = F.concat(F.when(n % 3 == 0, "W/").otherwise(""), F.lit('"'), F.substring(name, 1, 8), F.when(n % 7 == 0, "x").otherwise(""), F.lit('"'))
    fields = F.create_map(F.lit("etag"), F.when(n % 5 != 0, tag), F.lit("last-modified"), F.when(n % 4 != 0, F.substring(name, 9, 8)), F.lit("content-type"), F.lit("text/html"), F.lit("date"), n.cast("string"))
    return pages.select(n.alias("record_id"), "url", F.timestamp_seconds(1_700_000_000 + n * 600).alias("at"), (n % 3 != 0).alias("is_full"), F.map_filter(fields, lambda k, v: v.isNotNull()).alias("headers"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    small_batches(spark)
    texts = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    small_batches(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filters, op2_quality, op3_image_copies, op4_pii_surrogates, op5_sharding, op6_decontamination, op7_bpe, op8_revisits, op9_html_text, op10_simhash)
    return {f.__name__: f for f in (*found, benchmark_proximity)}


_OP1 = """
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rule_host, rule_path, says)),
m as (
  select u.page_id, u.host, u.path, r.rule_host || r.rule_path as rule, r.says,
    row_number() over (partition by u.page_id order by length(r.rule_host || r.rule_path) desc nulls last) as n
  from u left join r on ('.' || u.host) like ('%.' || r.rule_host) and starts_with(u.path, r.rule_path))
select page_id, host, path, rule,
  coalesce(says, case when array_to_string(string_split(host, '.')[-3:], '.') in (
    select h from (values ('casino-win.example.net'), ('cheap-pills.example.net'), ('spam-farm.example.org')) t(h)
    union all select 'spam-' || i || '.example.com' from range(5000) t(i)) then 'block' else 'allow' end) as verdict
from m where n = 1
"""

_OP6 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
k as (select distinct least(len(w), 10) as k from b where len(w) > 0),
bw as (
  select distinct item_id, n as k, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, k where len(w) >= k)),
hits as (select dw.doc_id, dw.k, dw.i, bw.item_id from dw join bw using (k, phrase)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

_NEAR = _OP6[: _OP6.index("),\nk as")] + f"""),
q as (select distinct item_id, unnest(w[1:{NEAR_WORDS}]) as term from b),
n as (select item_id, count(*) as n from q group by item_id),
t as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from d),
h as (select doc_id, item_id, pos, term from t join q using (term)),
x as (select a.doc_id, a.item_id, a.pos, count(distinct b.term) as k from h a join h b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.pos >= a.pos and b.pos < a.pos + {NEAR_SPAN}
  group by a.doc_id, a.item_id, a.pos)
select distinct doc_id, item_id from x join n using (item_id) where k = n
"""

_OP8 = r"""
with c as (
  select page_id, trim(url, ' ') as u, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as plain
  from pages),
k as (
  select page_id,
    case when length(u) > 0 then regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^(?:www|m)\.|:(?:80|443)$', '', 'g')
      || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '')
      || coalesce((select '?' || string_agg(p, '&' order by p) from (select unnest(string_split(regexp_extract(plain, '\?(.*)$', 1), '&')) as p)
        where p <> '' and not regexp_matches(lower(p), '^(?:utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(?:=|$)')), '') end as canonical_url
  from c),
r as (
  select page_id, canonical_url, page_id % 3 <> 0 as is_full, md5(coalesce(canonical_url, '')) as name,
    case when page_id % 5 <> 0 then '"' || substring(md5(coalesce(canonical_url, '')), 1, 8) || case when page_id % 7 = 0 then 'x' else '' end || '"' end as etag,
    case when page_id % 4 <> 0 then substring(md5(coalesce(canonical_url, '')), 9, 8) end as modified
  from k),
m as (
  select v.*, f.page_id as f_id, f.etag as f_etag, f.modified as f_modified,
    case when v.is_full and v.canonical_url is not null then 'full' when f.page_id is null then 'unmatched'
      when v.etag is not null and f.etag is not null then case when v.etag = f.etag then 'etag' else 'mismatch' end
      when v.modified is not null and f.modified is not null then case when v.modified = f.modified then 'last-modified' else 'mismatch' end
      else 'unvalidated' end as validation
  from r v left join (
    select a.page_id as of_id, max(b.page_id) as page_id from r a join r b on a.canonical_url = b.canonical_url and b.page_id < a.page_id and b.is_full and not a.is_full group by a.page_id) x
    on x.of_id = v.page_id left join r f on f.page_id = x.page_id)
select page_id, canonical_url, case when validation in ('etag', 'last-modified', 'unvalidated') then f_id end as match_id, validation,
  case when validation = 'full' then 2 + (etag is not null)::int + (modified is not null)::int
    when validation in ('etag', 'last-modified', 'unvalidated') then 2 + (coalesce(etag, f_etag) is not null)::int + (coalesce(modified, f_modified) is not null)::int
    else -1 end as n_headers
from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _OP1, "op6_decontamination": _OP6, "op8_revisits": _OP8, "benchmark_proximity": _NEAR}
