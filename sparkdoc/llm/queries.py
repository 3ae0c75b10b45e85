"""Driver queries of the corpus operators, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkdoc.llm import decontaminate, embeddings, html, mixing, quality, secrets, sharding, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back, with their places in the capture histories."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of one label."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents with the record of their sites."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the languages to their target weights."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs, table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates over all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_warc, op3_embeddings, op4_secrets, op5_decontaminate, op6_quality, op7_mixing, op8_simhash, op9_html, op10_toxicity)}


_OP3 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), sound as (
  select * from v where e is not null and label is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from v
  union
  select r.a, l.b from reach r join link l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least.component_id, v.vec_id = least.component_id as kept
from v join least on least.a = v.vec_id left join (select a, count(*) as n from link group by a) n on n.a = v.vec_id
"""

_OP5 = """
with words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents
), item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null and text is not null
), win as (
  select distinct item_id, least(len(w), 8) as n, array_to_string(w[p : p + least(len(w), 8) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as p from item where len(w) > 0)
), place as (
  select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from words, (select distinct n from win) where len(w) >= n)
), hit as (
  select doc_id, p, place.n, item_id from place join win on win.n = place.n and win.g = place.g
), covered as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as k from (select distinct doc_id, p, n from hit)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id
)
select words.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words left join covered using (doc_id) left join items using (doc_id)
"""


# keys as for these URLs; captures follow page_id, as their times do
_OP2 = """
with p as (
  select page_id, coalesce(html, '') as h, lower(coalesce(url, 'urn:page:' || page_id)) as url from pages
), d as (
  select page_id, strlen(h) as n, sha1(h) as digest,
    regexp_replace(regexp_replace(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)', 1), '^.*@', ''), '(:|:80|:443)$', '') as host,
    regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)', 2) as rest, url
  from p
), k as (
  select page_id, n, digest, case when regexp_matches(url, '^(?:[a-z][a-z0-9+.-]*:)?//')
    then array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*[.]', ''), '.')), ',') || ')' || coalesce(nullif(rest, ''), '/') else url end as urlkey
  from d
), r as (
  select digest, max(page_id) as newest from d where n >= 1000 group by digest
)
select page_id, n::bigint as payload_bytes, k.digest as payload_digest,
  case when n >= 1000 and page_id < newest then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < newest then newest end as refers_to,
  urlkey, row_number() over (partition by urlkey order by page_id) - 1 as capture_no
from k left join r on r.digest = k.digest
"""

# these pages have one article element each, with the tags and references named here
_OP9 = r"""
with a as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as x from pages
), b as (
  select page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') as x from a
), c as (
  select page_id, url, regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') as x from b
), d as (
  select page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) as text from c
)
select page_id, url, text, length(text)::bigint as n_chars from d
"""


# the base kinds; tokens with checksums, which SQL can't verify, don't occur in these tables
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_OP4 = f"""
with k as (
  select doc_id, coalesce(text, '') as t from documents
), m as (
  select doc_id, 'assign' as kind, 0 as rank, regexp_extract_all(t, '{_ASSIGN}') as m, string_split_regex(t, '{_ASSIGN}') as p from k
  union all
  select doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from k
  union all
  select doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{{16,}}'), string_split_regex(t, '[0-9a-f]{{16,}}') from k
), s as (
  select doc_id, kind, rank, m[i] as x, (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::bigint as start
  from (select *, unnest(generate_series(1, len(m))) as i from m where len(m) > 0)
), f as (
  select doc_id, kind, rank, start, start + length(x) as stop from s
  where rank = 0 and length(regexp_extract(x, '{_ASSIGN}', 2)) >= 12 or rank = 1 and length(x) >= 18 or rank = 2
), g as (
  select doc_id, count(*) filter (rank = 0) as a, count(*) filter (rank = 1) as b, count(*) filter (rank = 2) as c,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from f group by doc_id
)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join g on g.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2, "op3_embeddings": _OP3, "op4_secrets": _OP4, "op5_decontaminate": _OP5, "op9_html": _OP9}
