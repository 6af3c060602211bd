"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, embeddings, linededup, mixing, pii, quality, simhash, toxicity, urls, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


ORACLES["op2_urls"] = urls.oracle_sql()


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


ORACLES["op9_warc"] = """
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
    q as (select *, max(page_id) over (partition by d) as top from p)
    select page_id, n as payload_bytes, d as payload_digest, case when n < 1000 or page_id = top then 'response' else 'revisit' end as record_type,
           case when n >= 1000 and page_id <> top then top end as refers_to
    from q
"""


# parts of op4 and op7 that SQL can express


@query
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.sizes(table(spark, sf_dir, "documents"))
    goals = mixing.targets(d.groupBy("k", "source").agg(F.sum("size").alias("source_size")))
    return d.select("doc_id", "k", "size").join(goals, "k").select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


ORACLES["mixing_targets"] = r"""
    with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
    s as (select source, sum(size) as n from d group by source),
    r as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 2.0 * n as lim, 1.5 * sum(n) over () as total from s),
    o as (select *, (total - coalesce(sum(lim) over (order by lim / w, source rows between unbounded preceding and 1 preceding), 0))
                    / sum(w) over (order by lim / w, source rows between current row and unbounded following) as level from r),
    f as (select *, max(case when lim > level * w then level end) over () as open_ from o)
    select doc_id, size, n as source_size, round(case when lim <= level * w then lim else w * open_ end, 3) as target from d join f on d.source is not distinct from f.source
"""


@query
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pii.base_spans(table(spark, sf_dir, "documents"))
    return base.select("doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS])


_BYTE = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
ORACLES["pii_counts"] = rf"""
    with t as (select doc_id, coalesce(text, '') as t from documents),
    m as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
                 list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as card,
                 list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phone from t)
    select doc_id, len(email) as n_email, len(list_filter(ip, lambda x: regexp_full_match(x, '{_BYTE}(\.{_BYTE})(\.{_BYTE})(\.{_BYTE})'))) as n_ip,
           len(list_filter(card, lambda x: length(x) between 12 and 19 and list_sum(list_transform(string_split(reverse(x), ''), lambda c, i: case when i % 2 = 1 then c::int when c::int > 4 then c::int * 2 - 9 else c::int * 2 end)) % 10 = 0)) as n_card,
           len(list_filter(phone, lambda x: length(x) between 9 and 15)) as n_phone from m
"""
