"""The queries of the corpus operators, one for each, over the whole of their tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import align, audit, bpe, lines, pii, quality, repeats, shards, simhash, suffix, topk, toxicity, urls
from tracelake.llm.common import written

QUERIES, ORACLES = {}, {}
RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: labelled rows that the models learn from, at most
TOXIC_ROWS, QUALITY_ROWS = 20_000, 4_000


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.members(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return simhash.with_components(found).select(
        F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = toxicity.training_rows(table(spark, sf_dir, "labels"), "toxic", "doc_id", 4, 2, TOXIC_ROWS)
    training = written(toxicity.one_of_each(docs, training, "doc_id", "text"), "training")
    model = toxicity.fit(docs, training, "doc_id", "text")
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op5_urls",
    """
with parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select host, path, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as n
  from (select distinct host, path from parts) join rules
  on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
from parts left join (select * from best where n = 1) using (host, path)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op6_topk",
    """
with codes as (
  select vec_id, [floor(256 * cast(x as double)) for x in embedding] as code
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.code, c.code) as bigint) as score
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id,
    score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.col("vec_id") % 50 == 0, 5)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = toxicity.training_rows(table(spark, sf_dir, "labels"), "quality", "doc_id", 3, 1, QUALITY_ROWS)
    scored = quality.score(docs, quality.fit(docs, training))
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        shards.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    group = ["text_crc32", "size", "text_hash"]
    placed = shards.assign(docs, "size", [*group, "doc_id"], group, 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed_chars")


@query("op11_align")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.groups(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.usual_links(found).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query("op12_repeats")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_shared(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op13_filters",
    """
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
failing as (
  select doc_id, part,
    case when len(words) < 50 then 'A' else '' end ||
    case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end ||
    case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end ||
    case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end ||
    case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fails
  from texts),
marked as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counted as (
  select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from failing left join marked using (doc_id) group by part, fails),
letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
steps as (
  select filter_order, step, filter_order[step] as own, filter_order[:step - 1] as earlier
  from orders cross join (select unnest([1, 2, 3, 4, 5]) as step)),
seen as (
  select part, filter_order, step, own, n, good, toxic, contains(fails, own) as fails_own, fails = own as only_own,
    translate(fails, earlier, '') = fails as reached
  from counted cross join steps),
found as (
  select part, filter_order, cast(step as int) as step, own,
    cast(coalesce(sum(n) filter (reached and not fails_own), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter (reached and fails_own), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (fails_own and not reached), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (only_own), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (reached and fails_own), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter (reached and fails_own), 0) as bigint) as toxic_lost
  from seen group by all)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from found
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = audit.mark_repeats(written(audit.text_failures(docs), "failures"))
    label = lambda name: F.max((F.col(name) == 1).cast("int")).alias(name)
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(label("quality"), label("toxic"))
    known = rows.join(marks, "doc_id", "left")
    counts = audit.survivors(known, F.col("source"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit.order_effects(counts, {"good_lost": "good", "toxic_lost": "toxic"})
