"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from . import ann, bpe, embed_dedup, filter_audit, fim, html_extract, langid, license_scan, lm_score, mixing, near_dup, token_counts, toxicity
from .shared import removed, settled, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return settled(lambda: ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0), spark, "ann-search")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every vector within its label."""
    return settled(lambda: embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")), spark, "embed-dedup")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again, as digests."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache of this call's own."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token_counts-{uuid.uuid4().hex}"  # of this call alone: every call does the whole work
    docs, path = _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    counted = settled(lambda: token_counts.count_tokens(docs, path, cache), spark, "token-counts")
    removed(spark, cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


WORDS = r"[^\x20\x09-\x0D]+"
#: Characters that lower a document's quality in the mix: digits and ASCII punctuation.
ODD = r"[!-@\[-`{-~]"


def mix_columns() -> tuple:
    """(size, quality) of a document in the mix: its words; 1 less twice its share of odd characters, 0.05 at least."""
    size = F.regexp_count("text", F.lit(WORDS))
    return size, F.greatest(F.lit(0.05), 1 - 2 * F.regexp_count("text", F.lit(ODD)) / F.greatest(F.length("text"), F.lit(1)))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    size, quality = mix_columns()
    mixed = lambda: mixing.mix(_table(spark, sf_dir, "documents"), size, quality).select("row.doc_id", "size", "source_size", "target", "taken")
    return settled(mixed, spark, "mixed")


OP2_SQL = f"""
with texts as (
  select doc_id, source, md5(coalesce(text, '')) as digest, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint as size,
    greatest(coalesce(greatest(0.05::double, 1 - 2 * len(regexp_extract_all(text, '{ODD}'))::double / greatest(length(text), 1)), 0.000001::double), 0.000001::double) as weight
  from documents),
numbered as (select *, row_number() over (partition by doc_id, source, digest) as occurrence from texts),
rows as (
  select doc_id, source, size, -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || digest || '|' || occurrence), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / weight as draw
  from numbered),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
weighed as (
  select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, 2.0::double * source_size as cap from sizes),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from weighed),
level as (select max(level) as level from levels where level <= cap / weight),
goals as (
  select source, source_size, coalesce(least(cap, level.level * weight), cap)::double as target from levels cross join level),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from goals),
drawn as (
  select doc_id, size, source_size, target, epochs, greatest(0, target - epochs * source_size) as budget,
    sum(size) over (partition by r.source order by draw) as upto
  from rows r join budgets b on r.source is not distinct from b.source)
select doc_id, size, source_size, target, ((epochs + (upto - size / 2.0 <= budget)::bigint) * size)::bigint as taken from drawn
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or holds."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    starts, base = F.col("base.first_word"), F.col("base.label")
    named = F.filter("spans", lambda x: x.named)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max(F.transform(named, lambda x: x.share)), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(named, lambda x: x.label))).alias("labels"), F.when(F.size("base") > 0, F.greatest(share, F.lit(0.5))).otherwise(share).alias("score"),
    )


def _bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def language_model(docs: DataFrame) -> langid.CrossParser:
    return langid.fit(docs.where(F.coalesce(_bucket(3), F.lit(0)) != 1))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, language_model(docs)).select("doc_id", F.coalesce(_bucket(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels").where(F.coalesce(_bucket(4), F.lit(0)) != 2)
    return toxicity.fit(docs, labels, "toxic")


#: Scores from this on count as toxic.
TOXIC = 0.3


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_bucket(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by wrappers inferred for each host."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each step of all orders of five filters, for each language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = f"""
with recursive
texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '{WORDS}') as words, min(doc_id) over (partition by text) as first from texts),
masks as (
  select w.part,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(w.text, '[A-Z]')) > 3 * length(w.text))::int
    + 8 * regexp_matches(w.text, '[#$%&*|]')::int + 16 * (w.doc_id > w.first)::int as mask,
    coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic
  from words w left join labels l using (doc_id)),
cells as (select part, mask, good, toxic, count(*) as n from masks group by all),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
prefixes(prefix, step, letter, bit, before, applied) as (
  select '', 0, '', 0, 0, 0
  union all
  select prefix || l.letter, step + 1, l.letter, l.bit, applied, applied | l.bit from prefixes join letters l on applied & l.bit = 0),
met as (
  select part, prefix, step, letter,
    coalesce(sum(n) filter (mask & applied = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit > 0 and mask & before > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0 and good), 0)::bigint as good_lost,
    coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0 and toxic), 0)::bigint as toxic_lost
  from cells, prefixes where step > 0 group by all)
select part, f.prefix as filter_order, m.step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, m.letter))::bigint as shapley
from met m join prefixes f on f.step = 5 and starts_with(f.prefix, m.prefix)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in its middle, as digests."""
    return fim.fill_in_middle(_table(spark, sf_dir, "documents"), with_output=False)


OP13_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, 'null')) as h from documents),
numbers as (
  select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from drawn),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers),
pieces as (
  select *, substring(text, 1, lo) as prefix, substring(text, lo + 1, hi - lo) as middle, substring(text, hi + 1) as suffix from cuts)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then lo end::bigint as prefix_chars, case when form <> 'plain' then hi - lo end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from pieces
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann_search, op2_mix_sources, op3_license_scan, op4_byte_bpe, op5_lm_score, op6_near_dup, op7_language_id, op8_toxicity, op9_embed_dedup, op10_token_counts, op11_html_extract, op12_filter_audit, op13_fill_in_middle)
}

ORACLES: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
