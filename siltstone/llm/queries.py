"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siltstone.llm import ann, clusters, collocations, decontaminate, jaccard, language, licenses, lines, mixing, mixture, packing, quality, sstable
from siltstone.llm.common import crc_fold


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rank_order(spark, sf_dir):
    """The language of all documents, learned from four fifths of those with one."""
    docs = _table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 5)
    learned = language.profiles(docs.where(fold != 0))
    return language.identify(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), learned)


def op2_sstable(spark, sf_dir):
    """Token ids of all documents, written as sorted-string tables and read back."""
    docs = _table(spark, sf_dir, "documents")
    return sstable.encode_to_shards(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_anisotropic(spark, sf_dir):
    """The five nearest of all vectors for every fiftieth one."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), is_query=F.pmod("id", F.lit(50)) == 0)


def op4_context_mixing(spark, sf_dir):
    """Log-probabilities of all documents under the mixed model and under word counts."""
    return mixing.scores(_table(spark, sf_dir, "documents"))


def op5_edit_join(spark, sf_dir):
    """Lines of all documents that copy an earlier line within two edits."""
    out = lines.deduplicated(_table(spark, sf_dir, "documents"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return out.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("__dropped", none("int")).alias("dropped"),
        F.coalesce("__kept_ids", none("long")).alias("kept_ids"), F.col("__links").alias("n_links"),
    )


def op6_vertical_jaccard(spark, sf_dir):
    """Groups of near copies among all documents: five words, a similarity of 0.75."""
    return jaccard.near_groups(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    """Licences of all documents, as files of a directory for each source and language."""
    return licenses.scan(_table(spark, sf_dir, "documents"), path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op8_kneser_ney(spark, sf_dir):
    """Perplexity and verdict for all documents."""
    out = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_units", "perplexity", "threshold", "keep")


def op9_best_two_fit(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_decontamination(spark, sf_dir):
    """All documents held against all windows of the benchmark."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language over all documents."""
    return collocations.mined(_table(spark, sf_dir, "documents"))


def op12_fair_queueing(spark, sf_dir):
    """How often the mix of all sources takes each document."""
    return mixture.mixed(_table(spark, sf_dir, "documents"))


def op13_kd_filter(spark, sf_dir):
    """Eight clusters of all vectors in whole numbers, after ten rounds."""
    return clusters.clustered(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_rank_order, op2_sstable, op3_anisotropic, op4_context_mixing, op5_edit_join, op6_vertical_jaccard, op7_license_scan, op8_kneser_ney, op9_best_two_fit, op10_decontamination, op11_collocations, op12_fair_queueing, op13_kd_filter)}


def _license_sql() -> str:
    """The licence scan in SQL: its templates are rows, as in the operator."""
    quoted = lambda x: x.replace("'", "''")
    templates = ", ".join(f"({i}, '{name}', '{quoted(text)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    hint = lambda x: " or ".join(f"contains(lower({x}), '{h}')" for h in licenses.HINTS)
    many, other = len(licenses.TEMPLATES), f"(ln({1.0 + len(licenses.TEMPLATES)}) + 1.0)"
    return f"""
with templates(template, license, text) as (values {templates}),
tt as (select template, license, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from templates),
tc as (select template, license, term, count(*) as tf from tt group by all),
idf as (select term, ln({1.0 + many} / (1.0 + count(*))) + 1.0 as idf from tc group by term),
raw as (select tc.*, tf * idf as w from tc join idf using (term)),
weights as (select term, template, license, w / sqrt(sum(w * w) over (partition by template)) as weight from raw),
files as (select distinct doc_id, text, concat_ws('/', source, lang, cast(doc_id as varchar)) as path from documents),
speaking as (select *, string_split(text, chr(10)) as lines from files where {hint("text")}),
numbered as (select doc_id, lines, unnest(range(len(lines))) as i from speaking),
heads as (select doc_id, lines, i, lines[i + 1] as line from numbered where {hint("lines[i + 1]")}),
sentences as (select doc_id, unnest(regexp_split_to_array(line, '{licenses.SENTENCE_END}')) as text from heads),
units as (
  select doc_id, 0 as whole, text from (select doc_id, text from sentences where {hint("text")} union select doc_id, array_to_string(lines[i + 1 : i + n], chr(10)) as text from heads, (select unnest([{", ".join(map(str, licenses.WINDOWS))}]) as n))
  union all select doc_id, 1 as whole, text from speaking
),
keyed as (select row_number() over () as unit, doc_id, whole, text from units),
ut as (select unit, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from keyed),
uw as (select unit, term, count(*) * coalesce(any_value(idf), {other}) as w from ut left join idf using (term) group by unit, term),
un as (select unit, sqrt(sum(w * w)) as norm from uw group by unit),
dots as (select unit, template, license, round(sum(w * weight), 9) as dot from uw join weights using (term) group by all),
best as (select *, license = '{licenses.LAST_RESORT}' as last from dots qualify row_number() over (partition by unit order by dot desc, license) = 1),
cosines as (select doc_id, whole, license, last, round(dot / norm, 6) as cosine from best join un using (unit) join keyed using (unit)),
own as (select doc_id, license, cosine from cosines where whole = 0 and cosine >= {licenses.LINE_COSINE} qualify row_number() over (partition by doc_id order by last, cosine desc, license) = 1),
declared as (
  select regexp_replace(path, '/[^/]*$', '') as above, license, cosine from cosines join files using (doc_id) where whole = 1 and cosine >= {licenses.FILE_COSINE}
  qualify row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by last, cosine desc, path, license) = 1
),
f as (select doc_id, concat_ws('/', source, lang, cast(doc_id as varchar)) as path from documents),
inherited as (
  select f.path as path, d.above, d.license, d.cosine from (select distinct path from f) f join declared d on d.above = '' or starts_with(f.path, d.above || '/')
  qualify row_number() over (partition by f.path order by length(d.above) desc) = 1
)
select f.doc_id, f.path, coalesce(own.license, i.license) as license, case when own.license is not null then own.cosine else i.cosine end as cosine,
  case when own.license is not null then 'own' when i.license is not null then 'inherited' end as origin, case when own.license is null then i.above end as directory
from f left join own using (doc_id) left join inherited i on i.path = f.path
"""


ORACLE_SQL: dict[str, str] = {"op7_license_scan": _license_sql(), "op11_collocations": collocations.SQL, "op12_fair_queueing": mixture.SQL}
