"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import fold_of
from .embed_dedup import embedding_near_duplicates
from .html_extract import extract_main_text
from .langid import fit_languages, predict_languages
from .minhash import minhash_near_duplicates
from .mixing import mix_sources
from .pii import PATTERNS, find_personal_data, span_text
from .quality import quality_verdicts
from .toxicity import fit_toxicity, score_toxicity
from .urls import filter_urls, url_host

#: Vocabulary of the encoder; its path is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit_toxicity(docs, _table(spark, sf_dir, "labels"), only=fold_of(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, lexicon).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "hits")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return bpe_decode(coded, path).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, only=fold_of(F.col("doc_id"), 4) != 2)
    return predict_languages(docs.drop("lang"), model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list is a table of keys: the mobile mirrors that the corpus met."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    mirrors = pages.select(url_host(F.col("url")).alias("host")).where(F.col("host").startswith("m.")).distinct()
    return filter_urls(pages, mirrors).select("page_id", "host", "path", "rule", "verdict")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "more")).alias("spans"))


def _of_kind(k: int):
    return lambda x: x["k"] == k


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_embedding_dedup, op2_toxicity, op3_html_text, op4_bpe, op5_language, op6_quality, op7_url_filter, op8_minhash_dedup, op9_personal_data, op10_mixing)
    return {f.__name__: f for f in own}


_OP1 = """
with recursive fit as (
  select vec_id, label, embedding::double[] v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id u, b.vec_id v from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach(u, v) as (select vec_id, vec_id from embeddings union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) c from reach group by u),
counted as (select u, count(*) n from links group by u)
select e.vec_id, coalesce(k.n, 0)::bigint n_links, l.c component_id, e.vec_id = l.c kept
from embeddings e join least l on l.u = e.vec_id left join counted k on k.u = e.vec_id
"""

_OP6 = r"""
with d as (
  select doc_id, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
grams as (select doc_id, unnest(range(1, len(w) - 3)) i, w from d where len(w) >= 5),
keyed as (select doc_id, i, array_to_string(w[i:i+4], ' ') g from grams),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from keyed) where c > 1),
cover as (select doc_id, count(distinct i + k) n from again, range(5) r(k) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(string_split(t, chr(10))) line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select d.doc_id, t, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint n_symbols,
    coalesce(lines.n, 0)::bigint n_dup_lines, coalesce(cover.n, 0)::bigint n_repeat_words
  from d left join lines using (doc_id) left join cover using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars > 60 * n_words or word_chars < 2 * n_words or 10 * n_symbols > 3 * word_chars
    or 10 * n_dup_lines > 5 * len(string_split(t, chr(10))) or not regexp_matches(t, '\p{L}')
    or 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars) kept
from b
"""

_OP7 = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end rule from p)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when starts_with(host, 'm.') then 'block' else 'allow' end verdict from r
"""

_OP8 = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i+4], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id u, b.doc_id v, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select u, v from shared join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 85 * (a.n + b.n - k)),
reach(u, v) as (select doc_id, doc_id from documents union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) c from reach group by u)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, l.c component_id, d.doc_id = l.c kept
from d join least l on l.u = d.doc_id left join n on n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": _OP1, "op6_quality": _OP6, "op7_url_filter": _OP7, "op8_minhash_dedup": _OP8}
