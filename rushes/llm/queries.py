"""The registered queries: each operator over its whole table, with digest columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents
from .alignment import align_tokens
from .bpe import code_texts
from .conversation_trie import conversation_trie
from .jaccard_join import link_components
from .katz import score_katz
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import pack_documents
from .piece_bpe import code_pieces
from .quality_classifier import fit_quality, score_quality
from .quality_rules import apply_quality_rules
from .substring_dedup import dedup_substrings
from .topk_search import search_top_k


def tokenizer_file(name: str) -> str:
    """The content of a public tokenizer file; tasks get the content, not the path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def model_file(name: str) -> bytes:
    """The content of a public model file, as above."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_sha").alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = code_texts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), texts=False)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_sha").alias("kept_sha256"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_components(documents(spark, sf_dir), gram=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = code_pieces(documents(spark, sf_dir).select("doc_id", "text"), model_file("piece_bpe_32k.model"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_bpe, op4_line_dedup, op5_katz, op6_jaccard_join, op7_license_scan, op8_quality_rules, op9_quality_classifier, op10_topk_search, op11_alignment, op12_sentencepiece, op13_conversation_trie)}

#: DuckDB SQL over whole tables, where it can express the query.
ORACLES = {
    "op4_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10),
judged as (select doc_id, i, line, common.k is not null as gone from keyed left join common on keyed.k = common.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op10_topk_search": """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5""",
    "op13_conversation_trie": """
with numbered as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as n
  from conversations where conv_id is not null),
sizes as (select c, max(n) as size from numbered group by c),
bytes as (
  select c, size, list_concat([4294967295::bigint], flatten([[ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0] for x in string_split(c::varchar, '')])) as bits
  from sizes),
heads as (
  select c, size, xor(list_reduce(bits, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 as h
  from (select c, size, bits from bytes)),
convs as (
  select heads.c, heads.h, heads.c - heads.c % 5 as base, least(heads.h, coalesce(sizes.size, 0)) as head
  from heads left join sizes on sizes.c = heads.c - heads.c % 5),
turns as (
  select convs.c, n as d, role, text from convs join numbered on numbered.c = convs.base where n <= head
  union all
  select convs.c, head + n - h, role, text from convs join numbered on numbered.c = convs.c where n > h),
path as (
  select c, 0 as d, '' as prefix, 0 as bytes from convs
  union all
  select c, d, sha256(string_agg(sha256(role) || sha256(text), '' order by d) over (partition by c order by d)), strlen(text) from turns),
deep as (select c, max(d) as depth from path group by c),
node as (select d, prefix, min(c) as owner, count(*) as n, any_value(bytes) as bytes from path group by d, prefix),
up as (
  select node.d, node.prefix, parent.d as pd, parent.prefix as pp, parent.owner as parent_owner
  from node join path p on p.c = node.owner and p.d = node.d - 1 join node parent on parent.d = p.d and parent.prefix = p.prefix),
kids as (select pd as d, pp as prefix, count(*) as k from up group by all),
sub as (
  select p.d, p.prefix, count(*) filter (where kids.k is null) as leaves, sum((v.n - 1) * v.bytes) as saved
  from node v left join kids on kids.d = v.d and kids.prefix = v.prefix join path p on p.c = v.owner and p.d <= v.d
  group by p.d, p.prefix),
ends as (
  select path.d, path.prefix, sha256(string_agg(c::varchar, ',' order by c)) as digest
  from path join deep using (c) where path.d = deep.depth group by all)
select node.owner as conv_id, node.d::bigint as depth, up.parent_owner as parent_conv_id, node.n::bigint as n_convs,
  coalesce(kids.k, 0)::bigint as n_children, sub.leaves::bigint as n_leaves, sub.saved::bigint as saved_tokens,
  coalesce(ends.digest, sha256('')) as ends_sha256
from node left join up on up.d = node.d and up.prefix = node.prefix left join kids on kids.d = node.d and kids.prefix = node.prefix
  join sub on sub.d = node.d and sub.prefix = node.prefix left join ends on ends.d = node.d and ends.prefix = node.prefix""",
}
