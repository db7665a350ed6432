"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm.common import held_out, materialize, table
from relictum.llm.decontaminate import find_leaks
from relictum.llm.embedding_dedup import embedding_components
from relictum.llm.html_text import extract_text, fit_dom_model, sample_pages
from relictum.llm.mixing import fit_topics, mix_sources, with_topics
from relictum.llm.piece_encoding import encode_pieces
from relictum.llm.prefix_trie import EMPTY, end_digests, placed_turns, prefix_trie
from relictum.llm.quality import fit_quality, score_quality
from relictum.llm.secret_scan import joined_spans, scan_secrets
from relictum.llm.simhash import simhash_components
from relictum.llm.suffix_dedup import remove_repeats
from relictum.llm.token_counts import token_counts
from relictum.llm.toxicity import fit_toxicity, score_toxicity
from relictum.llm.vector_codes import vector_codes

TOKEN_LIMIT = 4096
QUALITY_THRESHOLD = 0.3
TOKENIZER = "piece_bpe_32k.model"
#: The hot source is held down; other sources, and topics, share what is left by the square root of their tokens.
MIX_TARGETS = {
    "source": {"src0": 0.15},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {},
}
MIX_TEMPERED = {"source": 0.5, "topic": 0.5}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def mixed(docs: DataFrame, *, texts: bool, tokens: str = "n_words") -> DataFrame:
    """Documents, with or without their texts, with topic, n_tokens, probability and selected. `tokens` names the weights."""
    described = with_topics(docs, F.col("lang"), fit_topics(docs, F.col("lang")))
    described = materialize(described if texts else described.drop("text"), "described")
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic")}
    return mix_sources(described, MIX_TARGETS, columns=columns, tempered=MIX_TEMPERED, tokens=F.col(tokens), draw=F.col("draw")).drop("draw", "n_words")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts(docs, tokenizer_path())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined_spans(F.col("secrets"), ("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs, texts=False).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "selected")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_dom_model(sample_pages(spark))
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), null_ids=True)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, the bytes of the source that the pieces' spans cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_pieces(docs, tokenizer_path(), columns=("n_tokens", "packed", "decoded", "covered"))
    return found.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "covered")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    said = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


#: Every fifth conversation lends its first turns, at most LENT, to itself and the four after it.
LENDERS, LENT = 5, 8


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed turns in which each conversation begins with the first turns of its lender, and the ids of all conversations."""
    lengths = materialize(turns.groupBy("conv_id").agg(F.max("place").alias("length")), "lengths")
    lends = lengths.select(F.col("conv_id").alias("lender"), F.least("length", F.lit(LENT)).alias("lent"))
    skipped = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LENT + 1))
    plan = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % LENDERS).alias("lender"), skipped.alias("skipped")).join(lends, "lender", "left")
    plan = materialize(plan.select("conv_id", "lender", "skipped", F.least("skipped", F.coalesce("lent", F.lit(0))).alias("borrowed")), "plan")
    own = turns.join(plan, "conv_id").where("place > skipped").select("conv_id", (F.col("place") - F.col("skipped") + F.col("borrowed")).alias("place"), "key", "bytes")
    heads = turns.where((F.col("place") <= LENT) & (F.col("conv_id") % LENDERS == 0)).withColumnRenamed("conv_id", "lender")
    lent = heads.join(plan, "lender").where("place <= borrowed").select("conv_id", "place", "key", "bytes")
    return own.unionByName(lent), plan.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(*rebuilt_turns(placed_turns(table(spark, sf_dir, "conversations"))))
    # A conversation that ends alone is the whole list of its node.
    listed = trie.nodes.where("n_convs > 1").join(end_digests(trie.shared_ends).withColumnRenamed("node_conv_id", "conv_id"), ["conv_id", "depth"], "left")
    alone = trie.nodes.where("n_convs = 1").withColumn("ends_sha256", F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return listed.select(*columns).unionByName(alone.select(*columns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_toxicity, op4_source_mixing, op5_html_extraction, op6_suffix_dedup, op7_quality, op8_embedding_dedup, op9_decontamination, op10_simhash, op11_piece_encoding, op12_vector_codes, op13_prefix_trie, pipeline)}


OP8_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings
), usable as (
  select vec_id, label, x from v
  where vec_id is not null and label is not null and x is not null and list_inner_product(x, x) > 0
    and not list_contains(list_transform(x, lambda e: e is null or not isfinite(e)), true)
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
), degree as (
  select a, count(*) as n_links from links group by a
)
select v.vec_id, cast(coalesce(d.n_links, 0) as bigint) as n_links, l.component_id, v.vec_id = l.component_id as kept
from v join least l on l.a = v.vec_id left join degree d on d.a = v.vec_id
"""




def op12_sql(rounds: int = 6) -> str:
    """Ids are taken as unique and vectors as of one length."""
    steps = ["""
kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
), parts as materialized (
  select vec_id, p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) as x from kept, range(8) as r(p)
), book0 as materialized (
  select p, place as entry, x from (select vec_id, row_number() over (order by vec_id) - 1 as place from kept qualify place < 16) join parts using (vec_id)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as materialized (
  select vec_id, p, least_pair.entry as entry, least_pair.error as error, x from (
    select a.vec_id, a.p, any_value(a.x) as x, min(struct_pack(error := cast(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), entry := b.entry)) as least_pair
    from parts a join book{k} b on a.p = b.p group by a.vec_id, a.p)
)""")
        if k < rounds:
            steps.append(f"""
sums{k} as (
  select p, entry, i, sum(x[i]) as s, count(*) as n from near{k}, lateral (select unnest(range(1, len(x) + 1)) as i) group by p, entry, i
), book{k + 1} as materialized (
  select p, entry, coalesce(m.x, b.x) as x from book{k} b left join (
    select p, entry, list(cast((s - (s % n + n) % n) // n as bigint) order by i) as x from sums{k} group by p, entry) m using (p, entry)
)""")
    return "with " + ",".join(steps) + f"""
, coded as (
  select vec_id, string_agg(format('{{:02x}}', entry), '' order by p) as code, cast(sum(error) as bigint) as error from near{rounds} group by vec_id
), said as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by p, entry)) as codebooks_sha256 from book{rounds}
)
select k.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept k join coded using (vec_id), said
"""


OP13_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), named as (
  select *, sha256(concat(strlen(role), ':', role, ':', text)) as k from turns
), numbered as (
  select *, dense_rank() over (order by role, text) as said, strlen(text) as bytes from named
), own as (
  select conv_id, list(struct_pack(said := said, bytes := bytes) order by turn nulls first, role, k) as t from numbered group by conv_id
), cut as (
  select conv_id, t, conv_id - conv_id % 5 as lender,
    xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda crc, byte:
      list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(crc, byte)), cast(4294967295 as bigint)), 4294967295) % 9 as h
  from own
), rebuilt as materialized (
  select c.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(c.t, h + 1, len(c.t))) as t from cut c left join own b on b.conv_id = c.lender
), members as materialized (
  select conv_id, d, len(t) as length, list_transform(list_slice(t, 1, d), lambda x: x.said) as path, case when d > 0 then t[d].bytes else 0 end as bytes
  from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from rebuilt)
), nodes as materialized (
  select min(conv_id) as conv_id, d as depth, path, count(*) as n_convs, any_value(bytes) as bytes, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (length = d), '')) as ends_sha256
  from members group by d, path
), linked as materialized (
  select n.*, p.conv_id as parent_conv_id from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = list_slice(n.path, 1, n.depth - 1)
), children as (
  select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by 1, 2
), counted as materialized (
  select n.*, coalesce(c.n_children, 0) as n_children from linked n left join children c using (conv_id, depth)
)
select a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, cast(count(*) filter (b.n_children = 0) as bigint) as n_leaves,
  cast(sum((b.n_convs - 1) * b.bytes) as bigint) as saved_tokens, a.ends_sha256
from counted a join counted b on b.depth >= a.depth and list_slice(b.path, 1, a.depth) = a.path
group by a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_dedup": OP8_SQL, "op12_vector_codes": op12_sql(), "op13_prefix_trie": OP13_SQL}
