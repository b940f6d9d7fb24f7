"""Queries over the given tables, one per operator, and the pipeline's query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swapledger.llm import (
    block_topk, bpe_backtrack, centroid_clusters, covering_simhash, fingerprint, language_id, ngram_join, packing, quality_fm,
    rans_store, secret_index, suffix_dedup, whitening,
)
from swapledger.llm.common import read_table


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.train(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality_fm.with_quality(docs, model, output="score").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bottom_k_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op4_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans_store.new_folder(spark)
    rans_store.write_ids(read_table(spark, sf_dir, "documents"), folder)
    return rans_store.read_ids(spark, folder)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_backtrack.with_bpe(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_links(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "text_id", "class_id", "n_links", "n_text_links")


def op8_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, fold("doc_id", 4) != 2)
    return language_id.with_language(docs.select("doc_id", "text"), model, score="score").select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("secrets", lambda s: s["kind"].isin(*secret_index.BASE)))
    return found.select("doc_id", *map(count, secret_index.BASE), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


def op10_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.near_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), F.col("class_id").alias("component_id"))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_centroid_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(read_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_clusters.listed_sha256(F.col("centroid")).alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Whole-number inner products; sums of products of components stay far below 2^53 here.
_OP10 = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(coalesce(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def _op13() -> str:
    """Seeds, three rounds and the last assignment as chained CTEs."""
    ctes = ["""v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), c0 as (
  select cast(row_number() over (order by sha256('1:' || vec_id), e) - 1 as integer) as cluster, e from v where vec_id is not null
  qualify cluster < 16
)"""]
    for r in range(4):
        ctes.append(f"""d{r} as (
  select v.vec_id, v.e, c.cluster, cast(list_sum([(v.e[i] - c.e[i]) * (v.e[i] - c.e[i]) for i in range(1, 65)]) as bigint) as distance
  from v cross join c{r} c
), a{r} as (
  select vec_id, e, min(struct_pack(distance := distance, cluster := cluster)) as near from d{r} group by vec_id, e
)""")
        if r < 3:
            ctes.append(f"""s{r} as (
  select a.near.cluster as cluster, i, sum(a.e[i]) as t, count(*) as n from a{r} a, (select unnest(range(1, 65)) as i) group by 1, 2
), m{r} as (
  select cluster, list(cast((t - ((t % n) + n) % n) // n as bigint) order by i) as e from s{r} group by cluster
), c{r + 1} as (
  select c.cluster, coalesce(m.e, c.e) as e from c{r} c left join m{r} m on m.cluster = c.cluster
)""")
    return "with " + ", ".join(ctes) + """, w as (
  select near.cluster as cluster, cast(sum(near.distance) as bigint) as cluster_inertia from a3 group by 1
)
select a.vec_id, a.near.cluster as cluster, a.near.distance as distance, w.cluster_inertia,
       (select cast(sum(cluster_inertia) as bigint) from w) as inertia, sha256(list_aggregate(c.e, 'string_agg', ',')) as centroid_sha256
from a3 a join w on w.cluster = a.near.cluster join c3 c on c.cluster = a.near.cluster
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries by name."""
    fns = (
        op1_sum_of_squares_packing, op2_quality_fm, op3_bottom_k_fingerprint, op4_rans_token_ids, op5_suffix_dedup,
        op6_backtracking_bpe, op7_ngram_jaccard_join, op8_language_backoff, op9_secret_trigrams, op10_block_topk, op11_covering_simhash,
        op12_bit_sliced_whitening, op13_centroid_expressions, pipeline,
    )
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    return {"op10_block_topk": _OP10, "op13_centroid_expressions": _op13()}
