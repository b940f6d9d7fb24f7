"""Text and vector jobs (TXT) and the user-function surface (UDF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.functions.scans import decayed_mean
from swapledger.operators import text as X
from swapledger.operators import vectors as V
from swapledger.plans.q_aggregates import _DELTA
from swapledger.plans.q_windows import _JUMP, _WDEN, _WSUM, jumps
from swapledger.plans.registry import query
from swapledger.session import scratch_dir

# Pages as markdown: h1 becomes '#', b becomes '##', other tags go.  Same steps in both engines.
_MD = r"""md as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<nav>.*?</nav>', '', 'g'), '<h1>', chr(10) || '# ', 'g'), '<p><b>', chr(10) || '## Part' || chr(10), 'g'),
   '</h1>|</p>|<br>', chr(10), 'g') as t0 from pages), mdt as (select page_id, regexp_replace(t0, '<[^>]+>', '', 'g') as text from md)"""


def page_markdown(t):
    nl = "\n"
    c = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<nav>.*?</nav>", "")
    c = F.regexp_replace(c, "<h1>", nl + "# ")
    c = F.regexp_replace(c, "<p><b>", nl + "## Part" + nl)
    c = F.regexp_replace(F.regexp_replace(c, "</h1>|</p>|<br>", nl), "<[^>]+>", "")
    return t.base("pages").select("page_id", c.alias("text"))


_SECT = _MD + r""", ln as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from mdt),
  hd as (select *, length(regexp_extract(line, '^(#{1,4})\s+(.*)$', 1)) as depth, trim(regexp_extract(line, '^(#{1,4})\s+(.*)$', 2)) as title from ln),
  sg as (select *, sum(case when depth > 0 then 1 else 0 end) over (partition by page_id order by i) as sec,
    last_value(case when depth = 1 then title end ignore nulls) over (partition by page_id order by i) as h1, last_value(case when depth = 2 then title when depth = 1 then '' end ignore nulls) over (partition by page_id order by i) as h2 from hd),
  sec as (select page_id, sec, max(case when sec = 0 then '(preamble)' else concat_ws(' > ', h1, nullif(h2, '')) end) as heading,
    regexp_replace(string_agg(case when depth = 0 then line end, chr(10) order by i), '^\s+|\s+$', '', 'g') as body from sg group by 1, 2),
  sec2 as (select page_id, heading, body, row_number() over (partition by page_id order by sec) - 1 as section_no from sec where body is not null and body <> '')"""


@query("TXT-01", "sections", f"with {_SECT} select page_id, section_no, heading, body from sec2")
def sections(t):
    s = page_markdown(t).select("page_id", F.posexplode(X.sections(F.col("text"))).alias("section_no", "s"))
    return s.select("page_id", F.col("section_no").cast("long").alias("section_no"), "s.heading", "s.body")


def _windows_sql(source: str, cols: str, body: str) -> str:
    return f"""wd as (select {cols}, {body} as body, list_filter(string_split_regex({body}, '\\s+'), lambda w: w <> '') as ws from {source}),
  wn as (select {cols}, body, ws, unnest(case when len(ws) <= 160 then [0] else range(0, len(ws), 128) end) as st from wd),
  win as (select {cols}, cast(st // 128 as bigint) as window_no, case when len(ws) <= 160 then body else array_to_string(ws[st + 1 : st + 160], ' ') end as text from wn)"""


@query("TXT-02", "word_windows", f"with {_windows_sql('documents', 'doc_id', 'text')} select doc_id, window_no, text from win")
def word_windows(t):
    return t.base("documents").select("doc_id", F.posexplode(X.word_windows(F.col("text"))).alias("window_no", "text")).withColumn(
        "window_no", F.col("window_no").cast("long"))


@query("TXT-03", "corpus_chunks", f"with {_SECT}, {_windows_sql('sec2', 'page_id, heading, section_no', 'body')} select page_id as source, section_no, heading, window_no, text from win")
def corpus_chunks(t):
    c = X.load_corpus(page_markdown(t), "page_id", "text")
    return c.withColumn("section_no", F.col("section_no").cast("long")).withColumn("window_no", F.col("window_no").cast("long"))


_EMB = """em as (select doc_id, b, count(*) as n from (select doc_id, cast(('0x' || substr(md5(w), 1, 8)) as ubigint) % 64 as b from (select doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as w from documents)) group by 1, 2)"""


@query("TXT-04", "embedded_texts", f"""
with {_EMB}, nr as (select doc_id, sqrt(sum(n * n)) as s, count(*) as nnz, max(n) as m from em group by 1)
select doc_id, nnz as n_used, round(m / s, 4) as top_weight from nr""")
def embedded_texts(t):
    e = t.base("documents").select("doc_id", V.HashedTerms(64).column(F.col("text")).alias("v"))
    return e.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_used"), F.round(F.array_max("v").cast("double"), 4).alias("top_weight")).where("n_used > 0")


@query("TXT-05", "cosine_top_k", """
with q as (select embedding as qv from embeddings order by vec_id limit 1)
select vec_id, label, round(list_cosine_similarity(cast(embedding as double[]), cast(qv as double[])), 5) as score from embeddings, q order by list_cosine_similarity(cast(embedding as double[]), cast(qv as double[])) desc, vec_id limit 10""")
def cosine_top_k(t):
    e = t.base("embeddings")
    first = e.agg(F.min_by("embedding", "vec_id")).scalar()
    return V.cosine_top_k(e, first, 10).select("vec_id", "label", F.round("score", 5).alias("score"))


@query("TXT-05", "cosine_top_k_per_label", """
with q as (select label as query_id, arg_min(embedding, vec_id) as qv from embeddings group by 1),
  s as (select q.query_id, e.vec_id, list_cosine_similarity(cast(e.embedding as double[]), cast(qv as double[])) as sc from embeddings e, q)
select query_id, vec_id, round(sc, 5) as score, rank from (select *, row_number() over (partition by query_id order by sc desc, vec_id) as rank from s) where rank <= 5""")
def cosine_top_k_per_label(t):
    """One query vector per label, against the whole table."""
    e = t.base("embeddings")
    per = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    return V.cosine_top_k_joined(e, per.select(F.col("label").alias("query_id"), "vec"), 5).select(
        "query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("TXT-06", "vector_table", "select label, count(*) as n, 64 as dim, 'fixture-64' as model from embeddings group by 1")
def vector_table(t):
    """Vectors written with model and dimension pinned, reopened through the check."""
    _, table = V.vector_store(t.base("embeddings"), "fixture-64", 64)
    return table.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).withColumn("model", F.lit("fixture-64"))


@query("TXT-06", "approximate_top_k", "select 5 as k, count(*) filter (where vec_id % 10 = 0) as n_queries, count(*) as n_indexed, true as recall_ok, 5 * count(*) filter (where vec_id % 10 = 0) as n_found from embeddings")
def approximate_top_k(t):
    """Recall of the hashing index against exact retrieval, over every tenth vector as a query."""
    e = t.base("embeddings")
    index, path = V.HashIndex(64), scratch_dir(t.spark, "hash-index")
    index.build(e, path, k=5)
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    got = index.search(path, queries, 5).select("query_id", "vec_id")
    exact = V.cosine_top_k_joined(e, queries, 5).select("query_id", "vec_id")
    met = got.join(exact, ["query_id", "vec_id"]).agg(F.count("*")).scalar()
    return got.agg(F.count("*").alias("n_found"), F.count_distinct("query_id").alias("n_queries")).select(
        F.lit(5).alias("k"), "n_queries", e.agg(F.count("*")).scalar().alias("n_indexed"), (met >= F.col("n_found") * 0.9).alias("recall_ok"), "n_found")


@query("TXT-07", "context_block", """
with s as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by length(text) desc, turn) as r from conversations)
select conv_id, count(*) as n_hits, string_agg('[' || r || '] (' || role || ' > turn ' || turn || ')' || chr(10) || text, chr(10) || chr(10) order by r) as block from s where r <= 3 group by 1""")
def context_block(t):
    from swapledger.operators.matching import first_matches

    c = t.base("conversations").withColumn("source", F.col("role")).withColumn("heading", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    top = first_matches(c, ["conv_id"], [F.desc(F.length("text")), F.col("turn")], 3)
    return X.context_block(top, ["conv_id"], "rank")


# -- user-function surface -----------------------------------------------------------


@query("UDF-01", "row_functions", f"""
with {_DELTA} select event_id, leg_index, case when pre >= 2 then 'high' when pre >= 0 then 'mid' else 'low' end as tier, case when pre > 0 and delta > 0 then 'up-good' when pre > 0 then 'down-good' when delta > 0 then 'up-bad' else 'down-bad' end as quadrant from d""")
def row_functions(t):
    """Row callables of the original as column expressions."""
    from swapledger.operators.offsets import offset_window
    from swapledger.operators.outlines import tier

    w = offset_window(t.numbered_trade, t.psv, [-1, 1], ["value"]).dropna(subset=["value_t_minus_1", "value_t_plus_1"])
    pre, up = F.col("value_t_minus_1"), F.col("value_t_plus_1") > F.col("value_t_minus_1")
    return w.select("event_id", "leg_index", tier(pre, 2.0, 0.0).alias("tier"),
                    F.concat(F.when(up, "up").otherwise("down"), F.lit("-"), F.when(pre > 0, "good").otherwise("bad")).alias("quadrant"))


@query("UDF-02", "group_transform", f"""
with {_JUMP} select team_id, season, round(({_WSUM.replace('x,', 'jump,')}) / nullif({_WDEN.replace('x,', 'jump,')}, 0), 6) as decayed from jump window w as (partition by team_id order by season)""")
def group_transform(t):
    return decayed_mean(jumps(t), ["team_id"], "season", "jump", "d").select("team_id", "season", F.round("d", 6).alias("decayed"))


@query("UDF-03", "custom_aggregators", "select grp, season, count(ops) as n_known, round(var_samp(ops), 6) as variance from v_level group by 1, 2")
def custom_aggregators(t):
    return t.level.groupBy("grp", "season").agg(F.count("ops").alias("n_known"), F.round(F.var_samp("ops"), 6).alias("variance"))


@query("UDF-04", "best_score_per_team_season", """
select team_id, season, max(case role when '1-URGENT' then 1.0 when '2-HIGH' then 0.5 else 0.0 end * (length(person) % 7))::double as best from v_office group by 1, 2""")
def best_score_per_team_season(t):
    score = F.when(F.col("role") == "1-URGENT", 1.0).when(F.col("role") == "2-HIGH", 0.5).otherwise(0.0) * (F.length("person") % 7)
    return t.office.groupBy("team_id", "season").agg(F.max(score).alias("best"))


@query("UDF-05", "table_generators", f"with {_SECT} select page_id, count(*) as n_sections, cast(sum(length(body)) as bigint) as n_chars from sec2 group by 1")
def table_generators(t):
    """Generators of the original as exploded arrays."""
    s = page_markdown(t).select("page_id", F.explode(X.sections(F.col("text"))).alias("s"))
    return s.groupBy("page_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("s.body")).alias("n_chars"))


@query("UDF-05", "table_function", f"with {_SECT} select page_id, section_no, heading, body from sec2")
def table_function(t):
    """The section generator as a table function in a lateral join."""
    t.spark.conf.set("spark.sql.execution.pythonUDTF.arrow.enabled", "true")
    s = page_markdown(t).lateralJoin(X.SectionTable(F.col("text").outer()))
    return s.select("page_id", F.col("section_no").cast("long").alias("section_no"), "heading", "body")


@query("UDF-06", "encoder_protocol", "select count(*) as n, 32 as dim, true as unit_length from conversations where length(trim(text)) > 0")
def encoder_protocol(t):
    """An external encoder behind the protocol, called a batch at a time."""
    e = t.base("conversations").where(F.length(F.trim("text")) > 0).select(V.embed_udf(V.LetterProfile(32))("text").alias("v"))
    return e.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), (F.max(F.abs(V.norm(F.col("v")) - 1)) < 1e-5).alias("unit_length"))
