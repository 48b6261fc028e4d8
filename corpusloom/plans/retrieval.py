"""Retrieval, answers and scores, as queries with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import text, vectors
from corpusloom.operators import answer, retrieve
from corpusloom.session import materialize, maybe_broadcast, spread, table

# Questions to the municipal documents: (id, text, expected mode).
QUESTIONS = [
    (1, "How do I pay the water bills on Tanner Street?", "grounded"),
    (2, "When will the hydrant flushing be on Kiln Street?", "grounded"),
    (3, "Which complaints about leaf pickup were closed?", "grounded"),
    (4, "Generally, how does a combustion engine work?", "fallback"),
    (5, "Who won the chess tournament of the moon?", "abstained"),
    (6, "What is the cost of burn permits and septic checks?", "grounded"),
    (7, "Why do glaciers calve icebergs?", "fallback"),
    (8, "", "abstained"),
]
ANSWERS = [
    (1, '{"mode": "grounded", "answer": "Pay at the desk. [1]", "citations": ["u1", "u9", "u1"]}', ["u1", "u2"]),
    (2, 'Sure: {"mode": "Grounded", "answer": "Yes", "citations": ["u9"]} .', ["u1"]),
    (3, '{"mode": "fallback", "answer": "In most towns, yes.", "citations": ["u1"]}', ["u1"]),
    (4, '{"mode": "fallback", "answer": "General information, not from the archive: yes", "citations": []}', []),
    (5, '{"mode": "abstained", "answer": "I do not know."}', ["u1"]),
    (6, "not json", ["u1"]),
    (7, '{"mode": "oracle", "answer": "x"}', ["u1"]),
    (8, '{"mode": "grounded", "answer": "  ", "citations": ["u1"]}', ["u1"]),
    (9, None, ["u1"]),
]


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


def _questions(spark):
    return spark.createDataFrame([q[:2] for q in QUESTIONS], "query_id int, text string")


def _searched(spark, folder, k):
    """Every twentieth vector as a query against all vectors."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e, retrieve.vector_top_k(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), k)


def vector_top_k(spark, folder):
    return _searched(spark, folder, DEFAULT.top_k)[1]


def vector_top_k_capped(spark, folder):
    e, hits = _searched(spark, folder, DEFAULT.top_k * DEFAULT.over_fetch)
    return retrieve.capped(hits.join(e.select("id", "label"), "id"), "label")


def vector_live_only(spark, folder):
    """Live vectors (a label stands for a resource, label 3 for one that is gone): filtered after candidates are taken."""
    e, hits = _searched(spark, folder, DEFAULT.top_k * DEFAULT.over_fetch)
    return retrieve.capped(hits.join(e.where("label <> 3").select("id", "label"), "id"), "label", 1, 4)


def vector_norms(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("cosine"))


def hash_embed(spark, folder):
    return table(spark, folder, "documents").select("doc_id", vectors.hash_embed()(F.col("text")).alias("embedding"))


def _bm25(spark, folder, k):
    return retrieve.bm25(_documents(spark, folder), _questions(spark), k)


def bm25_top_k(spark, folder):
    return _bm25(spark, folder, 50)


def _covered(spark, folder):
    asked = materialize(_questions(spark).select("query_id", F.explode(text.content_words(F.col("text"))).alias("word")))
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    held = _documents(spark, folder).select("id", F.explode(text.content_words(F.col("text"))).alias("word")).join(maybe_broadcast(asked), "word")
    return held.groupBy("query_id", "id").agg(F.count("*").alias("hit")).join(maybe_broadcast(n), "query_id").select("query_id", "id", F.round(F.col("hit") / F.col("n"), 6).alias("score"))


def _covering(spark, folder, k):
    score = _covered(spark, folder)
    rank = F.row_number().over(retrieve.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return score.withColumn("rank", rank).where(F.col("rank") <= k)


def coverage_top_k(spark, folder):
    return _covering(spark, folder, 50)


def rrf_fusion(spark, folder):
    return retrieve.fuse([_bm25(spark, folder, 50), _covering(spark, folder, 50)], DEFAULT.top_k)


def _passages(spark, folder, k=4):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("source", F.lit("unknown")).alias("url"), F.col("doc_type").alias("title"))
    return retrieve.numbered_sources(_bm25(spark, folder, k).join(d, "id"))


def sources_numbered(spark, folder):
    return _passages(spark, folder).select("query_id", "id", "rank", "url", "source")


def context_assembled(spark, folder):
    return retrieve.contexts(_passages(spark, folder)).select("query_id", F.sha2("context", 256).alias("sha256"))


def coverage_answer(spark, folder):
    return answer.lexical_answer(_questions(spark), _passages(spark, folder)).withColumn("citations", F.array_join("citations", " "))


def answer_policy(spark, folder):
    given = spark.createDataFrame(ANSWERS, "id int, raw string, urls array<string>")
    return answer.policy(given).withColumn("citations", F.array_join("citations", " "))


def _outcomes(spark, folder):
    """Outcomes against the source of the first document that has all words of a question, which retrieval may miss."""
    expected = spark.createDataFrame([(q[0], q[2]) for q in QUESTIONS], "query_id int, expected_mode string")
    got = answer.lexical_answer(_questions(spark), _passages(spark, folder))
    found = _passages(spark, folder).groupBy("query_id").agg(F.collect_set("url").alias("retrieved"))
    named = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("unknown")).alias("url"))
    whole = _covered(spark, folder).where("score = 1.0").groupBy("query_id").agg(F.min("id").alias("id"))
    first = whole.join(named, "id").select("query_id", F.col("url").alias("expected_source"))
    return expected.join(got, "query_id").join(found, "query_id", "left").join(first, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def eval_metrics(spark, folder):
    return answer.metrics(_outcomes(spark, folder))


def eval_by_mode(spark, folder):
    return answer.metrics(_outcomes(spark, folder), "expected_mode")


def queries():
    named = [
        vector_top_k, vector_top_k_capped, vector_live_only, vector_norms, hash_embed, bm25_top_k, coverage_top_k, rrf_fusion, sources_numbered, context_assembled, coverage_answer, answer_policy,
        eval_metrics, eval_by_mode,
    ]
    return {f.__name__: f for f in named}


def oracle_sql():
    score = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6)"
    hits = f"h as (select q.vec_id as query_id, v.vec_id as id, v.label, {score} as score, row_number() over (partition by q.vec_id order by {score} desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 20 = 0)"
    capped = "c as (select *, row_number() over (partition by query_id, label order by rank) as per from h where rank <= 40{where}), k as (select query_id, id, label, score, row_number() over (partition by query_id order by rank) as rank from c where per <= {cap}) select * from k where rank <= {k}"
    values = ", ".join(f"({n}, '{t}', '{m}')" for n, t, m in QUESTIONS)
    asked = f"a as (select * from (values {values}) v(query_id, question, expected_mode))"
    stop = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS | text.QUESTION_WORDS))
    tokens = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+', 0)"
    words = "list_distinct(list_transform(list_filter(" + tokens + f", lambda t: length(t) > 2 and t not in ({stop})), lambda t: case when length(t) > 3 and ends_with(t, 's') then t[:-2] else t end))"
    bm25 = f"""{asked}, t as (select distinct query_id, unnest({tokens.format("question")}) as term from a), d as (select doc_id as id, {tokens.format("text")} as w from documents where text is not null),
        m as (select count(*) as n, avg(len(w)) as mean from d), u as (select id, len(w) as length, unnest(w) as term from d), f as (select id, length, term, count(*) as tf from u where term in (select term from t) group by all),
        g as (select term, count(*) as df from f group by 1), s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from f join g using (term) join t using (term), m group by 1, 2),
        bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"""
    cover = f"""cw as (select query_id, unnest({words.format("question")}) as word, len({words.format("question")}) as n from a), dw as (select doc_id as id, unnest({words.format("text")}) as word from documents),
        cs as (select query_id, id, round(count(*) / any_value(n), 6) as score from cw join dw using (word) group by 1, 2), cv as (select *, row_number() over (partition by query_id order by score desc, id) as rank from cs)"""
    passages = """p0 as (select query_id, id, rank, coalesce(source, 'unknown') as url, doc_type as title, text from bm join documents on doc_id = id where rank <= 4),
        p1 as (select *, min(rank) over (partition by query_id, url) as first from p0), p as (select *, dense_rank() over (partition by query_id order by first) as source from p1)"""
    judged = f"""q as (select query_id, question, expected_mode, {words.format("question")} as w from a), e as (select p.query_id, p.rank, p.url, case when len(q.w) > 0 then len(list_intersect(q.w, {words.format("p.text")})) / len(q.w) else 0 end as c from p join q using (query_id)),
        x0 as (select query_id, url, min(rank) as r from e where c >= 0.5 group by 1, 2), x as (select query_id, list(url order by r) as citations from x0 group by 1),
        o as (select q.query_id, expected_mode, case when citations is not null then 'grounded' when regexp_matches(question, '(?i)\\b(in general|generally|how does|how do .*\\bwork|why do|why does|what does .* mean|explain)\\b') then 'fallback' else 'abstained' end as mode, citations from q left join x using (query_id))"""
    scores = "count(*) as questions, case when count(f) > 0 then count(*) filter (where list_contains(coalesce(got, []), f)) / count(f) else 'nan'::double end as hit_rate, count(*) filter (where mode = expected_mode) / count(*) as mode_correct, count(*) filter (where list_has_all(coalesce(got, []::varchar[]), coalesce(citations, []::varchar[]))) / count(*) as citations_valid from o left join e1 using (query_id) left join (select query_id, list(distinct url) as got from p group by 1) using (query_id)"
    expected = f"{cover}, e0 as (select query_id, min(id) as id from cs where score = 1.0 group by 1), e1 as (select query_id, coalesce(source, 'unknown') as f from e0 join documents on doc_id = id)"
    expected = expected.replace(f"{asked}, ", "")
    return {
        "vector_top_k": f"with {hits} select query_id, id, score, rank from h where rank <= 8",
        "vector_top_k_capped": f"with {hits}, " + capped.format(where="", cap=3, k=8),
        "vector_live_only": f"with {hits}, " + capped.format(where=" and label <> 3", cap=1, k=4),
        "vector_norms": "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 5) as cosine from embeddings",
        "bm25_top_k": f"with {bm25} select * from bm where rank <= 50",
        "coverage_top_k": f"with {asked}, {cover} select * from cv where rank <= 50",
        "rrf_fusion": f"with {bm25}, {cover}, b as (select query_id, id, rank from bm where rank <= 50 union all select query_id, id, rank from cv where rank <= 50), z as (select query_id, id, round(sum(1.0 / (59 + rank)::double), 9) as score from b group by 1, 2) select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from z) where rank <= 8",
        "sources_numbered": f"with {bm25}, {passages} select query_id, id, rank, url, source from p",
        "context_assembled": f"with {bm25}, {passages}, n as (select query_id, string_agg(l, chr(10) order by source, l) as s from (select distinct query_id, source, '[' || source || '] ' || coalesce(title, url) as l from p) group by 1) select query_id, sha256(string_agg('[' || source || '] ' || text, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || 'Sources:' || chr(10) || any_value(s)) as sha256 from p join n using (query_id) group by 1",
        "coverage_answer": f"with {bm25}, {passages}, {judged} select query_id, mode, coalesce(array_to_string(citations, ' '), '') as citations from o",
        "eval_metrics": f"with {bm25}, {passages}, {judged}, {expected} select {scores}",
        "eval_by_mode": f"with {bm25}, {passages}, {judged}, {expected} select expected_mode, {scores} group by 1",
        "answer_policy": f"""select * from (values (1, 'grounded', 'Pay at the desk. [1]', 'u1'), (2, 'abstained', '{answer.ABSTAINED}', ''), (3, 'fallback', '{answer.LABEL}In most towns, yes.', ''),
            (4, 'fallback', '{answer.LABEL}yes', ''), (5, 'abstained', 'I do not know.', ''), (6, 'abstained', '{answer.ABSTAINED}', ''), (7, 'abstained', '{answer.ABSTAINED}', ''), (8, 'abstained', '{answer.ABSTAINED}', ''), (9, 'abstained', '{answer.ABSTAINED}', '')) v(id, mode, answer, citations)""",
    }
