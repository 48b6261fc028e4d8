"""The policy between a model's raw answer and what is shown, a deterministic stand-in for the model, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import EXPLANATORY, content_words, coverage, json_object

# Texts the policy shows.
ABSTAINED = "I could not find an answer to that in the archived documents."
LABEL = "General information, not from the archive: "
GROUNDED_FROM = 0.5


def policy(answers: DataFrame) -> DataFrame:
    """``answers`` (id, raw, urls) as (id, mode, answer, citations).

    Raw text that holds no JSON object, an unknown mode or a blank answer abstains. A grounded answer keeps, in its
    order and once each, the citations among ``urls``, and abstains if none is left; a fallback is labelled and
    cites nothing.
    """
    found = json_object(F.col("raw"))
    mode = F.lower(F.btrim(F.get_json_object(found, "$.mode")))
    answer = F.btrim(F.get_json_object(found, "$.answer"))
    cited = F.from_json(F.get_json_object(found, "$.citations"), "array<string>")
    kept = F.array_distinct(F.filter(F.coalesce(cited, F.array().cast("array<string>")), lambda u: F.array_contains("urls", u)))
    read = answers.select("id", mode.alias("m"), answer.alias("a"), kept.alias("kept"))
    usable = F.coalesce((F.col("a") != "") & F.col("m").isin("grounded", "fallback", "abstained"), F.lit(False))
    grounded = usable & (F.col("m") == "grounded") & (F.size("kept") > 0)
    fallback = usable & (F.col("m") == "fallback")
    labelled = F.when(F.lower("a").startswith(LABEL.lower()), F.col("a")).otherwise(F.concat(F.lit(LABEL), F.col("a")))
    own = usable & (F.col("m") == "abstained")
    return read.select(
        "id",
        F.when(grounded, "grounded").when(fallback, "fallback").otherwise("abstained").alias("mode"),
        F.when(grounded | own, F.col("a")).when(fallback, labelled).otherwise(ABSTAINED).alias("answer"),
        F.when(grounded, F.col("kept")).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


def lexical_answer(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """A stand-in for the model: rows (query_id, mode, citations) from the words that questions and passages share.

    ``questions`` has (query_id, text), ``passages`` (query_id, rank, url, text). All passages that hold enough of a
    question's content words are cited; else a question for an explanation falls back, any other abstains.
    """
    asked = questions.select("query_id", "text", content_words(F.col("text")).alias("q"))
    held = passages.select("query_id", "rank", "url", content_words(F.col("text")).alias("p")).join(asked.select("query_id", "q"), "query_id")
    good = held.where(coverage(F.col("q"), F.col("p")) >= GROUNDED_FROM)
    cited = good.groupBy("query_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])).alias("citations"))
    mode = F.when(F.col("citations").isNotNull(), "grounded").when(F.col("text").rlike(EXPLANATORY), "fallback").otherwise("abstained")
    return asked.join(cited, "query_id", "left").select("query_id", mode.alias("mode"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))


def user_message(question: Column, context: Column, urls: Column) -> Column:
    """What a model is asked: the question, the context and the URLs it may cite."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), context, F.lit("\n\nAllowed URLs:\n"), F.array_join(urls, "\n"))


def cited_numbers(answer: Column) -> Column:
    """The distinct numbers in square brackets in an answer, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """Scores of ``outcomes`` (expected_mode, mode, expected_source, retrieved, citations), in all or by columns.

    The hit rate is over questions that name a source, NaN if none does; citations are valid if all were retrieved.
    """
    eligible = F.col("expected_source").isNotNull()
    hit = F.array_contains("retrieved", F.col("expected_source"))
    valid = F.forall("citations", lambda c: F.array_contains("retrieved", c))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.when(F.count_if(eligible) > 0, F.count_if(eligible & hit) / F.count_if(eligible)).otherwise(F.lit(float("nan"))).alias("hit_rate"),
        (F.count_if(F.col("mode") == F.col("expected_mode")) / F.count("*")).alias("mode_correct"),
        (F.count_if(valid) / F.count("*")).alias("citations_valid"),
    )
