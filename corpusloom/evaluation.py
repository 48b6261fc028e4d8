"""A fixture corpus with questions of known outcome, and the report of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answer, retrieve

#: (url, title, text, state) of the fixture's documents, one chunk each; the last one is gone.
CORPUS = [
    ("https://town.example/water", "Water bills", "Water bills are due on the first Monday of the month and can be paid at the clerk's desk.", "active"),
    ("https://town.example/leaf", "Leaf pickup", "Leaf pickup begins in October. Rake leaves to the curb before seven in the morning.", "active"),
    ("https://town.example/pool", "Pool hours", "The pool opens at noon from June to August and closes when there is lightning.", "active"),
    ("https://town.example/permit", "Burn permits", "A burn permit costs ten dollars and is valid for one season of brush burning.", "active"),
    ("https://town.example/library", "Library", "The library lends telescopes and snowshoes to residents with a card.", "active"),
    ("https://town.example/tolls", "Bridge tolls", "Bridge tolls were four dollars until the tolls ended.", "gone"),
]
#: (id, question, expected mode, expected source).
QUESTIONS = [
    (1, "When are water bills due?", "grounded", "https://town.example/water"), (2, "Where does leaf pickup begin, at the curb?", "grounded", "https://town.example/leaf"), (3, "What does a burn permit cost for a season?", "grounded", "https://town.example/permit"),
    (4, "Does the library lend telescopes?", "grounded", "https://town.example/library"), (5, "When does the pool open in June?", "grounded", "https://town.example/pool"), (6, "What are the bridge tolls?", "abstained", None), (7, "Who won the chess tournament?", "abstained", None),
    (8, "Which planet is largest?", "abstained", None), (9, "Generally, how does a heat pump work?", "fallback", None), (10, "Why do glaciers calve icebergs?", "fallback", None),
]


def seed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(documents (id, url, title, text, state), questions (query_id, text, expected_mode, expected_source))."""
    documents = spark.createDataFrame([(n, *row) for n, row in enumerate(CORPUS)], "id int, url string, title string, text string, state string")
    return documents, spark.createDataFrame(QUESTIONS, "query_id int, text string, expected_mode string, expected_source string")


def evaluate(documents: DataFrame, questions: DataFrame, k: int = 4) -> DataFrame:
    """Rows (query_id, text, expected_mode, expected_source, mode, retrieved, citations): each question retrieved and answered once."""
    live = documents.where(~F.col("state").isin("gone", "error"))
    passages = retrieve.numbered_sources(retrieve.bm25(live.select("id", "text"), questions.select("query_id", "text"), k).join(live.select("id", "url", "title", "text"), "id"))
    got = answer.lexical_answer(questions.select("query_id", "text"), passages)
    found = passages.groupBy("query_id").agg(F.collect_set("url").alias("retrieved"))
    rows = questions.join(got, "query_id").join(found, "query_id", "left")
    return rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def report(outcomes: DataFrame, title: str = "Evaluation", markdown: bool = False) -> str:
    """The outcomes (one row a question, a few dozen) and their scores as text or Markdown."""
    rows = sorted(outcomes.collect(), key=lambda r: r["query_id"])
    whole = answer.metrics(outcomes).first()
    by = {r["expected_mode"]: r for r in answer.metrics(outcomes, "expected_mode").collect()}
    percent = {name: "n/a" if whole[name] != whole[name] else f"{100 * whole[name]:.0f} %" for name in ("hit_rate", "mode_correct", "citations_valid")}
    marked = []
    for r in rows:
        hit = None if r["expected_source"] is None else r["expected_source"] in r["retrieved"]
        valid = set(r["citations"]) <= set(r["retrieved"])
        good = r["mode"] == r["expected_mode"] and valid and hit is not False
        marked.append((good, r, {None: "-", True: "hit", False: "MISS"}[hit], str(len(r["citations"])) if valid else "INVALID"))
    if markdown:
        table = [f"| {'yes' if good else 'no'} | {r['text'].replace('|', chr(92) + '|')} | {r['expected_mode']} | {r['mode']} | {hit} | {cited} |" for good, r, hit, cited in marked]
        return "\n".join([f"## {title}", "", f"- Retrieval: {percent['hit_rate']}", f"- Mode: {percent['mode_correct']}", f"- Citations: {percent['citations_valid']}", "", "| ok | question | expected | mode | retrieval | citations |", "| - | - | - | - | - | - |", *table])
    lines = [f"{'+' if good else '-'} {r['text']}\n    mode {r['mode']} (expected {r['expected_mode']}), retrieval {hit}, citations {cited}" for good, r, hit, cited in marked]
    scores = [f"retrieval {percent['hit_rate']}, mode {percent['mode_correct']}, citations {percent['citations_valid']}"] + [f"    {mode}: {by[mode]['mode_correct']:.2f} of {by[mode]['questions']}" for mode in sorted(by)]
    return "\n".join([f"{title}: {len(rows)} questions", *lines, *scores])
