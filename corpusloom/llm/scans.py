"""Repairing the text of scanned documents (problem 7).

Running lines and page numbers: lines at page breaks. A line of a page number's form is one; a line in capitals or
title case is a running line if its shape stands beside page numbers chiefly, over the corpus, so also where its own
page has no number. Cut words: the joined word against the hyphenated one by their counts in the corpus. Misread
characters: every word has an anagram hash, the sum of the fifth powers of its characters, and each confusion (such
as rn for m) a fixed difference of hashes; rare words meet frequent ones in an equi-join on hash less difference, the
spelling is then checked, and of several corrections the most frequent one is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations_with_replacement

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, maybe_broadcast

#: Share of a shape's lines beside page numbers from which it is a running line's, and the fewest lines to judge by.
BESIDE, FEWEST = 0.3, 3
#: How many times as frequent as a rare word its correction must be; for words with signs no word has, less.
RATIO, SIGN_RATIO, LEAST_COUNT = 8.0, 1.5, 3
#: Most confusions of a word, and how many letters it needs for each beyond the first.
MOST, LETTERS = 3, 2

# True characters and what scanners read for them.
CONFUSIONS = [
    ("e", "c"), ("t", "f"), ("o", "0"), ("i", "|"), ("l", "|"), ("n", "ri"), ("s", "5"), ("l", "1"), ("i", "1"), ("u", "ii"), ("d", "cl"),
    ("m", "rn"), ("m", "nn"), ("n", "r|"), ("u", "|i"), ("u", "i|"), ("ti", "ﬁ"), ("g", "9"), ("h", "b"), ("h", "li"), ("b", "6"), ("b", "8"), ("w", "vv"), ("z", "2"), ("rn", "m"), ("cl", "d"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"),
]

_PRIME = (1 << 61) - 1
_TOKEN = re.compile(r"[|]?[^\W_]+(?:[|'’][^\W_]+)*[|]?")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_ODD = re.compile(r"[|0-9ﬀ-ﬄ]")
_CUT = re.compile(r"([^\W_](?:[^\W_]|[|])*)[-­‐]\s*$")
_START = re.compile(r"\s*((?:[^\W_]|[|])+)")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
_PAGE_NUMBER = re.compile(rf"[\s\[({{<*~_–—-]{{0,3}}(?:(?:page|pg|p)\b\.?\s*)?(?:[0-9]{{1,4}}|{_ROMAN})(?:\s*(?:of|/)\s*[0-9]{{1,4}})?[\s\])}}–—_-]*", re.I)


def is_page_number(line: str) -> bool:
    """Whether a line has nothing but the number of a page: digits or Roman, bare or adorned; not a sentence's end."""
    return bool(line.strip()) and bool(_PAGE_NUMBER.fullmatch(line.strip()))


def edge_shape(line: str) -> str | None:
    """The shape of a line that could run along a page's edge, None for prose, amounts and blank lines.

    Words in capitals, in title case and in lower case are U, T and l, numbers 0; runs and misread digits are folded.
    """
    line = line.strip()
    if not line or line[-1] in ".:;?!,-" or "$" in line or "..." in line:
        return None
    words = _TOKEN.findall(line)
    lettered = [w for w in words if not w.isdigit()]
    if not lettered or sum(w[0].isupper() or w[0] in "|015" for w in lettered) < 0.5 * len(lettered):
        return None
    folded = _TOKEN.sub(lambda m: "0" if m[0].isdigit() else "U" if len(m[0]) > 1 and not any(c.islower() for c in m[0]) else "T" if m[0][0].isupper() or m[0][0] in "|015" else "l", line)
    return re.sub(r"([UTl])(?: \1)+", r"\1", re.sub(r"\s+", " ", folded))


def _edges(documents: DataFrame) -> DataFrame:
    """Rows (resource_id, line_no, shape, beside): lines that could run along an edge; the first line is the title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["resource_id"], batch["text"], strict=True):
                lines = text.split("\n")
                numbers = [is_page_number(x) for x in lines]
                first = next((n for n, x in enumerate(lines) if x.strip()), 0)
                for n, line in enumerate(lines):
                    shape = None if numbers[n] or n <= first else edge_shape(line)
                    if shape:
                        rows.append((key, n, shape, numbers[n - 1] or (n + 1 < len(lines) and numbers[n + 1])))
            yield pd.DataFrame(rows, columns=["resource_id", "line_no", "shape", "beside"])

    return documents.select("resource_id", "text").mapInPandas(run, "resource_id string, line_no int, shape string, beside boolean")


def running_lines(documents: DataFrame) -> DataFrame:
    """Rows (resource_id, line_no): the running lines of ``documents`` (resource_id, text)."""
    edges = materialize(_edges(documents))
    shapes = edges.groupBy("shape").agg(F.count("*").alias("n"), F.count_if("beside").alias("m")).where((F.col("n") >= FEWEST) & (F.col("m") >= BESIDE * F.col("n")))
    known = edges.join(maybe_broadcast(materialize(shapes.select("shape"))), "shape", "left_semi").select("resource_id", "line_no")
    counts = edges.groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") < FEWEST)
    rare = edges.where("beside").join(counts.select("shape"), "shape", "left_semi").select("resource_id", "line_no")
    return known.unionByName(rare)


_TAKEN = "resource_id string, header array<int>, page_number array<int>, word array<string>, word_at array<int>, compound array<string>, cut array<string>, kept array<string>, cut_at array<int>, left array<int>, next_line array<int>"


def _tokens(documents: DataFrame, running: DataFrame) -> DataFrame:
    """Rows of _TAKEN, one a document, written to the shared folder: what its lines hold, in arrays.

    ``header`` and ``page_number`` are numbers of lines. A word of a body line is in ``word`` once a line, its line in
    ``word_at``; ``compound`` has the hyphenated words within lines. A word cut at the end of line ``cut_at`` is in
    ``cut`` joined and in ``kept`` with its hyphen; ``left`` counts its characters before the cut, and it goes on in
    ``next_line``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                edges = set(edge or ())
                numbers, body = [], []
                for n, line in enumerate(lines):
                    if n in edges:
                        continue
                    if n and is_page_number(line):
                        numbers.append(n)
                    elif line.strip():
                        body.append(n)
                words: list[str] = []
                word_at: list[int] = []
                compounds: list[str] = []
                cuts: list[tuple] = []
                started = 0
                for n, after in zip(body, [*body[1:], -1][: len(body)], strict=True):
                    line = lines[n][started:]
                    started = 0
                    cut = _CUT.search(line)
                    start = _START.match(lines[after]) if cut and after >= 0 else None
                    if start and not start[1][0].isupper() and not start[1].isdigit() and not cut[1].isdigit():
                        left, right = cut[1].lower(), start[1].lower()
                        cuts.append((left + right, f"{left}-{right}", n, len(left), after))
                        line, started = line[: cut.start()], start.end()
                    low = line.lower()
                    mine = {w for w in _TOKEN.findall(low) if not w.isdigit()}
                    words += mine
                    word_at += [n] * len(mine)
                    if "-" in low:
                        compounds += _COMPOUND.findall(low)
                rows.append((key, sorted(edges), numbers, words, word_at, compounds, *([c[k] for c in cuts] for k in range(5))))
            fields = [field.split() for field in _TAKEN.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    edge = running.groupBy("resource_id").agg(F.collect_list("line_no").alias("edge"))
    met = documents.select("resource_id", "text").join(edge, "resource_id", "left")
    return materialize(met.mapInArrow(run, _TAKEN))


_ARROW = {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def anagram_hash(word: str) -> int:
    """The sum of the fifth powers of the characters, modulo a prime: equal for anagrams, and additive."""
    return sum(pow(ord(c), 5, _PRIME) for c in word) % _PRIME


_DELTAS = [(true, read, (anagram_hash(true) - anagram_hash(read)) % _PRIME) for true, read in CONFUSIONS]


def respelled(word: str, target: str, changes: list[tuple[str, str]]) -> bool:
    """Whether undoing the ``changes`` (true, read), each once, turns ``word`` into ``target``."""
    if not changes:
        return word == target
    (true, read), rest = changes[0], changes[1:]
    at = word.find(read)
    while at >= 0:
        if respelled(word[:at] + true + word[at + len(read) :], target, rest):
            return True
        at = word.find(read, at + 1)
    return False


def corrections(words: DataFrame) -> DataFrame:
    """Rows (word, target, n): misread words and what they stand for, from ``words`` (word, n) with unique words.

    One or two confusions a word. Only rare words that hold a confusion's misread characters take part, each with the
    few differences of those; the join with the frequent words is an equi-join on the hash.
    """

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                odd = bool(_ODD.search(word))
                if len(word) < 3:
                    continue
                here = [k for k, (_, read, _) in enumerate(_DELTAS) if read in word]
                own = anagram_hash(word)
                several = [g for n in range(2, MOST + 1) if len(word) > n * LETTERS - LETTERS for g in combinations_with_replacement(here, n)]
                for group in [(k,) for k in here] + several:
                    if odd or len(word) > 3:
                        rows.append((word, n, odd, list(group), (own + sum(_DELTAS[k][2] for k in group)) % _PRIME))
            yield pd.DataFrame(rows, columns=["word", "n", "odd", "group", "hash"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"target": batch["word"], "target_n": batch["n"], "hash": [anagram_hash(w) for w in batch["word"]]})

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [respelled(w, t, [_DELTAS[k][:2] for k in g]) for w, t, g in zip(batch["word"], batch["target"], batch["group"], strict=True)]
            yield batch.loc[good, ["word", "target", "n", "target_n"]]

    rare = words.mapInPandas(differences, "word string, n bigint, odd boolean, group array<int>, hash bigint")
    plain = words.where((F.col("n") >= LEAST_COUNT) & ~F.col("word").rlike("[|0-9ﬀ-ﬄ]"))
    frequent = plain.mapInPandas(hashes, "target string, target_n bigint, hash bigint")
    pairs = rare.join(frequent, "hash").where(F.col("target_n") >= F.col("n") * F.when(F.col("odd"), SIGN_RATIO).otherwise(RATIO))
    good = pairs.select("word", "target", "n", "target_n", "group").mapInPandas(checked, "word string, target string, n bigint, target_n bigint")
    return good.groupBy("word").agg(F.max_by("target", F.struct("target_n", "target")).alias("target"), F.max("target_n").alias("n"))


def diagnose(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (resource_id, line_no, fault), and the rows (resource_id, line_no, fault, word, target, left, next_line) to repair by.

    ``documents`` has (resource_id, text) with unique ids. A document without lines has no faults.
    """
    tokens = _tokens(documents, running_lines(documents))
    words = materialize(tokens.select(F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    compounds = tokens.select(F.explode("compound").alias("other")).groupBy("other").agg(F.count("*").alias("n_hyphen"))
    zipped = F.arrays_zip(F.col("cut_at").alias("line_no"), F.col("cut").alias("word"), F.col("kept").alias("other"), F.col("left"), F.col("next_line"))
    cuts = tokens.where(F.size("cut") > 0).select("resource_id", F.inline(zipped))
    halves = cuts.select("word", F.substring_index("other", "-", 1).alias("a"), F.substring_index("other", "-", -1).alias("b"))
    joined = halves.select(F.explode(F.array("word", "a", "b")).alias("word")).distinct().join(words, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
    right = maybe_broadcast(materialize(corrections(words.unionByName(joined))))

    judged = cuts.withColumn("a", F.substring_index("other", "-", 1)).withColumn("b", F.substring_index("other", "-", -1))
    for half in ("a", "b"):
        judged = judged.join(right.select(F.col("word").alias(half), F.col("target").alias(f"{half}_target")), half, "left")
    judged = judged.withColumn("spelled", F.concat_ws("-", F.coalesce("a_target", "a"), F.coalesce("b_target", "b")))
    judged = judged.join(words.select("word", F.col("n").alias("n_joined")), "word", "left").join(right.select("word", "target", F.col("n").alias("n_target")), "word", "left").join(compounds.withColumnRenamed("other", "spelled"), "spelled", "left")
    whole = F.greatest(F.coalesce("n_joined", F.lit(0)), F.coalesce("n_target", F.lit(0)))
    tail = F.substring_index("other", "-", -1)
    split = F.when(F.col("n_hyphen").isNotNull(), whole > F.col("n_hyphen")).otherwise((whole > 0) | ~tail.isin("and", "or", "to"))
    judged = materialize(judged.select("resource_id", "line_no", "word", "other", "target", "left", "next_line", F.coalesce(split, F.lit(False)).alias("split")))
    kept_halves = [judged.where(~F.col("split")).select("resource_id", F.col(at).alias("line_no"), F.substring_index("other", "-", part).alias("word")) for at, part in (("line_no", 1), ("next_line", -1))]
    judged = judged.where("split")

    whole_words = tokens.select("resource_id", F.inline(F.arrays_zip(F.col("word_at").alias("line_no"), F.col("word").alias("word"))))
    plain = whole_words.unionByName(kept_halves[0]).unionByName(kept_halves[1]).join(right.select("word", "target"), "word").select("resource_id", "line_no", F.lit("char").alias("fault"), "word", "target", F.lit(0).alias("left"), F.lit(-1).alias("next_line"))
    kept = F.expr("left(word, `left`) = left(target, `left`)")
    at_cut = judged.where(F.col("target").isNotNull()).select("resource_id", F.when(kept, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("char").alias("fault"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("left"), F.lit(-1).alias("next_line"))
    hyphens = judged.select("resource_id", "line_no", F.lit("hyphen").alias("fault"), "word", "target", "left", "next_line")
    nothing = F.lit(None).cast("string")
    edges = None
    for fault in ("header", "page_number"):
        part = tokens.select("resource_id", F.explode(fault).alias("line_no"), F.lit(fault).alias("fault"), nothing.alias("word"), nothing.alias("target"), F.lit(0).alias("left"), F.lit(-1).alias("next_line"))
        edges = part if edges is None else edges.unionByName(part)
    repairs = materialize(plain.unionByName(at_cut).unionByName(hyphens).unionByName(edges))
    return repairs.select("resource_id", "line_no", "fault").distinct(), repairs


def paragraphs(documents: DataFrame) -> DataFrame:
    """Rows (resource_id, text): each document as paragraphs, one a line: edges gone, cuts joined, words corrected.

    A blank line ends a paragraph, unless only edge lines lie on it. Every document comes out.
    """
    _, repairs = diagnose(documents)
    notes = repairs.groupBy("resource_id").agg(F.collect_set(F.struct("line_no", "fault", "word", "target")).alias("notes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, found in zip(batch["resource_id"], batch["text"], batch["notes"], strict=True):
                gone, cut, fixes = set(), {}, {}
                for note in [] if found is None else found:
                    n, fault, word, target = note["line_no"], note["fault"], note["word"], note["target"]
                    if fault in ("header", "page_number"):
                        gone.add(n)
                    elif fault == "hyphen":
                        cut[n] = target
                    elif word is not None:
                        fixes.setdefault(n, {})[word] = target
                parts: list[str] = []
                glue = "\n"
                for n, line in enumerate(text.split("\n")):
                    if n in gone:
                        continue
                    line = line.strip()
                    if not line:
                        glue = "\n"
                        continue
                    mine = fixes.get(n, {})
                    line = _TOKEN.sub(lambda m, mine=mine: _as(m[0], mine.get(m[0].lower())), line)
                    parts += [glue if parts else "", line]
                    glue = " "
                    if n in cut:
                        parts[-1] = _CUT.sub(lambda m: m[1], line)
                        glue = ""
                out.append((key, "".join(parts)))
            yield pd.DataFrame(out, columns=["resource_id", "text"])

    return documents.select("resource_id", "text").join(notes, "resource_id", "left").mapInPandas(run, "resource_id string, text string")


def _as(word: str, target: str | None) -> str:
    """``target`` in the case of ``word``."""
    if target is None:
        return word
    return target.upper() if word.isupper() and len(word) > 1 else target[:1].upper() + target[1:] if word[:1].isupper() else target
