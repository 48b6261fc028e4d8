"""Main content of pages without the frame of the site (problem 2): site template removal.

Texts are read by Python once: :func:`analyse` turns each into narrow arrays (hashes of its elements, what residue its
lines hold), from which the model of the sites and the verdict on every line are computed without the texts.

The text of a page keeps the order of its elements: a line is a leaf, and a line with the short lines under it (a menu
or sidebar with its entries) is a subtree. Elements are hashed: a leaf by its form, with the site's own name as one
sign, and an entry by its shape, in which all words but function words are alike. Hashes are counted per host, and
for leaves over all hosts, over distinct texts; recurring leaves are frame, and so are, below recurring leaves, the
entries whose shape stands chiefly below recurring leaves. Shapes that titles of the corpus have are never entries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.words import STOPWORDS
from corpusloom.llm import residue
from corpusloom.session import materialize, maybe_broadcast

#: A leaf recurs if its texts are at least LEAST and significantly (two deviations) above this share of the texts.
LEAST, SHARE = 3, 0.008
#: Of the occurrences of an entry's shape, so many stand directly below a frame line; above SURE it is frame anywhere.
BELOW, SURE = 0.2, 0.6
#: Fewest occurrences of a shape from which a host's own share counts.
OWN = 30
#: Share of the titles from which a shape counts as a title's.
TITLE_SHARE = 0.0003
#: A line of so many texts and hosts becomes an exemplar if this share of its texts is messages to this share of words.
GROWN_TEXTS, GROWN_HOSTS, GROWN_SHARE, GROWN_COVERED = 3, 2, 0.8, 0.3
#: Documents of a host that are judged by one task.
PART = 50_000

# Words that stay themselves in a shape.
FUNCTION_WORDS = STOPWORDS | {"across", "along", "around", "near", "per", "within"}

_PIECES = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[0-9]+|[^\w\s]|_")


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def shape(line: str) -> str:
    """A line with its words alike: a run of n words as w and n (4 for more), numbers as 0, function words and signs as they are."""
    out: list[str] = []
    run = 0
    for piece in [*_PIECES.findall(line.lower()), ""]:
        sign = piece if piece in FUNCTION_WORDS else "w" if piece[:1].isalpha() else "0" if piece[:1].isdigit() else piece
        if sign == "w":
            run += 1
            continue
        if run:
            out.append(f"w{min(run, 4)}")
            run = 0
        if sign and not (sign == "_" and out[-1:] == ["_"]):
            out.append(sign)
    return " ".join(out)


class _Site(dict):
    """Words of lines on one host, each as it is or, if the host's name holds it, as one sign."""

    def __init__(self, host: str) -> None:
        super().__init__()
        self.name = re.sub(r"[^a-z0-9]", "", host.lower())

    def __missing__(self, word: str) -> str:
        letters = _LETTERS.search(word)
        if letters and len(letters[0]) > 3 and letters[0] in self.name:
            self[word] = word[: letters.start()] + "¤" + word[letters.end() :]
        elif len(self) < 200_000:
            self[word] = word
        else:
            return word
        return self[word]


_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = "\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_BLANKS = re.compile(f"[ {_SPACE}]{{2,}}|[{_SPACE}]")  # a single space is left as it is
_DIGITS = re.compile("[0-9]{2,}|[1-9]")


def leaf_forms(text: str, site: _Site) -> list[str]:
    """The form of each line of a page (lower case, white space and digit runs as one sign), the site's name masked."""
    flat = _DIGITS.sub("0", _BLANKS.sub(" ", text.lower()))
    look = site.__getitem__
    return [" ".join(map(look, line.split(" "))).replace("¤ ¤", "¤") for line in map(str.strip, flat.split("\n"))]


_INNER_END = re.compile(r"[^\W_]{2}[.!?]\s+\S")


def is_sentence(line: str) -> bool:
    """Whether a line reads as prose: ends like a sentence and has two function words or more, or a sentence before it."""
    line = line.rstrip()
    return line[-1:] in (".", "!", "?") and (len(FUNCTION_WORDS.intersection(_LETTERS.findall(line.lower()))) > 1 or bool(_INNER_END.search(line)))


def elements(text: str, site: _Site) -> list[tuple[int, int | None]]:
    """(leaf hash, shape hash or None for a sentence) of each line; (0, None) for a blank one."""
    out: list[tuple[int, int | None]] = []
    for line, form in zip(text.split("\n"), leaf_forms(text, site), strict=True):
        if not form:
            out.append((0, None))
        elif is_sentence(form):
            out.append((_hash(form), None))
        else:
            out.append((_hash(form), _hash(shape(line))))
    return out


ANALYSED = "resource_id string, host string, kind string, t bigint, u bigint, leaf array<bigint>, shape array<bigint>, words array<int>, label array<int>, covered array<int>"


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def analyse(documents: DataFrame, index: residue.Index) -> DataFrame:
    """Rows of ANALYSED, one per resource of ``documents`` (resource_id, host, kind, text), written to the shared folder.

    ``leaf`` and ``shape`` are the hashes of a page's lines (0 where there is none), empty for other kinds; ``label``
    and ``covered`` are those of ``residue.labelled_lines``; (t, u) is a digest of the text. Repeated deliveries of a
    resource are dropped from the arrays, so texts are not shuffled for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, _Site] = {}
        for batch in batches:
            rows = []
            for key, host, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                found = elements(text, sites.setdefault(host, _Site(host))) if kind == "page" else []
                digest = xxhash.xxh128_digest(text)
                halves = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
                rows.append((key, host, kind, *halves, [leaf for leaf, _ in found], [form or 0 for _, form in found], residue.word_counts(lines), *residue.labelled_lines(index, text, lines)))
            yield _batch(rows, ANALYSED)

    seen = documents.select("resource_id", "host", "kind", "text").mapInArrow(run, ANALYSED)
    return materialize(seen.dropDuplicates(["resource_id"]))


def _element_table(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (host, leaf, shape, above, n), n over distinct texts of the host, ``above`` the leaf before; and (host, texts)."""
    solid = F.filter(F.arrays_zip("leaf", "shape"), lambda x: x["leaf"] != 0)
    texts = pages.groupBy("host", "t", "u").agg(F.first(solid).alias("e"))
    above = F.array_prepend(F.transform(F.slice("e", 1, F.greatest(F.lit(0), F.size("e") - 1)), lambda x: x["leaf"]), F.lit(0).cast("bigint"))
    placed = F.zip_with("e", above, lambda x, a: F.when(x.isNotNull(), F.struct(x["leaf"].alias("leaf"), F.nullif(x["shape"], F.lit(0).cast("bigint")).alias("shape"), a.alias("above"))))
    spread = texts.select("host", F.inline(F.array_distinct(F.array_compact(placed))))
    counted = spread.groupBy("host", "leaf", "shape", "above").agg(F.count("*").alias("n"))
    return counted, texts.groupBy("host").agg(F.count("*").alias("texts"))


def _recurs(count, texts):
    expected = F.col(texts) * SHARE
    return F.col(count) >= F.greatest(F.lit(LEAST), expected + 2 * F.sqrt(expected))


def site_model(pages: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (host, hash, what): the hosts' frame leaves ("leaf") and entry shapes ("shape", "sure"); and (leaf, n, hosts).

    ``pages`` has rows of ANALYSED and ``titles`` (host, title). A line counts only beyond the pages of the host that
    have it as title. A host has at most 1 / SHARE times its mean number of lines as frame leaves, whatever its size;
    copies of one text count once. The second table counts the texts of every leaf.
    """
    counted, sizes = _element_table(pages)
    counted = materialize(counted)
    sizes = materialize(sizes)
    named = materialize(_title_forms(titles))
    own_titles = named.where(F.col("host").isNotNull()).groupBy("host", "leaf").agg(F.count("*").alias("titles"))
    leaves = counted.groupBy("host", "leaf").agg(F.sum("n").alias("n")).join(own_titles, ["host", "leaf"], "left")
    leaves = materialize(leaves.select("host", "leaf", (F.col("n") - F.coalesce("titles", F.lit(0))).alias("n")).where("n > 0"))
    whole = sizes.agg(F.sum("texts").alias("texts")).first()["texts"] or 0
    expected = whole * SHARE
    totals = leaves.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
    everywhere = totals.where((F.col("n") >= max(LEAST, expected + 2 * math.sqrt(expected))) & (F.col("hosts") > 1)).select("leaf")
    own = leaves.join(maybe_broadcast(sizes), "host").where(_recurs("n", "texts")).select("host", "leaf")
    frame = materialize(own.unionByName(leaves.join(everywhere, "leaf", "left_semi").select("host", "leaf")).distinct())
    few = maybe_broadcast(frame)

    shaped = named.groupBy("shape").agg(F.count("*").alias("n"))
    total = named.count()
    titled = materialize(shaped.where(F.col("n") >= TITLE_SHARE * total).select("shape"))
    shapes = counted.where(F.col("shape").isNotNull()).join(few, ["host", "leaf"], "left_anti")
    below = few.select("host", F.col("leaf").alias("above"), F.lit(1).alias("below"))
    shapes = shapes.join(below, ["host", "above"], "left").groupBy("host", "shape").agg(F.sum("n").alias("n"), F.sum(F.when((F.col("below") == 1) | (F.col("above") == 0), F.col("n")).otherwise(0)).alias("first"))
    shapes = materialize(shapes)
    overall = shapes.groupBy("shape").agg(F.sum("n").alias("all_n"), F.sum("first").alias("all_first")).where((F.col("all_n") >= 5) & (F.col("all_first") > 0))
    rate = F.when(F.col("n") >= OWN, F.col("first") / F.col("n")).otherwise(F.col("all_first") / F.col("all_n"))
    rated = shapes.join(overall, "shape").join(titled, "shape", "left_anti").withColumn("rate", rate).where(F.col("rate") >= BELOW)
    entries = rated.select("host", F.col("shape").alias("hash"), F.when(F.col("rate") >= SURE, "sure").otherwise("shape").alias("what"))
    return materialize(frame.select("host", F.col("leaf").alias("hash"), F.lit("leaf").alias("what")).unionByName(entries)), totals


def _title_forms(titles: DataFrame) -> DataFrame:
    """Rows (host, leaf, shape): the hashes that each title would have as a line of its host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sites: dict[str, _Site] = {}
        for batch in batches:
            forms = [" ".join(leaf_forms(t.replace("\n", " "), sites.setdefault(h or "", _Site(h or "")))) for h, t in zip(batch["host"], batch["title"], strict=True)]
            yield pd.DataFrame({"host": batch["host"], "leaf": [_hash(f) for f in forms], "shape": [_hash(shape(t)) for t in batch["title"]]})

    return titles.where(F.col("title").isNotNull()).select("host", "title").mapInPandas(run, "host string, leaf bigint, shape bigint")


def frame_lines(leaf: list[int], shape: list[int], leaves: set[int], shapes: set[int], sure: set[int]) -> list[bool]:
    """For each line of a page, given by its hashes, whether it is frame; a blank line never is."""
    out, below = [], True
    for one, form in zip(leaf, shape, strict=True):
        if not one:
            out.append(False)
            continue
        below = one in leaves or form in sure or (below and form in shapes)
        out.append(below)
    return out


_FLAGGED = "resource_id string, host string, frame array<int>, fixed boolean, hit int, other int, rest array<bigint>, rest_words array<int>"


def flagged(analysed: DataFrame, model: DataFrame) -> DataFrame:
    """Rows of _FLAGGED, one per row of ``analysed``: its frame lines, its residue and its other lines.

    The rows of a host are dealt out to parts of about PART, and each part gets one copy of the host's model, as rows
    that are sorted before the documents': no model travels with a document, and a host that holds most documents is
    many parts.
    """
    parts = analysed.groupBy("host").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = maybe_broadcast(materialize(parts))
    documents = analysed.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("resource_id"), F.col("parts")).cast("int")).drop("parts", "t", "u")
    copies = model.join(parts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hash", "what")
    both = copies.unionByName(documents.withColumn("hash", F.lit(0).cast("bigint")), allowMissingColumns=True).withColumn("late", F.col("resource_id").isNotNull())
    placed = both.repartition("host", "part").sortWithinPartitions("host", "part", "late").drop("late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, {}
        for batch in batches:
            rows = []
            for host, part, hashed, what, key, leaf, shape, words, label, covered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, part) != here:
                    here, known = (host, part), {"leaf": set(), "shape": set(), "sure": set()}
                if key is None:
                    known[what].add(hashed)
                    continue
                frame = frame_lines(leaf, shape, known["leaf"], known["shape"], known["sure"]) if leaf else [False] * len(words)
                rest = [n for n, one in enumerate(leaf) if one and not frame[n] and not (label and label[n])]
                rows.append((key, host, [n for n, hit in enumerate(frame) if hit], *residue.summary(label, covered, words, frame), [leaf[n] for n in rest], [words[n] for n in rest]))
            yield _batch(rows, _FLAGGED)

    return placed.select("host", "part", "hash", "what", "resource_id", "leaf", "shape", "words", "label", "covered").mapInArrow(run, _FLAGGED)


def grown(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (leaf): lines beside the frame that stand almost only in texts that are messages in good part.

    ``found`` has rows of _FLAGGED and ``totals`` counts the texts of every leaf. These lines are exemplars of the
    corpus' own, such as the number of the incident under a message.
    """
    near = found.where((F.col("hit") > 0) & (F.col("hit") >= GROWN_COVERED * (F.col("hit") + F.col("other"))))
    lines = near.select("host", F.explode(F.array_distinct("rest")).alias("leaf"))
    counts = lines.groupBy("leaf", "host").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.sum("n").alias("m"), F.count("*").alias("on"))
    enough = counts.where((F.col("m") >= GROWN_TEXTS) & (F.col("on") >= GROWN_HOSTS))
    return enough.join(totals, "leaf").where(F.col("m") >= GROWN_SHARE * F.col("n")).select("leaf")


def verdicts(analysed: DataFrame, model: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (resource_id, frame, residue, bare), one per row of ``analysed``, written to the shared folder.

    ``frame`` are the numbers of the frame lines, ``residue`` says whether the text has a placeholder or filler or is
    ``bare``: nothing but messages and filler, those of :func:`grown` included, beside its frame.
    """
    found = materialize(flagged(analysed, model))
    more = materialize(grown(found, totals))
    extra = found.where(F.size("rest") > 0).select("resource_id", F.inline(F.arrays_zip(F.col("rest").alias("leaf"), F.col("rest_words").alias("words")))).join(maybe_broadcast(more), "leaf", "left_semi").groupBy("resource_id").agg(F.sum("words").alias("extra"))
    both = found.select("resource_id", "frame", "fixed", "hit", "other").join(extra, "resource_id", "left")
    hit = F.col("hit") + F.coalesce("extra", F.lit(0))
    bare = (hit > 0) & (hit >= residue.COVERED * (F.col("hit") + F.col("other")))
    return materialize(both.select("resource_id", "frame", (F.col("fixed") | bare).alias("residue"), bare.alias("bare")))
