"""Packing documents into containers of fixed capacity (problem 9): hierarchical packing over several context sizes.

Every item is routed to the tier of the smallest context size that holds it. The tiers are packed one after the other,
from the longest to the shortest, and each only with its own items: a tier's bins have its context size, the longest
items open them and the longest that fit fill them. What is left open in a bin is then filled from the shorter tiers,
again longest first, so a shorter tier packs what the longer ones left of it. Windows that no short item is left to
fill are given up at the end, and their items share windows of the whole capacity. Bins of a short tier are windows of which
several make up a container: as the sizes are halves of each other, they are joined without loss, and step groups get
equal shares of every tier's containers and of their tokens.

As only lengths matter, all this runs over the histogram of lengths, which has at most as many rows as the capacity
whatever the corpus: a filling found once is repeated while the lengths in it last. Items then find their bin from
their length and their rank among items of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from corpusloom.session import materialize

CAPACITY = 2048
#: Context sizes as shares of the capacity, each half of the one before.
TIERS = (1.0, 0.5, 0.25, 0.125)
#: Share of a shorter tier's window that must be filled for it to be kept.
KEPT = 0.99
#: Containers in a step group; most items of one length that are ranked together.
STEP, RANKED = 64, 500_000


def sizes_of(capacity: int = CAPACITY, tiers: tuple[float, ...] = TIERS) -> list[int]:
    """The context sizes in tokens, largest first. ValueError unless each divides the one before and 1.0 is the first."""
    sizes = [int(capacity * t) for t in tiers if int(capacity * t) > 0]
    if not sizes or sizes[0] != capacity or any(a % b for a, b in zip(sizes, sizes[1:], strict=False)):
        raise ValueError(f"tiers {tiers} of {capacity}")
    return sizes


def fill(left: np.ndarray, gap: int, longest: int, shortest: int) -> tuple[dict[int, int], int]:
    """({length: items}, gap left) of one bin with ``gap`` open, longest fit first among the lengths from ``longest`` to ``shortest``."""
    filling: dict[int, int] = {}
    length = min(longest, gap)
    while length >= shortest and gap:
        below = np.flatnonzero(left[shortest : min(gap, length) + 1])
        if not len(below):
            break
        length = shortest + int(below[-1])
        take = min(gap // length, int(left[length]))
        filling[length] = take
        gap -= take * length
        length -= 1
    return filling, gap


def fillings(histogram: dict[int, int], capacity: int = CAPACITY, tiers: tuple[float, ...] = TIERS) -> list[tuple[int, dict[int, int], int]]:
    """Fillings as (context size, {length: items in a bin}, bins), together using up ``histogram`` {length: items}."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out = []
    sizes = sizes_of(capacity, tiers)
    for size, low in zip(sizes, [*sizes[1:], 0], strict=True):
        # The tier's own items; a bin whose gap the tier cannot fill any more is kept with the lengths in it.
        opened: list[tuple[dict[int, int], int, int]] = []
        for opener in range(size, low, -1):
            while left[opener]:
                filling, gap = fill(left, size, opener, low + 1)
                times = min(int(left[k] // m) for k, m in filling.items())
                for k, m in filling.items():
                    left[k] -= m * times
                opened.append((filling, gap, times))
        # Then the gaps, from the shorter tiers.
        for own, gap, times in opened:
            while times:
                more, _ = fill(left, gap, low, 1) if gap else ({}, 0)
                here = min([times, *(int(left[k] // m) for k, m in more.items())])
                for k, m in more.items():
                    left[k] -= m * here
                out.append((size, own | more, here))
                times -= here
    # Windows of shorter tiers that stay open are given up, and their items share windows of the whole capacity.
    kept = [x for x in out if x[0] == capacity or sum(k * m for k, m in x[1].items()) >= KEPT * x[0]]
    for size, filling, times in out:
        if size < capacity and sum(k * m for k, m in filling.items()) < KEPT * size:
            for k, m in filling.items():
                left[k] += m * times
    for opener in range(capacity, 0, -1):
        while left[opener]:
            filling, _ = fill(left, capacity, opener, 1)
            times = min(int(left[k] // m) for k, m in filling.items())
            for k, m in filling.items():
                left[k] -= m * times
            kept.append((capacity, filling, times))
    return kept


def _places(plan: list[tuple[int, dict[int, int], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], list[tuple[int, int]]]:
    """For each length (first rank, items a bin, tier, first bin of the tier) of its stretches of ranks; and (size, bins) of each tier."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins: dict[int, int] = {}
    for size, filling, times in plan:
        for length, m in filling.items():
            found.setdefault(length, []).append((used.get(length, 0), m, size, bins.get(size, 0)))
            used[length] = used.get(length, 0) + m * times
        bins[size] = bins.get(size, 0) + times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}, sorted(bins.items(), reverse=True)


def items(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, piece_index, token_start, token_count) of every document with text.

    A document above ``capacity`` is divided into pieces of ``capacity`` and a last one; any other is one item. Rows
    of a doc_id that is delivered again are dropped. Null and empty texts have no item.
    """
    counted = token_counts(documents.where(F.char_length("text") > 0), "doc_id", "text", folder, vocabulary).where("n > 0").dropDuplicates(["doc_id"])
    pieces = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece_index"))
    start = F.col("piece_index").cast("bigint") * capacity
    return pieces.select("doc_id", "piece_index", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - start).alias("token_count"))


def pack(found: DataFrame, capacity: int = CAPACITY, tiers: tuple[float, ...] = TIERS, step: int = STEP, ranked: int = RANKED) -> DataFrame:
    """``found`` (doc_id, piece_index, token_start, token_count) with the columns tier, container, window and step_group.

    ``tier`` is the context size of the item's window and ``window`` the window's number in its container: a container
    holds capacity / tier windows of one tier, its last one perhaps fewer. Items of one length are ranked in parts of
    about ``ranked`` items, however many there are. Every item comes out once; no items give no rows.
    """
    by_length = {r["token_count"]: r["n"] for r in found.groupBy("token_count").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = {k: -(-n // ranked) for k, n in by_length.items()}
    salt = F.pmod(F.xxhash64("doc_id", "piece_index"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in salts.items() if n > 1 for x in (k, n)]), F.col("token_count")), F.lit(1))).cast("int") if max(salts.values(), default=1) > 1 else F.lit(0)
    table = found.withColumn("salt", salt)
    counts = table.groupBy("token_count", "salt").agg(F.count("*").alias("n")).orderBy("token_count", "salt").collect()  # a row for every ``ranked`` items beyond those of by_length
    offsets: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = {}
    for row in counts:
        offsets[row["token_count"], row["salt"]] = histogram.get(row["token_count"], 0)
        histogram[row["token_count"]] = histogram.get(row["token_count"], 0) + row["n"]
    places, bins = _places(fillings(histogram, capacity, tiers))
    first, total = {}, 0
    for size, n in bins:
        first[size] = total
        total += -(-n * size // capacity)
    groups = max(1, -(-total // step))
    shared = found.sparkSession.sparkContext.broadcast((offsets, places, first))
    within = table.withColumn("rank", F.row_number().over(Window.partitionBy("token_count", "salt").orderBy("doc_id", "piece_index")) - 1)
    kind = found.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, places, first = shared.value
        for batch in batches:
            tier, bin_ = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for (length, salt), rows in batch.groupby(["token_count", "salt"]).indices.items():
                ranks = batch["rank"].to_numpy()[rows] + offsets[length, salt]
                start, each, size, base = places[length]
                k = np.searchsorted(start, ranks, "right") - 1
                tier[rows] = size[k]
                bin_[rows] = base[k] + (ranks - start[k]) // each[k]
            several = capacity // np.maximum(tier, 1)
            container = np.array([first[t] for t in tier.tolist()], np.int64) + bin_ // several
            yield batch.assign(tier=tier, container=container, window=bin_ % several, step_group=container % groups)[["doc_id", "piece_index", "token_start", "token_count", "tier", "container", "window", "step_group"]]

    return within.mapInPandas(place, f"doc_id {kind}, piece_index int, token_start bigint, token_count bigint, tier bigint, container bigint, window bigint, step_group bigint")
