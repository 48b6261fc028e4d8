"""Template residue, filler and messages in place of content (problem 4).

Labelled exemplars of residue, a table that is read (``residue_exemplars.tsv`` or one of the caller's), are indexed by
term. A text is taken in passage windows; the index retrieves the exemplars that share a term with a window, and TF-IDF
containment scores them: the weight of the terms both have, against the exemplar's weight (is the exemplar in the
passage?) or against the passage's (is the passage nothing but filler words?). Weights come from the document
frequencies of the exemplars' terms in the whole corpus. Placeholders and filler exclude a text wherever they stand;
messages only if they cover what a text has beside its frame. Lines that stand almost only in such texts become
exemplars too (``grown`` in ``boilerplate``).
"""

from __future__ import annotations

import csv
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least containment of a placeholder or message exemplar in a window, and of a window in filler exemplars.
CONTAINED, FILLED = 0.75, 0.75
#: Share of the words beside the frame that messages or filler must cover in a text without article.
COVERED = 0.6
#: Longest window in words; longer passages overlap by half.
WINDOW = 40
#: A filler's own terms, one of which all its windows have: those at most so many times as frequent as its middle one.
OWN = 4
#: A filler of fewer than SHORT words must be made of terms that at most this share of the texts has.
SHORT, RARE = 4, 0.02

EXEMPLARS = Path(__file__).with_name("residue_exemplars.tsv")

# The template syntaxes that become slots, in the order they are looked for. None spans lines.
SLOTS = [
    ("embedded", r"<%=?[^%\n]+%>|<\?(?:php|=)[^?\n]+\?>|\{%[^%\n]+%\}"),
    ("braces", r"\{\{[^\S\n]*[^{}\s][^{}\n]*\}\}|\{[!#]?[^\S\n]*[A-Za-z_][\w. ]*\}|\{\d+\}"),
    ("dollar", r"[$#]\{[^\S\n]*\w[^{}\n]*\}"),
    ("percent", r"%%[^\S\n]*\w+[^\S\n]*%%|%[A-Z][A-Z_]{2,}%|%\(\w+\)s"),
    ("at", r"@@\w+@@|##\w+##|\*\|\w[\w:]*\|\*"),
    ("brackets", r"\[\[[^\S\n]*\w[\w ]*\]\]|\[(?:[A-Z]+[_ ])*(?:NAME|DATE|TITLE|ADDRESS|NUMBER|TEXT|EMAIL|PHONE|YEAR|TIME|PLACE|TOWN)\]"),
    ("instruction", r"[\[<][^\S\n]*(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|ENTER|[Tt]ype|[Cc]hoose|[Ss]elect)\b[^\[\]<>\n]*[\]>]"),
    ("underscores", r"(?<![\w/-])__[A-Za-z](?:[A-Za-z/]|_(?!_))*__(?![\w/-])"),
    ("crosses", r"\b[Xx]{3}[-. ][Xx]{3}[-. ][Xx]{4}\b|\b[Xx]{2}/[Xx]{2}/[Xx]{2,4}\b"),
    ("guillemets", r"«\w+[_.][\w.]*»|<<\w[\w ]*>>"),
    ("fill", r"\bTBD(?:[^\w\n]+TBD\b)+"),
    ("angle", r"<\w[\w ]*>"),
]
_SLOT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in SLOTS))
_TERM = re.compile(r"⟦\w+⟧|[^\W_]+")
_HINT = re.compile(r"[{<«\[]|%%|@@|##|\*\||__|[Xx]{2}[Xx/]|TBD|%[A-Z(]")


def with_slots(text: str) -> str:
    """A text in lower case, template syntax as the signs of its slots."""
    if _HINT.search(text):
        text = "\n".join(_SLOT.sub(lambda m: f" ⟦{m.lastgroup}⟧ ", x) if _HINT.search(x) else x for x in text.split("\n"))
    return text.lower()


def terms(passage: str) -> list[str]:
    """The terms of a passage: lower-case words and numbers, and a sign for each slot of template syntax."""
    return _TERM.findall(with_slots(passage))


_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def _stretches(words: list[str]) -> Iterator[list[str]]:
    """``words`` whole or, if they are many, in windows that overlap by half."""
    if len(words) <= WINDOW:
        if words:
            yield words
        return
    for at in range(0, len(words) - WINDOW // 2, WINDOW // 2):
        yield words[at : at + WINDOW]


def windows(line: str) -> Iterator[list[str]]:
    """The passages of a line with slots: its sentences, longer ones in windows that overlap by half."""
    for sentence in _SENTENCES.split(line):
        yield from _stretches(_TERM.findall(sentence))


def read_exemplars(path: str | Path = EXEMPLARS) -> list[tuple[str, list[str]]]:
    """(label, terms) of a table with the columns label (placeholder, filler or message) and text; ⟦…⟧ is a slot."""
    with open(path, encoding="utf-8", newline="") as rows:
        found = [(r["label"], terms(r["text"])) for r in csv.DictReader(rows, delimiter="\t")]
    if any(label not in ("placeholder", "filler", "message") or not words for label, words in found):
        raise ValueError(f"{path}: a label is unknown or a text has no terms")
    return found


def vocabulary(exemplars: list[tuple[str, list[str]]]) -> frozenset[str]:
    return frozenset(t for _, words in exemplars for t in words)


def document_frequencies(documents: DataFrame, exemplars: list[tuple[str, list[str]]]) -> tuple[int, dict[str, int]]:
    """The number of ``documents`` (resource_id, text) and how many of them have each word of the exemplars.

    Counted in the JVM, repeated deliveries once. What comes to the driver has one row per term of the exemplars,
    which bounds it whatever the corpus. Slots of template syntax have no frequency: they are residue wherever they are.
    """
    known = F.array(*[F.lit(t) for t in sorted(vocabulary(exemplars)) if t[0] != "⟦"])
    had = F.array_intersect(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), known)
    one = documents.select("resource_id", F.array_append(had, F.lit("")).alias("had")).dropDuplicates(["resource_id"])
    found = {r["term"]: r["n"] for r in one.select(F.explode("had").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


class Index:
    """Exemplars by term, with the weights of a corpus."""

    def __init__(self, documents: int, frequencies: dict[str, int], exemplars: list[tuple[str, list[str]]] | None = None) -> None:
        exemplars = read_exemplars() if exemplars is None else exemplars
        known = vocabulary(exemplars)
        self.unseen = math.log(1 + documents / 0.5)
        self.idf = {t: math.log(1 + documents / (0.5 + frequencies.get(t, 0))) for t in known}
        self.rare = frozenset(t for t in known if frequencies.get(t, 0) <= max(1, RARE * documents))
        self.exemplars = [(label, frozenset(words), sum(self.idf[t] for t in set(words))) for label, words in exemplars]
        self.fillers = [words for label, words, _ in self.exemplars if label == "filler"]
        middle = {f: 0.5 + sorted(frequencies.get(t, 0) for t in f)[len(f) // 2] for f in self.fillers}
        self.own = {f: frozenset(t for t in f if frequencies.get(t, 0) + 0.5 <= OWN * middle[f]) for f in self.fillers}
        self.filling = frozenset().union(*self.fillers)
        self.anchored: dict[str, list[int]] = defaultdict(list)
        for k, (label, _, _) in enumerate(self.exemplars):
            for t in self._anchors(k) if label != "filler" else ():
                self.anchored[t].append(k)
        self.anchors = frozenset(self.anchored)

    def _anchors(self, k: int) -> Iterator[str]:
        """The heaviest terms of a placeholder or message, one of which every window that it matches has."""
        _, words, whole = self.exemplars[k]
        ranked, left = sorted(words, key=lambda t: (-self.idf[t], t)), whole
        for t in ranked:
            if left < CONTAINED * whole:
                return
            left -= self.idf[t]
            yield t

    def meets(self, words: set[str]) -> bool:
        """Whether ``words`` can hold a match: an anchor, or two terms of a filler, which every filler passage has."""
        return not self.anchors.isdisjoint(words) or bool(self._near(words))

    def _near(self, every: set[str]) -> list[frozenset[str]]:
        """The fillers that share two terms with ``every``, one of them the filler's own."""
        if self.filling.isdisjoint(every):
            return []
        return [f for f in self.fillers if not self.own[f].isdisjoint(every) and len(f & every) >= 2]

    def live(self, every: set[str]) -> tuple[list[int], list[frozenset[str]]]:
        """The placeholders and messages, by number, and the fillers of which a text with the terms ``every`` can have a match."""
        near = {k for t in self.anchors & every for k in self.anchored[t]}
        held = [k for k in sorted(near) if sum(self.idf[t] for t in self.exemplars[k][1] & every) >= CONTAINED * self.exemplars[k][2]]
        return held, self._near(every)

    def match(self, words: list[str]) -> str | None:
        """The label of an exemplar that a window of ``words`` matches; placeholders before filler before messages."""
        labels = set()
        every = set(words)
        held, fillers = self.live(every)
        for k in held:
            label, exemplar, _ = self.exemplars[k]
            if label == "placeholder" or len(words) <= 2 * len(exemplar) + 4:
                labels.add(label)
        if fillers and self.is_filler(words, every):
            labels.add("filler")
        return next((x for x in ("placeholder", "filler", "message") if x in labels), None)

    def is_filler(self, words: list[str], every: set[str]) -> bool:
        """Whether the terms of fillers that share two terms with a window hold the window's weight.

        Fewer than SHORT words must all be terms of one filler, two of them or more rare in the corpus.
        """
        near = self._near(every)
        if not near:
            return False
        distinct = {t for t in every if not t.isdigit()}
        if len(words) < SHORT:
            return any(distinct <= f and len(distinct & self.rare) >= 2 for f in near)
        weight = sum(self.idf.get(t, self.unseen) for t in distinct)
        return sum(self.idf[t] for t in frozenset().union(*near) & distinct) >= FILLED * weight


NONE, PLACEHOLDER, FILLER, MESSAGE = range(4)


def labelled_lines(index: Index, text: str, lines: list[str]) -> tuple[list[int], list[int]]:
    """For each line its label and how many words of messages or filler it holds; two empty lists if no line has any.

    A line with several labels has the first of placeholder, filler and message. Filler is looked for in sentences
    and in stretches of the whole line, as it may come in sentences of a word or two.
    """
    low = with_slots(text)
    held, fillers = index.live(set(_TERM.findall(low)))
    if not held and not fillers:
        return [], []
    hooks = [t for t in index.anchors & frozenset().union(*(index.exemplars[k][1] for k in held)) if t in low]
    hooks += [t for t in frozenset().union(*(index.own[f] for f in fillers)) if t in low]
    labels, covered = [NONE] * len(lines), [0] * len(lines)
    for n, line in enumerate(low.split("\n")):
        # As substrings first, which costs less than taking the line apart.
        if not any(t in line for t in hooks):
            continue
        words = _TERM.findall(line)
        if not words or not index.meets(set(words)):
            continue
        found = [(window, index.match(window)) for window in windows(line)]
        whole = [window for window in _stretches(words) if index.is_filler(window, set(window))] if len(found) > 1 else []
        kinds = {label for _, label in found} | ({"filler"} if whole else set())
        labels[n] = next((k for k, name in ((PLACEHOLDER, "placeholder"), (FILLER, "filler"), (MESSAGE, "message")) if name in kinds), NONE)
        covered[n] = min(len(words), max(sum(len(w) for w, label in found if label in ("filler", "message")), sum(map(len, whole))))
    return (labels, covered) if any(labels) else ([], [])


def word_counts(lines: list[str]) -> list[int]:
    return [len(line.split()) for line in lines]


def summary(labels: list[int], covered: list[int], words: list[int], frame: list[bool]) -> tuple[bool, int, int]:
    """(has placeholder or filler, words of messages and filler, other words) of a text whose ``frame`` lines are known.

    Frame lines that hold a message (such as a script notice) count as message, other frame lines not at all.
    """
    fixed, hit, other = False, 0, 0
    for n, is_frame in enumerate(frame):
        label = labels[n] if labels else NONE
        if is_frame:
            hit += covered[n] if label == MESSAGE else 0
            continue
        fixed |= label in (PLACEHOLDER, FILLER)
        hit += covered[n] if label else 0
        other += max(0, words[n] - (covered[n] if label else 0))
    return fixed, hit, other


def judge(index: Index, lines: list[str], frame: list[bool]) -> tuple[bool, bool]:
    """(has residue, has no article): of a text whose ``frame`` lines are known."""
    labels, covered = labelled_lines(index, "\n".join(lines), lines)
    fixed, hit, other = summary(labels, covered, word_counts(lines), frame)
    bare = hit > 0 and hit >= COVERED * (hit + other)
    return fixed or bare, bare
