"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Any run of words of a text is a window, across lines and blank lines. The best window of a template is found exactly: it begins and
ends with a bigram of the template, and a window of a bigrams and a template of b only reach a coefficient t if
t / (2 - t) * b <= a <= (2 - t) / t * b and they share at least t / (2 - t) * b bigrams. Texts, and then first words, that cannot have so
many are left out by counting; from the others, all lengths are compared. Bigrams count as often as they occur in both.

Templates that differ in versions only need their own version in the window or as the next word. Of templates of like size that match
one another's text (GPL and AGPL headers, CC BY and CC BY-SA), the better match of overlapping windows stays, then the larger template.

Rows: null, empty and wordless texts match nothing; a template of one word matches where that word occurs. Ties go to the first
template by name. Equal texts have equal matches. No templates: no matches.
"""

from __future__ import annotations

import json
import math
import pkgutil
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns

THRESHOLD = 0.8
WORD = regex.compile(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*")

VERSION = regex.compile(r"v?(\p{N}+(?:\.\p{N}+)*)")
#: Words that go with a version: notices that differ in nothing else are the same notice in several versions.
PORTS = frozenset(("version", "v", "international", "unported", "generic"))

#: Licences, headers and notices by name, from licenses.json; what a copy fills in is left out.
TEMPLATES: dict[str, str] = json.loads(pkgutil.get_data(__package__, "licenses.json"))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def versions(words: list[str]) -> frozenset[str]:
    """The numbers among the words, "3.0" as "3"."""
    return frozenset(regex.sub(r"(\.0+)+$", "", m[1]) for m in map(VERSION.fullmatch, words) if m)


def bigrams(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []


class Templates:
    """Templates by size, and by bigram."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        counts = {name: Counter(bigrams(words_of(text))) for name, text in sorted(texts.items())}
        self.sizes = sorted((c.total(), name) for name, c in counts.items() if c)
        self.index: dict[tuple, list[tuple[str, int]]] = {}
        for name, c in counts.items():
            for gram, k in c.items():
                self.index.setdefault(gram, []).append((name, k))
        self.single = {gram[0]: [name for name, _ in named] for gram, named in self.index.items() if len(gram) == 1}
        self.names = [name for name, c in counts.items() if any(len(gram) == 2 for gram in c)]
        grams = sorted(gram for gram in self.index if len(gram) == 2)
        self.ids = {w: i for i, w in enumerate(sorted({w for gram in grams for w in gram}), 1)}
        #: Sorted codes of the bigrams, and how often each template has each.
        self.codes = np.array([self.code(*map(self.ids.get, gram)) for gram in grams], np.int64)
        self.counts = np.array([[counts[name][gram] for name in self.names] for gram in grams], np.int32).reshape(len(grams), len(self.names))
        self.totals = self.counts.sum(axis=0)
        self.compare({name: words_of(texts[name]) for name in counts})

    def compare(self, words: dict[str, list[str]]) -> None:
        """Templates that differ in versions only, with their versions; and templates of like size that match one another's text."""
        plain: dict[tuple[str, ...], list[str]] = {}
        for name, w in words.items():
            plain.setdefault(tuple(x for x in w if x not in PORTS and not VERSION.fullmatch(x)), []).append(name)
        self.versions = {name: versions(words[name]) for same in plain.values() if len({versions(words[n]) for n in same}) > 1 for name in same}
        self.size = {name: n for n, name in self.sizes}
        self.siblings: dict[str, set[str]] = {name: set() for name in self.size}
        for name, n in self.size.items():
            alike = self.candidates(n)
            for other in self.places(words[name]):
                if other != name and other in alike:
                    self.siblings[name].add(other)
                    self.siblings[other].add(name)

    def code(self, first, second):
        return first * (len(self.ids) + 1) + second

    def candidates(self, size: int) -> dict[str, int]:
        """Templates whose size lets a unit of ``size`` bigrams reach the threshold."""
        t = self.threshold
        low, high = math.ceil(size * t / (2 - t) - 1e-9), math.floor(size * (2 - t) / t + 1e-9)
        return {name: n for n, name in self.sizes[bisect_left(self.sizes, (low, "")):bisect_right(self.sizes, (high, chr(0x10FFFF)))]}

    def match(self, words: list[str]) -> list[tuple[str, float]]:
        size = max(len(words) - 1, min(len(words), 1))
        candidates = self.candidates(size) if size else {}
        if not candidates:
            return []
        shared: Counter = Counter()
        for gram, k in Counter(bigrams(words)).items():
            for name, n in self.index.get(gram, ()):
                if name in candidates:
                    shared[name] += min(k, n)
        scored = ((name, 2 * both / (size + candidates[name])) for name, both in shared.items())
        return [(name, d) for name, d in scored if d >= self.threshold]

    def places(self, words: list[str]) -> dict[str, list[tuple[float, int, int]]]:
        """Windows that reach the threshold, per template: (dice, first word, word after the last), best first, none overlapping a
        better one of the template."""
        out: dict[str, list[tuple[float, int, int]]] = {}
        if self.single:
            for i, w in enumerate(words):
                for name in self.single.get(w, ()):
                    out.setdefault(name, []).append((1.0, i, i + 1))
        if len(words) < 2 or not len(self.codes):
            return out
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = self.code(ids[at], ids[at + 1])
        gram = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[gram] == code
        at, gram = at[known], gram[known]
        found, often = np.unique(gram, return_counts=True)
        need = np.maximum(np.ceil(self.totals * self.threshold / (2 - self.threshold) - 1e-9), 1)
        shared = np.minimum(self.counts[found], often[:, None]).sum(axis=0)
        for t in np.flatnonzero(shared >= need):
            n = self.counts[gram, t]
            windows = self.windows(at[n > 0], gram[n > 0], n[n > 0], int(self.totals[t]), int(need[t]))
            if windows:
                out[self.names[t]] = windows
        return out

    def named(self, words: list[str]) -> dict[str, float]:
        """Best Dice per template, over the places where its version agrees and no sibling matches better. A notice without a version
        comes after those with one."""
        places = [(name not in self.versions or bool(self.versions[name]), dice, self.size[name], name, first, last)
                  for name, found in self.places(words).items() for dice, first, last in found
                  if name not in self.versions or self.versions[name] <= versions(words[first:last + 1])]
        kept: dict[str, list[tuple[int, int]]] = {}
        best: dict[str, float] = {}
        for _, dice, _, name, first, last in sorted(places, key=lambda x: (not x[0], -x[1], -x[2], x[3:])):
            if not any(i < last and first < j for other in self.siblings[name] for i, j in kept.get(other, ())):
                kept.setdefault(name, []).append((first, last))
                best[name] = max(best.get(name, 0.0), dice)
        return best

    def windows(self, at: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int, need: int) -> list[tuple[float, int, int]]:
        """The windows of one template of ``size`` bigrams, of which the text has ``gram`` at ``at`` and the template has it ``n`` times.

        An occurrence adds to the shared count of a window if the n-th one before it (``past``) lies before the window."""
        longest = math.floor(size * (2 - self.threshold) / self.threshold + 1e-9)
        order = np.argsort(gram, kind="stable")
        back = np.arange(len(order)) - n[order]
        same = (back >= 0) & (gram[order[back]] == gram[order])
        past = np.empty(len(at), np.int64)
        past[order] = np.where(same, at[order[back]], -1)
        # What the longest window from each occurrence shares: an occurrence counts for the starts after ``past`` and near enough.
        steps = np.zeros(len(at) + 1, np.int64)
        np.add.at(steps, np.searchsorted(at, np.maximum(past, at - longest), "right"), 1)
        steps[1:] -= 1
        reached = []
        for k in np.flatnonzero(np.cumsum(steps[:-1]) >= need):
            end = np.searchsorted(at, at[k] + longest)
            dice = 2 * np.cumsum(past[k:end] < at[k]) / (at[k:end] - at[k] + 1 + size)
            best = int(dice.argmax())
            if dice[best] >= self.threshold:
                reached.append((float(dice[best]), int(at[k]), int(at[k + best]) + 2))
        reached.sort(key=lambda x: (-x[0], x[1], x[2]))
        kept: list[tuple[float, int, int]] = []
        taken: list[tuple[int, int]] = []
        for dice, first, last in reached:
            i = bisect_left(taken, (first, last))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or last <= taken[i][0]):
                taken.insert(i, (first, last))
                kept.append((dice, first, last))
        return kept


def scan(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", name: str = "licenses") -> DataFrame:
    """``df`` with the templates its windows match, best first: a list of (license, dice). One pass; the templates travel with the
    task, and they must be few enough to be listed by the caller."""
    held = df.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, threshold))
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))

    def make():
        known = held.value

        def found(value):
            return [{"license": a, "dice": d} for a, d in sorted(known.named(words_of(value or "")).items(), key=lambda x: (-x[1], x[0]))]

        return lambda values: [pa.array([found(v) for v in values.to_pylist()], pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64())])))]

    return append_columns(df, [text], [T.StructField(name, kind)], make)
