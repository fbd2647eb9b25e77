"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. The automaton recognises every run of words of
any item. A document's words stream through it; the state tells the longest run that ends at the current word and occurs in an
item. Where that run is at least ``window`` words long, its last ``window`` words are a window of an item; an item of fewer words
is one window, met where the run is at least as long as the item and ends with it.

The items are cut into blocks of at most ``BLOCK_WORDS`` words, one automaton each: only one block's items pass through the driver
at a time, each block is a broadcast of bounded size, and each is applied in a map of its own over the documents, so a benchmark
of any size works. An item of more words than a block is cut into pieces that overlap by ``window`` - 1 words.

Rows: null, empty and wordless texts have no words and no hits. Items without text or words have no window; null item ids are
matched but not named. Repeated items count once by id. Repeated documents are alike. No documents or no items: no hits.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns, byte_list, column, fresh, small_batches
from marlstone.session import cut_lineage

WINDOW = 13
#: Most words of benchmark items per automaton: some tens of MB in a worker.
BLOCK_WORDS = 200_000
#: Blocks applied one after the other before what they found is written down.
CHAINED = 16

#: Every byte that is not part of a word becomes a space; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers; ``items`` are (name, words)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int | None]] = []  # (state, name) where a word of an item ends
        whole: list[tuple[int, int, int | None]] = []  # (state, length, name) where an item shorter than the window ends
        for name, words in items:
            state = 0
            for w in words:
                state = self._extend(state, self.number.setdefault(w, len(self.number)))
                ends.append((state, name))
            if 0 < len(words) < window:
                whole.append((state, len(words), name))
        names: list[set] = [set() for _ in self.next]
        short: list[dict[int, set]] = [{} for _ in self.next]
        for state, name in ends:
            names[state].add(name)
        for state, n, name in whole:
            short[state].setdefault(n, set()).add(name)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in order:  # what contains a longer run contains its suffixes
            if self.length[self.link[s]] >= window:
                names[self.link[s]] |= names[s]
        # Each state's answers by suffix links: items whose window ends here, and short items that end here with their lengths.
        self.names = [frozenset(n) if self.length[s] >= window else frozenset() for s, n in enumerate(names)]
        self.ending: list[tuple] = [()] * len(self.next)
        for s in reversed(order):
            own = tuple(sorted((n, frozenset(v)) for n, v in short[s].items()))
            self.ending[s] = self.ending[self.link[s]] + own if self.link[s] >= 0 else own
        # The state whose runs include the one of exactly ``window`` words.
        self.cut = list(range(len(self.next)))
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                self.cut[s] = self.cut[self.link[s]]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the runs that end p's move by c and are at most one longer than p's."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [begin, end) of hit words, merged and in order, and the names of the items whose windows occur."""
        spans: list[list[int]] = []
        found: set = set()
        moves, link, length, window, ending, cut, names = self.next, self.link, self.length, self.window, self.ending, self.cut, self.names
        state = run = 0
        for at, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = run = 0
                continue
            here = moves[state]
            while c not in here and state:
                state = link[state]
                run, here = length[state], moves[state]
            if c in here:
                state = here[c]
                run += 1
            else:
                continue
            hit = 0
            if run >= window:
                hit = window
                found |= names[cut[state]]
            if ending[state]:
                for n, who in ending[state]:
                    if n <= run:
                        hit = max(hit, n)
                        found |= who
            if hit:
                begin = at + 1 - hit
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = at + 1
                else:
                    spans.append([begin, at + 1])
        return spans, found


@lru_cache(maxsize=2)
def build(items: tuple, window: int) -> Automaton:
    """One automaton per worker and block."""
    return Automaton([(name, words_of(text)) for name, text in items], window)


def merge(one: list, two: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted([*one, *two]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(items: DataFrame, id: str, text: str, window: int, block_words: int):
    """Tuples of (name, text) with at most ``block_words`` words each; one block at a time reaches the driver."""
    small_batches(items.sparkSession)
    rows = items.select(column(items, id).alias("item"), column(items, text).alias("text")).filter("text is not null")

    def pieces(batches):
        for batch in batches:
            out = []
            for name, value in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                words = words_of(value)
                step = max(block_words - window + 1, 1)
                for at in range(0, max(len(words) - window + 1, 1) if words else 0, step):
                    part = words[at:at + step + window - 1]
                    out.append((name, b" ".join(part), len(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (batch.schema.field(0).type, pa.binary(), pa.int64()))], names=["item", "text", "n"])

    kind = rows.schema["item"].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("text", T.BinaryType()), T.StructField("n", T.LongType())])
    held, n = [], 0
    for r in rows.mapInArrow(pieces, schema).toLocalIterator():
        if held and n + r["n"] > block_words:
            yield tuple(held)
            held, n = [], 0
        held.append((r["item"], bytes(r["text"])))
        n += r["n"]
    if held:
        yield tuple(held)


def scan(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         names: tuple[str, str, str] = ("n_words", "spans", "items"), block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with the number of words of its text, the merged spans [begin, end) of hit words, and the ids of the items found
    (as strings, sorted). No shuffle: each block is a map over the documents."""
    sc = df.sparkSession.sparkContext
    span = T.ArrayType(T.ArrayType(T.LongType()))
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], span), T.StructField(names[2], T.ArrayType(T.StringType()))]
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]

    def stage(held):
        def make():
            automaton = build(held.value, window) if held else None

            def work(values, *before):
                out = []
                earlier = zip(*(c.to_pylist() for c in before)) if before else iter(lambda: ([], []), None)
                for value, (spans, found) in zip(byte_list(values), earlier):
                    words = words_of(value)
                    new, who = automaton.scan(words) if automaton else ([], set())
                    out.append((len(words), merge(spans, new) if spans else new, sorted({*found, *(str(x) for x in who if x is not None)})))
                return [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]

            return work

        return make

    out = None
    for k, block in enumerate(blocks(items, item_id, item_text, window, block_words)):
        if k and k % CHAINED == 0:
            out = cut_lineage(out)
        held = sc.broadcast(block)
        if out is None:
            out = append_columns(df, [text], fields, stage(held))
        else:
            again = append_columns(out, [text, names[1], names[2]], [T.StructField(f"{f.name}_next", f.dataType) for f in fields], stage(held))
            out = again.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{f.name}_next`").alias(f.name) for f in fields])
    return out if out is not None else append_columns(df, [text], fields, stage(None))


def n_hit(spans: str):
    """Words inside the spans of this column."""
    return F.aggregate(F.col(f"`{spans}`"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(n_words: str, spans: str, share: int = 20):
    """At least one word hit, and at least one in ``share`` of all words."""
    hit = n_hit(spans)
    return (hit > 0) & (hit * share >= F.col(f"`{n_words}`"))


def keep_clean(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows that are not contaminated, as they are."""
    names = tuple(fresh(df, "n_words", "spans", "items"))
    found = scan(df, items, text, item_id, item_text, window, names)
    return found.filter(~contaminated(names[0], names[1], share)).select(*[F.col(f"`{c}`") for c in df.columns])


def cut_spans(df: DataFrame, text: str = "text", spans: str = "spans", max_span: int = WINDOW) -> DataFrame:
    """``df`` (from :func:`scan`) with every span of at least ``max_span`` words cut out of its text, white space around it kept."""
    (name,) = fresh(df, "cut_text")

    def make():
        import re

        pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

        def work(values, marks):
            out = []
            for value, cuts in zip(byte_list(values), marks.to_pylist()):
                cuts = [c for c in cuts or () if c[1] - c[0] >= max_span]
                if value is None or not cuts:
                    out.append(value)
                    continue
                places = [m.span() for m in pattern.finditer(value)]
                parts, at = [], 0
                for a, b in cuts:
                    parts.append(value[at:places[a][0]])
                    at = places[b - 1][1]
                out.append(b"".join([*parts, value[at:]]))
            return [pa.array(out, pa.binary()).cast(pa.string())]

        return work

    out = append_columns(df, [text, spans], [T.StructField(name, T.StringType())], make)
    return out.select(*[(F.col(f"`{name}`").alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])
