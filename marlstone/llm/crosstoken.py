"""Alignment of two tokenizers over the same texts: groups of tokens that end together, and links between tokens that overlap.

Both tokenizers read a space and the text, A a byte-level BPE (``tokenizers`` JSON), B a piece model (``sentencepiece``, which adds
the space). The cumulative byte ends of the tokens go into end-to-index dictionaries; the ends that both have, found as a set
intersection and sorted, cut the two id lists into groups, and the links of each slice are expanded by their byte ranges.

A text is aligned in chunks that begin at a space after a visible character, or at a mark after a Latin letter. No token of A crosses
such a place (its pattern has a space only before a word, and letters only with letters), nor one of B as long as no piece has a
space after another character or a mark after a letter, which is looked up in the model; else a text is one chunk. Chunks up to ``KEPT_LENGTH`` characters are aligned once per worker and kept, at most ``KEPT_CHUNKS`` of them.

How many documents hold a linked id pair is counted in Spark: each document's pairs are written once with their number, exploded
and added up. The sums over a document's links look the counts up in two parts. Of R (document, pair) rows fewer than
``FREQUENT`` pairs can have R / FREQUENT documents or more; these are broadcast. The others are joined by a shuffle in which no pair has
more rows than that.

Rows: null and empty texts, and texts whose tokens do not give the bytes back (a literal U+2581), have no tokens: zeros, and an
empty ``groups``. Rows are documents: repeated rows and null or repeated ids count once each. An empty table gives no rows. An input
column with the name of a result column comes back with underscores before its name.
"""

from __future__ import annotations

import gc
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns, byte_list, fresh, making_room
from marlstone.session import written

SPACE = "▁"
RESULT = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
FREQUENT = 1 << 17
KEPT_CHUNKS = 1 << 18
KEPT_LENGTH = 48
#: Before a space that follows a visible character and has something behind it, and between a Latin letter and a mark.
CUT = re.compile(r"(?<=\S)(?= [\s\S])")
MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[^\w\s])")
#: A word that the pattern of A keeps whole.
PLAIN = re.compile("[A-Za-z]+")


@dataclass(frozen=True)
class Vocabularies:
    """Contents of the two vocabulary files; ``b_size`` packs a pair of ids as ``a * b_size + b``."""

    a_json: str
    b_model: bytes
    b_size: int
    packed: T.DataType


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    import sentencepiece
    from tokenizers import Tokenizer

    a_json, b_model = open(a_path, encoding="utf-8").read(), open(b_path, "rb").read()
    size = sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()
    most = Tokenizer.from_str(a_json).get_vocab_size() * size
    return Vocabularies(a_json, b_model, size, T.IntegerType() if most < 1 << 31 else T.LongType())


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes a byte that is a visible Latin-1 character as itself, the others as the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: n_a, n_b, n_groups, the groups as ``a1,a2|b1;a3|b2``, and the links as packed pairs with repeats, 64-bit integers. A plain tuple:
#: the collector of Python's garbage does not look through those again.
Aligned = tuple[int, int, int, str, bytes]


class Aligner:
    def __init__(self, vocabularies: Vocabularies):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.size = vocabularies.b_size
        self.a = Tokenizer.from_str(vocabularies.a_json)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b_model)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.name = [str(i) for i in range(max(self.size, max(self.a_bytes) + 1))]
        across = re.compile(f"[^{SPACE}]{SPACE}|{MARK.pattern}")
        as_written = "ﬁ e\u0301"
        self.first = self.b.encode("a")
        self.in_chunks = (len(self.first) == 1 and self.b.decode(self.b.encode(as_written)) == as_written
                          and not any(across.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))))
        self.byte_space = {b: c for c, b in alphabet.items()}[32]
        self.kept: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def chunk(self, whole: str) -> Aligned | None:
        """The tokens of a text from its space on, or of a part of it after a letter; None where they do not give its bytes."""
        if whole[0] == " ":
            ids_b = self.b.encode(whole[1:])
            word = PLAIN.fullmatch(whole, 1)
        else:
            ids_b, word = self.b.encode("a" + whole)[1:], None
        ids_a = [t.id for t in self.model.tokenize(self.byte_space + whole[1:])] if word else self.a.encode(whole, add_special_tokens=False).ids
        parts_a, parts_b = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == whole.encode():
            return None
        index_a = dict(zip(accumulate(map(len, parts_a)), range(1, len(ids_a) + 1)))
        index_b = dict(zip(accumulate(map(len, parts_b)), range(1, len(ids_b) + 1)))
        common = sorted(index_a.keys() & index_b.keys())
        name, size, groups, links, at_a, at_b = self.name, self.size, [], [], 0, 0
        for end in common:
            to_a, to_b = index_a[end], index_b[end]
            if to_a - at_a == 1 and to_b - at_b == 1:
                i, j = ids_a[at_a], ids_b[at_b]
                links.append(i * size + j)
                groups.append(name[i] + "|" + name[j])
            else:
                some_a, some_b = ids_a[at_a:to_a], ids_b[at_b:to_b]
                if len(some_a) == 1 or len(some_b) == 1:
                    links += [i * size + j for i in some_a for j in some_b]
                else:
                    links += overlaps(some_a, some_b, parts_a[at_a:to_a], parts_b[at_b:to_b], size)
                groups.append(",".join([name[i] for i in some_a]) + "|" + ",".join([name[j] for j in some_b]))
            at_a, at_b = to_a, to_b
        return len(ids_a), len(ids_b), len(groups), ";".join(groups), array("q", links).tobytes()

    def look_up(self, text: str) -> Aligned | None:
        """The alignment of a chunk. Parts between marks are kept, in two generations: what is not used again while one fills up goes with it."""
        if len(parts := MARK.split(text)) > 1:
            return joined([self.kept.get(p) or self.look_up(p) for p in parts])
        if len(text) > KEPT_LENGTH:
            return self.chunk(text)
        found = self.older[text] if text in self.older else self.chunk(text)
        if len(self.kept) >= KEPT_CHUNKS:
            self.kept, self.older = {}, self.kept
        self.kept[text] = found
        return found

    def text(self, text: str) -> Aligned | None:
        """The alignment of a whole text; None where it has no tokens."""
        if not text:
            return None
        if not self.in_chunks:
            return self.chunk(" " + text)
        kept, look_up = self.kept.get, self.look_up
        return joined([kept(c) or look_up(c) for c in CUT.split(" " + text)])


def joined(parts: list[Aligned | None]) -> Aligned | None:
    """One alignment of consecutive parts, None if one of them is."""
    if None in parts:
        return None
    n_a, n_b, n_groups, groups, links = zip(*parts)
    return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)


@lru_cache(maxsize=1)
def aligner_of(vocabularies: Vocabularies) -> Aligner:
    """One aligner per worker: later tasks find its vocabularies loaded and its chunks kept. They hold no cycles, so garbage
    is looked for less often and not among them."""
    aligner = Aligner(vocabularies)
    gc.freeze()
    gc.set_threshold(1 << 16)
    return aligner


def overlaps(ids_a: list[int], ids_b: list[int], parts_a: list[bytes], parts_b: list[bytes], size: int) -> list[int]:
    """Packed pairs of the tokens whose byte ranges overlap, of two lists over the same bytes."""
    ends_a, ends_b, out, i, j = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b))), [], 0, 0
    while i < len(ids_a):
        out.append(ids_a[i] * size + ids_b[j])
        end_a, end_b = ends_a[i], ends_b[j]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
    return out


def align(df: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, the groups as text, and the distinct linked pairs with their number; one pass, no shuffle."""
    held = df.sparkSession.sparkContext.broadcast(vocabularies)
    long, packed = T.LongType(), vocabularies.packed
    kind = pa.int32() if isinstance(packed, T.IntegerType) else pa.int64()

    def make():
        aligner = aligner_of(held.value)

        def work(values):
            counts, groups, sizes, pairs, times = [], [], [0], [], []
            for value in byte_list(values):
                found = aligner.text(value.decode()) if value else None
                if found is None:
                    counts.append((0, 0, 0, 0))
                    groups.append("")
                    sizes.append(sizes[-1])
                    continue
                *sums, text_groups, links = found
                counts.append((*sums, len(links) // 8))
                groups.append(text_groups)
                pair, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                sizes.append(sizes[-1] + len(pair))
                pairs.append(pair)
                times.append(n)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times)]
            offsets = pa.array(sizes, pa.int32())
            return [*[pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 4)], pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[0]).cast(kind)), pa.ListArray.from_arrays(offsets, pa.array(flat[1]).cast(pa.int32()))]

        return work

    kinds = [long, long, long, long, T.StringType(), T.ArrayType(packed), T.ArrayType(T.IntegerType())]
    fields = [T.StructField(c, k) for c, k in zip(RESULT, kinds)]
    return append_columns(df, [text], fields, make)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether its A id has no pair with more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    of_a = F.call_function("div", F.col("pair"), F.lit(b_size))
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(df: DataFrame, vocabularies: Vocabularies, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``df``: its columns but the text, those of :func:`align` but the pairs and with the SHA-256 of the groups in
    place of the groups (empty without tokens), n_best and count_sum.

    n_best: links whose pair is in more documents than, or as many as, any pair of the same A id. count_sum: the documents that hold
    each link's pair, summed over links.
    """
    df, (text,) = making_room(df, [*RESULT, "n_best", "count_sum", "groups_sha256"], text)
    row, of = fresh(df, "row", "row_of_sums")
    found = align(df, vocabularies, text).withColumn("groups", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(""))
    aligned = written(found.drop(text).withColumnRenamed("groups", "groups_sha256").withColumn(row, F.monotonically_increasing_id()))
    counts = written(pair_counts(aligned, vocabularies.b_size))
    total = counts.agg(F.sum("n")).head()[0] or 0
    often = F.col("n") * frequent > F.lit(total)
    pairs = aligned.select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    top, rest = F.broadcast(counts.filter(often)), counts.filter(~often)

    def sums(linked):
        return linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    both = sums(pairs.join(top, "pair")).unionByName(sums(pairs.join(top, "pair", "left_anti").join(rest, "pair")))
    sums_of = both.groupBy(F.col("row").alias(of)).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (aligned.drop("pairs", "times").join(sums_of, F.col(row) == F.col(of), "left").drop(row, of)
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}))
