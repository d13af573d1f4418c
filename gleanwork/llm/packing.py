"""Harmonic packing of tokenised documents into sequences.

A piece of length l belongs to class k = capacity // l, so l lies in (capacity / (k + 1), capacity / k],
and every sequence of class k takes exactly k pieces. Documents may be cut, so lengths are made to
fit the classes: a document gives full sequences first; of the rest, a piece is left whole if its
class wastes little, else the largest capacity // k that fits is cut off, and so on. Waste is then a
few tokens in most sequences, and at most one sequence per class is unfinished: these few are packed
again by first fit.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, worker_cache

CAPACITY = 2048
SLACK = 64  # a rest is left whole if it wastes at most a 64th of its share of a sequence
SMALLEST = 32  # a rest of at most so many tokens is never cut
CACHE = 500_000  # words in a generation of those whose ids a worker remembers: some 100 MB
TOGETHER = 1 << 21  # characters of texts whose new words are learned at once
HELD = 1 << 20  # ids, or 16 of them a piece without ids, that a worker holds before it hands them on
END_ID = 1
SEPARATOR = "<|startoftext|>"
#: Words whose letters and marks the pre-tokeniser always parts, with letters that are their own normal form but for case.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,|]*)")


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        share = capacity // (capacity // rest)
        if rest <= SMALLEST or (share - rest) * SLACK <= share:
            out.append(rest)
            break
        piece = capacity // (capacity // rest + 1)
        out.append(piece)
        rest -= piece
    return out


#: The steps of a tokenizer file for which words can be encoded one by one and LETTERS holds.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class _Ids(dict):
    """The ids of words, in two generations: when the younger is full, it becomes the older, and words that are used return."""

    old: dict[str, bytes] = {}
    most: int | None = None

    @property
    def room(self) -> int:
        return CACHE if self.most is None else self.most

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.old[word]
        return ids

    def make_room(self, n: int) -> None:
        if len(self) + n > self.room:
            self.old = dict(self)
            self.clear()


class PlainEncoder:
    """The ids that any tokenizer gives, text by text."""

    def __init__(self, one) -> None:
        self.one = one

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        for t in texts:
            yield np.array(self.one.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


class WordEncoder:
    """The ids that a tokenizer of white-space-separated words gives, with the ids of words remembered.

    Its normaliser and pre-tokeniser drop white space and never join characters across it, so a
    text's ids are those of its words in order. Words that are new are encoded together, kept apart
    by a special token. fits() tells whether a tokenizer is of this kind.
    """

    def __init__(self, one) -> None:
        self.one = one
        self.separator = one.token_to_id(SEPARATOR)
        self.ids = _Ids()

    @staticmethod
    def fits(file: dict) -> bool:
        """By the tokenizer's own file: it normalises and parts texts in the steps known here, and has the separator as a special token."""

        def kinds(step: dict | None, inner: str) -> list[dict]:
            return [y for x in step[inner] for y in kinds(x, inner)] if step and inner in step else [step] if step else []

        normal, parts = kinds(file.get("normalizer"), "normalizers"), kinds(file.get("pre_tokenizer"), "pretokenizers")
        special = any(x.get("content") == SEPARATOR and x.get("special") and not x.get("normalized") and not x.get("lstrip") and not x.get("rstrip") for x in file.get("added_tokens") or [])
        return special and normal == NORMALIZER and parts == PRE_TOKENIZER

    def _learn(self, words: set[str]) -> None:
        self.ids.make_room(2 * len(words))
        alone, joined = set(), []
        for w in words:
            if (m := LETTERS.fullmatch(w)) and (m[2] or not m[1].islower()):
                joined.append((w, m[1].lower(), m[2]))
            else:
                alone.add(w)
        parts = {x for _, *both in joined for x in both if x not in self.ids and x not in self.ids.old}
        self._encode(alone | parts)
        for w, letters, marks in joined:
            self.ids[w] = self.ids[letters] + self.ids[marks]

    def _encode(self, words: set[str]) -> None:
        plain = [w for w in words if "<|" not in w and "|>" not in w]
        for w in words.difference(plain):
            self.ids[w] = np.array(self.one.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        for at in range(0, len(plain), 64):
            some = plain[at : at + 64]
            ids = np.array(self.one.encode_batch_fast([SEPARATOR.join(some)], add_special_tokens=False)[0].ids, "<u4")
            edge = np.flatnonzero(ids == self.separator).tolist()
            for w, i, j in zip(some, [-1, *edge], [*edge, len(ids)], strict=True):
                self.ids[w] = ids[i + 1 : j].tobytes()

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. New words are learned for some texts at a time."""
        held, size = [], 0
        for t in texts:
            # All that is split on is white space to the tokenizer too.
            held.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
            size += len(t)
            if size >= TOGETHER:
                yield from self._all(held)
                held, size = [], 0
        yield from self._all(held)

    def _all(self, split: list[list[str]]) -> Iterator[bytes]:
        if new := set(filterfalse(self.ids.old.__contains__, filterfalse(self.ids.__contains__, set().union(*split)))):
            self._learn(new)
        for words in split:
            yield self._join(words)

    def _join(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:  # learning has made room by forgetting: then part by part, each small enough to stay known
            out = []
            step = max(1, self.ids.room // 4)
            for at in range(0, len(words), step):
                some = words[at : at + step]
                while lost := {w for w in some if w not in self.ids and w not in self.ids.old}:
                    self._learn(lost)
                out.append(b"".join(map(self.ids.__getitem__, some)))
            return b"".join(out)


def encoder(path: str, cache: int | None = None) -> WordEncoder | PlainEncoder:
    held = worker_cache("packing")
    if path not in held:
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held[path] = (WordEncoder if WordEncoder.fits(json.load(f)) else PlainEncoder)(one)
    if isinstance(held[path], WordEncoder):
        held[path].ids.most = cache
    return held[path]


def _tokenize(path: str, capacity: int, with_ids: bool, cache: int | None):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
    kinds = (pa.int64(),) * 5 + (pa.list_(pa.int32()),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache)
        for batch in batches:
            rows, held = [], 0
            # Texts leave Arrow one by one; what is held of them and of their pieces is bounded.
            texts = ((t.as_py() or "") for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(texts)):
                ids += END_ID.to_bytes(4, "little")
                start, total = 0, len(ids) // 4
                for n in cuts(total, capacity):
                    piece = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(piece), total, np.frombuffer(piece, "<u4").astype(np.int32) if with_ids else None))
                    start, held = start + n, held + (n if with_ids else 16)
                if held >= HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*columns])

    return run


def _first_fit(capacity: int):
    """The pieces of the classes' unfinished sequences, largest first, each into the first sequence with room."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "piece"], ascending=[False, True, True, True]).reset_index(drop=True)
        room: list[int] = []
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        full = 0  # sequences before it have no room left
        for i, n in enumerate(pdf["length"].tolist()):
            k = next((k for k in range(full, len(room)) if room[k] >= n), len(room))
            if k == len(room):
                room.append(capacity)
            sequence[i], offset[i] = k, capacity - room[k]
            room[k] -= n
            while full < len(room) and not room[full]:
                full += 1
        return pdf.assign(sequence=sequence, offset=offset)[["piece", "sequence", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, cache: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its token ids (tokenizer: path of a word tokenizer's file), then id 1. Sequences
    hold at most `capacity` ids; offset counts the ids before the piece in its sequence. cache: how many
    words' ids a worker remembers, twice over (default CACHE); it changes nothing but speed and memory.

    Workers tokenise and cut their own documents, and know the class of each piece from its length
    alone. Numbering pieces within (worker's partition, class), and adding up the counts of the
    partitions before, gives each piece its sequence: no worker waits for another's pieces. Only
    counts by partition and class, and the fewer than k pieces left over in each class k, are
    brought together.

    Nulls: a null text is empty, so the document is id 1 alone. A null id is kept as null. Repeated
    rows are packed as often as they occur. An empty table gives no rows; other columns of docs are
    ignored. Texts of any length are read whole.
    """
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _tokenize(tokenizer, capacity, with_ids, cache), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    )
    number = F.monotonically_increasing_id()
    pieces = pieces.withColumn("piece", number).withColumn("part", F.shiftright("piece", 33))
    pieces = cut(pieces.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long")), "pieces")

    counts = pieces.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    per_class = Window.partitionBy("k").orderBy("part")
    before = F.coalesce(F.sum("n").over(per_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.withColumn("before", before).withColumn("total", F.sum("n").over(Window.partitionBy("k"))), "counts")
    in_part = Window.partitionBy("k", "part").orderBy("piece")
    placed = pieces.drop("ids").withColumn("rank", F.row_number().over(in_part) - 1)
    placed = placed.join(counts, ["k", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = placed.withColumn("bin", F.floor(F.col("rank") / F.col("k")).cast("long"))
    whole = (F.col("bin") + 1) * F.col("k") <= F.col("total")
    placed = cut(placed.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "rank", "bin", whole.alias("whole")), "placed")

    # Sequences are numbered class after class; there are at most `capacity` classes.
    totals = counts.select("k", "total").distinct()
    by_class = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    classes = totals.select("k", F.coalesce(F.sum(F.floor(F.col("total") / F.col("k"))).over(by_class), F.lit(0)).alias("first"))
    end = totals.agg(F.coalesce(F.sum(F.floor(F.col("total") / F.col("k"))), F.lit(0)).cast("long").alias("end"))
    in_bin = Window.partitionBy("k", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    done = placed.filter("whole").withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    done = done.join(F.broadcast(classes), "k").withColumn("sequence_id", F.col("first") + F.col("bin"))
    left = placed.filter("NOT whole").select("piece", "doc_id", "start", "length")
    fitted = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_first_fit(capacity), "piece long, sequence long, offset long")
    rest = placed.filter("NOT whole").join(fitted, "piece").crossJoin(F.broadcast(end)).withColumn("sequence_id", F.col("end") + F.col("sequence"))
    columns = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = done.select(columns).union(rest.select(columns))
    if with_ids:
        out = out.join(pieces.select("piece", "ids"), "piece")
    return out.drop("piece").withColumn("sequence_id", F.col("sequence_id").cast("long"))
