"""Operator 10, packing by bounded-space online best fit.

Each partition keeps OPEN windows of WINDOW tokens. A document's tokens beyond whole windows are cut off as whole
windows; the rest goes to the open window with the least room that holds it. If none holds it, the fullest window is
topped up with the rest's first tokens and emitted, and the remaining tokens try again (a fresh window takes the place of the
emitted one). At a partition's end its open windows are leftovers: they are poured together into whole windows, and
what still is no whole window goes to a second stage that pours the leftovers of MERGE partitions together. Its last tokens are cut
into sequences whose lengths are powers of two, which need no padding. So no sequence is padded at all.

Pieces are written to the shared folder between the stages, so that a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

WINDOW, OPEN, MERGE = 4096, 32, 64
END_ID = 2
CACHE_WORDS, BATCH_RUNS = 1_200_000, 4096
SLICE_BYTES = 8 << 20
MARK = r"([a-z])([.,;:!?|#*])"
# Texts on which a tokenizer must split as Encoder.runs does: case, white space, marks, digits, marks within words, other scripts, special tokens.
PROBES = ("Ab cD. e,f G!h", "tab\tline\n two  blanks ", "it's 3.14 a-b c_d (e) #f g#h *i* j|k", "\u00c9t\u00e9 na\u00efve \u65e5\u672c\u8a9e stra\u00dfe", "x<|y |> <|pad|> Z", "word" * 40, ".,;:!?", "A.B.C. u.s.a")
TOKENIZER = "word_bpe_49k.json"
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())]
)
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, left boolean"
Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, doc_tokens


class Encoder:
    """32-bit ids of whole texts.

    The tokenizer lower-cases, drops white space and never joins letters with white space or with the marks in MARK, so
    runs between these are encoded once and remembered by the worker process (CACHE_WORDS of them, then anew): a run's
    ids are a stretch of one array. A slice of texts is split into runs and its distinct runs are looked up, both
    without a loop over words. Runs of letters are one unit to the tokenizer each and are encoded many at a time.
    """

    shared: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it owns
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        for probe in PROBES:
            made = self.ids(pa.array([probe]))[0][:-1].tolist()
            if made != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path} splits texts in another way than this encoder")
        self.forget()

    def forget(self) -> None:
        """Known runs by number; the first two are the empty run and the end of a text."""
        self.known = {"": 0}
        self.flat, self.first = np.array([END_ID], "<u4"), np.array([0, 0, 1])

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    @staticmethod
    def runs(texts: pa.Array) -> pa.ListArray:
        """The runs of each text. A special token must not be made by lower-casing, nor cut: texts that may hold one are split at white space only."""
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r"\1 \2")
        special = pc.match_substring(texts, "<|")
        return pc.ascii_split_whitespace(pc.if_else(special, texts, cut) if pc.any(special).as_py() else cut)

    def learn(self, runs: pa.Array) -> None:
        """Remember the ids of new, distinct runs."""
        letters = pc.utf8_is_alpha(runs)
        words, rest = runs.filter(letters).to_pylist(), runs.filter(pc.invert(letters)).to_pylist()
        names: list[str] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for at in range(0, len(words), BATCH_RUNS):
            part = words[at : at + BATCH_RUNS]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            made, unit = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1, [len(made)]))
            if len(cuts) == len(part) + 1:
                names += part
                ids.append(made)
                sizes.append(np.diff(cuts))
            else:
                rest += part
        for at in range(0, len(rest), BATCH_RUNS):
            made = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(rest[at : at + BATCH_RUNS], add_special_tokens=False)]
            ids += made
            sizes.append(np.array([len(x) for x in made]))
        names += rest
        self.known.update(zip(names, range(len(self.first) - 1, len(self.first) - 1 + len(names)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate([self.flat, *ids])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's followed by END_ID; offsets of the texts into them). No text is null."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = self.runs(texts)
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        number = np.array([self.known.get(r, -1) for r in distinct.to_pylist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            asked = distinct.take(pa.array(new))
            self.learn(asked)
            number[new] = [self.known[r] for r in asked.to_pylist()]
        number = np.append(number, 1)
        first = self.first[number]
        size = self.first[number + 1] - first
        runs = np.insert(coded.indices.to_numpy(), ends[1:] - ends[0], len(number) - 1)
        sizes = size[runs]
        upto = np.cumsum(sizes)
        at = np.repeat(first[runs] - upto + sizes, sizes)
        at += np.arange(len(at))
        last = ends[1:] - ends[0] + np.arange(len(texts))
        return self.flat[at], np.concatenate(([0], upto[last])).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, without END_ID."""
        ids, ends = self.ids(pa.array(texts, pa.string()))
        return [ids[a : b - 1].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Packer:
    """Open windows of one partition; done holds (pieces, is left over) of emitted sequences."""

    def __init__(self) -> None:
        self.open: list[tuple[int, list[Piece]]] = []
        self.done: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        while len(ids) >= 4 * WINDOW:
            self.done.append([(doc, start, ids[: 4 * WINDOW], total)])
            start, ids = start + WINDOW, ids[4 * WINDOW :]
        if not ids:
            return
        size = len(ids) // 4
        fits = [(WINDOW - used, k) for k, (used, _) in enumerate(self.open) if used + size <= WINDOW]
        if len(self.open) < OPEN and (not fits or min(fits)[0] > size):
            self.open.append((size, [(doc, start, ids, total)]))
        elif fits:
            k = min(fits)[1]
            self.open[k][1].append((doc, start, ids, total))
            self.open[k] = (self.open[k][0] + size, self.open[k][1])
            if self.open[k][0] == WINDOW:
                self.done.append(self.open.pop(k)[1])
        else:
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            room = WINDOW - used
            self.done.append([*pieces, (doc, start, ids[: 4 * room], total)])
            self.add((doc, start + room, ids[4 * room :], total))

    def leftovers(self) -> list[Piece]:
        """What the open windows hold, in order, once whole windows are poured from it."""
        left = pour([p for _, pieces in self.open for p in pieces], self.done)
        self.open = []
        return left


def pour(pieces: list[Piece], done: list[list[Piece]], sizes: tuple[int, ...] = (WINDOW,)) -> list[Piece]:
    """Fill sequences of the given sizes from left to right, as many of each as the pieces fill; return the rest."""
    left = sum(len(p[2]) for p in pieces) // 4
    pieces = pieces[::-1]
    for size in sizes:
        while left >= size:
            room, filled = size, []
            while room:
                doc, start, ids, total = pieces.pop()
                take = min(room, len(ids) // 4)
                filled.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    pieces.append((doc, start + take, ids[4 * take :], total))
                room -= take
            done.append(filled)
            left -= size
    return pieces[::-1]


def rows(sequences: list[list[Piece]], first_id: int, left: bool) -> pa.RecordBatch:
    out = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, ids, total, first_id + k, offset, left))
            offset += len(ids) // 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)] if out else [pa.array([], f.type) for f in PIECES], schema=PIECES)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and END_ID, so an empty document is one token; each token is
    in exactly one piece. Sequences hold WINDOW tokens or a power of two. Repeated rows are packed once each. Other
    columns are ignored. An empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = Encoder.of(tokenizer_path), Packer()
        base = TaskContext.get().partitionId() << 40
        number = 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            upto = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
                ids, ends = encoder.ids(texts.slice(at, end - at))
                for doc, first, last in zip(batch.column(0).slice(at, end - at).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    packer.add((doc, 0, ids[first:last].tobytes(), last - first))
                at = end
                if packer.done:
                    yield rows(packer.done, base + number, False)
                    number, packer.done = number + len(packer.done), []
        left = packer.leftovers()
        if packer.done:
            yield rows(packer.done, base + number, False)
            number += len(packer.done)
        if left:
            yield rows([left], base + number, True)

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        columns = [part.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        done: list[list[Piece]] = []
        pour(list(zip(*columns, strict=True)), done, tuple(2**k for k in range(WINDOW.bit_length() - 1, -1, -1)))
        return pa.Table.from_batches([rows(done, (1 << 62) + (key[0].as_py() << 40), False)])

    packed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, DDL), "packed")
    groups = packed.filter("left").withColumn("group", F.shiftright("sequence_id", 40 + MERGE.bit_length() - 1))
    poured = groups.groupBy("group").applyInArrow(merge, DDL)
    return packed.filter("not left").unionByName(poured).drop("left")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_file()))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
