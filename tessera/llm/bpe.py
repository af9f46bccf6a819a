"""BPE encoding and decoding through a table of distinct words.

Texts are split into words and these into pieces that the tokenizer never merges across, each
distinct piece of the corpus is encoded once, and its ids are joined back by position. A bounded number of the most
frequent pieces (``Params.head``) is broadcast; these cover most positions, and every very
frequent one. The positions of all other pieces are shuffled by piece to the table and back by
document. The ids of each distinct piece are joined with the vocabulary's id-to-piece table, whose size the vocabulary
file fixes, so what a piece decodes to is known once for all its positions; a text decodes to what its pieces do, joined by position.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, text_slices
from tessera.scratch import materialize


def _letters(kind: str) -> str:
    """The characters below U+0180 of a general category, as a regex class holds them."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: The pre-tokenizer's pattern over lower-cased text of ``PLAIN`` characters, without white space; line ends part words.
PIECES = re.compile(f"\\n|[{_letters('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_letters('N')}]|[^\\x09-\\x0D\\x20\\x85\\xa0{_letters('L')}{_letters('N')}]+")
#: Text in which normalization only lower-cases single characters: no combining marks, nothing that
#: composes or grows, no special token, no white space that libraries differ on. A word outside it is
#: a piece as it stands, and the library sees all of it.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\xA0-įı-ž]*")
SPECIAL = "<|"


@dataclass(frozen=True)
class Params:
    """``tokenizer``: the file's path. ``head``: distinct pieces to broadcast at most."""

    tokenizer: str
    head: int = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_pieces(text: str) -> list[str]:
    """Pieces whose encodings, one after the other, are the text's encoding."""
    out: list[str] = []
    for word in re.split(r"[\x09-\x0D\x20]+", text):
        if not word:
            continue
        if SPECIAL not in word and PLAIN.fullmatch(word):
            out += PIECES.findall(word.lower())
        else:
            out.append(word)
    return out


class Numbers(dict):
    """Pieces numbered as they are asked for; 0 is the line end that parts words."""

    def __init__(self, pieces: list[str]) -> None:
        super().__init__({"\n": 0})
        for piece in pieces:
            self[piece]
        self.base = len(self)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n

    def added(self) -> list[str]:
        return list(islice(self, self.base, None))


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STRETCH = 1 << 18


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends and 128 bits of its hash, a bounded stretch at a time."""
    found, at, n = [], 0, len(joined)
    while at < n:
        end = min(n, at + _STRETCH)
        if end < n:  # a stretch ends between words
            gap = _GAP.search(joined, end)
            end = gap.start() if gap else n
        raw = np.frombuffer(joined, np.uint8, end - at, at)
        solid = np.concatenate(([False], ~_IS_GAP[raw], [False]))
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, stop = edge[::2], edge[1::2]
        hashes, values, total = [], raw.astype(np.uint64) + np.uint64(1), np.zeros(len(raw) + 1, np.uint64)
        for base in _BASES:
            power, inverse = _powers(base, max(2 * _STRETCH, 1 << len(raw).bit_length()))
            np.cumsum(values * power[: len(raw)], out=total[1:])
            hashes.append((total[stop] - total[start]) * inverse[start])
        found.append((start + at, stop + at, *hashes))
        at = end
    cat = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    return cat[0], cat[1], cat[2], cat[3]


def distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, each word's place among them, and each text's number of words."""
    joined = b"\n".join(texts)
    start, stop, one, two = word_hashes(joined)
    code, _ = pd.factorize(one)
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    if not (two == two[first[code]]).all():  # half of the hashes agree by chance
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(joined[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.int64, len(start))
        words = list(known)
    else:
        words = [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, code, np.diff(np.searchsorted(start, ends), prepend=0)


def number_words(words: list[bytes], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words' pieces, word after word, and how many each has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = b"\n".join(words).decode()
    if SPECIAL not in text and PLAIN.fullmatch(text):
        pieces = PIECES.findall(text.lower())
    else:
        pieces = [x for word in text.split("\n") for x in (*split_pieces(word), "\n")][:-1]
    flat = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
    parted = np.flatnonzero(flat == 0)
    return flat[flat != 0], np.diff(np.concatenate(([-1], parted, [len(flat)]))) - 1


def _take(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``which`` names, one after the other."""
    n = length[which]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(start[which], n) + step]


_HELD = 1 << 18  # pieces outside the head that a task numbers before it starts anew


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their counts, some more than once."""
    numbers, n = Numbers([]), np.zeros(1, np.int64)

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers.added(), pa.string()), pa.array(n[1:])], names=["piece", "n"])

    for part in (part for batch in batches for part in text_slices(batch)):
        words, code, _ = distinct_words(as_bytes(part, "text"))
        flat, length = number_words(words, numbers)
        times = np.bincount(code, minlength=len(words))
        more = np.bincount(flat, np.repeat(times, length), len(numbers)).astype(np.int64)
        more[: len(n)] += n
        n = more
        if len(numbers) > _HELD:
            yield counted()
            numbers, n = Numbers([]), np.zeros(1, np.int64)
    yield counted()


def piece_table(docs: DataFrame, p: Params) -> DataFrame:
    """``piece, n, ids, text``: every distinct piece of the texts, encoded once and decoded by a join of its ids with the vocabulary.

    ``ids``: unsigned 32-bit integers; ``text``: null where there are none.
    """
    pieces = docs.select("text").mapInArrow(_count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(p.tokenizer)
        for batch in batches:
            found = t.encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)
            ids = [np.array(e.ids, "<u4").tobytes() for e in found]
            each = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), each], names=["piece", "n", "ids", "each"])

    coded = pieces.mapInArrow(encode, "piece string, n long, ids binary, each array<int>")
    tokens = coded.select("piece", "n", "ids", F.posexplode_outer("each").alias("place", "id")).join(F.broadcast(vocabulary(docs.sparkSession, p)), "id", "left")
    return materialize(tokens.groupBy("piece", "n", "ids").agg(joined_tokens().alias("text")), "bpe-pieces")


def vocabulary(spark: SparkSession, p: Params) -> DataFrame:
    """``id, token``: the id-to-piece table, bounded by the vocabulary file."""
    return spark.createDataFrame(list(enumerate(id_pieces(p.tokenizer))), "id int, token string")


def joined_tokens() -> Column:
    """The tokens of a group in order of ``place``, one blank between them, as a tokenizer without a decoder gives them; null without any."""
    listed = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "token")))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(F.array_sort(listed), lambda x: x["token"]), " "))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The pieces above the least frequency that at most ``most`` have; found from a histogram of a few hundred rows."""
    grade = F.floor(F.log2("n") * 16)
    rows = sorted(((r["g"], r["c"]) for r in table.groupBy(grade.alias("g")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for g, c in rows:
        held += c
        if held > most:
            break
        least = g
    return table.where(grade >= least) if least is not None else table.limit(0)


def id_pieces(path: str) -> list[str]:
    """The id-to-piece table; an id without a piece is skipped in decoding."""
    t = load(path)
    vocab = t.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


class _Head:
    """The broadcast pieces from the most frequent down, numbered from 1, their ids side by side, and what they decode to."""

    def __init__(self, pieces: list[str], ids: list[bytes], texts: list[str | None]) -> None:
        self.pieces = pieces
        self.texts = np.array([None, *texts], object)
        self.ids = np.frombuffer(b"".join(ids), "<u4").copy()
        self.length = np.array([0, *[len(i) // 4 for i in ids]], np.int64)  # 0: a piece that isn't here
        self.start = np.cumsum(self.length) - self.length


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^21 in one to three bytes each, small ones in fewer, compressed."""
    n = numbers.astype(np.uint32)
    wide, wider = n >= 1 << 7, n >= 1 << 14
    raw = np.stack((n & 127 | wide.astype(np.uint32) << 7, n >> 7 & 127 | wider.astype(np.uint32) << 7, n >> 14), 1).astype(np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(raw[np.stack((np.ones(len(n), bool), wide, wider), 1)].tobytes())


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], raw[:-1] < 128)))
    size = np.diff(np.append(first, len(raw)))
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, size))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, first)


_CHUNKS = "chunk long, doc_id array<long>, n_pieces array<int>, pieces binary"
_TAILS = "chunk long, place int, piece string"


def _lookup(shared, tails: bool, docs_per_chunk: int = 64):
    """Chunks of documents as numbers of the head's pieces, 0 where the head lacks one or, with ``tails``, a row
    for each of these with its piece.

    A chunk's name holds a hash of its texts and ids. If two scans cut their rows into other chunks, names
    don't meet and ``assemble`` fails, so a place never gets the ids of another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value.pieces)
        base = numbers.base
        number = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in text_slices(whole)):
            if len(numbers) > base + _HELD:
                numbers = Numbers(shared.value.pieces)
            texts, ids = as_bytes(batch, "text"), batch.column("doc_id").to_pylist()
            words, code, counts = distinct_words(texts)
            flat, length = number_words(words, numbers)
            start = np.cumsum(length) - length
            added = numbers.added() if tails else []
            rows: list[tuple] = []
            first_word = 0
            for at in range(0, len(counts), docs_per_chunk):
                part = counts[at : at + docs_per_chunk]
                own = code[first_word : first_word + int(part.sum())]
                first_word += len(own)
                of = _take(flat, start, length, own)
                content = xxhash.xxh64(b"\n".join(texts[at : at + docs_per_chunk]), number % (1 << 64))
                content.update(repr(ids[at : at + docs_per_chunk]))
                chunk = content.intdigest() - (1 << 63)
                if tails:
                    slots = (of[of >= base] - base).tolist()
                    rows += zip([chunk] * len(slots), range(len(slots)), [added[i] for i in slots], strict=True)
                else:
                    per = np.bincount(np.repeat(np.arange(len(part)), part), length[own], len(part)).astype(np.int32)
                    rows.append((chunk, ids[at : at + docs_per_chunk], per, pack(np.where(of >= base, 0, of))))
                number += 1
            kinds = [pa.int64(), pa.int32(), pa.string()] if tails else [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = ["chunk", "place", "piece"] if tails else ["chunk", "doc_id", "n_pieces", "pieces"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def weave(head: _Head, pieces: np.ndarray, n_pieces: list[int], extra: list[bytes]) -> list[np.ndarray]:
    """The ids of a chunk's documents: those of the head's pieces, and ``extra`` where there is a 0, in order."""
    size = head.length[pieces]
    ids = _take(head.ids, head.start, head.length, pieces)
    if extra:
        slot = np.flatnonzero(pieces == 0)
        more = np.array([len(e) // 4 for e in extra])
        ids = np.insert(ids, np.repeat((np.cumsum(size) - size)[slot], more), np.frombuffer(b"".join(extra), "<u4"))
        size[slot] = more
    ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n_pieces)]
    return np.split(ids, ends[:-1])


def weave_texts(head: _Head, pieces: np.ndarray, n_pieces: list[int], extra: list[str | None]) -> list[str]:
    """What a chunk's documents decode to: what their pieces do, those without a token left out."""
    texts = head.texts[pieces]
    texts[pieces == 0] = extra
    return [" ".join([t for t in one if t is not None]) for one in np.split(texts, np.cumsum(n_pieces)[:-1])]


def encoded(docs: DataFrame, p: Params, schema: str, make: Callable[[np.ndarray, str], tuple]) -> DataFrame:
    """A row for each document: its ``doc_id`` and what ``make`` gives for the ids of its whole text and what these decode to.

    A null text is empty; equal rows stay apart; an empty table gives none; other columns are not
    read. ``docs`` is scanned twice and has to give its rows in the same order, as a table read
    from files does; if it doesn't, the job fails instead of giving wrong ids.
    """
    slim = docs.select("doc_id", "text")
    table = piece_table(slim, p)
    if not 0 <= p.head < 1 << 21:
        raise ValueError("the head has to be below 2^21 pieces")
    top = frequent(table, p.head).toArrow().sort_by([("n", "descending"), ("piece", "ascending")])
    shared = docs.sparkSession.sparkContext.broadcast(_Head(top["piece"].to_pylist(), top["ids"].to_pylist(), top["text"].to_pylist()))
    tails = slim.mapInArrow(_lookup(shared, True), _TAILS)
    found = tails.join(table.select("piece", "ids", "text"), "piece").select("chunk", "place", "ids", "text")
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]

    def assemble(key: tuple, heads: pa.Table, extra: pa.Table) -> pa.Table:
        extra = extra.take(pc.sort_indices(extra["place"]))
        pieces, texts = extra["ids"].to_pylist(), extra["text"].to_pylist()
        if heads.num_rows != 1:
            raise ValueError("two scans of the documents gave their rows in another order: write them as a table first")
        (row,) = heads.to_pylist()
        numbers = unpack(row["pieces"])
        if len(pieces) != int((numbers == 0).sum()):
            raise ValueError("pieces are missing: write the documents as a table first")
        back = weave_texts(shared.value, numbers, row["n_pieces"], texts)
        each = [make(ids, text) for ids, text in zip(weave(shared.value, numbers, row["n_pieces"], pieces), back, strict=True)]
        arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*each, strict=True), fields, strict=True)]
        return pa.table([pa.array(row["doc_id"], pa.int64()), *arrays], names=["doc_id", *[n for n, _ in fields]])

    heads = slim.mapInArrow(_lookup(shared, False), _CHUNKS)
    return heads.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(assemble, f"doc_id long, {schema}")


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, p: Params, with_ids: bool = False) -> DataFrame:
    """``doc_id``, the number of tokens, the SHA-256 of the ids and of the decoded text, and if asked the ids."""

    def make(ids: np.ndarray, text: str) -> tuple:
        out = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        return (*out, ids.astype(np.int32)) if with_ids else out

    return encoded(docs, p, _DIGEST + ", ids array<int>" * with_ids, make)


def token_ids(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of each row's whole text."""
    return encoded(docs, p, "ids array<int>", lambda ids, _: (ids.astype(np.int32),))


def decoded_texts(ids: DataFrame, p: Params) -> DataFrame:
    """``doc_id`` and the decoded ``text`` of rows ``(doc_id, ids)``: ids are joined with the vocabulary's id-to-piece table.

    Null ids decode to an empty text; equal rows stay apart; an empty table gives none. The vocabulary
    file bounds the table that is broadcast.
    """
    rows = materialize(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"), "bpe-ids")
    each = rows.select("row", F.posexplode("ids").alias("place", "id")).join(F.broadcast(vocabulary(ids.sparkSession, p)), "id")
    texts = each.groupBy("row").agg(joined_tokens().alias("text"))
    return rows.join(texts, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op6_bpe(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """Number of tokens and digests of the ids and the decoded text of each row's whole text; see ``encoded`` for odd rows."""
    return digests(docs, p or Params(default_path()))
