"""Operator 9: cost-balanced packing of tokenised documents."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import in_batches
from touchline.llm.words import BASE, BYTE_VALUES, Texts, runs, span_hashes

LENGTH = 2048
END_ID = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention inside it).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A task packs its documents in blocks of about this many tokens.
BLOCK_TOKENS = 1 << 20
#: Sequences looked at, cheapest first, before a piece is cut.
LOOK = 8
#: Words whose ids a task remembers before it starts afresh.
REMEMBERED = 2_000_000
SPLIT_BYTES = 1 << 20
#: Signs, each a token of its own, that may stand between words.
SIGNS = "\x01\x02\x03\x04\x05\x06\x07"
IS_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
IS_SIGN = np.isin(np.arange(256), [x for x in range(33, 127) if x != 39]) & ~IS_ALNUM
_LOADED: dict = {}


def word_ids(path: str) -> "WordIds":
    """The tokenizer and its words so far, kept for the worker's next task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a run, cut where an ASCII sign other than an
    apostrophe (contractions are tokens) follows an ASCII letter or digit."""
    cut = np.zeros(len(texts.data), dtype=bool)
    cut[1:] = IS_SIGN[texts.data[1:]] & IS_ALNUM[texts.data[:-1]]
    cut[texts.text_at[:-1][texts.text_at[:-1] < len(cut)]] = False
    at = np.flatnonzero(cut)
    return (np.sort(np.concatenate([texts.starts, at])), np.sort(np.concatenate([texts.ends, at])))


class WordIds:
    """Token ids of words.  The tokenizer drops white space and joins neither across
    it nor from a letter or digit to the sign behind it, so a text's ids are those
    of such pieces in a row; each new piece is encoded once, many at a time with a
    sign between them that occurs in none.  Pieces are kept as 64-bit hashes,
    sorted, with the place of their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Strings that the plain call takes as one id: texts that hold one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        self.known, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.at, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def code(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.asarray(f.ids, dtype=np.uint32) for f in found])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        joined = "".join(words)
        sign = next((c for c in SIGNS if c not in joined), None)
        if sign is None:  # every sign occurs: one word at a time
            parts = [self.code([w]) for w in words]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        mark = self.code([sign])[0]
        ids = self.code([f" {sign} ".join([*words[i:i + 256], ""]) for i in range(0, len(words), 256)])
        ends = np.flatnonzero(ids == mark)
        return np.delete(ids, ends), np.diff(np.append(-1, ends)) - 1

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes`` are sorted and new."""
        for i in range(0, len(words), 16384):
            ids, sizes = self.encode_words(words[i:i + 16384])
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes, dtype=np.int64)])
        place = np.arange(len(self.at) - 1 - len(words), len(self.at) - 1)
        spot = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, spot, hashes), np.insert(self.place, spot, place)

    def has_added(self, column: pa.Array) -> np.ndarray:
        """Which texts hold an added token, whatever its case."""
        found = np.zeros(len(column), dtype=bool)
        for token in self.added:
            found |= pc.fill_null(pc.match_substring(column, token, ignore_case=True), False).to_numpy(zero_copy_only=False)
        return found

    def encode_whole(self, text: str) -> np.ndarray:
        self.tokenizer.encode_special_tokens = False
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return np.array([*ids, END_ID], dtype=np.uint32)

    def places(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index in ``at`` of every piece of the run."""
        values = BYTE_VALUES[texts.data]
        values[texts.space] = 0
        hashes, first, inverse = np.unique(span_hashes(values, starts, ends - starts, BASE),
                                           return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > REMEMBERED:
            self.clear()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            raw, at = texts.data.tobytes(), first[new]
            self.learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            spot = np.searchsorted(self.known, hashes)
        return self.place[spot][inverse] if len(hashes) else np.zeros(0, dtype=np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts), each text closed by END_ID."""
        opens, closes = pieces(texts)
        word = self.places(texts, opens, closes)
        ends = np.searchsorted(opens, texts.text_at[1:])
        starts = np.insert(self.at[word], ends, -1)
        lengths = np.insert(self.at[word + 1] - self.at[word], ends, 1)
        before = np.append(0, np.cumsum(lengths))
        pick = np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)
        close = before[1:][starts < 0] - 1
        pick[close] = 0
        ids = self.ids[pick] if len(self.ids) else np.zeros(len(pick), dtype=np.uint32)
        ids[close] = END_ID
        return ids, np.append(0, close + 1)


def assign(lengths: np.ndarray, capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC,
           look: int = LOOK) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Fill sequences of the given capacities completely, as far as there are tokens.

    Items go in descending order of cost; each goes whole to the cheapest sequence
    that still has room for it, among the ``look`` cheapest; else it is cut to
    fill the cheapest one and the rest goes on.  Returns placed pieces (item,
    start in the item, length, sequence) and what is left, (item, start).
    """
    room = list(capacities)
    load = [(0.0, s) for s in range(len(room))]
    heapq.heapify(load)
    placed, left = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, n = 0, int(lengths[item])
        while n:
            if not load:
                left.append((item, start))
                break
            tried, found = [], None
            while load and len(tried) < look:
                tried.append(heapq.heappop(load))
                if room[tried[-1][1]] >= n:
                    found = tried.pop()
                    break
            if found is None:
                found = tried.pop(0)
            for other in tried:
                heapq.heappush(load, other)
            cost, s = found
            piece = min(n, room[s])
            placed.append((item, start, piece, s))
            room[s] -= piece
            if room[s]:
                heapq.heappush(load, (cost + linear * piece + quadratic * piece * piece, s))
            start, n = start + piece, n - piece
    return placed, left


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


class Packer:
    """Packs one task's documents, a block at a time; what a block leaves over
    goes into the next, and the last remainder into sequences of powers of two."""

    def __init__(self, first: int, length: int, with_ids: bool):
        self.next, self.length, self.with_ids = first, length, with_ids
        self.pool: list[tuple] = []  # (doc id, start, ids, tokens of the document)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            yield self.row(doc_id, start, ids[start:start + self.length], len(ids), self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.pool.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole

    def row(self, doc_id, start, ids, total, sequence, offset):
        return (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset,
                *([ids] if self.with_ids else []))

    def flush(self, last: bool) -> Iterator[tuple]:
        full, rest = divmod(self.tokens, self.length)
        capacities = [self.length] * full + (powers_of_two(rest) if last else [])
        placed, left = assign(np.array([len(x[2]) for x in self.pool], dtype=np.int64), capacities)
        offsets = [0] * len(capacities)
        for item, start, n, s in placed:
            doc_id, base, ids, total = self.pool[item]
            yield self.row(doc_id, base + start, ids[start:start + n], total, self.next + s, offsets[s])
            offsets[s] += n
        self.next += len(capacities)
        self.pool = [(self.pool[i][0], self.pool[i][1] + s, self.pool[i][2][s:], self.pool[i][3]) for i, s in left]
        self.tokens = sum(len(x[2]) for x in self.pool)


PIECE = ("doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    ``tokenizer``: path of a tokenizer file (default: the public word-level BPE).
    Every document, empty or null texts too, ends with id 1.  Whole stretches of
    ``length`` ids fill sequences of their own; the remainders of a block of
    documents are balanced by cost over the block's sequences, cutting where no
    sequence has room, so all sequences are full but a task's last few, which have
    lengths that are powers of two.  No shuffle: a task packs what it reads, in
    blocks of bounded size, and a rerun of a task gives the same sequences.
    Sequence ids are unique, not dense.  Repeated rows are packed each; an empty
    table gives no rows; other columns are not carried; a null key stays null.
    """
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[key]
    schema = PIECE.format(key=kind) + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def out(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(columns[0], type=doc_type), *(pa.array(c, type=pa.int64()) for c in columns[1:7])]
        if with_ids:
            ends = np.cumsum(columns[2], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)),
                                                   pa.array(np.concatenate(columns[7]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        words, doc_type = word_ids(tokenizer), pa.int64()
        packer = Packer(TaskContext.get().partitionId() << 40, length, with_ids)
        rows: list[tuple] = []
        for batch in batches:
            doc_type = batch.column(0).type
            special = words.has_added(batch.column(1))
            for texts in runs(batch.column(1), lower=True, limit=SPLIT_BYTES):  # the tokenizer lower-cases
                ids, at = words.encode(texts)
                for i, doc_id in enumerate(batch.column(0).slice(texts.row0, texts.n).to_pylist()):
                    whole = special[texts.row0 + i]
                    rows.extend(packer.add(doc_id, words.encode_whole(batch.column(1)[texts.row0 + i].as_py()) if whole else ids[at[i]:at[i + 1]]))
                    if packer.tokens >= block_tokens:
                        rows.extend(packer.flush(last=False))
                if rows:
                    yield out(rows, doc_type)
                    rows = []
        rows.extend(packer.flush(last=True))
        if rows:
            yield out(rows, doc_type)

    return in_batches(docs.select(F.col(key), F.col(text)), run, schema)
