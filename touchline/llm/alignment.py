"""Operator 11: aligning the tokens of two tokenizers with inverted pair bitmaps."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import broadcast_if_small, in_batches, stored
from touchline.llm.words import BASE, BYTE_VALUES, byte_view, span_hashes

#: Documents of a block are numbered from 0; a block ends at so many documents
#: (numbers take 16 bits) or so many bytes of text, after whole documents.
BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 8 << 20
#: Chunks whose tokens a task remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Bytes of chunks handed to a tokenizer at once.
CALL_BYTES = 1 << 14
_ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: First bytes of the UTF-8 forms of white space beyond ASCII (fixed values).
_WIDE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_CHUNK_BASE = 0xA24BAED4963EE407


class ByteTokenizer:
    """Byte-level BPE: ids and the length in bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.sizes = np.zeros(size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(token)  # one printable sign stands for each byte

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(f.ids, dtype=np.int64) for f in found]


class PieceTokenizer:
    """Sentence pieces with byte fallback: ids, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(list(range(n))))]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in self.model.id_to_piece(list(range(n)))):
            raise ValueError("pieces of this model reach across white space")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of chunks, each beginning with a space or a line end.  The model
        puts a space before what it is given, a token of its own before a line end."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [np.asarray(i if t[0] == " " else i[1:], dtype=np.int64) for i, t in zip(ids, texts)]

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[i] for i in ids.tolist())


class Aligner:
    """Tokens of both kinds for chunks of text.

    A chunk starts at a space or line end behind a character that is not white
    space, and holds one that is not.  No token of either kind reaches across its
    start, so a text's tokens are those of its chunks, and both kinds end there.
    A chunk is kept as its 64-bit hash with the place of its ids; ``whole`` tells
    whether its pieces give back its bytes.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        self.byte, self.piece = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]
        self.at = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]
        self.whole = np.zeros(0, dtype=bool)

    def encode_chunks(self, chunks: list[bytes]) -> None:
        """Many chunks in one call: their sizes in bytes tell where each one ends."""
        raw = b"".join(chunks)
        sizes = np.array([len(c) for c in chunks])
        ends = np.cumsum(sizes)
        whole = np.ones(len(chunks), dtype=bool)
        for kind, tokenizer in enumerate((self.byte, self.piece)):
            ids = tokenizer.encode([raw.decode()])[0]
            last = np.cumsum(tokenizer.sizes[ids])
            good = not kind or self.piece.joined(ids) == raw
            cuts = np.searchsorted(last, ends)
            if good and len(ids) and last[-1] == ends[-1] and (last[cuts] == ends).all():
                counts = np.diff(np.append(0, cuts + 1))
            else:  # some piece does not give back its text: chunk by chunk
                each = tokenizer.encode([c.decode() for c in chunks])
                counts = np.array([len(i) for i in each])
                ids = np.concatenate(each)
                if kind:
                    whole &= np.array([self.piece.joined(i) == c for i, c in zip(each, chunks)])
            self.ids[kind] = np.concatenate([self.ids[kind], ids.astype(np.int32)])
            self.at[kind] = np.concatenate([self.at[kind], self.at[kind][-1] + np.cumsum(counts)])
        self.whole = np.concatenate([self.whole, whole])

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """``hashes`` are sorted and new."""
        first = len(self.whole)
        total = np.append(0, np.cumsum([len(c) for c in chunks]))
        fresh = Aligner.__new__(Aligner)  # grown apart, so that the store is copied once
        fresh.byte, fresh.piece = self.byte, self.piece
        parts = []
        for p in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(total[1:] // CALL_BYTES)) + 1):
            fresh.clear()
            fresh.encode_chunks([chunks[i] for i in p])
            parts.append((fresh.ids, fresh.at, fresh.whole))
        for kind in (0, 1):
            self.ids[kind] = np.concatenate([self.ids[kind], *(p[0][kind] for p in parts)])
            counts = np.concatenate([np.diff(p[1][kind]) for p in parts])
            self.at[kind] = np.concatenate([self.at[kind], self.at[kind][-1] + np.cumsum(counts)])
        self.whole = np.concatenate([self.whole, *(p[2] for p in parts)])
        spot = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, spot, hashes)
        self.place = np.insert(self.place, spot, np.arange(first, len(self.whole)))

    def chunks(self, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Where chunks start; ``data`` is space+text of each text in a row."""
        space = _ASCII_SPACE[data]
        solid = ~space  # may end a chunk: not white space of any kind
        wide = _WIDE_SPACE[data]
        for back in (1, 2):
            solid[back:] &= ~wide[:-back]
        start = (data == 32) | (data == 10)
        start[1:] &= solid[:-1]
        # a chunk of nothing but white space stays with the one before it
        spaces = np.append(0, np.cumsum(~space))
        start[text_at[:-1]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(data))
        empty = (spaces[ends] == spaces[at]) & ~np.isin(at, text_at[:-1])
        return at[~empty]

    def encode(self, data: np.ndarray, text_at: np.ndarray):
        """Two of (ids, offsets of the texts) and whether the pieces give back each text."""
        at = self.chunks(data, text_at)
        lengths = np.diff(np.append(at, len(data)))
        hashes, first, inverse = np.unique(span_hashes(BYTE_VALUES[data], at, lengths, BASE ^ _CHUNK_BASE),
                                           return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > REMEMBERED:
            self.clear()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            self.learn(hashes[new], [raw[a:a + n] for a, n in zip(at[first[new]].tolist(), lengths[first[new]].tolist())])
            spot = np.searchsorted(self.known, hashes)
        chunk = self.place[spot][inverse]
        chunk_at = np.searchsorted(at, text_at)
        out = []
        for ids, ids_at in zip(self.ids, self.at):
            counts = ids_at[chunk + 1] - ids_at[chunk]
            before = np.append(0, np.cumsum(counts))
            pick = np.arange(before[-1]) + np.repeat(ids_at[chunk] - before[:-1], counts)
            out.append((ids[pick], before[chunk_at]))
        bad = np.append(0, np.cumsum(~self.whole[chunk]))
        return *out, bad[chunk_at[1:]] == bad[chunk_at[:-1]]


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """Kept for the worker's next task."""
    return Aligner(byte_path, piece_path)


@lru_cache(maxsize=1)
def decimal_table(n: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, left-aligned in rows, and how many each has."""
    texts = np.arange(n).astype("S")
    width = texts.dtype.itemsize
    return texts.view(np.uint8).reshape(n, width), np.char.str_len(texts).astype(np.int64)


def decimals(values: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each): decimal numbers, each followed by its mark."""
    digits, sizes = decimal_table()
    n = sizes[values]
    out = np.empty((len(values), digits.shape[1] + 1), dtype=np.uint8)
    out[:, :-1] = digits[values]
    out[np.arange(len(values)), n] = marks
    return out[np.arange(out.shape[1]) <= n[:, None]], n + 1


def group_strings(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray,
                  text_at: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``text_at`` are offsets in the groups."""
    def marks(group, end):
        out = np.full(len(group), 44, dtype=np.uint8)
        out[np.append(group[1:] != group[:-1], True)] = end
        return out

    group = np.concatenate([a_group * 2, b_group * 2 + 1])
    order = np.argsort(group, kind="stable")
    values = np.concatenate([a, b])[order]
    raw, sizes = decimals(values, np.concatenate([marks(a_group, 124), marks(b_group, 59)])[order])
    total = np.append(0, np.cumsum(sizes))
    cuts = total[np.searchsorted(group[order], 2 * text_at)]
    data = raw.tobytes()
    return [data[x:max(x, y - 1)] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Block:
    """Documents of a task, numbered from 0, and the links between their tokens.

    The pair (A id, B id) of a link is one number; a link is one stretch between
    neighbouring ends of tokens of either kind.
    """

    def __init__(self):
        self.docs = self.bytes = 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, worker: Aligner, texts: pa.Array) -> dict[str, pa.Array]:
        raw, offsets = byte_view(texts)
        n = len(texts)
        sizes = np.diff(offsets)
        text_at = np.append(0, np.cumsum(sizes + 1))
        data = np.full(text_at[-1], 32, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[text_at[:-1]] = False
        data[keep] = raw[offsets[0]:offsets[-1]]
        (a, a_at), (b, b_at), whole = worker.encode(data, text_at)
        counted = whole & (sizes > 0)
        kept_a, kept_b = (np.repeat(counted, np.diff(at)) for at in (a_at, b_at))
        a, b = a[kept_a], b[kept_b]
        n_a, n_b = np.diff(a_at) * counted, np.diff(b_at) * counted
        # places count the bytes of the counted texts in a row
        ends_a, ends_b = np.cumsum(worker.byte.sizes[a]), np.cumsum(worker.piece.sizes[b])
        doc_a = np.repeat(np.arange(n), n_a)
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # merges two sorted runs
        again = np.append(False, ends[1:] == ends[:-1])[:len(ends)]
        common, ends = ends[again], ends[~again]
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        doc = doc_a[link_a]
        links = np.sort((a[link_a].astype(np.int64) << 36) | (b[link_b].astype(np.int64) << 16) | doc)
        first = np.flatnonzero(np.append(True, links[1:] != links[:-1])[:len(links)])
        pairs = links[first]
        self.runs.append((pairs >> 16, (pairs & 0xFFFF) + self.docs, np.diff(np.append(first, len(links)))))
        text_ends = np.cumsum((sizes + 1) * counted)
        group_at = np.append(0, np.searchsorted(common, text_ends, side="right"))
        strings = group_strings(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), group_at)
        out = {"number": np.arange(self.docs, self.docs + n), "n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_at),
               "n_links": np.bincount(doc, minlength=n)[:n] if len(doc) else np.zeros(n, dtype=np.int64)}
        self.docs, self.bytes = self.docs + n, self.bytes + int(sizes.sum())
        return {k: pa.array(v.astype(np.int64)) for k, v in out.items()} | {
            "groups": pa.array([s.decode() for s in strings], pa.large_string())}

    def postings(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, int]]:
        """(pairs, popcounts, bitmaps, plane): for each pair the runs' documents OR-merged into
        one bitmap (plane 0), and planes 1, 2, ... with bit 0, 1, ... of its number
        of further links in each document."""
        pairs, docs, n = (np.concatenate(x) for x in zip(*self.runs)) if self.runs else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(pairs, kind="stable")  # runs follow each other in document order
        pairs, docs, n = pairs[order], docs[order], n[order] - 1
        plane = 0
        while len(pairs):
            chosen = slice(None) if plane == 0 else (n >> (plane - 1)) & 1 == 1
            if plane == 0 or chosen.any():
                yield (*pack(pairs[chosen], docs[chosen], self.docs), plane)
            plane += 1
            if not (n >> (plane - 1)).any():
                break


def pack(pairs: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, popcount, bitmap) of sorted postings.  A bitmap is the list of its
    documents, 16 bits each, or, where that is shorter, one bit a document; the
    list has an even length, the bits an odd one."""
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    n = np.diff(np.append(first, len(pairs)))
    width = (n_docs + 7) // 8 | 1
    dense = 2 * n > width
    sizes = np.where(dense, width, 2 * n)
    at = np.append(0, np.cumsum(sizes))
    out = np.zeros(at[-1], dtype=np.uint8)
    thick = np.repeat(dense, n)
    places = np.repeat(at[:-1], n)
    sparse = docs[~thick]
    spot = (places + 2 * (np.arange(len(pairs)) - np.repeat(first, n)))[~thick]
    out[spot], out[spot + 1] = sparse & 255, sparse >> 8
    np.bitwise_or.at(out, places[thick] + (docs[thick] >> 3), (1 << (docs[thick] & 7)).astype(np.uint8))
    bitmap = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
    return pairs[first], n, bitmap


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) of every bit set."""
    raw, at = byte_view_binary(bitmaps)
    sizes = np.diff(at)
    odd = sizes & 1 == 1
    lists = np.repeat(~odd, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pairs = raw[lists].reshape(-1, 2)
    rows, docs = [owner[lists][::2]], [pairs[:, 0].astype(np.int64) | (pairs[:, 1].astype(np.int64) << 8)]
    for i in np.flatnonzero(odd):
        found = np.flatnonzero(np.unpackbits(raw[at[i]:at[i + 1]], bitorder="little"))
        rows.append(np.full(len(found), i))
        docs.append(found)
    return np.concatenate(rows), np.concatenate(docs)


def byte_view_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_NAMES = ["key", "block", "number", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "plane", "n", "bitmap"]
_SCHEMA = ("key {key}, block long, number long, n_a long, n_b long, n_groups long, n_links long, groups {groups}, "
           "pair long, plane int, n long, bitmap binary")


def inverted_index(docs: DataFrame, key: str, text: str, tokenizers: tuple[str, str], digest: bool = False,
                   block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two kinds of rows, written to the shared folder: one a document (``number``
    within its ``block``, its counts and groups; ``pair`` null), and one for each
    pair, block and plane (``bitmap`` over the block's numbers, ``n`` bits set)."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        worker = aligner(*tokenizers)
        serial, block = TaskContext.get().partitionId() << 32, Block()
        doc_type = None

        def rows(length: int, **columns) -> pa.RecordBatch:
            types = [doc_type, *[pa.int64()] * 6, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [columns[c].cast(t) if c in columns else pa.nulls(length, t) for c, t in zip(_NAMES, types)]
            return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

        def flush() -> Iterator[pa.RecordBatch]:
            for pairs, n, bitmap, plane in block.postings():
                for lo in range(0, len(pairs), 50_000):
                    part = slice(lo, lo + 50_000)
                    m = len(pairs[part])
                    yield rows(m, block=pa.array(np.full(m, serial)), pair=pa.array(pairs[part]), n=pa.array(n[part]),
                               plane=pa.array(np.full(m, plane)), bitmap=bitmap.slice(lo, m))

        for batch in batches:
            doc_type = batch.column(0).type
            lo = 0
            while lo < batch.num_rows:
                sizes = np.diff(byte_view(batch.column(1).slice(lo))[1])
                n = max(1, int(np.searchsorted(np.cumsum(sizes), 1 << 20, side="right")))
                part = batch.slice(lo, min(n, block_docs - block.docs))
                out = block.add(worker, part.column(1))
                if digest:
                    out["groups"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"].to_pylist()])
                yield rows(part.num_rows, key=part.column(0), block=pa.array(np.full(part.num_rows, serial)), **out)
                lo += part.num_rows
                if block.docs >= block_docs or block.bytes >= block_bytes:
                    yield from flush()
                    serial, block = serial + 1, Block()
        yield from flush()

    schema = _SCHEMA.format(key=kind, groups="string")
    return stored(in_batches(docs.select(F.col(key), F.col(text)), run, schema), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): in how many documents a pair is linked, how
    often in all, and whether no pair of its A id is in more documents.  Blocks hold
    different documents, so the popcounts of their bitmaps add up."""
    planes = index.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"),
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(F.col("n") * F.expr("shiftleft(1L, plane - 1)"))).alias("n_links"))
    highest = planes.groupBy(F.expr("shiftright(pair, 20)").alias("a")).agg(F.max("n_docs").alias("highest"))
    joined = planes.withColumn("a", F.expr("shiftright(pair, 20)")).join(highest, "a")
    return joined.select("pair", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best"))


def document_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, number, n_best, count_sum) from the postings: each pair hands its
    count to the documents of its bitmaps, as often as they hold it."""
    postings = index.where("pair is not null").select("block", "pair", "plane", "bitmap")
    scored = postings.join(broadcast_if_small(counts.select("pair", "n_docs", "best")), "pair")

    def run(batches):
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            row, number = unpack(columns["bitmap"])
            plane = columns["plane"].to_numpy()
            times = np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
            blocks, block = np.unique(columns["block"].to_numpy(), return_inverse=True)
            place = block[row] * BLOCK_DOCS + number
            some, at = np.unique(place, return_inverse=True)
            total = np.zeros(len(some), dtype=np.int64)
            best = np.zeros(len(some), dtype=np.int64)
            np.add.at(total, at, (times * columns["n_docs"].to_numpy())[row])
            np.add.at(best, at, (times * columns["best"].to_numpy(zero_copy_only=False))[row])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (blocks[some // BLOCK_DOCS], some % BLOCK_DOCS, best, total)],
                                             names=["block", "number", "n_best", "count_sum"])

    parts = in_batches(scored, run, "block long, number long, n_best long, count_sum long")
    return parts.groupBy("block", "number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_tokenizer: str | None = None,
          piece_tokenizer: str | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).  Documents: ``key``, n_a, n_b, n_groups, n_links, n_best,
    count_sum and ``groups`` (the aligned groups as text, or with ``digest`` their
    SHA-256 in hex).  Pairs: A id, B id, documents and links that hold them.

    Both tokenizers read a space and the text.  Where tokens of both kinds end at
    the same byte a group ends; tokens that share a byte are linked.  A text that is
    null or empty, or that its pieces do not give back byte by byte, has no tokens,
    zeros and an empty string.  Repeated rows are documents of their own.  An empty
    table gives no rows; other columns are not carried; a null key stays null.
    A long text is a block of its own at most: memory follows the longest text.
    """
    if byte_tokenizer is None or piece_tokenizer is None:
        import public_tokenizers
        byte_tokenizer = byte_tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        piece_tokenizer = piece_tokenizer or public_tokenizers.path("piece_bpe_32k.model")
    index = inverted_index(docs, key, text, (byte_tokenizer, piece_tokenizer), digest)
    counts = stored(pair_counts(index), "pair-counts")
    scores = document_scores(index, counts)
    rows = index.where("pair is null").select("key", "block", "number", "n_a", "n_b", "n_groups", "n_links", "groups")
    out = rows.join(scores, ["block", "number"], "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")
    pairs = counts.select(F.expr("shiftright(pair, 20)").alias("a"), F.expr("pair & 1048575").alias("b"), "n_docs", "n_links")
    return out, pairs


def align_digest(docs: DataFrame) -> DataFrame:
    return align(docs, digest=True)[0].withColumnRenamed("groups", "groups_sha256")
