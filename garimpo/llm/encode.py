"""Token ids of whole corpora by a public byte-level BPE tokenizer.

Method: tree concatenation. A text is encoded in pieces that are joined pairwise: around
a join a window is encoded again and grown until it agrees exactly with both sides. Short
stretches between white space are remembered, since a corpus repeats them.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie; every operator takes another as a parameter.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the splitting pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a leaf of the tree, and bytes of a leaf of a stretch the pattern does not split.
LEAF_CHARS, LEAF_BYTES = 4096, 512
#: Texts above so many characters are spread over tasks before they are encoded.
SPREAD_CHARS = 1 << 18
#: Stretches remembered by a worker; the memory is emptied when it is full.
MEMORY = 1 << 18

_STRETCH = re.compile(r"\s*\S+|\s+")


class TreeEncoder:
    """Encodes text exactly as the tokenizer would in one go."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._ranks = ranks
        self._bytes = {v: k for k, v in ranks.items()}
        self._split = regex.compile(PATTERN)
        self._known: dict[str, array.array] = {}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes

    # -- one stretch that the pattern does not split ------------------------------------

    def _plain(self, piece: bytes) -> list[int]:
        at = self._ranks.get(piece)
        return [at] if at is not None else list(self._bpe.encode_single_piece(piece))

    def _fits(self, left: int, right: int) -> bool:
        """Two neighbours are a valid encoding of their bytes; a sequence is the encoding iff all neighbours are."""
        return self._plain(self._bytes[left] + self._bytes[right]) == [left, right]

    def join_ids(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of one unsplit stretch from those of its halves.

        The window of k tokens on either side is encoded again; k doubles until the new
        tokens fit both untouched sides.
        """
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self._plain(b"".join(self._bytes[t] for t in [*a[i:], *b[:j]]))
            if (i == 0 or self._fits(a[i - 1], window[0])) and (j == len(b) or self._fits(window[-1], b[j])):
                return a[:i] + window + b[j:]
            k *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self._plain(data)
        mid = len(data) // 2
        return self.join_ids(self.piece(data[:mid]), self.piece(data[mid:]))

    # -- stretches between white space ---------------------------------------------------

    def stretch(self, text: str) -> array.array:
        """White space and the non-blank run after it: a token never spans the border before it."""
        got = self._known.get(text)
        if got is None:
            if len(text) <= self.leaf_bytes:
                got = array.array("i", self._bpe.encode_ordinary(text))
            else:
                got = array.array("i", [t for p in self._split.findall(text) for t in self.piece(p.encode("utf-8", "surrogatepass"))])
            if len(text) <= 64:
                if len(self._known) >= MEMORY:
                    self._known.clear()
                self._known[text] = got
        return got

    def leaf(self, text: str) -> array.array:
        out = array.array("i")
        stretch = self.stretch
        for s in _STRETCH.findall(text):
            out.extend(stretch(s))
        return out

    # -- the tree over a text -------------------------------------------------------------

    def _drop(self, ids: array.array, size: int, from_end: bool) -> int:
        """How many tokens cover `size` bytes at the start or end; -1 where no token ends there."""
        n = done = 0
        while done < size and n < len(ids):
            done += len(self._bytes[ids[-1 - n] if from_end else ids[n]])
            n += 1
        return n if done == size else -1

    def join_texts(self, left: str, a: array.array, right: str, b: array.array) -> array.array:
        """Ids of left + right from the ids of both.

        The window reaches back to a border between non-blank and white space in left and
        forward to one in right, where tokens of any encoding end. It is encoded again
        and grown until both sides split there too.
        """
        width = 32
        while True:
            i = max(0, len(left) - width)
            while i > 0 and not (left[i].isspace() and not left[i - 1].isspace()):
                i -= 1
            j = min(len(right), width)
            while j < len(right) and not (right[j].isspace() and not right[j - 1].isspace()):
                j += 1
            cut = self._drop(a, len(left[i:].encode()), True)
            skip = self._drop(b, len(right[:j].encode()), False)
            if (cut >= 0 and skip >= 0) or (i == 0 and j == len(right)):
                out = a[: len(a) - cut] if i else array.array("i")
                out.extend(self.leaf(left[i:] + right[:j]))
                out.extend(b[skip:] if j < len(right) else array.array("i"))
                return out
            width *= 2

    def encode(self, text: str | None) -> array.array:
        if not text:
            return array.array("i")
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join_texts(left, self.encode(left), right, self.encode(right))


def _to_list_array(parts: list[array.array]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = array.array("i")
    for p in parts:
        flat.extend(p)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32), pa.int32()))


def _encoder(folder: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeEncoder(folder, name)
        for batch in batches:
            step = 256  # the ids of few texts at a time
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = _to_list_array([coder.encode(t) for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return run


def encode_corpus(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of docs (doc_id BIGINT, text STRING), without special tokens.

    Empty and null texts give an empty list; strings that look like special tokens are
    ordinary text; repeated doc_ids keep their rows; extra columns are ignored. Texts up
    to spread_chars are encoded where they lie, without a shuffle; longer ones are cut
    into pieces of that size, encoded in parallel tasks and joined pairwise again.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    run = _encoder(folder, name)
    short = rows.where(F.length("text") <= spread_chars).mapInArrow(run, "doc_id bigint, ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                for n, at in enumerate(range(0, len(text), spread_chars)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "doc_id": [doc], "n": [n], "text": [text[at : at + spread_chars]]}, schema=pieces)

    pieces = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("text", pa.string())])

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeEncoder(folder, name)
        for batch in batches:
            ids = _to_list_array([coder.encode(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    def merge(table: pa.Table) -> pa.Table:
        coder = TreeEncoder(folder, name)
        ordered = table.sort_by("n")
        level = [(t, array.array("i", i)) for t, i in zip(ordered.column("text").to_pylist(), ordered.column("ids").to_pylist())]
        while len(level) > 1:
            paired = [(x[0] + y[0], coder.join_texts(x[0], x[1], y[0], y[1])) for x, y in zip(level[::2], level[1::2])]
            level = paired + level[len(paired) * 2 :]
        return pa.table({"doc_id": ordered.column("doc_id").slice(0, 1), "ids": _to_list_array([level[0][1]])})

    long = (
        rows.where(F.length("text") > spread_chars)
        .select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
        .mapInArrow(cut, "key bigint, doc_id bigint, n int, text string")
        .repartition("key", "n")
        .mapInArrow(encode_piece, "key bigint, doc_id bigint, n int, text string, ids array<int>")
        .groupBy("key")
        .applyInArrow(merge, "doc_id bigint, ids array<int>")
    )
    return short.unionByName(long)
