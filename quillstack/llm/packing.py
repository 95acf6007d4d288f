"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a window, and the id that ends a document.
WINDOW, END_ID = 1024, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents of one local piece of sequence ids.
_LOCAL_BITS = 40


class Encoder:
    """Token ids of a text by a byte-level BPE vocabulary.

    The rank file holds the vocabulary of the tokenizer file and gives the same ids several times
    faster; a text that holds a special token's string goes through the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, rank_path: str | None = None, pattern: str | None = None, special: tuple[str, ...] = ()):
        self.path, self.special, self.full, self.fast = tokenizer_path, special, None, None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


def default_encoder() -> Encoder:
    """The 50k byte-level BPE of the installed public tokenizers."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>",))


class Packer:
    """Places pieces online; ``counts[h]`` is the number of open windows filled to level h.

    A piece of s ids goes to the level whose change of the sum of squared counts is least:
    from h to h + s the sum changes by 2 (counts[h + s] - counts[h]) + 2, into a new window by
    2 counts[s] + 1, and a window that becomes full leaves the array. Ties take the fullest level.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Adds a piece; returns the window's pieces if that fills it."""
        w, n = self.window, self.counts
        if size == w:
            return [piece]
        change = 2 * (n[1 + size :] - n[1 : w - size + 1]) + 2
        change[-1] = 1 - 2 * n[w - size]  # a full window leaves the array
        change = np.where(n[1 : w - size + 1] > 0, change, np.iinfo(np.int64).max)
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        if change[at] <= 2 * n[size] + 1:
            level = at + 1
            bin_ = self.levels[level].pop()
            n[level] -= 1
        else:
            level, bin_ = 0, []
        bin_.append(piece)
        if level + size == w:
            return bin_
        self.levels[level + size].append(bin_)
        n[level + size] += 1
        return None

    def flush(self) -> Iterator[list]:
        """Closes the open windows: the emptiest are cut up to fill the fullest, so at most one stays partial."""
        bins = [(h, b) for h in range(self.window - 1, 0, -1) for b in self.levels[h]]
        rest: list[tuple] = []
        i, j = 0, len(bins) - 1
        while i <= j or rest:
            if i > j:
                fill, bin_ = 0, []
            else:
                fill, bin_ = bins[i][0], list(bins[i][1])
                i += 1
            while fill < self.window and (rest or i <= j):
                if not rest:
                    rest = list(bins[j][1])
                    j -= 1
                doc, start, ids, total = rest.pop()
                cut = min(len(ids), self.window - fill)
                bin_.append((doc, start, ids[:cut], total))
                fill += cut
                if cut < len(ids):
                    rest.append((doc, start + cut, ids[cut:], total))
            yield bin_
        self.__init__(self.window)


def _pack(encoder, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), Packer(window)
        base, made = TaskContext.get().partitionId() << _LOCAL_BITS, 0
        rows: list[tuple] = []

        def close(pieces: list) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, offset))
                offset += len(ids)
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    full = packer.place((doc, start, piece, len(ids)), len(piece))
                    if full:
                        close(full)
                if len(rows) > 50_000:
                    yield out()
        for pieces in packer.flush():
            close(pieces)
        yield out()

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, encoder=default_encoder) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every input partition packs its own documents as they come, so nothing is shuffled; sequence
    ids hold the partition's number in their upper bits. A document's whole windows are sequences
    of their own and its rest is one piece, cut again only when the last open windows of a
    partition are joined; one sequence of a partition can stay short.

    Null and empty texts are the end id alone. Null or repeated doc_ids are packed row by row.
    Other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pack(encoder, window, end_id), SCHEMA)
