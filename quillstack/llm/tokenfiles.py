"""Files of token ids: documents in order, ids range-coded in independent checksummed blocks.

Layout of a file, all numbers little-endian:

    magic "QTIDS2\\0\\0"
    groups, one after another: a dictionary of words (runs of ids; may be absent) and the payload of every block
    block table: per block u4 ids, u4 symbols, u4 payload bytes, u4 CRC-32 of the payload, u4 CRC-32 of the ids (as u4)
    group table: per group u4 blocks, u4 dictionary bytes, u4 CRC-32 of the dictionary
    document table: per document i8 doc_id, u1 is null, u8 ids (a CRC-32 of the three tables follows)
    trailer: u8 blocks, u8 groups, u8 documents, u8 ids, u8 offset of the block table, magic

Blocks are cut without regard to documents; the document table says where those end. The symbols of a group with a
dictionary are its words, with their counts in the group as order 0; without one they are ids, each block with a model of its own.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coder
from .common import Scratch, release

#: Ids of a block, blocks coded in step, and the id that ends a document.
BLOCK, LANES, END_ID = 4096, 1024, 2
MAGIC = b"QTIDS2\0\0"
#: Words whose ids a worker remembers at most.
WORDS = 500_000
#: Bytes of text encoded at once, at least a row.
STEP_BYTES = 20 << 20
#: Ids of a word of a file's dictionary at most; longer ones are cut.
LONGEST_WORD = 255
_BLOCKS = np.dtype([("ids", "<u4"), ("symbols", "<u4"), ("bytes", "<u4"), ("payload_crc", "<u4"), ("ids_crc", "<u4")])
_GROUPS = np.dtype([("blocks", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])
_TRAILER = struct.Struct("<QQQQQ8s")
_DICTIONARY = struct.Struct("<IIIB")


def _gather(values: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The runs ``values[ends[k]:ends[k + 1]]`` of the picked k, one after another."""
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values)).take(pa.array(picked)).flatten().to_numpy(zero_copy_only=False)


#: What normalizers and pretokenizers must be for ``Encoder`` to take letters and the signs behind them apart.
_LETTERS_APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters that lower-case one by one, then signs but the apostrophe: two pretokens of such a tokenizer.
_SIMPLE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


_EMPTY, _BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


class Encoder:
    """Ids of texts by a tokenizer file; words between white space are encoded once and remembered.

    That is right for tokenizers that split at white space and drop it, which the constructor tries out;
    others get whole texts. Where the file is known to lower-case and to part letters from signs, words of Latin letters are
    remembered without case and signs, and new ones encoded many at a time: each ends with the one id that has the suffix of a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        tried = " it's a\tTest, don't.\n\x0b3rd ́é \xa0x "
        whole = self.tokenizer.encode(tried, add_special_tokens=False).ids
        self.apart = whole == sum((self.tokenizer.encode(w, add_special_tokens=False).ids for w in tried.encode().decode().translate(dict.fromkeys(range(9, 14), " ")).split(" ")), [])
        plan = json.loads(self.tokenizer.to_str())
        suffix = plan["model"].get("end_of_word_suffix")
        self.simple = None
        if self.apart and suffix and not plan["model"].get("dropout") and plan["post_processor"] is None and all(plan[k] == v for k, v in _LETTERS_APART.items()):
            self.simple = Tokenizer(self.tokenizer.model)
            self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        # Places of pieces of words; a word that is encoded as it stands has a blank before it.
        self.pieces = pa.array([""], pa.large_string())
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        whole = pc.starts_with(pieces, " ")
        plain, odd = pieces.filter(pc.invert(whole)), pieces.filter(whole)
        ids, sizes = [self.ids], [np.zeros(0, np.int64)]
        for some in (plain.slice(k, 4096).to_pylist() for k in range(0, len(plain), 4096)):
            ids.append(np.array(self.simple.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4"))
            ends = np.flatnonzero(self.last[ids[-1]]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids[-1]):
                raise ValueError("the tokenizer does not end words as its file says")
            sizes.append(np.diff(ends, prepend=0))
        for some in (odd.slice(k, 4096).to_pylist() for k in range(0, len(odd), 4096)):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p[1:] for p in some], add_special_tokens=False)]
            ids.append(np.fromiter((i for f in found for i in f), "<u4"))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.pieces = pa.concat_arrays([self.pieces, plain, odd])
        self.ids, self.ends = np.concatenate(ids), np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the pieces stand among those remembered; new ones are encoded."""
        at = pc.index_in(pieces, value_set=self.pieces)
        found = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new, known = pieces.filter(at.is_null()), len(self.pieces)
            self._learn(new.unique())
            found[found < 0] = known + pc.index_in(new, value_set=self.pieces.slice(known)).to_numpy()
        return found

    def words(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts as places in a dictionary, the end id as a word behind those of each text;
        the dictionary's ids, their ends (0 first), and how many ids each text has."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.pieces) > WORDS:
            self._clear()
        if self.simple:
            cut = pc.extract_regex(words, _SIMPLE)
            core, tail = pc.struct_field(cut, 0), pc.struct_field(cut, 1)
            simple = cut.is_valid()
            core = pc.if_else(simple, pc.utf8_lower(core), pc.binary_join_element_wise(_EMPTY, words, _BLANK))
            tail = pc.if_else(simple, tail, "")
            tails = tail.dictionary_encode()
            at = self._places(pa.concat_arrays([core, tails.dictionary]))
            a, b = at[: len(words)], at[len(words) :][tails.indices.to_numpy()]
        else:
            a = self._places(pc.binary_join_element_wise(_EMPTY, words, _BLANK))
            b = np.zeros(len(a), np.int64)
        pairs, own = np.unique(a * len(self.pieces) + b, return_inverse=True)
        both = np.stack([pairs // len(self.pieces), pairs % len(self.pieces)], 1).ravel()
        sizes = np.diff(self.ends)[both].reshape(-1, 2).sum(1)
        ids = np.concatenate([_gather(self.ids, self.ends, both), np.array([end_id], "<u4")])
        ends = np.concatenate([[0], np.cumsum(np.append(sizes, 1))])
        # Words without ids are no words of the dictionary.
        filled, number = sizes > 0, np.cumsum(sizes > 0) - 1
        last = np.cumsum(parts.value_lengths().to_numpy().astype(np.int64))
        codes = np.insert(own[coded.indices.to_numpy()] if len(words) else own, last, len(sizes))
        held = np.append(sizes, 1)[codes]
        edges = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], last + np.arange(1, len(last) + 1)])]
        if not filled.all():
            codes = np.append(number, filled.sum())[codes[held > 0]]
            ends = np.concatenate([[0], ends[1:][np.append(filled, True)]])
        return codes, ids, ends, np.diff(edges)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        if not self.apart:
            found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts.cast(pa.large_string()).fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)
        codes, ids, ends, sizes = self.words(texts, end_id)
        return _gather(ids, ends, codes), sizes


def default_encoder() -> Encoder:
    """The 49k word BPE of the installed public tokenizers."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("word_bpe_49k.json"))


_encoders: dict = {}


def _packed(counts: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A dictionary whose counts fall: runs of equal counts, ids of each word, ids."""
    edges = np.flatnonzero(np.diff(counts, prepend=-1))
    runs = np.stack([counts[edges], np.diff(np.append(edges, len(counts)))], 1).astype("<u4")
    wide = int(ids.max()) >= 1 << 16
    data = runs.tobytes() + np.diff(ends).astype("u1").tobytes() + ids.astype("<u4" if wide else "<u2").tobytes()
    return _DICTIONARY.pack(len(runs), len(counts), len(ids), wide) + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, words, size, wide = _DICTIONARY.unpack_from(packed)
    kind = np.dtype("<u4" if wide else "<u2")
    data = pa.decompress(packed[_DICTIONARY.size :], 8 * n + words + size * kind.itemsize, codec="zstd", asbytes=True)
    runs = np.frombuffer(data, "<u4", 2 * n).reshape(-1, 2).astype(np.int64)
    sizes = np.frombuffer(data, "u1", words, 8 * n)
    return np.repeat(runs[:, 0], runs[:, 1]), np.frombuffer(data, kind, size, 8 * n + words).astype("<u4"), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _short(codes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and ends of the dictionary with words of over ``LONGEST_WORD`` ids cut."""
    pieces = -(-np.diff(ends) // LONGEST_WORD)
    if not len(pieces) or pieces.max() == 1:
        return codes, ends
    firsts = np.concatenate([[0], np.cumsum(pieces)])
    cuts = np.concatenate([np.arange(a, b, LONGEST_WORD) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return _gather(np.arange(firsts[-1]), firsts, codes), np.append(cuts, ends[-1])


def _spelled(ids: np.ndarray, ends: np.ndarray, blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of each block of words."""
    every = np.concatenate(blocks)
    cuts = np.concatenate([[0], np.cumsum(np.diff(ends)[every])])[np.cumsum([len(b) for b in blocks])]
    return np.split(_gather(ids, ends, every), cuts[:-1])


class Writer:
    """Writes one file; it gets its name only when it is whole, so a task that is run again replaces it."""

    def __init__(self, root: str, name: str, block: int = BLOCK, lanes: int = LANES):
        self.store, base = fs.FileSystem.from_uri(root)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.store.create_dir(base)
        self.out = self.store.open_output_stream(self.part)
        self.block, self.most = block, block * lanes
        self.waiting: list[np.ndarray] = []
        self.size = self.ids = self.bytes = 0
        self.blocks: list[tuple] = []
        self.groups: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, docs: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.ids += len(ids)
        for first in range(0, len(ids), self.most):
            self.waiting.append(ids[first : first + self.most])
            self.size += len(self.waiting[-1])
            if self.size >= self.most:
                self._code(self.size // self.block * self.block)

    def add_words(self, docs: np.ndarray, codes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents as words of a dictionary, as ``Encoder.words`` gives them. A block holds a quarter as many words as it would ids."""
        self._code(self.size)
        self.docs.append(docs)
        codes, ends = _short(codes, ids, ends)
        size = max(1, self.block // 4)
        groups = -(-len(codes) // min(max(size, self.most), coder.MOST_WORDS))
        for some in np.array_split(codes, groups) if groups else []:
            counts = np.bincount(some, minlength=len(ends) - 1)
            used = np.flatnonzero(counts)
            used = used[np.argsort(-counts[used], kind="stable")]
            number = np.zeros(len(counts), np.int64)
            number[used] = np.arange(len(used))
            own, tops = _gather(ids, ends, used), np.concatenate([[0], np.cumsum(np.diff(ends)[used])])
            symbols, counts = number[some], counts[used]
            packed = _packed(counts, own, tops)
            self._write(packed)
            blocks = [symbols[k : k + size] for k in range(0, len(symbols), size)]
            self.groups.append((len(blocks), len(packed), zlib.crc32(packed)))
            for block, spelled, payload in zip(blocks, _spelled(own, tops, blocks), coder.encode_words(blocks, counts), strict=True):
                self._block(spelled, len(block), payload)
                self.ids += len(spelled)

    def _block(self, ids: np.ndarray, symbols: int, payload: bytes) -> None:
        self.blocks.append((len(ids), symbols, len(payload), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())))
        self._write(payload)

    def _code(self, n: int) -> None:
        held = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        self.waiting, self.size = [held[n:].copy()], len(held) - n
        for first in range(0, n, self.most):
            ids = held[first : min(n, first + self.most)]
            blocks = [ids[k : k + self.block] for k in range(0, len(ids), self.block)]
            self.groups.append((len(blocks), 0, 0))
            for ids, payload in zip(blocks, coder.encode(blocks), strict=True):
                self._block(ids, len(ids), payload)

    def close(self) -> tuple[str, int, int, int]:
        """Path, documents, ids and bytes."""
        self._code(self.size)
        at, docs = self.bytes, np.concatenate([np.zeros(0, _DOCS), *self.docs])
        tables = np.array(self.blocks, _BLOCKS).tobytes() + np.array(self.groups, _GROUPS).tobytes() + docs.tobytes()
        self._write(tables + struct.pack("<I", zlib.crc32(tables)))
        self._write(_TRAILER.pack(len(self.blocks), len(self.groups), len(docs), self.ids, at, MAGIC))
        self.out.close()
        self.store.move(self.part, self.path)
        return self.path, len(docs), self.ids, self.bytes


class Reader:
    """Reads a file of ``Writer``: its tables at once, its blocks and their group's dictionary as they are asked for."""

    def __init__(self, root: str, name: str):
        store, base = fs.FileSystem.from_uri(root)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        blocks, groups, docs, self.ids, at, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        tables = self.file.read_at(size - _TRAILER.size - at, at) if magic == MAGIC else b""
        if magic != MAGIC or zlib.crc32(tables[:-4]) != struct.unpack("<I", tables[-4:])[0]:
            raise ValueError(f"{name}: no file of token ids, or its tables are damaged")
        self.blocks = np.frombuffer(tables, _BLOCKS, blocks)
        self.groups = np.frombuffer(tables, _GROUPS, groups, self.blocks.nbytes)
        self.docs = np.frombuffer(tables, _DOCS, docs, self.blocks.nbytes + self.groups.nbytes)
        # Group k holds the blocks from edges[k] on; dictionaries come before the blocks of their group.
        self.edges = np.concatenate([[0], np.cumsum(self.groups["blocks"], dtype=np.int64)])
        before = np.repeat(np.cumsum(self.groups["bytes"], dtype=np.int64), self.groups["blocks"])
        self.starts = len(MAGIC) + before + np.cumsum(self.blocks["bytes"], dtype=np.int64) - self.blocks["bytes"]
        self.held: tuple = (None, None)

    def _dictionary(self, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held[0] != group:
            size = int(self.groups["bytes"][group])
            packed = self.file.read_at(size, int(self.starts[self.edges[group]]) - size)
            if zlib.crc32(packed) != self.groups["crc"][group]:
                raise ValueError(f"the dictionary of group {group} is damaged")
            self.held = group, _unpacked(packed)
        return self.held[1]

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1; other blocks are not touched."""
        found = [np.zeros(0, np.uint32)]
        while first < last:
            group = int(np.searchsorted(self.edges, first, "right")) - 1
            upto = min(last, int(self.edges[group + 1]))
            found += self._read(group, first, upto)
            first = upto
        return np.concatenate(found)

    def _read(self, group: int, first: int, last: int) -> list[np.ndarray]:
        own, starts = self.blocks[first:last], self.starts[first:last] - self.starts[first]
        data = self.file.read_at(int(starts[-1]) + int(own["bytes"][-1]), int(self.starts[first]))
        payloads = [data[a : a + n] for a, n in zip(starts.tolist(), own["bytes"].tolist(), strict=True)]
        for k, payload in enumerate(payloads):
            if zlib.crc32(payload) != own["payload_crc"][k]:
                raise ValueError(f"block {first + k} is damaged")
        if self.groups["bytes"][group]:
            counts, ids, ends = self._dictionary(group)
            found = _spelled(ids, ends, coder.decode_words(payloads, own["symbols"].tolist(), counts))
        else:
            found = coder.decode(payloads, own["symbols"].tolist())
        for k, ids in enumerate(found):
            if len(ids) != own["ids"][k] or zlib.crc32(ids.astype("<u4").tobytes()) != own["ids_crc"][k]:
                raise ValueError(f"block {first + k} does not decode to what was written")
        return found

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, from the blocks that hold it."""
        ends = np.cumsum(self.docs["ids"]).astype(np.int64)
        start, end = int(ends[k]) - int(self.docs["ids"][k]), int(ends[k])
        edges = np.concatenate([[0], np.cumsum(self.blocks["ids"], dtype=np.int64)])
        first, last = int(np.searchsorted(edges, start, "right")) - 1, int(np.searchsorted(edges, end, "left"))
        return self.read(first, last)[start - edges[first] : end - edges[first]]


def _write(root: str, encoder, end_id: int, block: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder not in _encoders:
            _encoders[encoder] = encoder()
        encode, number, out = _encoders[encoder], TaskContext.get().partitionId(), None
        for whole in batches:
            parts = max(1, -(-whole.nbytes // STEP_BYTES))
            rows = max(1, -(-whole.num_rows // parts))
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                out = out or Writer(root, f"part-{number:06d}.qtids", block, lanes)
                words = getattr(encode, "apart", False)
                *found, sizes = (encode.words if words else encode)(batch.column(1), end_id)
                docs = np.zeros(batch.num_rows, _DOCS)
                docs["doc_id"], docs["null"] = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                docs["ids"] = sizes
                (out.add_words if words else out.add)(docs, *found)
        if out:
            path, docs, ids, size = out.close()
            release()
            yield pa.RecordBatch.from_pylist([{"file": number, "name": path.rpartition("/")[2], "docs": docs, "ids": ids, "bytes": size}], FILES)

    return run


FILES = pa.schema([("file", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_ids(docs: DataFrame, root: str, encoder=default_encoder, end_id: int = END_ID, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """(doc_id, text) -> files of ids in the folder ``root``; one row per file: file, name, docs, ids, bytes.

    Rows are range-partitioned and sorted by doc_id (null first; rows of one doc_id by a hash of their text), and
    every partition writes one file, so files in the order of their numbers hold all documents in
    ascending order. Null and empty texts are the end id alone. Other columns are ignored; an empty
    table writes no file. ``root`` must be a folder that the executors share, as a URI that
    ``pyarrow.fs`` knows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    spark = docs.sparkSession
    # Coding costs far more than the bytes suggest, so small partitions are not merged.
    dealt = plain.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return Scratch(spark, "token-files").save(dealt.mapInArrow(_write(root, encoder, end_id, block, lanes), "file long, name string, docs long, ids long, bytes long"), "files")


def _read(root: str, lanes: int):
    def documents(name: str) -> Iterator[pa.RecordBatch]:
        file = Reader(root, name)
        sizes = file.docs["ids"].astype(np.int64)
        starts, crcs, doc = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), 0
        at = 0
        for first, last in ((k, min(k + lanes, b)) for a, b in zip(file.edges[:-1].tolist(), file.edges[1:].tolist(), strict=True) for k in range(a, b, lanes)):
            ids = file.read(first, last).astype("<u4").view(np.uint8).data
            end = at + len(ids) // 4
            while doc < len(sizes) and starts[doc] < end:
                low, high = max(starts[doc], at) - at, min(starts[doc] + sizes[doc], end) - at
                crcs[doc] = zlib.crc32(ids[4 * low : 4 * high], int(crcs[doc]))
                if starts[doc] + sizes[doc] > end:
                    break
                doc += 1
            at = end
        ids = pa.array(file.docs["doc_id"], mask=file.docs["null"].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), ids, pa.array(starts), pa.array(sizes), pa.array(crcs)], names=["name", "doc_id", "within", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from documents(name)
        release()

    return run


def read_digests(files: DataFrame, root: str, lanes: int = 4 * LANES) -> DataFrame:
    """Files of ``write_ids`` -> one row per document: doc_id, start, n_tokens, ids_crc32, from the decoded blocks.

    Each file is read by one task, a group of blocks at a time; damaged blocks raise an error. ``start``
    sums the ids of the files before, of which there is one row a file.
    """
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = Scratch(files.sparkSession, "token-files").save(files.select("name", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    many = max(1, files.count())
    found = files.select("name").repartition(many).mapInArrow(_read(root, lanes), "name string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(starts), "name").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, encoder=default_encoder, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents to files in the shared folder and reads their digests back."""
    root = Scratch(docs.sparkSession, "token-ids").root
    return read_digests(write_ids(docs, root, encoder, end_id), root)
