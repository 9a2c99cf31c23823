"""Token ids in Arrow files of fixed-size lists.

Documents are ranged by id; each task tokenizes its range in order and writes one Arrow file. Its record batches hold
SEQUENCES sequences of LENGTH ids (16 bits where the vocabulary allows) and mask bits as fixed-size lists, so that sequence s of a file is found by arithmetic and its
buffers are used without copying. A text's ids run on from sequence to sequence; only the end of a file is padded, with mask 0.
The document index (Parquet, beside the files) names the file of the attempt that succeeded; files of lost attempts are
never read.

Files are written through pyarrow.fs to the folder's own scheme, which must be one that executors share.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm.words import pieces, split_words

LENGTH = 2048
SEQUENCES = 64
#: Word pieces remembered by a worker process, about 60 MB; beyond that it starts afresh.
REMEMBERED = 1 << 18
#: The pattern of word pieces for which _KIND gives the same cuts, but for words with apostrophes.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of UTF-8 bytes in lower-cased plain words: 0 line end, 1 letter (with the two bytes of U+00DF to U+00FF), 2 digit, 3 mark.
_KIND = np.full(256, 3, np.int8)
_KIND[10], _KIND[48:58], _KIND[97:123], _KIND[128:] = 0, 2, 1, 1


class WordTokenizer:
    """A tokenizers file, with the work done once for each word where that gives the same ids.

    That holds for byte-pair models with an end-of-word mark whose normaliser and pre-tokenizer never look across white
    space. Words of plain letters are cut by the file's own pattern, and each new piece is encoded once; other words are
    encoded whole. Any other kind of tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        suffix, self.added = spec["model"].get("end_of_word_suffix"), [t["content"] for t in spec["added_tokens"]]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = bool(suffix) and normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not spec["post_processor"]
        if self.by_word:
            self.cut = f"({steps[0]['pattern']['Regex']})"
            vocabulary = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _rows(self, parts: list[str]) -> np.ndarray:
        """Rows of the remembered pieces; `parts` are single pieces of the file's pattern."""
        if len(self.row) > REMEMBERED:
            self.forget()
        fresh = [p for p in parts if p not in self.row]
        if fresh:
            ids = self._encode(" ".join(fresh))
            ends = np.flatnonzero(self.ends[ids]) + 1
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + ends))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter(map(self.row.__getitem__, parts), np.int64, len(parts))

    def _cut(self, words: pa.Array) -> pa.Array:
        """Spaces between the pieces of each word. Runs of letters, single digits and runs of marks need no regular expression."""
        if self.cut != f"({RUNS})" or not len(words):
            return pc.replace_substring_regex(words, self.cut, "\\1 ")
        quoted = pc.match_substring(words, "'")
        text = np.frombuffer("\n".join(pc.if_else(quoted, "", words).to_pylist()).encode(), np.uint8)
        kind = _KIND[text]
        at = 1 + np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & (kind[:-1] > 0))
        spaced = pa.array(np.insert(text, at, 32).tobytes().decode().split("\n"), pa.string())
        if not pc.any(quoted).as_py():
            return spaced
        return pc.if_else(quoted, pc.replace_substring_regex(pc.if_else(quoted, words, ""), self.cut, "\\1 "), spaced)

    def _words(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, and where they start."""
        words = pa.array(vocabulary, pa.string())
        plain = pc.match_substring_regex(words, "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$").to_numpy(zero_copy_only=False)
        for added in self.added:
            plain &= ~pc.match_substring(words, added).to_numpy(zero_copy_only=False)
        parts = split_words(self._cut(pc.utf8_lower(words.filter(pa.array(plain)))))
        rows = self._rows(parts.vocabulary)[parts.codes]
        length = np.diff(self.starts)[rows]
        total = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(self.starts[rows] - total[:-1], length) + np.arange(total[-1])]
        if plain.all():
            return flat, total[parts.starts]
        pieces_of = iter(np.split(flat, total[parts.starts][1:-1]) if plain.any() else ())
        some = [next(pieces_of) if p else self._encode(w) for w, p in zip(vocabulary, plain.tolist(), strict=True)]
        return np.concatenate(some), np.concatenate(([0], np.cumsum([len(x) for x in some])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for some in ids for i in some], np.uint32), np.concatenate(([0], np.cumsum([len(s) for s in ids], dtype=np.int64)))
        words = split_words(texts)
        if not words.vocabulary:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        flat, offset = self._words(words.vocabulary)
        length = np.diff(offset)[words.codes]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(offset[words.codes] - total[:-1], length) + np.arange(total[-1])]
        return ids.astype(np.uint32), total[words.starts]


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class _Writer:
    """Fills fixed-size sequences and writes them in batches to one Arrow file."""

    def __init__(self, folder: str, name: str, length: int, end_id: int, kind: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.length, self.end_id, self.total = length, end_id, 0
        self.kind = np.dtype(kind)
        lists = pa.list_(pa.field("item", pa.from_numpy_dtype(self.kind), False), length), pa.list_(pa.field("item", pa.bool_(), False), length)
        self.schema = pa.schema([pa.field("input_ids", lists[0], False), pa.field("attention_mask", lists[1], False)])
        self.stream = self.fs.open_output_stream(f"{root}/{name}")
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.waiting = [np.zeros(0, np.uint32)]
        self.held = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask, ids = np.arange(len(ids)) < real, ids.astype(self.kind)
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        block = SEQUENCES * self.length
        if self.held >= block:
            whole = np.concatenate(self.waiting)
            upto = len(whole) // block * block
            for at in range(0, upto, block):
                self._put(whole[at : at + block], block)
            self.waiting, self.held = [whole[upto:].copy()], len(whole) - upto

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            self._put(np.concatenate((ids, np.full(-len(ids) % self.length, self.end_id, np.uint32))), len(ids))
        self.file.close()
        self.stream.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> None:
    """Writes the ids of every text, each followed by `end_id`, in ascending order of doc_id, and the document index.

    Null and empty texts have the end id alone. Null ids come first; equal ids are ordered by their texts' hashes, equal rows
    follow each other. Other columns are ignored. An empty table gives an index without rows and no file.
    """

    kind = "uint16" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else "uint32"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, writer = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.arrow", None
        for piece in pieces(batches, "text"):
            writer = writer or _Writer(f"{folder}/files", name, length, end_id, kind)
            ids, starts = _tokenizer(tokenizer).encode(piece.column(1))
            starts = starts + np.arange(len(starts))
            at = writer.total
            writer.add(np.insert(ids, (starts[1:] - np.arange(1, len(starts))), np.uint32(end_id)))
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(n, part, np.int32)), pa.array([name] * n), pa.array(at + starts[:-1]), pa.array(np.diff(starts))],
                                             ["doc_id", "part", "file", "offset", "n_tokens"])
        if writer:
            writer.close()

    ordered = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie"))
    ordered.mapInArrow(encode, "doc_id long, part int, file string, offset long, n_tokens long").write.parquet(f"{folder}/index")


class TokenFile:
    """Random access to one file; arrays are views of its buffers where the file system maps files into memory."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field(0).type.list_size
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, b: int) -> pa.RecordBatch:
        if self.held[0] != b:
            self.held = (b, self.reader.get_batch(b))
        return self.held[1]

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence `s` of the file; the ids are a view, the mask's bits are unpacked."""
        batch, row = self.batch(s // SEQUENCES), s % SEQUENCES
        return tuple(batch.column(i).flatten().slice(row * self.length, self.length).to_numpy(zero_copy_only=i == 0) for i in (0, 1))

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, in one view for each batch they lie in."""
        block = SEQUENCES * self.length
        for b in range(start // block, -(-(start + n) // block)):
            yield self.batch(b).column(0).flatten().to_numpy()[max(0, start - b * block) : start + n - b * block]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{folder}/index")
    # one row for each file
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for f in files:
        before[f["part"]] = total
        total += f["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = batch.to_pydict()
            crc, start = [], []
            for part, own, offset, n in zip(rows["part"], rows["file"], rows["offset"], rows["n_tokens"], strict=True):
                if own != name:
                    name, file = own, TokenFile(f"{folder}/files/{own}")
                value = 0
                for view in file.ids(offset, n):
                    value = zlib.crc32(view.astype("<u4", copy=False).data, value)
                crc.append(value)
                start.append(before[part] + offset)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
