"""Token ids in seekable zstandard files.

A file holds the ids of whole documents, as little-endian 2- or 4-byte unsigned integers, in independent
zstandard frames; a frame ends with a document, so that a document is in one frame. Behind them come

* a skippable frame (magic 0x184D2A50) with the documents: id, null mark and number of tokens;
* the seek table of the public zstandard seekable format (skippable frame 0x184D2A5E): for each frame its
  compressed size, its size and the low 32 bits of its XXH64; then the number of frames, a descriptor
  byte with the checksum bit, and the magic 0x8F92EAB1.

Any zstandard decoder gives the ids of the whole file, and ``TokenFile`` those of the documents asked for,
reading and checking only their frames. Files are written and read with ``pyarrow.fs``, so they can be in
any store that it reaches and that all executors share.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_folder, table

#: Fixed values of the public zstandard seekable format.
SKIPPABLE_DOCS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_BIT = 0x80

#: A frame is closed once it has this many ids, so reading one document decodes little more.
FRAME_IDS = 65_536
#: Pieces of text whose ids a worker remembers, and the longest such piece.
CACHE_PIECES, CACHE_CHARS = 700_000, 64


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers have for each byte: printing ones stand for themselves, the others for 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - own))}


class Encoder:
    """``tokenizers`` with a bounded memory of the ids of short pieces of text.

    A byte-level tokenizer never joins across a space between two other characters, so a text may be cut
    there and the pieces encoded alone; frequent pieces are then encoded once for each worker.
    """

    def __init__(self, path: str, remembered: int = CACHE_PIECES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Where a text has one of these, as <|endoftext|>, the tokenizer cuts first; such texts are encoded whole.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.two_bytes = self.tokenizer.get_vocab_size() <= 1 << 16
        pre = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        #: A word of Latin letters, with a blank before it and one mark behind it or not: one or two pre-tokens.
        self.simple = re.compile("^(?:( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,:;!?|]?)(?=\n|\\Z)|(.*))$", re.MULTILINE)
        self.marks = {x: self._encode([x])[0] for x in ("", *".,:;!?|")}
        self.letters = byte_letters()
        self.bytes_of = [np.array([k], "<u4").tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.safe = re.compile(r"(?<=\S)(?= \S)")

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def pieces(self, text: str) -> list[str]:
        # Every gap must be one space or one newline: a count alone lets gaps of other blanks make up for longer ones.
        if text.split() != text.replace("\n", " ").split(" ") or "\0" in text:
            return self.safe.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces: of simple words from the tokenizer's model alone, of others from the whole of it."""
        lines, rest = [x for x in pieces if x and "\n" not in x], [x for x in pieces if not x or "\n" in x]
        out: dict[str, bytes] = {}
        if lines:
            parts = self.simple.findall("\n".join(lines))
            words = "\n".join([x[0] for x in parts]).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
            ids, tokenize = self.bytes_of, self.tokenizer.model.tokenize
            for line, (word, mark, _), letters in zip(lines, parts, words, strict=True):
                if word:
                    out[line] = b"".join([ids[x.id] for x in tokenize(letters)]) + self.marks[mark]
                else:
                    rest.append(line)
        if rest:
            out.update(zip(rest, self._encode(rest), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 4-byte unsigned integers."""
        if not self.cuts:
            return self._encode(texts)
        whole = {k: x for k, x in enumerate(texts) if any(a in x for a in self.added)}
        if not whole:
            return self._encode_cut(texts)
        out = self._encode_cut(["" if k in whole else x for k, x in enumerate(texts)])
        for k, ids in zip(whole, self._encode(list(whole.values())), strict=True):
            out[k] = ids
        return out

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        cut_up = [self.pieces(x) for x in texts]
        found = [list(map(self.known.get, x)) for x in cut_up]
        new = {p for ps, vs in zip(cut_up, found, strict=True) if None in vs for p in compress(ps, map(not_, vs))}
        fresh = self.encode_pieces(list(new)) if new else {}
        for p, v in fresh.items():
            if len(self.known) >= self.remembered:
                break
            if len(p) <= CACHE_CHARS:
                self.known[p] = v
        return [b"".join(vs) if None not in vs else b"".join([fresh[p] if v is None else v for p, v in zip(ps, vs, strict=True)]) for ps, vs in zip(cut_up, found, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, remembered: int = CACHE_PIECES) -> Encoder:
    return Encoder(path, remembered)


class FileWriter:
    """Writes one token file, frame by frame."""

    def __init__(self, out, two_bytes: bool, frame_ids: int = FRAME_IDS) -> None:
        self.out, self.kind, self.frame_ids = out, "<u2" if two_bytes else "<u4", frame_ids
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        self.waiting: list[bytes] = []
        self.held = 0
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: 4-byte unsigned integers."""
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = np.frombuffer(b"".join(self.waiting), "<u4").astype(self.kind).tobytes()
            packed = self.zstd.compress(raw)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.out.write(packed)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        docs = np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        body = struct.pack("<BQ", int(self.kind[2]), len(self.ids)) + self.zstd.compress(docs)
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(body)) + body)
        body = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUM_BIT, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)


class TokenFile:
    """Reads one token file. ``source`` is a seekable binary file."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUM_BIT:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3).astype("i8")
        self.packed, self.raw, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(self.packed)])
        self.begins = np.concatenate([[0], np.cumsum(self.raw)])
        mark, length = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if mark != SKIPPABLE_DOCS:
            raise ValueError("no table of documents behind the frames")
        body = self._at(int(self.places[-1]) + 8, length)
        self.width, n = struct.unpack("<BQ", body[:9])
        docs = zstandard.ZstdDecompressor().decompress(body[9:]) if n else b""
        self.doc_ids = np.frombuffer(docs, "<i8", n)
        self.nulls = np.frombuffer(docs, "u1", n, 8 * n).astype(bool)
        self.counts = np.frombuffer(docs, "<u8", n, 9 * n).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        out = self.source.read(length)
        if len(out) != length:
            raise ValueError("the file ends too early")
        return out

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.sums[k]):
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, which: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the documents at these rising places, or of all; decodes their frames only."""
        now, raw = -1, b""
        for i in range(len(self.counts)) if which is None else which:
            begin, end = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
            if begin == end:
                yield i, np.zeros(0, "<u4")
                continue
            k = int(np.searchsorted(self.begins, begin, "right")) - 1
            if k != now:
                now, raw = k, self.frame(k)
            yield i, np.frombuffer(raw[begin - int(self.begins[k]) : end - int(self.begins[k])], f"<u{self.width}").astype("<u4")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(df: DataFrame, out_dir: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, frame_ids: int = FRAME_IDS, order: Sequence[str] = (), remembered: int = CACHE_PIECES) -> DataFrame:
    """Writes the token files of ``df`` and returns one row a file: file_no, path, n_docs, n_ids, first_id, last_id.

    A document's ids are those of its whole text, followed by ``end_id``; null counts as empty. Documents
    are in ascending order of id (nulls first, equal ids by text), or of the columns ``order`` and then of id,
    over the files and in them: each file is a range of that order. Other columns are not read. A task writes under a name of its own and then renames, so
    a task that runs again leaves one whole file. An empty table gives no or empty files. A worker remembers the ids of
    ``remembered`` pieces of text, some 200 bytes each; it changes memory and speed, never the ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer_path, remembered)
        end = np.array([end_id], "<u4").tobytes()
        no = TaskContext.get().partitionId()
        fs, folder = place(out_dir)
        fs.create_dir(folder, recursive=True)
        name, draft = f"{folder}/tokens-{no:06d}.zst", f"{folder}/_draft-{no:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            file = FileWriter(out, codes.two_bytes, frame_ids)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [x or "" for x in part.column(1).to_pylist()]
                    for doc_id, ids in zip(part.column(0).to_pylist(), codes.encode(texts), strict=True):
                        file.add(doc_id, ids + end)
            file.close()
        fs.move(draft, name)
        ids = [x for x, null in zip(file.ids, file.nulls, strict=True) if not null]
        row = {"file_no": [no], "path": [name], "n_docs": [len(file.counts)], "n_ids": [sum(file.counts)]}
        ends = {"first_id": pa.array([min(ids, default=None)], pa.int64()), "last_id": pa.array([max(ids, default=None)], pa.int64())}
        yield pa.RecordBatch.from_pydict(row | ends)

    keys = {f"o{k}": F.col(c) for k, c in enumerate(order)}
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keys.items()])
    rows = rows.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id", "text").select("id", "text")
    return cut(rows.mapInArrow(write, "file_no long, path string, n_docs long, n_ids long, first_id long, last_id long"))


def read_tokens(files: DataFrame, out_dir: str, with_ids: bool = True, only: Iterable[int] | None = None) -> DataFrame:
    """The documents of token files: file_no, doc_id, start (in the file), n_tokens, ids_crc32 and, if wanted, ids.

    ``files`` are rows of ``write_tokens``. Every frame's checksum is verified. With ``only``, a list of ids, other
    files are not opened and frames without a document of these ids not decoded.
    """
    wanted = None if only is None else np.array(sorted(set(only)), "i8")
    if wanted is not None:
        low, high = (int(wanted[0]), int(wanted[-1])) if len(wanted) else (0, -1)
        files = files.where((F.col("first_id") <= high) & (F.col("last_id") >= low))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = place(out_dir)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as source:
                    file = TokenFile(source)
                    places = np.arange(len(file.counts)) if wanted is None else np.flatnonzero(np.isin(file.doc_ids, wanted) & ~file.nulls)
                    found = file.read(places.tolist())
                    for begin in range(0, len(places), 1000):
                        at = places[begin : begin + 1000]
                        ids = [next(found)[1] for _ in at]
                        cols = {
                            "file_no": pa.array([row["file_no"]] * len(at), pa.int64()),
                            "doc_id": pa.array(file.doc_ids[at], pa.int64(), mask=file.nulls[at]),
                            "start": pa.array(file.starts[at], pa.int64()),
                            "n_tokens": pa.array(file.counts[at], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        }
                        if with_ids:
                            cols["ids"] = pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(cols)

    kind = "file_no long, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.mapInArrow(read, kind)


def token_rows(df: DataFrame, out_dir: str, tokenizer_path: str, order: Sequence[str] = (), remembered: int = CACHE_PIECES) -> DataFrame:
    """Writes ``df`` as token files, reads them back, and counts ``start`` over all files. See ``write_tokens``."""
    files = write_tokens(df, out_dir, tokenizer_path, order=order, remembered=remembered)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = files.select("file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_offset"))
    docs = read_tokens(files, out_dir, with_ids=False).join(offsets, "file_no")
    return docs.select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from its token file. Null texts are empty,
    so they have the end id alone; rows with a null doc_id come first; an empty table gives no rows."""
    return token_rows(table(spark, sf_dir, "documents"), fresh_folder(spark, "token-files"), default_tokenizer())
