"""Token-ID output: seekable zstandard files of token ids.

A file holds one zstandard frame per document (little-endian ids, 2 or 4 bytes each), then a skippable frame
with the header (JSON) and the documents' ids, then the seek table of the public seekable format: a skippable
frame with, per frame, compressed size, decompressed size and checksum (low 32 bits of XXH64 of the content),
and a footer. Every frame is independent and carries zstandard's own content checksum as well, so a reader
finds any document from the file's end and decompresses nothing else.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import textbytes as tb
from cadenza.llm.workspace import Workspace, opened, put

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A51
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Words an encoder remembers; about 25 MB. Beyond that it starts anew, which changes speed only.
REMEMBERED = 400_000
ENCODE_RUN = 4 << 20
#: The normalizers and the split pattern of tokenizers whose texts may be cut into pieces as WordEncoder does.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = tb.byte_class((97, 122))
_STOP = tb.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Second bytes of the letters of U+00C0 to U+00FF, after 0xC3.
_LATIN = tb.byte_class((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Pieces of a-z and of letters of U+00C0 to U+00FF: normalizers only lower their case, and SPLIT leaves them whole.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that ByteLevel writes for bytes.
_SHOWN = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}


def cuts_alike(path: str) -> bool:
    """Whether a tokenizer file drops case and white space and splits words by SPLIT, so that pieces may be encoded apart."""
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    normal = kept.get("normalizer") or {}
    parts = (kept.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = parts[0]
    return (
        [n.get("type") for n in normal.get("normalizers", [])] == NORMALIZERS
        and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
        and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in parts[1:]] == [("ByteLevel", False, False)]
        and kept.get("post_processor") is None
    )


def _with(places: np.ndarray, more: np.ndarray, size: int) -> np.ndarray:
    """Both lists of places up to ``size``, in order and once each."""
    mark = np.zeros(size + 1, dtype=bool)
    mark[places] = True
    mark[more] = True
    return np.flatnonzero(mark)


def _shown(word: bytes) -> str:
    """A piece that _PLAIN matches as the tokenizer's model gets it."""
    return word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(_SHOWN)


class WordEncoder:
    """Token ids of whole texts; of a tokenizer that drops white space and case each distinct piece is encoded once.

    A tokenizer file of another make (``cuts_alike`` says so) encodes every text whole. Otherwise equal to ``encode(text, add_special_tokens=False)``: this tokenizer always parts words at ASCII white space
    and between a letter up to U+00FF and ASCII punctuation but the apostrophe, and A-Z count as a-z where no mark
    can follow (a byte of 0xCC or more), so a text's ids are the ids of its
    lower-cased pieces in order. Pieces of plain letters go straight to the tokenizer's model, as the steps before it only
    lower them and write their bytes as characters; others are encoded many at a time, parted by a special token. A run of texts
    that may hold a special token's own text is cut at white space only, keeps its case, and pieces that may
    hold one are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), cuts_alike(path)
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = special[-1] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if special else -1
        self.hint = min((s[:2].encode() for s in special), default=b"<|")
        self.size = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        kind = np.array([0 if _PLAIN.fullmatch(w) else 2 if self.mark is None or self.hint in w else 1 for w in words], dtype=np.int8)
        ids, counts = [], []
        plain = [[t.id for t in self.model.tokenize(_shown(words[i]))] for i in np.flatnonzero(kind == 0)]
        ids.append(np.fromiter(chain.from_iterable(plain), np.uint32))
        counts.append(np.fromiter(map(len, plain), np.int64))
        other, gap = [words[i] for i in np.flatnonzero(kind == 1)], f" {self.mark} ".encode()
        for a in range(0, len(other), 4096):
            got = self._ids(gap.join(other[a : a + 4096]).decode("utf-8", "replace"))
            marks = np.flatnonzero(got == self.mark_id)
            counts.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
            ids.append(np.delete(got, marks))
        for i in np.flatnonzero(kind == 2):
            ids.append(self._ids(words[i].decode("utf-8", "replace")))
            counts.append(np.array([len(ids[-1])]))
        keys = keys[np.argsort(kind, kind="stable")]
        count = np.concatenate(counts).astype(np.int64)
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *ids])
        keys, first, count = np.concatenate([self.keys, keys]), np.concatenate([self.first, first]), np.concatenate([self.count, count])
        order = np.argsort(keys, kind="stable")  # a few sorted runs, which a stable sort merges
        self.keys, self.first, self.count = keys[order], first[order], count[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; number of ids of each text)."""
        if not self.pieces:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            got = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)
        special = self.hint in data.tobytes()
        if special:
            start, end, of = tb.word_spans(data, offsets, tb.NON_SPACE)
        else:
            marked = np.flatnonzero(data[1:] >= 0xCC)  # before a mark case matters: T with U+0308 stays two characters, t becomes one
            raw, data = data, tb.lowered(data)
            data[marked] = raw[marked]
            start, end, _ = tb.word_spans(data, offsets, tb.NON_SPACE)
            letter = _LETTER[data[:-1]]
            letter[1:] |= _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
            cut = 1 + np.flatnonzero(letter & _STOP[data[1:]])
            start, end = _with(start, cut, len(data)), _with(end, cut, len(data))
            of = np.searchsorted(start, offsets)
        keys = tb.span_hashes(data, start, end)
        keys, one, back = np.unique(tb.mix(keys, 5) if special else keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self._learn([raw[start[i] : end[i]] for i in one[new]], keys[new])
        at = np.searchsorted(self.keys, keys)[back]
        count = self.count[at]
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(self.first[at] - upto[:-1], count) + np.arange(upto[-1])]
        per_text = upto[of[1:]] - upto[of[:-1]]
        out = np.full(len(flat) + len(per_text), end_id, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(per_text)), per_text)] = flat
        return out, per_text + 1


def frames(rows, dtype: str, level: int = 3):
    """The bytes of a file from (doc_id, id bytes) in order."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    ids, table = [], []
    for doc_id, raw in rows:
        frame = pack.compress(raw)
        ids.append(doc_id)
        table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        yield frame
    known = np.array([x is not None for x in ids], dtype=np.uint8)
    numbers = np.array([x or 0 for x in ids], dtype="<i8")
    head = json.dumps({"dtype": dtype, "documents": len(ids)}).encode()
    body = pack.compress(struct.pack("<I", len(head)) + head + known.tobytes() + numbers.tobytes())
    yield struct.pack("<II", INDEX_MAGIC, len(body)) + body
    table.append((8 + len(body), 0, 0))
    seek = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek


class TokenFile:
    """Random access to the documents of a file; a frame whose checksum differs raises ValueError."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        self.file.seek(0, 2)
        size = self.file.tell()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table with checksums")
        self.table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()
        body = self.unpack.decompress(self._at(self.offset[count - 1] + 8, int(self.table[count - 1, 0]) - 8))
        n = struct.unpack_from("<I", body)[0]
        head = json.loads(body[4 : 4 + n])
        docs = head["documents"]
        self.dtype = head["dtype"]
        known = np.frombuffer(body, np.uint8, docs, 4 + n)
        numbers = np.frombuffer(body, "<i8", docs, 4 + n + docs)
        self.doc_ids = [int(v) if k else None for v, k in zip(numbers, known, strict=True)]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of document i as little-endian unsigned 32-bit integers."""
        raw = self.unpack.decompress(self._at(self.offset[i], int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i}: checksum differs")
        return np.frombuffer(raw, self.dtype).astype("<u4")

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Encode every text and write the files in ascending id order; one row per file: part, path, documents, tokens.

    Only ids are shuffled, 2 bytes a token where the vocabulary allows, to ranges of the id column. A null
    text counts as empty (its end id alone), a null id comes first, repeated rows are all written. Without
    rows there are no files.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.array(sorted(set(rows.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else [], dtype=np.float64)

    def encode(batches):
        encoder = tb.kept(WordEncoder, tokenizer)  # pieces that earlier tasks met are known
        dtype = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            number = batch.column(0)
            part = np.searchsorted(bounds, number.fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.float64), side="left")
            for first, last, own, at in tb.runs(data, offsets, ENCODE_RUN):
                ids, count = encoder.encode(own, at, end_id)
                flat = ids.astype(dtype).view(np.uint8)
                size = np.concatenate([[0], np.cumsum(count * int(dtype[-1]))]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(size), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(part[first:last], pa.int32()), number.slice(first, last - first), pa.array([int(dtype[-1])] * (last - first), pa.int32()), held], ["part", "doc_id", "width", "ids"])

    folder = f"{ws.path}/ids"

    def write(batches):
        number, width, docs_, tokens = None, None, 0, 0

        def flow():
            nonlocal number, width, docs_, tokens
            for batch in batches:
                if not len(batch):
                    continue
                number, width = batch.column(0)[0].as_py(), batch.column(2)[0].as_py()
                for d, raw in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                    docs_, tokens = docs_ + 1, tokens + len(raw.as_buffer()) // width
                    yield d, raw.as_py()

        rows_ = flow()
        head = next(rows_, None)
        if head is None:
            return
        path = f"{folder}/part-{number:06d}.tok.zst"

        def every():
            yield head
            yield from rows_

        put(path, frames(every(), f"<u{width}"))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([docs_], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "documents", "tokens"])

    encoded = rows.mapInArrow(tb.tidied(encode), "part int, doc_id long, width int, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return ws.table("files", dealt.mapInArrow(tb.tidied(write), "part int, path string, documents long, tokens long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Read written files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned CRC-32 of the
    ids as little-endian unsigned 32-bit integers), part."""
    spark = files.sparkSession
    listed = files.orderBy("part").collect()  # one row per file
    starts, total = [], 0
    for r in listed:
        starts.append((r.part, r.path, total))
        total += r.tokens
    todo = spark.createDataFrame(starts, "part int, path string, start long").repartitionById(max(1, len(starts)), F.pmod("part", F.lit(max(1, len(starts))))) if starts else spark.createDataFrame([], "part int, path string, start long")

    def read(batches):
        for batch in batches:
            for part, path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = TokenFile(path)
                for lo in range(0, len(held), 4096):
                    hi = min(lo + 4096, len(held))
                    start, count, crc = [], [], []
                    for i in range(lo, hi):
                        ids = held.ids(i)
                        start.append(at)
                        count.append(len(ids))
                        crc.append(zlib.crc32(ids.tobytes()))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids[lo:hi], pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * (hi - lo), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])
                held.close()

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
