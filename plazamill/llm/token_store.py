"""Token ids in binary files with a shared zstandard dictionary.

File format (little endian). A segment holds documents in ascending doc_id order:

    "PZTK" | version u32 | width u32 (bytes of an id) | dictionary hash u64 | documents u64 | tokens u64
    frames, one zstandard frame a document, all made with the shared dictionary
    index: for each document doc_id i64, offset of its frame u64, token count u64, flags u64 (1: doc_id is null)
    offset of the index u64

So a short document is read by one seek in the index and one small frame. `dictionary.zdict` beside the segments is
trained on the serialised ids of a bounded sample of documents (the SAMPLE_DOCS least hashes of doc_id, up to
SAMPLE_BYTES of each; compression only, no result depends on it); its xxh64 stands in each segment and is checked by the reader.

Texts are encoded whole. Where the tokenizer's own file proves that white space never joins two pieces and that
letters are lower-cased (see `separable`), a text is cut there, and between a Latin letter and a stop. The pieces of a
slice of texts are cut and made distinct as Arrow arrays; the library encodes those that the Python worker has not met,
and all are looked up. Texts that spell an added token go to the library as they are. With any other file every text
goes to the library as it is.

Frames are written to a table first; ranges of (doc_id, hash of the text, a number drawn once) are then cut by Spark's
range partitioning, so neither null ids nor any number of repeats of one id make a range that can't be cut. Segments
are written under a name of their own by each attempt, and the manifest (Parquet) names the files of the attempts that
counted. Null text is an empty document (end id only); null ids come first; rows that repeat an id follow each other
in the order of their texts' hashes; very long texts are one frame; other columns are ignored, whatever their names; an
empty table writes no segment.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import slices

HEAD, HEAD_BYTES = "<4sIIQQQ", 36
ENTRY = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("tokens", "<u8"), ("flags", "<u8")])
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 16 << 10
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 16 << 20
RANGE_BYTES = 32 << 20
#: Of texts that are encoded at a time: the more, the fewer pieces are looked up.
TEXT_BYTES = 2 << 20
MOST_PIECES, KEPT_PIECES = 600_000, 300_000
#: An encoding holds far more than its ids, so few of them live at a time.
ASK, ASK_CHARS = 2000, 1 << 20
PLAIN = re.compile("[a-zß-öø-ÿ]+")
WHITE, STOP, LETTER, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[list(b",.!?;:")], KIND[97:123] = WHITE, STOP, LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Second bytes, after C3, of capital and of small Latin-1 letters.
CAPITAL, SMALL = np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = SMALL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
#: Marks start with this byte or a greater one. A letter before them is not lower-cased here: composing comes first, and
#: some small letters compose with a mark where the capital does not.
MARK = 0xCC
#: The normalizer and pre-tokenizer under which pieces between white space are independent: white space becomes one
#: blank and is dropped by a pattern whose matches hold none; letters are lower-cased before; bytes are spelt after.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def separable(spec: dict) -> bool:
    """Whether a tokenizer's file says that it splits at white space and lower-cases, as SPLITTING does, over a model
    that maps each pre-token by itself and always alike."""
    model = spec.get("model") or {}
    return all(spec.get(k) == v for k, v in SPLITTING.items()) and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")


class Cut:
    """The pieces of all texts, lower-cased, as one binary array. first: for each text its first piece, and at the end the
    number of pieces; spells: which texts spell one of `added` in any case (they have no pieces)."""

    def __init__(self, texts: pa.Array, added: list[bytes]):
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
        self.spells = np.zeros(len(texts), bool)
        buf, bounds = self.bytes_of(texts)
        low = LOWER[buf]
        if added:
            lowered = binary(bounds, low)
            for a in added:
                self.spells |= pc.match_substring(lowered, a).to_numpy(zero_copy_only=False)
        if self.spells.any():
            buf, bounds = self.bytes_of(pc.if_else(pa.array(self.spells), "", texts))
            low = LOWER[buf]
        after = np.append(buf[1:], np.uint8(0)) >= MARK
        held = np.flatnonzero(after & (low != buf))
        low[held] = buf[held]
        second = np.append(False, buf[:-1] == 0xC3)[: len(buf)]
        low[second & CAPITAL[buf] & ~after] += 32
        kind = KIND[low]
        word = kind != WHITE
        letter = (kind == LETTER) | (second & SMALL[low])
        cut = np.zeros(len(low) + 1, bool)
        cut[1:-1] = (word[1:] != word[:-1]) | (letter[:-1] & (kind[1:] == STOP))
        cut[bounds] = True
        at = np.flatnonzero(cut)
        own = word[at[:-1]]
        self.first = np.searchsorted(at[:-1][own], bounds)
        self.pieces = binary(np.append(0, np.cumsum(np.diff(at)[own])), low[word])

    @staticmethod
    def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Their bytes, and where each starts and the last ends."""
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


class Pieces(dict):
    """Piece -> its number; an unknown piece gets the next number and waits for encoding."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Texts to ids. Memory is bounded: past MOST_PIECES distinct pieces only the KEPT_PIECES most used ones stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = separable(spec)
        #: In lower case: such a token may be looked for before or after lower-casing.
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens") or []]
        self.model = self.tokenizer.model
        #: How the byte-level pre-tokeniser writes the letters of PLAIN words that are not ASCII.
        self.spelt = {i: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100) if i != 0xF7} if self.by_piece else {}
        self.reset()

    def reset(self) -> None:
        self.pieces = Pieces()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.len, self.uses = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def shrink(self) -> None:
        names = list(self.pieces)
        keep = np.sort(np.argsort(-self.uses[: len(names)], kind="stable")[:KEPT_PIECES])
        flat, at, lens, uses = self.flat, self.at[keep], self.len[keep], self.uses[keep]
        self.reset()
        for i in keep.tolist():
            self.pieces[names[i]]
        self.pieces.new = []
        own = np.concatenate([flat[a : a + n] for a, n in zip(at.tolist(), lens.tolist())])
        self.flat = np.concatenate([own, np.zeros(1 << 19, np.uint32)])
        self.used = len(own)
        self.at, self.len, self.uses = (np.concatenate([x, np.zeros(1 << 18, np.int64)]) for x in (np.cumsum(lens) - lens, lens, uses // 2))

    def ids(self, texts: list[str]) -> list[list[int]]:
        out, a = [], 0
        while a < len(texts):
            z, chars = a, 0
            while z < len(texts) and z - a < ASK and (z == a or chars + len(texts[z]) <= ASK_CHARS):
                chars += len(texts[z])
                z += 1
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[a:z], add_special_tokens=False)]
            a = z
        return out

    def learn(self) -> None:
        """Encodes the waiting pieces. A word of small Latin letters is one pre-token that normalising leaves as it is, so
        the library's model takes it directly; all else goes through the library whole."""
        new, self.pieces.new = self.pieces.new, []
        n, said, lens, places, rest = len(self.pieces), [], [], [], {}
        for i, piece in enumerate(new, n - len(new)):
            word = piece.decode()
            if PLAIN.fullmatch(word):
                before = len(said)
                said += [t.id for t in self.model.tokenize(word.translate(self.spelt))]
                lens.append(len(said) - before)
                places.append(i)
            else:
                rest[i] = word
        for ids in self.ids(list(rest.values())):
            said += ids
            lens.append(len(ids))
        places += rest
        flat, lens = np.array(said, np.uint32), np.array(lens, np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.at):
            self.at, self.len, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[places], self.len[places] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(flat)

    def encode(self, texts: pa.Array | list[str | None], end: int) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_piece:
            return [np.array([*x, end], np.uint32) for x in self.ids([t or "" for t in texts.to_pylist()])]
        if len(self.pieces) > MOST_PIECES:
            self.shrink()
        cut = Cut(texts, self.added)
        spells = np.flatnonzero(cut.spells)
        whole = dict(zip(spells.tolist(), self.ids(texts.take(pa.array(spells)).to_pylist())))
        every = cut.pieces.dictionary_encode()
        which = every.indices.to_numpy(zero_copy_only=False)
        known = np.fromiter(map(self.pieces.__getitem__, every.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(every.dictionary))
        if self.pieces.new:
            self.learn()
        self.uses[known] += np.bincount(which, minlength=len(known))
        lens = self.len[known][which]
        stop = np.cumsum(lens)
        tokens = self.flat[np.repeat(self.at[known][which] - (stop - lens), lens) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.append(0, stop)[cut.first]
        return [np.append(np.array(whole[i], np.uint32) if i in whole else tokens[edge[i] : edge[i + 1]], np.uint32(end)) for i in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def width(largest: int) -> int:
    return 2 if largest < 1 << 16 else 4


def open_fs(path: str):
    return fs.FileSystem.from_uri(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, dtype: str) -> bytes:
    """From the serialised ids of a bounded sample; it shapes compression only."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")).limit(SAMPLE_DOCS).distinct()
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").limit(SAMPLE_DOCS)

    def run(batches):
        for b in slices(batches, most=TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(dtype).tobytes()[:SAMPLE_BYTES] for x in encoder(tokenizer).encode(b.column(0), end)], pa.binary())], ["ids"])

    samples = [bytes(r["ids"]) for r in some.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to learn from: an empty dictionary
        return b""


def dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, out: str | None = None) -> str:
    """Encodes all documents into segments below `out` (default: the shared folder) and returns that folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    out = out or scratch.path("store")
    largest = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end)
    dtype = f"<u{width(largest)}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = train_dictionary(slim, tokenizer, end, dtype)
    mark = xxhash.xxh64_intdigest(trained)
    files, root = open_fs(out)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(trained)

    least = -(1 << 63)

    def encode(batches):
        press = zstandard.ZstdCompressor(level=3, dict_data=dictionary(trained), write_content_size=True)
        for b in slices(batches, most=TEXT_BYTES):
            ids = encoder(tokenizer).encode(b.column(1), end)
            drawn = np.frombuffer(uuid.uuid4().bytes[:8], np.int64)[0] ^ np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(drawn), pa.array([len(x) for x in ids], pa.int64()), pa.array([press.compress(x.astype(dtype).tobytes()) for x in ids], pa.binary())], ["doc_id", "h", "drawn", "tokens", "frame"])

    hashed = slim.select("doc_id", "text", F.xxhash64("text").alias("h"))
    framed = scratch.save(hashed.mapInArrow(encode, "doc_id long, h long, drawn long, tokens long, frame binary"), "frames")
    ranges = max(1, math.ceil((slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / RANGE_BYTES))
    order = ["doc_id", "h", "drawn"]
    # the number of a range is that of its partition, and ranges ascend
    rows = framed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "doc_id", "tokens", "frame")

    def write(batches):
        files, root = open_fs(out)
        made, ids, tokens, frames, size, part = [], [], [], [], 0, 0

        def flush():
            name = f"{part:08d}-{len(made):05d}-{uuid.uuid4().hex[:8]}.seg"
            index = np.zeros(len(ids), ENTRY)
            index["doc_id"] = [least if i is None else i for i in ids]
            index["flags"] = [i is None for i in ids]
            index["tokens"] = tokens
            lens = np.array([len(f) for f in frames], np.uint64)
            index["at"] = HEAD_BYTES + np.cumsum(lens) - lens
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(struct.pack(HEAD, b"PZTK", 1, int(dtype[2]), mark, len(ids), sum(tokens)))
                f.write(b"".join(frames))
                f.write(index.tobytes())
                f.write(struct.pack("<Q", HEAD_BYTES + int(lens.sum())))
            made.append((part, len(made), name, len(ids), sum(tokens)))

        for b in batches:
            for r, i, n, f in zip(*(c.to_pylist() for c in b.columns)):
                part = r
                ids.append(i), tokens.append(n), frames.append(f)
                size += len(f)
                if size >= SEGMENT_BYTES:
                    flush()
                    ids, tokens, frames, size = [], [], [], 0
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["range", "number", "name", "documents", "tokens"])

    manifest = rows.mapInArrow(write, "range int, number int, name string, documents long, tokens long")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    scratch.drop("frames")
    return out


def segments(spark: SparkSession, store: str) -> DataFrame:
    """The manifest, one row per segment, with the tokens of all segments before it: within a range, then over ranges."""
    m = spark.read.parquet(f"{store}/manifest")
    within = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = m.groupBy("range").agg(F.sum("tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(over), F.lit(0)))
    return m.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(ranges.select("range", "base"), "range").select("name", (F.col("base") + F.col("before")).alias("base"))


class Segment:
    """Random access to one segment."""

    def __init__(self, files, path: str, trained: bytes):
        self.file = files.open_input_file(path)
        magic, version, self.width, mark, self.documents, self.tokens = struct.unpack(HEAD, self.file.read_at(HEAD_BYTES, 0))
        if magic != b"PZTK" or version != 1 or mark != xxhash.xxh64_intdigest(trained):
            raise ValueError(f"{path}: not a segment of this store, or of another dictionary")
        size = self.file.size()
        (self.end,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.index = np.frombuffer(self.file.read_at(size - 8 - self.end, self.end), ENTRY)
        self.unpress = zstandard.ZstdDecompressor(dict_data=dictionary(trained))

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by one small read."""
        start = int(self.index["at"][i])
        stop = int(self.index["at"][i + 1]) if i + 1 < self.documents else self.end
        return self.decoded(self.file.read_at(stop - start, start))

    def decoded(self, frame) -> np.ndarray:
        return np.frombuffer(self.unpress.decompress(frame), f"<u{self.width}")

    def every(self, at_once: int = 2000):
        """(first document, their ids) in pieces; the frames come in one read a piece."""
        edge = np.append(self.index["at"].astype(np.int64), self.end)
        for a in range(0, self.documents, at_once):
            z = min(a + at_once, self.documents)
            raw = memoryview(self.file.read_at(int(edge[z] - edge[a]), int(edge[a])))
            yield a, [self.decoded(raw[edge[i] - edge[a] : edge[i + 1] - edge[a]]) for i in range(a, z)]


def read_documents(spark: SparkSession, store: str, digest=None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) read back from the files; with `digest`, "crc32": ids_crc32 instead of ids."""
    import zlib

    def run(batches):
        files, root = open_fs(store)
        with files.open_input_file(f"{root}/dictionary.zdict") as f:
            trained = f.read()
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                seg = Segment(files, f"{root}/{name}", trained)
                index = seg.index
                start = base + np.cumsum(index["tokens"].astype(np.int64)) - index["tokens"].astype(np.int64)
                for a, some in seg.every():
                    part = slice(a, a + len(some))
                    all_ids = [x.astype("<u4") for x in some]
                    last = pa.array([zlib.crc32(x.tobytes()) for x in all_ids], pa.int64()) if digest else pa.array([x.tolist() for x in all_ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"][part], mask=index["flags"][part] == 1), pa.array(start[part]), pa.array([len(x) for x in all_ids], pa.int64()), last], ["doc_id", "start", "n_tokens", "x"])

    parts = segments(spark, store)
    n = max(1, spark.read.parquet(f"{store}/manifest").count())
    out = parts.repartition(n, "name").mapInArrow(run, f"doc_id long, start long, n_tokens long, x {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("x", "ids_crc32" if digest else "ids")
