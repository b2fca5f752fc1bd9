"""Token ids as length-delimited binary records with an offset index.

A record file is a run of frames: length (u64), masked CRC-32C of the length, payload, masked CRC-32C of the payload, all
little-endian - the framing that many training readers take. A payload is doc_id (i64), number of ids (u32), bytes of an id (u16),
whether doc_id is null (u16), ids. The index file beside it has for each record doc_id, offset and number of ids, so a reader can
fetch records in any order without reading the rest.

Files go to a folder that driver and executors share, by pyarrow's file systems. A task writes under a name of its own attempt, and
only names that a successful attempt has returned count, so a lost executor or a second attempt leaves no half file behind in the result."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import PATTERN, PieceEncoder
from .common import by_size, carried_id, modest_batches, shared_dir, text_of, written

CASTAGNOLI, MASK_DELTA, BLOCK = 0x82F63B78, 0xA282EAD8, 512
HEAD = struct.Struct("<qIHH")
#: Bytes of a frame beside its payload.
FRAME = 16
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u4"), ("is_null", "<u4")])
#: Bytes read at a time, bytes of payloads whose checksums are taken together, bytes of text a file is planned for.
READ, GROUP, FILE_BYTES = 4 << 20, 1 << 20, 256 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """For a byte with k zero bytes after it its share of the checksum, k from BLOCK - 1 to 0; and the checksum's shift by BLOCK zero bytes, by bytes of the checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CASTAGNOLI), one >> 1).astype(np.uint32)
    rows = [one]
    for _ in range(BLOCK - 1):
        rows.append(one[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    shift = []
    for byte in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(BLOCK):
            x = one[x & 0xFF] ^ (x >> 8)
        shift.append(x.tolist())
    return np.concatenate(rows[::-1]), np.arange(BLOCK, dtype=np.int32) * 256, shift


def crc32c(data: bytes) -> int:
    return crc32c_many([data])[0]


def crc32c_many(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part. The checksum is linear: the bytes of all parts, in blocks of BLOCK, are looked up at once and their shares xor-ed; a part's blocks are then folded."""
    flat, base, (s0, s1, s2, s3) = _tables()
    counts = [max(1, -(-len(p) // BLOCK)) for p in parts]
    m = np.zeros(sum(counts) * BLOCK, dtype=np.uint8)
    at = 0
    for part, n in zip(parts, counts, strict=True):
        at += n * BLOCK
        if part:
            m[at - len(part) : at] = np.frombuffer(part, dtype=np.uint8)
        if len(part) >= 4:  # the start value, taken in by the first four bytes
            m[at - len(part) : at - len(part) + 4] ^= 0xFF
    m = m.reshape(-1, BLOCK)
    shares: list[int] = []
    for k in range(0, len(m), 2048):
        shares += np.bitwise_xor.reduce(flat[m[k : k + 2048] + base], axis=1).tolist()
    out, k = [], 0
    for part, n in zip(parts, counts, strict=True):
        acc = 0
        for v in shares[k : k + n]:
            acc = s0[acc & 255] ^ s1[acc >> 8 & 255] ^ s2[acc >> 16 & 255] ^ s3[acc >> 24] ^ v
        k += n
        if len(part) < 4:
            start = 0xFFFFFFFF
            for _ in part:  # the start value, shifted by as many zero bytes
                start = int(flat[(BLOCK - 1) * 256 + (start & 0xFF)]) ^ (start >> 8)
            acc ^= start
        out.append(acc ^ 0xFFFFFFFF)
    return out


def _masked(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def masked(data: bytes) -> int:
    return _masked(crc32c(data))


@lru_cache(maxsize=4096)
def _length_frame(n: int) -> bytes:
    size = struct.pack("<Q", n)
    return size + struct.pack("<I", masked(size))


def frame(payload: bytes) -> bytes:
    return frames_of([payload])[0]


def frames_of(payloads: list[bytes]) -> list[bytes]:
    return [b"".join((_length_frame(len(p)), p, struct.pack("<I", _masked(c)))) for p, c in zip(payloads, crc32c_many(payloads), strict=True)]


def payload_of(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    if not wide and len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"id {int(ids.max())} needs wide records")
    return HEAD.pack(doc_id or 0, len(ids), 4 if wide else 2, doc_id is None) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width, is_null = HEAD.unpack_from(payload)
    return (None if is_null else doc_id), np.frombuffer(payload, dtype=f"<u{width}", count=n, offset=HEAD.size)


def frames(stream: io.RawIOBase, group: int = GROUP) -> Iterator[bytes]:
    """Payloads in file order; ValueError at a broken frame. Payloads of `group` bytes together are verified at once."""
    held, at = b"", 0

    def take(n: int) -> bytes:
        nonlocal held, at
        while len(held) - at < n:
            more = stream.read(max(READ, n))
            if not more:
                raise ValueError("a record is cut off")
            held, at = held[at:] + more, 0
        at += n
        return held[at - n : at]

    def verified(payloads: list[bytes], checks: list[bytes]) -> Iterator[bytes]:
        if [struct.pack("<I", _masked(c)) for c in crc32c_many(payloads)] != checks:
            raise ValueError("a record doesn't match its checksum")
        yield from payloads

    payloads: list[bytes] = []
    checks: list[bytes] = []
    size = 0
    while True:
        if at == len(held):
            held, at = stream.read(READ), 0
            if not held:
                yield from verified(payloads, checks)
                return
        length = take(12)
        (n,) = struct.unpack_from("<Q", length)
        if length != _length_frame(n):
            raise ValueError("a record's length doesn't match its checksum")
        payloads.append(take(n))
        checks.append(take(4))
        size += n
        if size >= group:
            yield from verified(payloads, checks)
            payloads, checks, size = [], [], 0


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_at(path: str, entries: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records with these ordinals, in the order asked for: a shuffled read by the offset index."""
    fs, p = _fs(path)
    with fs.open_input_file(f"{p}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    with fs.open_input_file(p) as f:
        for i in entries:
            f.seek(int(index["offset"][i]))
            yield parse_payload(next(frames(f, group=0)))


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


def _is_plain_byte_level(spec: dict) -> bool:
    """Whether the file is a byte-level vocabulary whose pre-tokenizer is PATTERN and nothing else, so that a text's pieces may be encoded one by one."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    rare = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback")
    return bool(plain and model.get("type") == "BPE" and not any(model.get(x) for x in rare))


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian u32, as Tokenizer.encode gives them without special tokens.

    With a plain byte-level file the library's model encodes each piece once and it is remembered. A text with one of the added tokens, and any text with another kind of file, goes through the library whole."""
    import regex
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        plain = _is_plain_byte_level(json.load(f))
    t = Tokenizer.from_file(tokenizer)
    words, tokenize, letters = regex.compile(PATTERN).findall, t.model.tokenize, byte_letters()
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    packed = [struct.pack("<I", i) for i in range(max(t.get_vocab(with_added_tokens=True).values(), default=0) + 1)]
    space = letters[32]

    def whole(s: str) -> bytes:
        return b"".join([packed[i] for i in t.encode(s, add_special_tokens=False).ids])

    def word(w: str) -> bytes:
        spelled = w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(letters)
        return b"".join([packed[x.id] for x in tokenize(spelled)])

    def encode(s: str) -> bytes:
        return b"".join([packed[x.id] for w in words(s) for x in tokenize(w.encode().decode("latin-1").translate(letters))])

    if not plain:
        return whole
    pieces = PieceEncoder(encode, pattern=PATTERN, word=word, whole=whole)
    return lambda s: whole(s) if any(a in s for a in added) else pieces(s)


def write_records(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, wide: bool = False, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text (null: empty) by a vocabulary file of the tokenizers library, appends end_id and writes the records in ascending doc_id order, null ids first, rows of one id by a hash of the text, then the text.

    Returns the manifest, a row for each file: shard (in record order), path, n_docs, n_ids, n_bytes. wide: 4 bytes an id; else 2, and an id above 65,535 raises ValueError.
    A file is planned for FILE_BYTES of text, with no fewer files than shuffle partitions; many rows of one id spread over several. An empty table gives no file and an empty
    manifest. Other columns are not read."""
    spark = docs.sparkSession
    modest_batches(spark)
    path = path or shared_dir(spark, "records")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carried_id(F.col(doc_id))[1:], text_of(text).alias("text"))
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    ordered = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h").withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, encode = TaskContext.get(), encoder(tokenizer)
        batches = by_size(batches)
        first = next(batches, None)
        if first is None:
            return
        fs, folder = _fs(path)
        fs.create_dir(folder, recursive=True)
        shard = context.partitionId()
        name = f"part-{shard:06d}-{context.taskAttemptId()}.rec"
        end = b"" if end_id is None else struct.pack("<I", end_id)
        offset = total = count = 0
        with fs.open_output_stream(f"{folder}/{name}") as out, fs.open_output_stream(f"{folder}/{name}.idx") as index:
            while first is not None:
                entries, payloads = [], []
                doc_ids = [None if none else int(i) for i, none in zip(first["doc_id"], first["no_id"], strict=True)]
                for i, t in zip(doc_ids, first["text"], strict=True):
                    ids = np.frombuffer(encode(t) + end, dtype="<u4")
                    payloads.append(payload_of(i, ids, wide))
                    entries.append((i or 0, offset, len(ids), i is None))
                    offset, total, count = offset + len(payloads[-1]) + FRAME, total + len(ids), count + 1
                out.write(b"".join(frames_of(payloads)))
                index.write(np.array(entries, dtype=INDEX).tobytes())
                first = next(batches, None)
        yield pd.DataFrame([[shard, f"{path}/{name}", count, total, offset]], columns=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    return written(ordered.mapInPandas(write, "shard int, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids in all records before), n_tokens, ids_crc32 of the ids as unsigned 32-bit integers, path and position - from the files, every checksum verified.

    One task reads one file, in blocks of a few MB. Starts come from the manifest, which has a row a file."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    files = manifest.count()
    listed = manifest.select("shard", "path", before.alias("base")).repartition(max(1, files))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                fs, p = _fs(path)
                rows: list[tuple] = []
                start = int(base)
                with fs.open_input_stream(p) as f:
                    for position, payload in enumerate(frames(f)):
                        i, ids = parse_payload(payload)
                        rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path, position))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "path", "position"])
    out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")  # not by way of doubles
    return out
