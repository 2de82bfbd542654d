"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts each text into chunks that depend on content alone, so documents that share a passage share
chunks. Chunks found in several places are encoded once: the heaviest, at most `shared` of them, in a job of their own
whose results are broadcast (a bound on size, not on results), the others once in each Python worker, which keeps the
KEPT last ones over all its tasks. A chunk's
ids are right except around its two ends, so each join of chunks is repaired: the text around it is encoded anew,
further and further into the next chunk, until both agree on where a pre-token begins; from there on the scan of the
text and the scan of the chunk are the same. Special strings part a text before all else, as in the library.

A null text is the empty text, with no ids; repeated rows are encoded each; empty tables give no rows; other
columns of the input are not read. Decoding replaces bytes that are not UTF-8 as the library does.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, durable, table, texts_of
from .wordbpe import Cached, byte_letters, loaded, tokenizer_path

MASK = (1 << 10) - 1  # chunks of a kilobyte on average
SHARED = 16_384
KEPT = 8_192  # chunks in a worker's cache
LARGEST = 8_192  # bytes of a chunk that is worth keeping
HEAD = 12  # pre-tokens at a chunk's start that are kept for repairs
TAIL = 3  # pre-tokens at a text's end that more text may change

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
UNSAFE = re.compile(r"[^\t\n\r -~¡-ſ]")
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


class ByteBpe:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json", path))
        self.model = self.library.model
        self.letters = byte_letters()
        of = {c: b for b, c in self.letters.items()}
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for mapped, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = mapped.encode() if i in added else bytes(of[c] for c in mapped)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def pretokens(self, text: str) -> list[str]:
        if not UNSAFE.search(text):
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, pretoken: str) -> list[int]:
        return [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def chunks(raw: bytes) -> list[bytes]:
    """raw cut after each character at whose end the hash of the 32 bytes before has its low bits clear."""
    if len(raw) < 64:
        return [raw] if raw else []
    data = np.frombuffer(raw, np.uint8)
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    cut = np.flatnonzero((h >> np.uint32(16) & np.uint32(MASK)) == 0) + 1
    cut = cut[cut < len(raw)]
    cut = cut[data[cut] & 0xC0 != 0x80]
    edges = [0, *cut.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


_kept: dict = {}


def packed(found: tuple) -> bytes | None:
    """A chunk's encoding as bytes: tail, ids before it, how many starts, starts, ids before each, ids; None without."""
    ids, starts, counts, tail, before = found
    return None if ids is None else np.array([tail, before, len(starts), *starts, *counts], "<u4").tobytes() + ids


def unpacked(raw: bytes) -> tuple:
    tail, before, n = np.frombuffer(raw, "<u4", 3).tolist()
    return raw[12 + 8 * n :], np.frombuffer(raw, "<u4", n, 12).tolist(), np.frombuffer(raw, "<u4", n, 12 + 4 * n).tolist(), tail, before


class Encoder:
    """Encodes texts chunk by chunk; `shared` holds packed encodings by chunk, and each Python worker keeps those it made
    last as (ids, starts, ids before each, tail, ids before the tail)."""

    def __init__(self, path: str | None, shared: dict):
        self.tok, self.cache = loaded(ByteBpe, path)
        self.shared = shared
        if path not in _kept:
            _kept[path] = Cached(self.chunk, KEPT)
        self.kept = _kept[path]

    def scan(self, raw: bytes) -> tuple[list[int], list[bytes]]:
        """The starts of raw's pre-tokens and each one's ids."""
        pre = self.tok.pretokens(raw.decode())
        if raw.isascii():
            sizes = list(map(len, pre))
        else:
            sizes = [len(p.encode()) for p in pre]
        starts = np.cumsum([0, *sizes[:-1]]).tolist() if pre else []
        return starts, [self.cache[p] for p in pre]

    def chunk(self, raw: bytes) -> tuple:
        starts, parts = self.scan(raw)
        if len(parts) < HEAD + TAIL:
            return None, starts, [], 0, 0
        counts = np.cumsum([0, *(len(p) for p in parts[:HEAD])]).tolist()
        return b"".join(parts), starts[: HEAD + 1], counts, starts[-TAIL], sum(map(len, parts[:-TAIL]))

    def segment(self, raw: bytes) -> bytes:
        """The ids of a text without special strings, as little-endian uint32."""
        out, pending = [], b""
        for piece in chunks(raw):
            known = self.shared.get(piece)
            if known is not None:
                found = unpacked(known)
            else:
                found = self.kept[piece] if len(piece) <= LARGEST else self.chunk(piece)
            ids, starts, counts, tail, before_tail = found
            if ids is None:
                pending += piece
                continue
            begin = 0
            if pending:
                agreed = None
                for k in (1, 2, 4, HEAD - TAIL):
                    window = pending + piece[: starts[k + TAIL]]
                    seen, parts = self.scan(window)
                    want = len(pending) + starts[k]
                    if want in seen[: 1 - TAIL] and starts[k] <= tail:
                        agreed = k
                        out.append(b"".join(parts[: seen.index(want)]))
                        break
                if agreed is None:
                    pending += piece
                    continue
                begin = counts[agreed]
            out.append(ids[begin:before_tail])
            pending = piece[tail:]
        if pending:
            out.append(b"".join(self.scan(pending)[1]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        out = []
        for part in self.tok.at_special.split(text) if "<|" in text else [text]:
            if part in self.tok.special:
                out.append(self.tok.special[part].to_bytes(4, "little"))
            else:
                out.append(self.segment(part.encode()))
        return np.frombuffer(b"".join(out), "<u4").tolist()


def fingerprint(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def shared_chunks(docs: DataFrame, path: str | None = None, most: int = SHARED) -> dict:
    """Encodings of the chunks that occur more than once, heaviest (bytes times occurrences) first, at most `most`."""
    spark = docs.sparkSession
    tok_path = path

    def count(batches):
        for batch in batches:
            seen: dict[bytes, list] = {}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch), strict=True):
                for piece in chunks(text.encode()):
                    if 128 <= len(piece) <= LARGEST and doc_id is not None:
                        seen.setdefault(fingerprint(piece), [0, len(piece), doc_id])[0] += 1
            values = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([v[i] for v in values], t) for i, t in enumerate((pa.int64(), pa.int64(), batch.schema.field("doc_id").type)))], ["chunk", "n", "size", "owner"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(count, f"chunk binary, n long, size long, owner {kind}")
    counted = counted.groupBy("chunk").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min("owner").alias("owner")).filter("n > 1")
    counted = durable(counted.select("chunk", "owner", (F.col("n") * F.col("size")).alias("weight")), "chunks")
    bands = counted.groupBy(F.floor(4 * F.log2("weight")).alias("band")).agg(F.count("*").alias("keys"), F.min("weight").alias("least")).sort(F.desc("band")).collect()
    kept, cut = 0, None
    for row in bands:
        if kept + row["keys"] > most:
            break
        kept, cut = kept + row["keys"], row["least"]
    if cut is None:
        return {}
    chosen = counted.filter(F.col("weight") >= cut)
    owners = chosen.select(F.col("owner").alias("doc_id")).distinct()
    wanted = spark.sparkContext.broadcast(set(chosen.select("chunk").toArrow()["chunk"].to_pylist()))

    def encode(batches):
        encoder = Encoder(tok_path, {})
        for batch in batches:
            rows = {}
            for text in texts_of(batch):
                for piece in chunks(text.encode()):
                    if piece not in rows and fingerprint(piece) in wanted.value:
                        rows[piece] = packed(encoder.chunk(piece))
            rows = {k: v for k, v in rows.items() if v is not None}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], ["chunk", "encoding"])

    encoded = docs.join(F.broadcast(owners), "doc_id", "left_semi").select("text").mapInArrow(encode, "chunk binary, encoding binary")
    got = encoded.groupBy("chunk").agg(F.min("encoding").alias("encoding")).toArrow()
    return dict(zip(got["chunk"].to_pylist(), got["encoding"].to_pylist(), strict=True))


def bpe_encode(docs: DataFrame, path: str | None = None, shared: int = SHARED) -> DataFrame:
    """(doc_id, ids) of every text."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, shared))

    def run(batches):
        encoder = Encoder(path, known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([encoder.encode(t) for t in texts_of(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""

    def run(batches):
        tok, _ = loaded(ByteBpe, path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([None if i is None else tok.decode(i) for i in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digest(docs: DataFrame, path: str | None = None, shared: int = SHARED) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without moving the ids."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, shared))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        encoder = Encoder(path, known.value)
        tok = encoder.tok
        for batch in batches:
            out = [[], [], []]
            for text in texts_of(batch):
                ids = encoder.encode(text)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(tok.decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))
