"""Media columns by content-defined chunking.

A payload is stored as an 8-bit mono WAV file: a header, kept with the file's row, and a body. The body is cut where a rolling gear hash has ``bits`` zero
bits, so equal stretches of different files give equal chunks wherever they stand; the header, which holds the file's length, is in no chunk. A file is
described by its *manifest*, the ordered list of its chunk digests. Chunks of some 270 bytes are the size of a paragraph, which is what texts share.

1. Each document's manifest is computed; only digests leave the task. Equal texts are one file, described once.
2. Joins on digests give each chunk one owner, the first file that has it. Chunks that stand at several places are *lent* by their owner.
3. The store is written: a row for each file, with the chunks that it has alone. Lent chunks are written once, each in a row, so that a borrower
   need not read its lenders' files.
4. Reading back: a file that has all its chunks alone is put together in place; others join the chunks that are lent. The file's digest is
   verified, and features are computed from the samples read.

Cases: a null text is empty; an empty text has one unit of padding; equal texts give equal values; ids may repeat or be null (rows are joined by
their texts' digests); an empty table gives an empty result; other columns are kept, but for the text
and those named in ``RESULT``, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, documents, fresh

UNIT, RATE, HEADER = 576, 8000, 44
_GEAR = np.random.default_rng(576).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32
RESULT = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def payload_of(text: str | None, unit: int = UNIT) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


def encode_wav(payload: bytes) -> bytes:
    """8-bit mono PCM: a header of 44 bytes and the samples, with a byte of padding after an odd number of them."""
    body = payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + body


def decode_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this store")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j for j below WINDOW, by doubling the window."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW and width < len(h):
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: bytes, least: int, most: int, bits: int) -> list[int]:
    """Ends of the chunks."""
    mask = np.uint32(((1 << bits) - 1) << (32 - bits))
    marks = np.flatnonzero(gear_hashes(data) & mask == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + most, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes, least: int, most: int, bits: int) -> list[bytes]:
    ends = cuts(data, least, most, bits)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _manifest(batches: Iterator[pd.DataFrame], least: int, most: int, bits: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, key in zip(pdf["text"], pdf["_t"], strict=True):
            body = encode_wav(payload_of(text))[HEADER:]
            digests = [hashlib.blake2b(chunk, digest_size=16).digest() for chunk in chunks_of(body, least, most, bits)]
            rows.append((key, digests))
        yield pd.DataFrame(rows, columns=["_t", "chunks"])


def _store(batches: Iterator[pd.DataFrame], least: int, most: int, bits: int) -> Iterator[pd.DataFrame]:
    """Rows of the store: a file whole (kind ``file``) or the chunks that it has alone, in order (``part``), and chunks that it lends (``lent``)."""
    for pdf in batches:
        rows = []
        for key, text, shared, lend in zip(pdf["_t"], pdf["text"], pdf["shared"], pdf["lend"], strict=True):
            media = encode_wav(payload_of(text))
            header, body = media[:HEADER], media[HEADER:]
            chunks = chunks_of(body, least, most, bits)
            if shared is None:
                rows.append(("file", key, hashlib.sha256(media).digest(), header, [], [body]))
                continue
            mine = sorted(set(range(len(chunks))) - set(shared))
            rows.append(("part", key, hashlib.sha256(media).digest(), header, mine, [chunks[i] for i in mine]))
            rows += [("lent", hashlib.blake2b(chunks[i], digest_size=16).digest(), None, None, [], [chunks[i]]) for i in lend]
        yield pd.DataFrame(rows, columns=["kind", "key", "sha", "header", "at", "bytes"])


def feature_of(samples: bytes) -> str:
    """Of the 8-bit samples: their mean (whole, downwards), sum, sum of squares (so mean and deviation), crossings of the middle, number of different values, and peak."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    high = x >= 128
    return f"mean={x.sum() // len(x)};sum={x.sum()};squares={(x * x).sum()};crossings={(high[1:] != high[:-1]).sum()};values={len(np.unique(x))};peak={x.max()}"


def _read(batches: Iterator[pd.DataFrame], borrow: bool) -> Iterator[pd.DataFrame]:
    """Files put together, verified and described."""
    for pdf in batches:
        rows = []
        for i, (key, sha, header, at, own) in enumerate(zip(pdf["key"], pdf["sha"], pdf["header"], pdf["at"], pdf["bytes"], strict=True)):
            if borrow:
                parts = dict(zip(map(int, at), own, strict=True)) | {b["pos"]: b["bytes"] for b in (pdf["borrowed"].iat[i] if pdf["borrowed"].iat[i] is not None else [])}
                media = b"".join([header, *[parts[j] for j in range(len(parts))]])
            else:
                media = header + own[0]
            digest = hashlib.sha256(media)
            if digest.digest() != bytes(sha):
                raise ValueError("a stored file differs from its manifest")
            payload = decode_wav(media)
            rows.append((key, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), len(media), digest.digest(), feature_of(payload)))
        yield pd.DataFrame(rows, columns=["_t", *RESULT])


READ = "_t binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


class ChunkStore:
    """The media of a table's texts: ``manifests`` (text key, file digest, chunks), ``files`` and ``lent`` (the stored bytes)."""

    def __init__(self, docs: DataFrame, text: str = "text", least: int = 128, most: int = 65536, bits: int = 7):
        spark: SparkSession = docs.sparkSession
        self.tables = Tables(spark, "media")
        cut = {"least": least, "most": most, "bits": bits}
        # A row's key is its text's 128-bit hash, so equal texts are one.
        key = F.unhex(F.coalesce(F.md5(docs[text].cast("binary")), F.md5(F.lit("").cast("binary")))).alias("_t")
        self.key = key
        texts = docs.select(key, docs[text].alias("text"))
        every = texts.mapInPandas(functools.partial(_manifest, **cut), "_t binary, chunks array<binary>")
        self.manifests = self.tables.write(every.groupBy("_t").agg(F.first("chunks").alias("chunks"), F.count(F.lit(1)).alias("rows")), "manifests")
        # Most chunks stand at one place only. Hashes of 8 bytes are counted first, so that digests and places are shuffled only of chunks that may repeat; digests decide.
        hashes = self.manifests.select(F.explode(F.transform("chunks", lambda x: F.xxhash64(x))).alias("h"))
        repeated = self.tables.write(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
        held = self.manifests.select("_t", F.posexplode("chunks").alias("pos", "digest")).withColumn("h", F.xxhash64("digest"))
        held = self.tables.write(held.join(broadcast_if_small(repeated), "h", "left_semi").drop("h"), "held")
        owners = held.groupBy("digest").agg(F.min(F.struct("_t", "pos")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = self.tables.write(held.join(owners, "digest").select("_t", "pos", "digest", ((F.col("owner._t") == F.col("_t")) & (F.col("owner.pos") == F.col("pos"))).alias("owns")), "shared")
        # What the writer must know: files with chunks that are lent, and which of these they own.
        told = shared.groupBy("_t").agg(F.collect_list("pos").alias("shared"), F.collect_list(F.when(F.col("owns"), F.col("pos"))).alias("lend"))
        # Only texts that occur more than once are shuffled, so that one row of each writes the file.
        copies = self.manifests.where("rows > 1").select("_t")
        told = self.tables.write(told.join(copies.withColumn("copied", F.lit(True)), "_t", "full"), "told")
        rows = texts.join(broadcast_if_small(told), "_t", "left")
        single = rows.where("copied is null").select("_t", "text", "shared", "lend")
        copied = rows.where("copied").groupBy("_t").agg(F.first("text").alias("text"), F.first("shared").alias("shared"), F.first("lend").alias("lend")).select("_t", "text", "shared", "lend")
        store = single.unionByName(copied).mapInPandas(functools.partial(_store, **cut), "kind string, key binary, sha binary, header binary, at array<int>, bytes array<binary>")
        self.store = self.tables.write(store, "store", by="kind", codec="zstd")
        self.shared = shared

    def sizes(self) -> DataFrame:
        """One row: bytes of the different files' bodies, and what is stored of them. A chunk is stored once, however many files hold it."""
        held = F.aggregate("bytes", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
        of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), held)), F.lit(0))
        lent = self.store.where("kind = 'lent'").select(F.col("key").alias("digest"), held.alias("n"))
        borrowed = self.shared.join(lent, "digest").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("borrowed"))
        stored = self.store.agg(of("file", "part").alias("own"), of("lent").alias("lent"))
        return stored.join(F.broadcast(borrowed), how="left").select((F.col("own") + F.col("borrowed")).alias("body_bytes"), (F.col("own") + F.col("lent")).alias("stored_bytes"))  # a row each

    def read(self) -> DataFrame:
        """(_t, RESULT): a row for each different text, from the stored bytes; digests as bytes."""
        whole = self.store.where("kind = 'file'").select("key", "sha", "header", "at", "bytes").mapInPandas(functools.partial(_read, borrow=False), READ)
        lent = self.store.where("kind = 'lent'").select(F.col("key").alias("digest"), F.get("bytes", F.lit(0)).alias("bytes"))
        borrowed = self.shared.join(lent, "digest").groupBy(F.col("_t").alias("key")).agg(F.collect_list(F.struct("pos", "bytes")).alias("borrowed"))
        parts = self.store.where("kind = 'part'").select("key", "sha", "header", "at", "bytes").join(borrowed, "key", "left")
        return whole.unionByName(parts.mapInPandas(functools.partial(_read, borrow=True), READ))


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes, payload and media figures and features, all read back from the store."""
    docs = docs.drop(*RESULT)
    store = ChunkStore(docs, text)
    read = store.tables.write(store.read(), "read")
    others = [c for c in docs.columns if c != text]
    shown = [F.lower(F.hex(c)).alias(c) if c.endswith("sha256") else F.col(c) for c in RESULT]
    (k,) = fresh(docs, "t")
    return docs.select(*others, store.key.alias(k)).join(read.withColumnRenamed("_t", k), k).select(*others, *shown)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir).select("doc_id", "text"))


def _sql() -> str:
    le = lambda x: f"(select string_agg(substr(printf('%08X', ({x})::bigint), 7 - 2 * i, 2), '' order by i) from range(4) t(i))"
    return f"""
with texts as (
  select doc_id, encode(coalesce(text, '')) as data from documents
), sized as (
  select doc_id, data, octet_length(data)::bigint as n_bytes, greatest(1, ceil(octet_length(data) / {UNIT}.0))::bigint * {UNIT} as payload_bytes from texts
), payloads as (
  select *, hex(data) || repeat('FF', payload_bytes - n_bytes) as h from sized
), samples as (
  select doc_id, i, ('0x' || substr(h, (2 * i + 1)::int, 2))::int as x from (select doc_id, h, unnest(range(payload_bytes)) as i from payloads)
), described as (
  select doc_id, sum(x) as total, sum(x * x) as squares, count(distinct x) as n_values, max(x) as peak,
         sum(case when (x >= 128) <> before then 1 else 0 end) as crossings
  from (select *, lag(x >= 128) over (partition by doc_id order by i) as before from samples) group by doc_id
), ends as (
  select doc_id, list(x::bigint order by i) as tail from samples join sized using (doc_id) where i >= payload_bytes - 32 group by doc_id
), checked as (
  select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, tail), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
         lambda y, r: xor(y >> 1, 3988292384 * (y & 1))))) as crc from ends
), files as (
  select *, from_hex('52494646' || {le("36 + payload_bytes")} || '57415645666D74201000000001000100' || {le(RATE)} || {le(RATE)} || '01000800' || '64617461' || {le("payload_bytes")} || h) as media from payloads
)
select doc_id, n_bytes, payload_bytes, sha256(from_hex(h)) as payload_sha256, crc::bigint as tail_crc32, octet_length(media)::bigint as media_bytes, sha256(media) as media_sha256,
       'mean=' || (total // payload_bytes) || ';sum=' || total || ';squares=' || squares || ';crossings=' || crossings || ';values=' || n_values || ';peak=' || peak as feature
from files join described using (doc_id) join checked using (doc_id)
"""


SQL = _sql()
