"""Shared passages are stored once and come back whole."""

import hashlib
import random

from wayfind.llm import media


def test_shared_passages_are_stored_once(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(900)
    texts = [text(300 + 7 * i) + passage + text(200 + i) for i in range(6)] + [text(500), "", None, passage * 3, passage * 3]
    store = media.ChunkStore(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bodies = {media.encode_wav(media.payload_of(t))[media.HEADER :] for t in texts}
    chunks = [c for b in bodies for c in media.chunks_of(b, 128, 65536, 7)]
    sizes = store.sizes().first()
    assert sizes["body_bytes"] == sum(map(len, bodies)) and sizes["stored_bytes"] == sum(map(len, set(chunks)))
    assert sizes["stored_bytes"] < 0.7 * sizes["body_bytes"]
    got = {bytes(r["media_sha256"]): bytes(r["payload_sha256"]) for r in store.read().collect()}
    assert got == {hashlib.sha256(media.encode_wav(p)).digest(): hashlib.sha256(p).digest() for p in map(media.payload_of, texts)}


def test_equal_beginnings_share_though_lengths_differ(spark):
    start = " ".join(str(i * i) for i in range(600))
    store = media.ChunkStore(spark.createDataFrame([(1, start + "a" * 50), (2, start + "b" * 5000)], "doc_id long, text string"))
    assert store.shared.count() > 4
    assert media.ChunkStore(spark.createDataFrame([], "doc_id long, text string")).sizes().first()["stored_bytes"] == 0
