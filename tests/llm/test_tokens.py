"""Byte-level BPE and packing against the libraries themselves."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hindsight.llm import byte_bpe, packing
from tests.conftest import bag, order

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk, overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (600, 150)])
def test_digests(docs, rows, chunk, overlap):
    """Chunks of any size give the library's ids, and decoding gives the text back."""
    enc = byte_bpe.encoder(RANKS, PATTERN)
    want = []
    for r in rows:
        text = r[1] or ""
        # the library itself cannot take long white space
        ids = enc.encode_ordinary(text) if "   " not in text else byte_bpe.encode_text(enc, text)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert bag(byte_bpe.digests(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap)) == sorted(want, key=order)


def test_long_white_space(monkeypatch):
    enc = byte_bpe.encoder(RANKS, PATTERN)
    texts = ["a" + " " * n + tail for n in (1, 2, 29, 30, 31, 60) for tail in ("", "b", "!", "\n")] + ["\n" * 40 + " x", " \t" * 30, "  " + " " * 40 + "y"]
    want = [enc.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "LONG_SPACE", 30)
    monkeypatch.setattr(byte_bpe, "_RUN", byte_bpe.re.compile(f"[{byte_bpe._SPACES}]{{30,}}"))
    assert [byte_bpe.encode_text(enc, t) for t in texts] == want


def test_encode_then_decode(docs, rows):
    ids = byte_bpe.encode(docs, RANKS, PATTERN, chunk=600, overlap=150)
    back = byte_bpe.decode(ids, RANKS, PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_empty(no_docs):
    assert byte_bpe.digests(no_docs, RANKS, PATTERN).collect() == []
    assert packing.pack(no_docs, WORD_BPE).collect() == []


def test_pack(docs, rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {}
    for r in rows:
        ids.setdefault((r[0], len(r[1] or "")), []).append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = packing.pack(docs, WORD_BPE, length=512, with_ids=True)
    found = got.collect()
    texts = Counter()
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        texts[r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]] += 1
    want = Counter()
    for (doc, _), many in ids.items():
        for data in many:
            for start in range(0, len(data) // 4, 512):
                want[doc, start, data[4 * start : 4 * (start + 512)], len(data) // 4] += 1
    assert texts == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(got).collect()}
    assert joined == {k: b"".join(d for _, _, d in sorted(v)) for k, v in by.items()}


@pytest.mark.parametrize("count", [1, 7, 400, 50_000])
def test_plan(count):
    """Every piece is placed once, nothing overflows, and large inputs are filled well."""
    rng = np.random.default_rng(count)
    demand = Counter(np.minimum(rng.lognormal(3.5, 1, count).astype(int) % 256 + 1, 256).tolist())
    plan = packing.cutting_plan(demand, 256)
    used = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 256 and times > 0
        for s, n in pattern.items():
            used[s] += n * times
    assert used == demand
    if count >= 50_000:
        assert sum(t for _, t in plan) <= 1.01 * -(-sum(s * n for s, n in demand.items()) // 256)


def test_words_as_the_library(rows):
    enc, tokenizer = packing.encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in [r[1] or "" for r in rows] + ["don't 'LL ÀÉÿ ßx×y÷ 12a's ''s _-_ \t\r\n a", "q" * 300]:
        assert enc.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
