"""Packing against the tokenizers library, plain best fit and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from lagspark.llm import packing
from lagspark.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(tokenizer):
    return pytest.importorskip("tokenizers").Tokenizer.from_str(tokenizer.decode())


def test_ids_equal_the_library(tokenizer, library, monkeypatch):
    codec, rng = packing.Encoder(tokenizer), random.Random(1)
    letters = " ab\n\t'sé日😀12!_  \x1c"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b", " " * 9000, "\n" * 5000 + "x", "'" * 300, "x" * 20000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for stretch in (packing.STRETCH, 16):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        for text in texts:
            assert codec.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [1, 8, 64])
def test_best_fit_equals_plain_search(size):
    rng = random.Random(size)
    for _ in range(50):
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 60))), reverse=True)
        room = []
        for length in lengths:
            held = [r for r in room if r >= length]
            room.remove(min(held)) if held else None
            room.append((min(held) if held else size) - length)
        packed = packing.best_fit(lengths, size)
        assert sorted(size - sum(lengths[p] for p in w) for w in packed) == sorted(room)
        assert sorted(p for w in packed for p in w) == list(range(len(lengths)))


def test_top_up_leaves_no_padding():
    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted((rng.choice([1, 33, 40, 64, rng.randint(1, 64)]) for _ in range(rng.randint(0, 30))), reverse=True)
        full = packing.top_up([[(p, 0, lengths[p]) for p in w] for w in packing.best_fit(lengths, 64)], 64)
        loads = [sum(b - a for _, a, b in w) for w in full]
        assert all(n <= 64 and n & (n - 1) == 0 for n in loads) and sum(loads) == sum(lengths)
        assert sum(n < 64 for n in loads) <= 6  # at most one window of each smaller power
        places = sorted((p, i) for w in full for p, a, b in w for i in range(a, b))
        assert places == [(p, i) for p, n in enumerate(lengths) for i in range(n)]


def check(found, want, size):
    """Pieces tile their documents, sequences are gapless, ids and digests are those of the text."""
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and {r["padding"] for r in pieces} == {0 if at & (at - 1) == 0 else size - at}
    assert by_doc.keys() == want.keys()
    for doc, texts in want.items():
        assert sorted(r["doc_tokens"] for r in by_doc[doc] if r["start"] == 0) == sorted(map(len, texts))
        got = sorted((r["doc_tokens"], r["start"], bytes(r["ids"])) for r in by_doc[doc])
        if len(texts) == 1:
            assert b"".join(x for _, _, x in got) == np.array(texts[0], "<u4").tobytes()
        assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, texts))


@pytest.mark.parametrize("group_bytes", [1 << 24, 2000])
def test_pack(spark, tokenizer, library, group_bytes):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["stone", "river", "Übung", "7"]) for _ in range(rng.choice([3, 30, 400]))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", None), (102, "x" * 3000, "x"), (None, "no id", "x"), (5, "again", "x"), (100, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    for fill in (True, False):
        found = packing.pack(docs, tokenizer, size=64, fill=fill, group_bytes=group_bytes).collect()
        check(found, want, 64)
        assert not fill or not any(r["padding"] for r in found)
    # One third of all rows under one id, and a text over many windows, are spread over groups.
    if group_bytes == 2000:
        assert len({r["sequence_id"] >> 40 for r in found}) > 3


def test_pack_nothing(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, tokenizer, size=100)


def test_pack_a_very_long_text(spark, tokenizer, library):
    text = "one more word of many " * 100_000 + " " * 10_000
    found = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer, group_bytes=1 << 19)
    check(found.collect(), {1: [[*library.encode(text, add_special_tokens=False).ids, 1]]}, 2048)
