import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabloom.llm import bpe

PARTS = ["a", "the ", "  ", "\n", " \n", " ", "'re", "'", "é", " 12", "3.5", "<|endoftext|>", "<|end", "oftext|>", "!!", "日本", "\xa0", "\t", "\x1c",
         "\x00", "᠎", "​", "😀", "ﬁ", "Ⅷ", "\x85", "'s", "x'll ", "Word", " word.", " word,\n"]


@pytest.fixture(scope="module")
def library(bpe_file):
    return Tokenizer.from_file(bpe_file)


def _ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_encoder_is_the_library(library, bpe_file):
    rng, own = random.Random(5), bpe.Encoder(bpe_file, limit=300)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert _ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids, text
    assert len(own) <= 300


def test_decoding_is_the_library(library, bpe_file):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert bpe.decode_ids(np.array(ids, dtype="<u4").tobytes(), bpe_file) == library.decode(ids, skip_special_tokens=False)


def test_chunks_depend_on_content_only():
    rng = random.Random(7)
    shared = bytes(rng.choice(b"abcdefgh ,.") for _ in range(20_000))
    a, b = bytes(rng.choice(b"xyz ") for _ in range(3000)) + shared, b"something else" + shared

    def chunks(t):
        ends = bpe.chunk_ends(t)
        return [t[i:j] for i, j in zip([0, *ends], ends)]
    assert b"".join(chunks(a)) == a and b"".join(chunks(b)) == b
    assert len(set(chunks(a)) & set(chunks(b))) > 20
    assert bpe.chunk_ends(b"") == [] and bpe.chunk_ends(b"x") == [1]
    for t in ("é" * 5000).encode(), b"\0" * 50_000:
        assert all((len(c) >= 64 or c == chunks(t)[-1]) and c.decode() is not None for c in chunks(t))


def test_joins_agree_with_the_library(library, bpe_file):
    rng, own = random.Random(8), bpe.Encoder(bpe_file)

    def encode(x):
        return own.encode([x.decode()])[0]
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(1500)).encode()
        known, start = {}, 0
        for n, end in enumerate(bpe.chunk_ends(text)):
            chunk, start = text[start:end], end
            seams = [m.start() for m in bpe._SEAM_BYTES.finditer(chunk)]
            if len(seams) > 1 and rng.random() < 0.8:
                known[n] = {"probe_end": seams[1], "tail": len(chunk) - seams[-1], "probe": encode(chunk[seams[0]:seams[1]]),
                            "core": encode(chunk[seams[1]:seams[-1]])}
        assert _ids(bpe.join_chunks(text, known, encode)) == library.encode(text.decode(), add_special_tokens=False).ids


def test_operator(spark, odd_docs, no_docs, library, bpe_file):
    got = bpe.decode(bpe.counted(bpe.encode(odd_docs, bpe_file)), bpe_file).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), _ids(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe.encode(no_docs, bpe_file).count() == 0


def test_hot_chunks(spark, library, bpe_file):
    rng = random.Random(9)
    words = ["alpha", "béta", "gamma,", "delta.", "x1", "'re", "..."]
    hot = " ".join(rng.choice(words) for _ in range(2000))
    rows = [(i, (f"{rng.random()} " if i % 2 else "") + hot + f" {i}") for i in range(60)] + [(100 + i, f"own {i}") for i in range(60)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe_file).collect()
    assert {r.doc_id: _ids(r.ids) for r in got} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
