"""Operator 7 against the tokenizers library and with large vocabularies."""

import random

import numpy as np
import pytest

from lodegraph.llm import tokenstore

public_tokenizers = pytest.importorskip("public_tokenizers")
PLANES = [(32, 127), (0, 256), (0x100, 0x600), (0x900, 0x1200), (0x1E00, 0x2100), (0x300, 0x370), (0x3000, 0x3400), (0xAC00, 0xAD00), (0xFF00, 0xFFEF), (0x1D400, 0x1D800), (0x10000, 0x1FFFF)]
ODD = ["İ", ":", "?", "...", "<|endoftext|>", "'s", "'LL", " ", "\n", "ß", "ǅ", "क़", "ſ", "\x85", "\xa0", "\x1c", "Σ.", "Word", "K", "ﬁ", "ª.", "ͅ"]


def strange(rng):
    out = []
    for _ in range(rng.randint(1, 8)):
        if rng.random() < 0.35:
            out.append(rng.choice(ODD))
            continue
        lo, hi = PLANES[0] if rng.random() < 0.3 else rng.choice(PLANES)
        out.append("".join(chr(c) for c in (rng.randrange(lo, hi) for _ in range(rng.randint(1, 6))) if not 0xD800 <= c < 0xE000))
        if rng.random() < 0.4:
            out.append(rng.choice(".,;:!?'\"-*&"))
    return "".join(out)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, encoder, rng = Tokenizer.from_file(path), tokenstore.Encoder(path), random.Random(5)
    texts = ["Worldİ?", "İ:", *(strange(rng) for _ in range(50_000))]
    for lo in range(0, len(texts), 5000):
        some = texts[lo : lo + 5000]
        want = [[*e.ids, 2] for e in library.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some, 2)] == want


def test_more_ids_than_sixteen_bits_tell_apart():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(150_000), rng.integers(0, 40, 50_000)]).astype(np.uint32)
    counts = np.bincount(ids)
    lengths = tokenstore.code_lengths(counts)
    assert 17 <= tokenstore.width(lengths) <= 25 and np.sum(2.0 ** -lengths.astype(float)) <= 1
    stream, offsets = tokenstore.encode_block(ids, lengths, tokenstore.canonical_codes(lengths))
    assert (tokenstore.decode_block(stream, offsets, len(ids), tokenstore.decode_table(lengths)) == ids).all()
