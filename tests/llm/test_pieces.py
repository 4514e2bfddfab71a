import math
import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from lodegraph.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sampling_costs_a_small_multiple_of_splitting(spark, monkeypatch):
    """CPU time against a plain reading of the same texts by a regular expression, on one machine."""
    rng = random.Random(3)
    parts = ["an", "er", "th", "on", "ti", "es", "al", "ä", "ch", "or", "qu", "in", "ve", "um"]
    new = lambda n: "".join(rng.choices(parts, k=n))
    often = [new(rng.randrange(1, 4)) for _ in range(2_000)]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.7 else new(rng.randrange(2, 8)) for _ in range(160)) for _ in range(3_000)]
    monkeypatch.setattr(pieces, "arrow_map", lambda df, run, schema: run)
    run = pieces.sample(spark.createDataFrame([], "doc_id long, text string"), MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    pieces.Pieces.shared(MODEL, 1.0)
    split, sampled = [], []
    for _ in range(3):
        began = time.process_time()
        found = [re.findall(r" +[^ ]*|[^ ]+", x) for x in texts]
        split.append(time.process_time() - began)
        began = time.process_time()
        rows = sum(x.num_rows for x in run(batch))
        sampled.append(time.process_time() - began)
        assert rows == 2 * len(found)
    print(f"ratio {min(sampled) / min(split):.1f}")
    assert min(sampled) < 16 * min(split)


def test_chunks_are_runs_of_spaces_and_what_follows():
    rng = random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choice("   ab é\n🙂") for _ in range(rng.randrange(9))) if rng.random() > 0.15 else rng.choice([None, ""]) for _ in range(rng.randrange(12))]
        lo = rng.randrange(len(texts) + 1)
        names, number, ends = pieces._chunks(pa.array(texts, rng.choice([pa.string(), pa.large_string()])).slice(lo))
        got = [[names[k] for k in x] for x in np.split(number, ends[:-1])] if len(ends) else []
        assert got == [re.findall(r" +[^ ]*", " " + x) if x else [] for x in texts[lo:]]


def test_probabilities_are_those_of_all_segmentations():
    """Every path through the vocabulary, listed with the library's pieces alone."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [i for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
    ids = {lib.id_to_piece(i).replace("▁", " "): (i, 1 / (r + 10)) for r, i in enumerate(plain)}
    total = sum(w for _, w in ids.values())
    lone = math.exp(-math.log(len(plain) + 10) - math.log(total) - 1)

    def paths(text):
        if not text:
            yield (), 1.0
        for n in range(1, len(text) + 1):
            if (found := ids.get(text[:n])) or n == 1:
                raw = text[0].encode()
                head, w = ((found[0],), found[1] / total) if found else (tuple(lib.piece_to_id(f"<0x{b:02X}>") for b in raw), lone ** len(raw))
                yield from ((head + rest, w * v) for rest, v in paths(text[n:]))

    for text in ("on the", "a  🙂b", "\x00ñ"):
        want = dict(paths(" " + text))
        mass = sum(w for x, w in want.items())
        # a piece with a space inside would cross a chunk's border; the operator has none of those
        crossing = {i for s, (i, _) in ids.items() if re.search(r"[^ ] ", s)}
        assert not any(crossing & set(x) for x in want)
        (rows,) = pieces.segment([text], [1], len(want) + 1, pieces.Pieces.shared(MODEL, 1.0))
        got = {tuple(x[0].tolist()): math.exp(x[1]) for x in rows}
        assert got.keys() == want.keys() and len(rows) == len(want)
        assert all(math.isclose(got[x], w / mass, rel_tol=1e-9) for x, w in want.items())


def test_one_long_word_takes_memory_in_proportion():
    p = pieces.Pieces.shared(MODEL, 1.0)
    tracemalloc.start()
    (rows,) = pieces.segment(["ab" * 6_000], [7], 3, p)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len({x[0].tobytes() for x in rows}) == 3 and all(p.decode(x[0].tolist()) == b"ab" * 6_000 for x in rows)
    assert peak < 100e6, peak
