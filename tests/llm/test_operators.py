"""The training-data operators against brute force, round trips and defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodegraph.llm import chat, embeddings, mixing, paragraphs, pieces, pii, simhash, suffix, tokenstore, urls
from lodegraph.llm.buckets import forest, pairs
from lodegraph.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, home string"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", sources[i] if sources else "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- shared parts --------------------------------------------------------------------------------


def test_pairs_and_forest():
    stop = np.array([3, 3, 3, 5, 5, 6])
    got = {(int(a), int(b)) for x in pairs(stop, at_once=2) for a, b in zip(*x)}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    root, other = forest(a, b)
    group = {int(x): {int(x)} for x in np.concatenate([a, b])}
    for x, y in zip(a.tolist(), b.tolist()):
        merged = group[x] | group[y]
        for z in merged:
            group[z] = merged
    assert {int(o): int(r) for r, o in zip(root, other)} == {x: min(g) for x, g in group.items() if min(g) != x}


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (2, 3), (3, 1), (4, 4), (None, 3), *((100 + i, 50) for i in range(30))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in range(5, 10)}, 1: 1, 2: 1, 3: 1, 50: 50, **{100 + i: 50 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 32))
    rows = [(i, (base[i % 30] + rng.normal(size=32) * 0.08).tolist(), i % 3 // 2) for i in range(150)]
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, [2 * x for x in rows[1][1]], rows[1][2])]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 32, 0), (303, [1.0, None] * 16, 0), (304, [float("nan")] * 32, 0), (305, rows[0][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    fine = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: {r[0]} for r in rows}
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    for x in fine:
        for y in fine:
            if x[0] != y[0] and x[2] == y[2] and len(x[1]) == len(y[1]) and cos(x[1], y[1]) >= 0.93:
                links[x[0]].add(y[0])
    want = sum(len(v) - 1 for v in links.values())
    assert want > 200 and len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * want
    assert all(got[i].n_links <= len(v) - 1 for i, v in links.items())
    for i in (300, 301, 302, 303, 304, 305):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[306].component_id == got[307].component_id == 306 and got[200].component_id == 0
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_segmentations_are_gumbel_top_k():
    p = pieces.Pieces.shared(MODEL, 1.0)
    n, text = 1500, "on the"
    rows = list(pieces.segment([text] * n, list(range(n)), 3, p))
    assert all(len({tuple(x[0].tolist()) for x in r}) == 3 and r[0][2] >= r[1][2] >= r[2][2] for r in rows)
    prob = {tuple(x[0].tolist()): math.exp(x[1]) for r in rows for x in r}
    first = Counter(tuple(r[0][0].tolist()) for r in rows)
    for a, q in prob.items():
        assert abs(first[a] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 2 / n
    second = Counter(tuple(r[1][0].tolist()) for r in rows)
    b = max(prob, key=prob.get)
    want = sum(q * prob[b] / (1 - q) for a, q in prob.items() if a != b)
    assert abs(second[b] / n - want) < 0.06
    assert abs(np.mean([sum(math.exp(x[1] - x[3]) for x in r) for r in rows]) - 1) < 0.05  # Horvitz-Thompson


@pytest.mark.parametrize("text", ["", " ", "a", "  two  spaces ", "line\nbreak\ttab", "▁literal ▁▁", "naïve Ünïcode 漢字 🙂", "x" * 3000, "\x00\x7f"])
def test_segmentations_decode_exactly(text):
    p = pieces.Pieces.shared(MODEL, 1.0)
    (rows,) = pieces.segment([text], [7], 4, p)
    assert len({tuple(x[0].tolist()) for x in rows}) == len(rows) >= 1
    assert all(p.decode(x[0].tolist()).decode() == text for x in rows)


def test_segmentations_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    df = docs_of(spark, [words(rng, rng.randrange(60)) for _ in range(40)] + [None, ""])
    one = {(r.doc_id, r.sample): r for r in pieces.sample(df.coalesce(1), MODEL, 3).collect()}
    many = {(r.doc_id, r.sample): r for r in pieces.sample(df.repartition(7), MODEL, 3).collect()}
    assert one == many and all(r.text_crc32 == zlib.crc32((df_text or "").encode()) for r, df_text in ((r, {x.doc_id: x.text for x in df.collect()}[r.doc_id]) for r in one.values()))
    assert pieces.sample(df.limit(0), MODEL).count() == 0
    decoded = {(r.doc_id, r.sample): r.back for r in pieces.decode(pieces.sample(df, MODEL, 1), MODEL, out_col="back").collect()}
    assert decoded == {(r.doc_id, 1): r.text or "" for r in df.collect()}
    plain = pieces.encode(df, MODEL).select("ids", "text").collect()
    assert all(pieces.Pieces.shared(MODEL, 1.0).decode(r.ids).decode() == r.text for r in plain if r.text)


# -- 3 ---------------------------------------------------------------------------------------------


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls_ = ["http://A.Example.NET/en/x?q#f", "https://b.net", "http://x.example.com/de/", "http://x.example.com/DE/", "ftp://o.org/fr/?a", None, "no scheme", "http://bad.biz/1", "http://bad.biz/2", "http://notexample.net/en/", "http://net/", "://?", "http://é.org#x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls_)], "page_id long, url string, rule string")
    out = spark.createDataFrame([("http://bad.biz/1", True)] * 40 + [("http://good.com/1", False)] * 60 + [("http://good.com/2", None)], "url string, bad boolean")
    for table in (rules, rules + [(f"h{i}.test", "/", "block") for i in range(300)]):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, out, table).collect()}
        assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
        assert got[1] == ("b.net", "", None, "allow") and got[2][2:] == ("example.com/de/", "block") and got[3][2] is None
        assert got[4] == ("o.org", "/fr/", "org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow")
        assert got[7][3] == got[8][3] == "block" and got[9][2:] == ("net/", "block") and got[10] == ("net", "/", "net/", "block")
        assert got[11][:2] == ("", "") and got[12][:2] == ("é.org", "")
    assert {r.verdict for r in urls.judge(pages, out.limit(0), []).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), out, rules).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(600)] + [None, "", " \t"]
    sources = [rng.choice(["a", "a", "a", "b", "c", "é", None]) for _ in texts]
    df = docs_of(spark, texts, sources)
    rows = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == size
    names = sorted({s for s in sources if s is not None}) + [None]
    total, w = sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in names}
    full: set = set()
    while True:
        left, ws = total - sum(3 * own[s] for s in full), sum(w[s] for s in names if s not in full)
        goal = {s: 3 * own[s] if s in full else w[s] * left / ws for s in names}
        if not (over := {s for s in names if s not in full and goal[s] > 3 * own[s]}):
            break
        full |= over
    for r in rows:
        assert math.isclose(r.target, goal[sources[r.doc_id]]) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in names:
        taken = sum(r.taken for r in rows if sources[r.doc_id] == s)
        assert abs(taken - goal[s]) <= 60
        assert len({r.copies for r in rows if sources[r.doc_id] == s}) <= 2
    assert sorted(rows) == sorted(mixing.mix(df.repartition(5)).collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("size(split(text, ' ')) > 99")).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text, width=4):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + width]), 42) for i in range(max(1, len(ws) - width + 1))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_fingerprints_and_groups(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "One", "one", "TWO words", "É É é x y"]
    for _ in range(25):
        base = words(rng, 120, 5000).split()
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "zz"
            texts.append(" ".join(t))
    texts += texts[-3:] * 2
    want = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == want
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (want[i] ^ want[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if x == a else x for x in root]
    assert [got[i].component_id for i in range(len(texts))] == root
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_anchors_lose_no_pair(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for d in (1, 2, 3, 4, 5):
            for b in rng.sample(range(64), d):
                f ^= 1 << b
            fps.append(f)
    fps = sorted({f if f < 1 << 63 else f - (1 << 64) for f in fps})
    for block in (4096, 8):
        simhash.compare_buckets.__defaults__ = (block,)
        links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
        root = {f: f for f in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert top(a) == top(b) or root.__setitem__(max(top(a), top(b)), min(top(a), top(b))) is None
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    assert top(a) == top(b)
    simhash.compare_buckets.__defaults__ = (4096,)


# -- 6 ---------------------------------------------------------------------------------------------


def test_chat_events(spark):
    s = "conv_id long, pos long, copy int, seq long, type string, role string, text string, block string"
    tricky = r"<|im_end|><\|im_start|>a<|nl|>"
    log = [
        (1, 0, 1, 0, "message", "user", "hi"), (1, 1, 1, 1, "message", "assistant", ""), (1, 1, 1, 2, "delta", None, "wro"), (1, 1, 1, 3, "regenerate", None, "ignored"), (1, 1, 1, 700, "delta", None, "Hel"), (1, 1, 1, 701, "delta", None, "lo"),
        (1, 2, 1, 9, "message", "user", "x"), (1, 2, 1, 800, "edit", None, tricky), (1, 900, 1, 801, "message", "assistant", tricky), (2, 0, 1, 0, "message", "a\nb<|", None), (None, 0, 1, 0, "delta", "assistant", "é"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in log], s)
    messages = chat.fold_events(df)
    assert {(r.conv_id, r.pos, r.role, r.text) for r in messages.collect()} == {(1, 0, "user", "hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", tricky), (1, 900, "assistant", tricky), (2, 0, "a\nb<|", ""), (None, 0, "assistant", "é")}
    blocks = chat.render_blocks(messages)
    got = {r.conv_id: r for r in chat.digests(blocks).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha(f"user\nhi\nassistant\nHello\nuser\n{tricky}\nassistant\n{tricky}\n")
    assert got[1].loss_sha256 == sha("Hello" + tricky) and got[1].loss_chars == len("Hello" + tricky)
    assert got[2].turns_sha256 == sha("a\nb<|\n\n") and got[2].loss_chars == 0 and got[None].loss_sha256 == sha("é")
    whole = {r.conv_id: r.formatted for r in chat.conversations(blocks).collect()}
    assert all(len(whole[c]) == got[c].formatted_chars for c in whole) and whole[1].count("<|im_start|>") == 4
    assert chat.digests(chat.render_blocks(chat.fold_events(df.limit(0)))).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 40, 3000):
        counts = np.append(np.minimum((rng.pareto(0.4, n) * 9).astype(np.int64) + 1, 10**11), [0, 0])
        lengths = tokenstore.code_lengths(counts)
        assert lengths.max() <= 16 and (lengths[counts == 0] == 0).all() and np.sum(2.0 ** -lengths[lengths > 0].astype(float)) <= 1
        heap = counts[counts > 0].tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            heapq.heappush(heap, (s := heapq.heappop(heap) + heapq.heappop(heap)))
            cost += s
        assert (lengths.astype(np.int64) * counts).sum() >= cost
        if lengths.max() < 16:
            assert n == 1 or (lengths.astype(np.int64) * counts).sum() == cost
        ids = rng.choice(n, 3000, p=counts[:n] / counts.sum()).astype(np.uint32)
        stream, offsets = tokenstore.encode_block(ids, lengths, tokenstore.canonical_codes(lengths))
        assert (tokenstore.decode_block(stream, offsets, len(ids), tokenstore.decode_table(lengths)) == ids).all()
    assert not tokenstore.code_lengths(np.zeros(5, np.int64)).any()


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(80)) for _ in range(50)] + [None, "", "Ça va? «Σας» O\x1cK a.b., x!! <|endoftext|>A", "\xa0 é́ İ", "it's o'clock's. 12,5", "y" * 5000]
    store = tokenstore.store_documents(docs_of(spark, texts).repartition(5), path)
    got = {r.doc_id: r for r in tokenstore.digests(tokenstore.read_store(spark, store)).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = tokenstore.store_documents(docs_of(spark, []), path)
    assert tokenstore.read_store(spark, empty).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------


def test_repeats_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        texts = [" ".join(rng.choice("abc") if rng.random() < 0.8 else rng.choice("defghij") for _ in range(rng.randrange(45))) for _ in range(rng.randrange(1, 5))]
        got = suffix._measure(texts, 3)
        for i, t in enumerate(texts):
            w = t.split()
            n = len(w)
            same = lambda p, q: next((k for k in range(n - max(p, q)) if w[p + k] != w[q + k]), n - max(p, q))  # noqa: B023, E731
            best = [max([0] + [same(p, q) for q in range(n) if q != p]) for p in range(n)]
            cover = lambda least, size: len(set().union(*[range(p, p + (size or best[p])) for p in range(n) if best[p] >= least]))  # noqa: B023, E731
            assert (got[0][i], got[4][i], got[5][i], got[6][i]) == (n, cover(8, 8) if n else 0, cover(3, None) if n else 0, max([0] + [b for b in best if b >= 3]))


def test_quality(spark):
    rng = random.Random(10)
    clean, line = words(rng, 200, 3000), words(rng, 150, 3000)
    texts = [clean, None, "", "a b", ("buy now " * 60), f"{line}\n{clean}\n{line}", "# % x\ny\ny\n \n \n" + clean, "z" * 100_000]
    got = {r.doc_id: r for r in suffix.judge(docs_of(spark, texts)).collect()}
    assert [got[i].kept for i in range(8)] == [True, False, False, False, False, False, True, False]
    assert got[6].n_symbols == 2 and got[6].n_dup_lines == 1 and got[0].word_chars == len(clean.replace(" ", "")) and got[5].longest_repeat == 150
    kept = suffix.filter_documents(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == {0, 6}
    assert suffix.judge(docs_of(spark, [])).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def fine(kind, m):
        digits = re.sub("[^0-9]", "", m[0])
        return {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, t) if fine(k, m)]


def test_base_spans_against_the_patterns():
    rng = random.Random(11)
    bits = ["a", ".", "@", "@b.c", "-", "+1", " ", "(", ")", "9", "255", "256", "1.2.3.4", "4242424242424242", "%", "é", "4111 1111 1111 1111", "+1 (988) 555-2485", "\n", "000"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_disguises():
    for t, kind, found in [
        ("mail joe.x [at] ex-ample (dot) com now", "email", "joe.x [at] ex-ample (dot) com"), ("joe at example dot com", "email", "joe at example dot com"), ("see joe＠example．com", "email", "joe＠example．com"), ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"), ("host one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"), ("four two " * 8, "card", ("four two " * 8).strip()),
    ]:
        base, added = pii.find_spans(t)
        assert [(k, t[s:e]) for k, s, e in added] == [(kind, found)], t
        assert found not in pii.mask(t)
    for t in ["met at noon dot then", "one two", "look at [dot] com", "Привет мир", "", "un un un un un", "x" * 50_000 + "@" * 50_000]:
        assert pii.find_spans(t)[1] == []


def test_pii_table(spark):
    df = docs_of(spark, ["a@b.cd +1 (988) 555-2485", None, "", "x [at] y [dot] org"])
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert (got[0].n_email, got[0].n_phone, got[0].spans) == (1, 1, "email:0:6,phone:7:24") and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_email == 0 and got[3].spans == "email:0:18"
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[0].text == "[EMAIL] [PHONE]" and out[0].n_chars == 15 and out[1].text is None and out[3].text == "[EMAIL]"
    assert pii.find(df.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------


def test_paragraphs(spark):
    rng = random.Random(12)
    passage, line = words(rng, 55, 10**6), words(rng, 60, 10**6).split()
    near = list(line)
    near[30] = "changed"
    text = lambda n: words(rng, n, 10**6)
    texts = [text(80), f"{text(30)} {passage} {text(33)}", f"{text(41)} {passage.upper()} {text(7)}", f"{text(30)}\n{' '.join(line)}\n{text(30)}", f"{' '.join(near)}\n{text(40)}", None, "", "short line", "short line", ("a " * 300), f"{passage.replace(' ', chr(10), 9)}"]
    got = {r.doc_id: r for r in paragraphs.summary(docs_of(spark, texts)).collect()}
    assert {i for i, r in got.items() if not r.clean} == {2, 4, 10}
    assert got[2].repeats_of == [1] and got[10].repeats_of == [1] and got[4].repeats_of == [3] and len(got) == len(texts)
    out = {r.doc_id: r.text for r in paragraphs.dedup(docs_of(spark, texts)).collect()}
    assert out[0] == texts[0] and out[5] is None and out[4] == "\n" + texts[4].split("\n")[1] and len(out[2]) < len(texts[2]) - 100
    assert paragraphs.summary(docs_of(spark, [])).count() == 0
    assert paragraphs.tune_bands(0.8, 0.99, 4) == 9


def test_winnowing_shares_a_passage():
    rng = random.Random(13)
    for _ in range(40):
        shared = words(rng, 43, 10**6)
        a, b = paragraphs.Words([f"{words(rng, rng.randrange(60), 10**6)} {shared} {words(rng, rng.randrange(60), 10**6)}"]), paragraphs.Words([f"{words(rng, rng.randrange(60), 10**6)} {shared} {words(rng, rng.randrange(60), 10**6)}"])
        assert set(a.ranges[0].hash(*a.passages()).tolist()) & set(b.ranges[0].hash(*b.passages()).tolist())


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    texts = [words(rng, rng.randrange(30, 90), 5000) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", None, "", "spam " * 50, texts[2] + " mail a@b.cd"]
    docs = docs_of(spark, texts, [f"s{i % 3}" for i in range(len(texts))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= set(range(40)) | {41, 45} and 40 not in ids and not {42, 43, 44} & ids
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert {r.doc_id for r in now.collect()} == ids
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), "").count() == 0
    assert F  # columns only
