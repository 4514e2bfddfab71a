"""Cases that earlier versions of the training-data operators left out."""

import random

import pytest

from lodegraph.llm import paragraphs, pii, similar

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_pipeline_near_duplicates_reach_the_similarity(spark):
    """Near copies with a few edits against brute force; their fingerprints are far more than 4 bits apart."""
    import corpus_pipeline

    rng = random.Random(15)
    texts = []
    for edits in (0, 1, 2, 3, 4, 5, 8, 12):
        first = words(rng, 200, 10**6).split()
        second = list(first)
        for k in range(edits):
            second[9 + k * 14] = f"edit{k}"
        texts += [" ".join(first), " ".join(second).upper()]
    texts += ["one two", "ONE\ttwo", "one three", None, ""]
    sets = [frozenset(zip(*(t.lower().split()[k:] for k in range(5)))) or frozenset([t.lower()]) for t in texts[:16]]
    gone = {i for i in range(1, 16, 2) if len(sets[i - 1] & sets[i]) >= 0.8 * len(sets[i - 1] | sets[i])} | {17, 20}
    assert {1, 3, 5, 7, 9} <= gone and 15 not in gone
    stay = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "").collect()}
    assert stay == set(range(len(texts))) - gone
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: i - 1 if i in gone else i for i in range(len(texts))}


def test_short_lines_and_wrapped_paragraphs(spark):
    rng = random.Random(16)
    short, wrapped = "Five words in one line", words(rng, 120).split()
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    texts = [f"{words(rng, 40)}\n{short}\n{words(rng, 9)}", f"{words(rng, 8)}\n {short.upper()} \n\n{words(rng, 30)}", "four words a line", "four words a line"]
    light = list(wrapped)
    light[40::50] = ["x1", "x2"]
    texts += [f"{words(rng, 20)}\n\n{wrap(wrapped, 9)}\n\n{words(rng, 20)}", f"{words(rng, 25)}\n \n{wrap(light, 11)}\n\n{words(rng, 25)}"]
    out = {r.doc_id: r.text for r in paragraphs.dedup(docs_of(spark, texts)).collect()}
    assert [out[i] for i in (0, 2, 3, 4)] == [texts[i] for i in (0, 2, 3, 4)]
    assert out[1] == texts[1].replace(short.upper(), "")
    assert out[5] == texts[5].replace(wrap(light, 11), "")
    w = paragraphs.Words(["a b\nc d\n\ne f g h i\n\n\nj\nk l m n", "", "o p q\nr s t", "u v w x y"])
    assert [(int(a), int(b)) for a, b in zip(*w.lines())] == [(4, 9), (20, 25), (9, 14), (14, 20)]  # blocks after lines


def test_disguises_beside_a_fragment():
    for t, fragment in [("jоe@example.com", "e@example.com"), ("joe [dot] smith@example.com", "smith@example.com"), ("joe@mail.exаmple.com", "joe@mail.ex"), ("joe@example.cоm", "joe@example.c"), ("jo\u200be@example.com", "e@example.com")]:
        base, added = pii.find_spans(f"mail {t} now")
        assert [(k, f"mail {t} now"[s:e]) for k, s, e in base] == [("email", fragment)], t
        assert [(k, f"mail {t} now"[s:e]) for k, s, e in added] == [("email", t)], t
        assert pii.mask(f"mail {t} now") == "mail [EMAIL] now"
    assert pii.find_spans("joe@example.com is plain")[1] == []


def test_wider_disguises():
    for t, kind, found in [
        ("ask jane at example.com today", "email", "jane at example.com"), ("ask jane_at_example.com today", "email", "jane_at_example.com"), ("jane_at_example_dot_com", "email", "jane_at_example_dot_com"), ("jane at mail.example.com.Then", "email", "jane at mail.example.com.Then"),
        ("ring +1 555 one two three 4567 now", "phone", "+1 555 one two three 4567"), ("ring plus 1 (five five five) 123 4567 now", "phone", "plus 1 (five five five) 123 4567"), ("ring plus one five five five one\ntwo three\tfour [five] six seven now", "phone", "plus one five five five one\ntwo three\tfour [five] six seven"),
        ("card 4111 1111 one one one one 1111 ok", "card", "4111 1111 one one one one 1111"), ("host 192.168.one.7 up", "ip", "192.168.one.7"), ("7, " + "four two " * 8, "card", ("four two " * 8).strip()),
    ]:
        base, added = pii.find_spans(t)
        assert (kind, found) in [(k, t[s:e]) for k, s, e in added], (t, base, added)
        assert found not in pii.mask(t)
    for t in ["met at noon.then left", "one of 5 or two", "look at this.one", "chapter one 2 three", "un un un", "_at_" * 20_000, "a at " * 20_000, "one " * 50_000, "1 one," * 20_000, "x." * 50_000]:
        assert pii.find_spans(t)[1] == [], t[:40]


def test_disguises_without_brackets_or_a_plus():
    for t, kind, found in [
        ("ask john(a)example.com", "email", "john(a)example.com"), ("ask john @ example . com now", "email", "john @ example . com"), ("ask john at example dot xyz", "email", "john at example dot xyz"), ("ask maria arroba ejemplo punto com", "email", "maria arroba ejemplo punto com"),
        ("frag hans at beispiel punkt de", "email", "hans at beispiel punkt de"), ("paul arobase exemple point fr", "email", "paul arobase exemple point fr"), ("call five five five, one two three, four five six seven now", "phone", "five five five, one two three, four five six seven"),
    ]:
        base, added = pii.find_spans(t)
        assert [(k, t[s:e]) for k, s, e in added] == [(kind, found)] and not base, t
    for t in ["one two three four five six seven eight nine", "look at this point in time", "at home . it was", "list (a) first (b) second", "1.2 one two three four five", "one two " * 40_000, " @ " * 50_000, "a @ b . " * 30_000]:
        assert pii.find_spans(t)[1] == [], t[:40]


def test_spans_under_a_wider_one_go():
    t = "mail a​b@example.com at example dot com " * 3000
    base, added = pii.find_spans(t)
    assert len(base) == 3000 and all(not any(x[1] <= y[1] and y[2] <= x[2] and x != y for x in added[max(0, k - 3) : k + 3]) for k, y in enumerate(added))


def test_shared_passages_go_from_end_to_end(spark):
    """A passage inside differing lines leaves whole, also where its keeper shares more with a third document."""
    rng = random.Random(19)
    p = [words(rng, n).split() for n in (43, 51, 60, 120)]
    texts = [f"{words(rng, 30)} {' '.join(p[0])} {words(rng, 7)} {' '.join(p[1])} {words(rng, 25)} {' '.join(p[3])}", f"{words(rng, 3)} {' '.join(p[0]).upper()} {words(rng, 40)}", f"{words(rng, 30)} {' '.join(p[1])}\n{words(rng, 6)}", f"{' '.join(p[2])} {words(rng, 30)}", f"{'x y ' * 9}{' '.join(p[2])} z", f"{words(rng, 50)} {' '.join(p[3][30:90])} {words(rng, 9)}"]
    left = {1: texts[1].replace(" ".join(p[0]).upper(), ""), 2: texts[2].replace(" ".join(p[1]), ""), 4: "x y " * 9 + " z", 5: texts[5].replace(" ".join(p[3][30:90]), "")}
    docs = docs_of(spark, texts).withColumnsRenamed({"lang": "_id", "source": "_spans"})
    out = {r.doc_id: r.text for r in paragraphs.dedup(docs).collect()}
    assert out == {i: left.get(i, t) for i, t in enumerate(texts)}
    assert paragraphs.dedup(docs).columns == docs.columns


def test_paragraph_links_and_components_against_brute_force(spark):
    """Banded and verified lines: no link below 0.8, at least 0.95 of those above, and their components."""
    rng = random.Random(20)
    lines = []
    for _ in range(100):
        first = words(rng, rng.randrange(5, 70)).split()
        lines.append(first)
        for _ in range(rng.randrange(4)):
            again = list(rng.choice(lines[-3:]))
            for _ in range(rng.randrange(4)):
                again[rng.randrange(len(again))] = f"e{rng.randrange(10**6)}"
            lines.append(again)
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in lines]
    n = len(lines)
    close = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    runs = [frozenset(zip(*(w[k:] for k in range(20)))) for w in lines]
    root = list(range(n))  # of lines that are close or share a run of the length of a passage
    tied = close + [(i, j) for i in range(n) for j in range(i) if runs[i] & runs[j]]
    while any(root[i] != root[j] for i, j in tied):
        for i, j in tied:
            root[i] = root[j] = min(root[i], root[j])
    docs = docs_of(spark, [f"{words(rng, 40)}\n{' '.join(w)}" for w in lines])
    got = {r.doc_id: r.component_id for r in paragraphs.summary(docs).collect()}
    assert len(close) > 60 and sum(got[i] == got[j] for i, j in close) >= 0.95 * len(close)
    assert all(root[i] == root[got[i]] for i in range(n)) and len(set(got.values())) < n  # nothing joined that nothing ties


def test_repeated_rows_and_long_texts_of_paragraphs(spark):
    rng = random.Random(21)
    long = words(rng, 60_000)
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, f"{words(rng, 9)}\n\n{long}", "en", "s", 0), (None, long, "en", "s", 0), (3, None, "en", "s", 0)]
    got = paragraphs.summary(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.clean, r.component_id or 0) for r in got) == [(0, True, 0), (1, True, 1), (1, True, 1), (2, False, 1), (3, True, 3)]
    assert next(r.n_removed for r in got if r.doc_id == 2) == len(long)
