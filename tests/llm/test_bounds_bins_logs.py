"""Posterior bounds and host names (3), key bins (4) and event logs (6)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import chat, mixing, urls


def below(a, b, cutoff, steps=20_000):
    """P(share <= cutoff) by the trapezoid rule over the logit of the share."""
    log = lambda t: a * t - (a + b) * (max(t, 0) + math.log1p(math.exp(-abs(t))))
    lo, cut, hi = -60 / a - 5, math.log(cutoff / (1 - cutoff)), 60 / b + 5
    top = log(math.log(a / b))

    def area(x, y):
        f = [math.exp(log(x + (y - x) * k / steps) - top) for k in range(steps + 1)]
        return (sum(f) - (f[0] + f[-1]) / 2) * (y - x) / steps

    left = area(lo, cut)
    return left / (left + area(cut, hi))


def test_posterior_bound_is_the_beta_quantile(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0.6, 12) * 3 ** rng.randrange(4), rng.uniform(0.6, 12) * 3 ** rng.randrange(3), rng.choice([0.3, 0.5, 0.8])) for _ in range(120)]
    rows += [(300.0, 250.0, 0.5), (300.0, 280.0, 0.5), (260.0, 240.0, 0.5), (5.0, 0.3, 0.5)]
    checked = 0
    for cutoff in (0.3, 0.5, 0.8):
        some = [(a, b) for a, b, c in rows if c == cutoff]
        df = spark.createDataFrame(some, "a double, b double").select("a", "b", urls.surely_above(F.col("a"), F.col("b"), cutoff).alias("above"))
        for r in df.collect():
            p = below(r.a, r.b, cutoff)
            if abs(p - 0.05) > 0.002:
                checked += 1
                assert r.above == (p <= 0.05), (r, p)
    assert checked > 100


def test_host_names_domains_suffixes(spark):
    want = {
        "a.b.com:8080": ("a.b.com", "b.com", "com"), "me:pw@x.example.org": ("x.example.org", "example.org", "org"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4", "(address)"),
        "[::1]:80": ("[::1]", "[::1]", "(address)"), "a.b.co.uk.": ("a.b.co.uk", "b.co.uk", "co.uk"), "me.github.io": ("me.github.io", "me.github.io", "github.io"),
        "github.io": ("github.io", "github.io", "io"), "": ("", "", ""), "localhost": ("localhost", "localhost", "localhost"), "co.uk": ("co.uk", "co.uk", "uk"),
    }
    name = urls.host_name(F.col("h"))
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", name.alias("n"), *(x.alias(c) for x, c in zip(urls.registered(name), ("d", "s"))))
    assert {r.h: (r.n, r.d, r.s) for r in df.collect()} == want


@pytest.mark.parametrize("weight", [None, 0.05, 1e-9, 40.0])
def test_prefix_by_bins_is_the_prefix_in_key_order(spark, weight):
    rng = random.Random(3)
    rows = [(i, " ".join(["x%y" if i % 7 else "word"] * rng.randrange(0, 9)) or None, rng.choice(["a"] * 8 + ["b", None]), "c") for i in range(3000)] + [(5, "word word", "a", "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, coarse string")
    given = None if weight is None else F.when(F.col("doc_id") % 2 == 0, weight)
    got = mixing.mix(df, weight=given)
    w = mixing.quality_weight(F.col("text")) if weight is None else F.greatest(F.lit(0.05), F.coalesce(given, F.lit(0.05)))
    keys = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.sampling_key(F.col("doc_id"), w, "mix").alias("key")).collect()
    plan = {r.source: r for r in got.join(df.select("doc_id", "source").distinct(), "doc_id").select("source", "source_size", "target").distinct().collect()}
    want = []
    for source, p in plan.items():
        rest, upto = p.target - p.target // p.source_size * p.source_size, 0
        for k in sorted((k for k in keys if k.source == source), key=lambda k: (k.key, k.doc_id, k.size)):
            upto += k.size
            extra = rest > 0 and (upto <= rest or (upto - k.size < rest and upto - rest <= rest - (upto - k.size)))
            want.append((k.doc_id, k.size, k.size * int(p.target // p.source_size + extra)))
    assert sorted((r.doc_id, r.size, r.taken) for r in got.collect()) == sorted(want)


def test_logs_fold_to_their_messages(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "a\nb", "é" * 5000, "word " * rng.randrange(900)])
    rows = [(rng.choice([1, 2, None]), pos, 1, rng.choice(["user", "assistant", None, "system"]), text(), "x") for pos in range(60)]
    messages = spark.createDataFrame(rows, "conv_id long, pos long, copy int, role string, text string, seq string")
    log = chat.log_of(messages)
    assert {"delta", "edit", "regenerate", "message"} == {r.type for r in log.select("type").distinct().collect()}
    got = chat.fold_events(log.orderBy(F.rand(1)))
    assert sorted((str(r.conv_id), r.pos, r.role, r.text) for r in got.collect()) == sorted((str(c), p, r or "", t or "") for c, p, _, r, t, _ in rows)
    assert chat.log_of(messages.limit(0)).count() == 0
