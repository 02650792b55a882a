"""Source mixes against a plain version: targets, permutations, shares of shards, whole blocks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, s long, start long, block long, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, 10, 11) for r in rows], SCHEMA)


def sample(rng, n=300):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "b", "é", "z", None])
        rows.append((i, "\t ".join(f"{source}{i}w{k}" for k in range(rng.choice([0, 1, 3, 20, 60]))) + rng.choice(["", " "]), source))
    rows += [(5, "same row here", "b")] * 4 + [(None, "no id", "b")] * 3 + [(900, None, "a"), (901, "", "only-empty"), (902, " \n", None), (903, "x" * 50_000 + " y" * 3_000, "z")]
    return rows


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water level by bisection: target = min(cap, level x weight)."""
    total, w = share * sum(sizes), [weights[i % 3] for i in range(len(sizes))]
    low, high = 0.0, total + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * x) for s, x in zip(sizes, w)) < total else (low, level)
    return [min(most * s, high * x) for s, x in zip(sizes, w)]


@pytest.mark.parametrize("sizes", [[100, 10, 1000], [5], [0, 0], [1, 1, 1, 1, 1, 100], [1000, 0, 10, 20, 3000, 7], []])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))


def test_word_counts():
    texts = ["a b", None, "", " x ", "\x1ca\x0bb", "é  ü o", "   ", "z"]
    want = [len([w for w in (t or "").encode().split() if w]) for t in texts]
    array = pa.array(["skip", *texts])
    assert mixing.word_counts(array.slice(1)).tolist() == want
    assert mixing.word_counts(array.slice(0, 0)).tolist() == [] and mixing.word_counts(pa.array([None, ""], pa.string())).tolist() == [0, 0]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permuted(size):
    for key in (0, 12345, 2**63 + 11):
        out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(out.tolist()) == list(range(size))
    if size == 1000:
        assert np.corrcoef(out, np.arange(size))[0, 1] < 0.1


def test_shares_meet_totals():
    totals = [1000, 0, 37, 5, 4000]
    shares = mixing.Shares(totals, 100, 3)
    drawn = [shares.of(k) for k in range(shares.shards)]
    at = np.zeros(5, np.int64)
    for k, (start, counts) in enumerate(drawn):
        assert (start == at).all() and counts.sum() == (100 if k < shares.shards - 1 else sum(totals) - 100 * k)
        at += counts
    assert at.tolist() == totals
    spread = np.array([c for _, c in drawn[:-1]])[:, 0]
    assert 2 < spread.std() < 6  # a binomial of 100 draws at about one in five: 4.0
    again = mixing.Shares(totals, 100, 3).of(17)
    assert (again[1] == drawn[17][1]).all()
    big = np.array([3 * 10**9, 10**9, 5, 0])
    split = mixing._split(big, 2 * 10**9 + 2, np.random.default_rng(1))
    assert split.sum() == 2 * 10**9 + 2 and (split >= 0).all() and (split <= big).all()


def test_mix(spark):
    rows = sample(random.Random(5))
    docs = frame(spark, rows)
    size = lambda t: len((t or "").encode().split())
    got = mixing.mix_report(docs, block=16, shard=32).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    again = mixing.mix_report(docs.repartition(7), block=16, shard=32).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s in rows if s == o) for o in order]
    want = dict(zip(order, zip(sizes, plain_targets(sizes))))
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(a, round(b, 6)) for a, b in want.values()}
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    for words, target in want.values():
        assert abs(taken[words] - target) <= 16, (words, target, taken[words])

    # the mix itself: whole blocks of the source's own words, and the report is what it holds
    blocks = mixing.mixed_blocks(docs, block=16, shard=32).collect()
    assert {r["shard"] for r in blocks} == set(range(-(-len(blocks) // 32))) and len({(r["shard"], r["place"]) for r in blocks}) == len(blocks)
    assert len({(r["source"], r["block"], r["round"]) for r in blocks}) == len(blocks) and {r["round"] for r in blocks} <= {0, 1}
    counts = Counter(w for r in blocks for w in r["words"].split())
    totals = Counter()
    for i, t, s in rows:
        for w in (t or "").split():
            totals[w] += 1
    assert all(n <= 2 * totals[w] for w, n in counts.items())
    by_doc = Counter()
    for r in got:
        by_doc[r["doc_id"]] += r["taken"]
    unique = {i for i, _, _ in rows if i is not None and i < 300 and i != 5}
    assert all(sum(n for w, n in counts.items() if w.rsplit("w", 1)[0][-len(str(i)):] == str(i) and w in set((t or "").split())) == by_doc[i] for i, t, _ in rows[:60] if i in unique)
    short = [r for r in blocks if len(r["words"].split()) != 16]
    assert all(r["block"] == -(-want[r["source"]][0] // 16) - 1 for r in short)


def test_mix_without_rows(spark):
    docs = frame(spark, [(1, "a b", "s")])
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed_blocks(docs.limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mix_report(frame(spark, [(1, None, "s")])).collect()] == [(1, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixing.plan_mix(mixing.measured(frame(spark, [(1, "a", "s"), (2, "a", "t")])), max_sources=1)
