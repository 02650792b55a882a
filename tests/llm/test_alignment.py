"""Token alignment against a plain version over byte spans; tokens against the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from leafspark.llm import alignment

PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, row long, a int, times int, n_a int"
ODD = ["plain words here, twice twice", "", None, " ", "  lead", "tail \n", "é ü 漢字 naïve", "<|endoftext|> </s> <unk> <0x41>", "a▁b", "▁", "ﬁ ½ Å", "\x00\x01 tab\tnewline\r\n", "x" * 300, "1234567890 don't we'll",
       " nbsp", "🙂 emoji 👩‍👧", "́combining"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def tokens(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    out = []
    for text in texts:
        data = (" " + (text or "")).encode()
        a, b = t.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        a = [(i, bytes(byte_of[c] for c in t.id_to_token(i))) for i in a]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in b]
        good = text and b"".join(d for _, d in a) == data == b"".join(d for _, d in b)
        out.append((a, b) if good else ([], []))
    return out


def plain(a, b):
    """(groups text, n, links) by byte spans alone."""
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, data in side:
            own.append((at, at + len(data), i))
            at += len(data)
        spans.append(own)
    common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    told, low = [], 0
    for high in common:
        told.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans))
        low = high
    links = [(i, j) for s, e, i in spans[0] for s2, e2, j in spans[1] if s < e2 and s2 < e]
    return ";".join(told), len(told), links


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Unbelievable", "token", "izer", "x1", "\n", "  ", "naïve", "漢", "(", "don't", "zzzqqq", "1234", "https://a.b/c?d", "🙂"]
    return ODD + [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_tokens_and_groups():
    tool = alignment.Aligner(*PATHS)
    given = texts()
    got = tool.align(tool.tokens(given))
    for k, (text, (a, b), (wa, wb)) in enumerate(zip(given, tool.tokens(given), tokens(given))):
        assert (a, b) == ([i for i, _ in wa], [i for i, _ in wb]), text
        told, n, links = plain(wa, wb)
        own = got.doc == k
        assert (got.told[k].decode(), got.numbers[k]) == (told, n) and Counter(zip(got.a[own].tolist(), got.b[own].tolist())) == Counter(links), text
        assert len(links) == max(0, len(a) + len(b) - n)
    assert [len(x) for x in tool.align([])] == [0] * 5 and tool.align([([], [])]).told == [b""]


@pytest.mark.parametrize("seed", range(5))
def test_groups_of_random_ends(seed):
    rng = random.Random(seed)
    shared = sorted(rng.sample(range(1, 400), 150)) + [400]
    a, b = (sorted({*shared, *rng.sample(range(1, 400), rng.choice([0, 5, 80]))}) for _ in range(2))
    got = alignment.groups(a, b)
    cut = [e for i, i2, _, _, one in got for e in (a[i:i2] if one else a[i2 - 1:i2])]
    assert cut == sorted(set(a) & set(b))
    assert all(a[i:i2] == b[j:j2] if one else a[i2 - 1] == b[j2 - 1] for i, i2, j, j2, one in got)
    assert [s[0] for s in got] == [0] + [s[1] for s in got[:-1]] and [s[2] for s in got] == [0] + [s[3] for s in got[:-1]]


def test_long_texts_are_cut_safely():
    rng = random.Random(8)
    text = " ".join(rng.choice(["word", "Other", "x,y", "é", "two  spaces", "12", "\n\n"]) for _ in range(40_000))
    tool = alignment.Aligner(*PATHS)
    assert len(list(tool.b.parts(text))) > 2
    assert tool.b.encode([text, "a b"]) == [tool.b.engine.encode(text), tool.b.engine.encode("a b")]
    whole = "漢字" * 200_000  # no place to cut
    assert [len(p) for p in tool.b.parts(whole)] == [len(whole)]
    assert tool.align(tool.tokens([text])).numbers[0] > 10_000


@pytest.mark.parametrize("frequent", [0, 7, alignment.FREQUENT])
def test_documents(spark, monkeypatch, frequent):
    given = texts(2, 40)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(given)] + [(1, given[0]), (1, given[0])]
    counts, per = Counter(), []
    for a, b in tokens([t for _, t in rows]):
        told, n, links = plain(a, b)
        counts.update(links)
        per.append((len(a), len(b), n, links, hashlib.sha256(told.encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter((i, na, nb, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for (i, _), (na, nb, n, links, sha) in zip(rows, per))
    docs = frame(spark, rows).repartition(3)
    table = alignment.aligned(docs, *PATHS, held=50)
    pairs = alignment.pair_counts(table)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)
    assert Counter(tuple(r) for r in alignment.scored(table, pairs, frequent).collect()) == want


def test_no_documents(spark):
    docs = frame(spark, [(1, None), (2, "")])
    assert sorted(tuple(r) for r in alignment.align_documents(docs, *PATHS).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align_documents(docs.limit(0), *PATHS).count() == 0
