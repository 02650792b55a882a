"""URL rules, SimHash links, exact copies, archives and benchmark passages against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from leafspark.llm import decontam, exact_dedup, simhash, url_filter, warc
from leafspark.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 AS h", "2 AS n_bytes", "3 AS copies", "4 AS root", "5 AS c0")


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(500, 500 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    want = plain_components({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    urls = ["http://a.example.org/es/x?y", "https://EXAMPLE.org/en/12", "http://example.org", "http://org/", "x://www.b.com/de/#z", "http://c.com/fr/?a=://d", "http://myexample.org/es/",
            "no scheme", None, "", "://", "http:///es/", "http://a.org./", "http://a..org/en", "x://" + "a." * 2000 + "com/de/" + "p" * 5000, "http://a.example.org/en/1\n2"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS host", "3 AS best")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "org", "/"), ("allow", None, "/")]

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut], rest[cut:]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert tuple(r)[1:] == judged(urls[1] if r["page_id"] is None else urls[r["page_id"]])
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, []), default="block").collect()} == {"block"}


def plain_fingerprint(text, width=3):
    from xxhash import xxh64_intdigest
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cell_size", [3, 1024])
def test_simhash(spark, monkeypatch, cell_size):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Ab", "cd", "é", "fg", "hi", "jk"]) + str(rng.randrange(50)) for _ in range(400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for n, t in enumerate(base * 8):
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        rows.append((100 + n, "\t".join(w)))
    rows += [(900, ""), (901, None), (902, "Ein Wort"), (903, "ein  wort"), (904, " \n"), (0, base[0]), (None, base[1]), (905, "z" * 100000)]
    original = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: original(fps, cell_size))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    assert len(got) == len(rows)
    values = sorted(set(prints.values()))
    root = plain_components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    lowest = {}
    for i, t in rows:
        if i is not None:
            lowest[root[prints[t]]] = min(i, lowest.get(root[prints[t]], i))
    want = Counter((i, f"{prints[t]:016x}", lowest[root[prints[t]]]) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_simhash_links_all_within_radius(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        word = rng.getrandbits(64)
        prints.add(word)
        for _ in range(12):
            prints.add(word ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = plain_components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    for size in (2, 1024):
        got = plain_components(signed, [tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), size).collect()])
        assert got == want


def test_exact_copies(spark):
    texts = ["a b", "a  b", "a\tb\n", "", None, " ", "\x0b", "a\u00a0b", "a b ", "a bc", "ab", "x" * 200000, "x" * 200000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "a b"), (0, "a b"), (None, "a b"), (None, "only"), (None, "only"), (5, "other")]
    norm = lambda t: __import__("re").sub("[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    low = {k: min([i for i in v if i is not None], default=None) for k, v in groups.items()}
    want = Counter((i, low[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    kept = exact_dedup.survivors(frame(spark, rows).repartition(4))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((norm(r["text"]), r["doc_id"]) for r in kept.collect()) == Counter(low.items())
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_trie_forks():
    trie = exact_dedup.Trie()
    for i, key in enumerate([b"abc", b"ab", b"abd", b"", b"abc", b"b", b"ab", b"abcde", b""]):
        trie.insert(key, 10 - i, 1, i)
    assert sorted((r[0], r[1]) for r in trie.rows()) == [(2, 2), (3, 1), (4, 2), (5, 1), (6, 2), (8, 1)]


def test_archives(spark, tmp_path):
    same = "é" * 600
    rows = [(1, "http://a/?x=%0A\r\nb c", same), (2, None, same), (3, "u", same), (3, "u", same), (4, "v", "short"), (5, "v", "short"), (6, "w", None), (7, "w", ""), (None, "n", same), (8, "z", "q" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS owner", "2 AS file", "3 AS offset")
    index = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w")
    got = warc.read_records(index, f"file://{tmp_path}/w").collect()
    want = Counter((i, u, "revisit" if h == same and i != 3 else "response", 3 if h == same and i != 3 else None, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, u, h in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(bytes(r["payload"]) in {(h or "").encode() for _, _, h in rows} for r in got if r["record_type"] == "response")
    some = warc.read_records(index.where("page_id in (4, 8)"), f"file://{tmp_path}/w").collect()
    assert sorted(len(r["payload"]) for r in some) == [5, 3_000_000]
    import gzip
    import pathlib
    for file in pathlib.Path(f"{tmp_path}/w").iterdir():
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def tokens(text):
    import re
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def plain_leaks(docs, items):
    found = {}
    for k, item in items:
        b = tokens(item)
        if not b:
            continue
        width = min(5, len(b))
        shingles = lambda w: Counter(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
        want = shingles(b)
        for i, text in docs:
            w = tokens(text)
            for s in range(max(1, len(w) - len(b) + 1)):
                own = shingles(w[s:s + len(b)])
                score = sum((own & want).values()) / max(1, sum((own | want).values()))
                if score >= 0.8 - 1e-9 and score > found.get((i, k), (0,))[0] + 1e-9:
                    found[i, k] = (score, s)
    return found


def test_leaks(spark):
    rng = random.Random(4)
    make = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate((14, 30, 30, 59, 45, 3, 1, 5, 60))] + [(20, None), (21, " ... "), (22, " ".join(["same"] * 20))]
    docs = [(0, None), (1, ""), (2, " ".join(make(200)))]
    for k, text in items[:9]:
        w = text.split()
        docs += [(10 + k, " ".join(make(50) + w + make(20))), (30 + k, ", ".join(w).upper()), (50 + k, " ".join(w[2:] + make(9))), (70 + k, " ".join(make(4) + w[:-1]))]
        w[len(w) // 2] = "changed"
        docs.append((90 + k, " ".join(make(30) + w)))
    docs += [(200, " ".join(["same"] * 21)), (201, " ".join(["same"] * 300)), (202, " ".join(make(6000) + items[3][1].split())), (10, docs[3][1])]
    w = items[1][1].split()
    docs += [(300, " ".join(make(10) + ["other"] + w[1:] + make(10))), (301, " ".join(["other"] + w[1:])), (302, " ".join(make(3) + w[:-1] + ["other"] + make(40)))]
    w = items[3][1].split()
    docs += [(303, " ".join(make(10) + ["o1", "o2", "o3"] + w[3:] + make(10))), (304, " ".join(make(10) + ["o1"] + w[1:-1] + make(10))), (305, " ".join(w + w + make(3) + w))]
    data = frame(spark, docs)
    got = decontam.find_leaks(data, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n")).collect()
    want = plain_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in got} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}
    assert len(want) > 25
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(data, none).count() == 0 and decontam.find_leaks(data.limit(0), none).count() == 0


@pytest.mark.parametrize("piece", [1, 40, 2_000])
def test_exact_copies_in_small_pieces(spark, piece):
    """Subtrees that are cut early and tries of few rows give the same groups; survivors and groups agree."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(5))) for _ in range(300)]
    rows = [(i % 250 if i % 7 else None, t) for i, t in enumerate(texts)]
    groups = {}
    for i, t in rows:
        groups.setdefault(exact_dedup.normalised(t.encode()), []).append(i)
    low = {k: min([i for i in v if i is not None], default=None) for k, v in groups.items()}
    docs = frame(spark, rows).repartition(5)
    got = exact_dedup.exact_groups(docs, piece=piece).collect()
    want = Counter((i, low[k], len(groups[k]), hashlib.sha256(k).hexdigest()) for k in groups for i in groups[k])
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(hashlib.sha256(k).hexdigest() for k in groups)
    kept = exact_dedup.survivors(docs, piece=piece).collect()
    assert Counter((exact_dedup.normalised(r["text"].encode()), r["doc_id"]) for r in kept) == Counter(low.items())


def test_normalised_bytes():
    for text in ["", " ", "a", " a", "a \t\nb ", "\x1c a\x85b   ", "\x0b\x0c", "é  é"]:
        assert exact_dedup.normalised(text.encode()).decode() == __import__("re").sub("[\x20\x09-\x0D]+", " ", text)
    assert exact_dedup.normalised(None) == b""


def test_leaks_among_many_items(spark):
    """A window meets few of many items of its size; pieces that all items share do not bring them all in."""
    rng = random.Random(12)
    common = "answer the following question with one of the four choices given below"
    items = [(k, common + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for k in range(10_000)]
    docs = [(k, " ".join(f"v{rng.randrange(500)}" for _ in range(20)) + " " + items[37 * k][1] + " tail") for k in range(40)] + [(100 + k, common * 3) for k in range(20)]
    table = decontam.item_table(spark.createDataFrame(items, "item_id long, text string"))
    seen = {}
    original = decontam._alike

    def counted(windows, shingles, similarity):
        near = original(windows, shingles, similarity)
        seen["windows"], seen["pairs"] = windows.count(), near.count()
        return near
    decontam._alike = counted
    try:
        got = decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        decontam._alike = original
    assert {(r["doc_id"], r["item_id"], r["start_word"]) for r in got} == {(k, 37 * k, 20) for k in range(40)}
    assert table.count() == 10_000 and seen["pairs"] < 3 * seen["windows"]


def test_many_marks_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 7)
    rng = random.Random(13)
    items = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(12))) for k in range(6)]
    docs = [(k, " ".join(" ".join(rng.choice(items)[1].split()[:rng.choice([9, 12])]) + f" x{rng.randrange(5)}" for _ in range(30))) for k in range(3)] + [(None, items[0][1])]
    got = decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in got} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}
