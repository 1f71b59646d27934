"""Exact duplicates, URL filters and source mixing on small tables, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

from recengine.llm import exactdup, mixing, urls


def test_exact_duplicates(spark):
    rows = [(5, "a b"), (3, "ab "), (9, "a\tb\n  "), (2, "ab"), (7, None), (8, ""), (6, " \x0b"), (4, "é x"), (None, "ab"), (1, "A b"), (4, "é x"), (10, "x" * 100_000), (11, " " + "x" * 100_000), (12, "\u00a0"), (None, "lone")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, keep_id int, key string").repartition(4)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    want = []
    for key, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        want += [(i, keep, len(own), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i, _ in own]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdup.exact_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exactdup.exact_duplicates(docs.limit(0)).collect() == []


def test_trie_holds_what_was_put_in():
    trie = exactdup.Trie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ba", b"a" * 500, b"a" * 499 + b"b"]
    for k, key in enumerate(keys):
        trie.at(key).value = k
    assert dict(trie.terminals()) == {key: k for k, key in enumerate(keys)}


def test_hot_group_leaves_a_task_as_one_entry(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('t', id), 'same text') AS text").repartition(3)
    found = docs.selectExpr("doc_id AS id", "text").mapInArrow(exactdup._owners, exactdup._OWNERS)
    assert found.where("key = cast('sametext' AS binary)").count() == 3
    r = exactdup.exact_duplicates(docs).where("group_size > 1").selectExpr("count(*) AS n", "max(keep_id) AS k").first()
    assert (r.n, r.k) == (1333, 1)


def test_spilled_trie_closes_what_no_later_key_can_reach():
    rng = random.Random(6)
    for alphabet in (b"ab", b"abcdefgh"):
        keys = [bytes(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(400)] + [b"", b"a" * 300, b"a" * 299 + b"b"]
        want = defaultdict(int)
        for k in keys:
            want[k] += 1
        trie, got, widest = exactdup.Spilled(), [], 0
        for k in sorted(keys):
            got += trie.put(k, (len(k), 1, 1))
            widest = max(widest, len(trie.path))
        assert widest <= 10 and len(got) > 100  # subtrees went on the way; no more than a path was held
        assert sorted((k, n) for k, (_, _, n) in got + trie.rest()) == sorted(want.items())


def test_tries_of_the_query_hold_many_keys_and_split_edges(monkeypatch):
    import pyarrow as pa

    made = []
    at = exactdup.Trie.at
    monkeypatch.setattr(exactdup.Trie, "at", lambda self, key: (made.append(self), at(self, key))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"a line that all of them share and number {k}" for k in range(3000)])], names=["id", "text"])
    entries = sum(len(b) for b in exactdup._owners(iter([batch])))
    tries = {id(t): t for t in made}.values()
    assert entries == 3000 and len(tries) <= 2 << exactdup.BITS
    assert max(sum(1 for _ in t.terminals()) for t in tries) > 5
    assert any(len(label) > 20 and not child.value for t in tries for label, child in t.edges.values())  # a shared upper edge


def test_largest_tries_are_handed_on(monkeypatch, spark):
    monkeypatch.setattr(exactdup, "HELD", 2000)
    import pyarrow as pa

    texts = [f"text number {k % 70} " * (1 + k % 5) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], names=["id", "text"])
    rows = [r for b in exactdup._owners(iter([batch])) for r in b.to_pylist()]
    assert len({r["key"] for r in rows}) < len(rows) < 500 and sum(r["n"] for r in rows) == 500
    ordered = sorted(rows, key=lambda r: (r["part"], r["key"]))
    out = [r for b in exactdup._merged(iter([pa.RecordBatch.from_pylist(ordered, schema=pa.schema([("part", pa.int32()), ("key", pa.binary()), ("points", pa.int64()), ("id", pa.int64()), ("n", pa.int64())]))])) for r in b.to_pylist()]
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[hashlib.sha256(t.replace(" ", "").encode()).digest()].append(k)
    assert {r["digest"]: (r["keep_id"], r["group_size"]) for r in out} == {d: (min(v), len(v)) for d, v in groups.items()} and len(out) == len(groups)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr/", "block"), ("a.org", "/fr/", "allow"), (None, "/", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow"))


def test_url_filter(spark):
    seen = [None, "", "nothing", "http://x.net", "http://x.net/", "HTTP://WWW.Example.NET/en/a?b=/#c", "https://example.net/EN/x", "ftp://net/en/", "http://a.org/fr/", "http://b.a.org/fr/x#y", "http://xa.org/fr/", "://example.com/de/", "http://example.com?/de/", "http://example.com/de", "a://b://c.net/x", "http://É.Net/", "http://user@example.com:80/de/", "http://" + "a." * 3000 + "net/" + "x" * 5000] * 2
    pages = spark.createDataFrame([(k % 5, u, "h") for k, u in enumerate(seen)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()), key=str)
    assert got == sorted(((k % 5, *brute_url(u)) for k, u in enumerate(seen)), key=str)
    assert {r.verdict for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), rules).collect() == []


def water(sizes, weights):
    targets, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        share = left / sum(free.values())
        over = [s for s in free if share * free[s] > 3 * sizes[s]]
        if not over:
            return targets | {s: share * w for s, w in free.items()}
        for s in over:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
            del free[s]
    return targets


def test_mix(spark):
    rows = [(k, f"s{min(k % 11, 4)}", "w " * (1 + k * 7 % 90)) for k in range(300)] + [(900, None, "a b c " * 400), (901, "s0", None), (902, "s0", " \t"), (903, "zero", ""), (5, "s1", "dup dup"), (5, "s1", "dup dup"), (None, "s2", "no id here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string").repartition(5)
    out = mixing.mix(spark, docs, block=8).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - goals[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - goals[s]) <= 8 * 4
    again = mixing.mix(spark, docs.repartition(2), block=8).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(spark, docs.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(spark, docs.where("text IS NULL")).collect()] == [0]


def test_repeated_rows_lose_no_words(spark):
    docs = spark.range(1000).selectExpr("7L AS doc_id", "'a' AS source", "'one' AS text").unionByName(spark.range(40).selectExpr("100 + id AS doc_id", "'b' AS source", "repeat('w ', 60) AS text")).repartition(6)
    out = mixing.mix(spark, docs, weights=(1.0, 12.6))
    a = out.where("source = 'a'").selectExpr("max(target) AS t", "sum(taken) AS n", "min(taken) AS lo", "max(taken) AS hi", "count(*) AS rows").first()
    assert 200 < a.t < 300 and abs(a.n - a.t) <= 2 * 64 and (a.lo, a.hi, a.rows) == (0, 1, 1000)
    b = out.where("source = 'b'").selectExpr("max(target) AS t", "sum(taken) AS n").first()
    assert abs(b.n - b.t) <= 2 * 64


def test_very_long_text_and_repeated_nulls(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 300_000), (2, "b", "x " * 50)] + [(None, None, None)] * 5, "doc_id long, source string, text string")
    out = {r.doc_id: r for r in mixing.mix(spark, docs).collect()}
    assert out[1].size == 300_000 and abs(out[1].taken - out[1].target) <= 128 and abs(out[2].taken - out[2].target) <= 64 and out[None].taken == 0


def test_written_out_takes_as_many_words(spark):
    docs = spark.createDataFrame([(1, "a", "one two  three\nfour", 4, 10), (2, "a", " x y", 2, 2), (3, "a", "z", 1, 0)], "doc_id long, source string, text string, size long, taken long")
    texts = sorted((r.doc_id, r.text) for r in mixing.written_out(docs).collect())
    assert texts == [(1, "one two"), (1, "one two  three\nfour"), (1, "one two  three\nfour"), (2, " x y")]
