"""Slots and shards; listed and mined address rules."""

import zlib
from collections import Counter, defaultdict

import pytest

from hindsight.llm import sharding, url_filter
from hindsight.llm.queries import LISTED
from hindsight.plans.registry import table
from tests.conftest import bag, order


def test_shards(docs, rows):
    out, versions = sharding.assign(docs, shards=5)
    got = out.collect()
    want = sorted([(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows], key=order)
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], key=order) == want
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    slots = {(r["version"], r["vslot"]): r["shard"] for r in versions.collect()}
    assert len(slots) == 2 * sharding.SLOTS
    assert all(slots[2, r["vslot"]] == r["shard"] for r in got)


def test_shards_are_even(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out, versions = sharding.assign(docs)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.01 * sum(sizes) / 24
    # an edit, not a new deal
    moved = versions.groupBy("vslot").agg({"shard": "max", "*": "count"}).count()
    first = {r["vslot"]: r["shard"] for r in versions.where("version = 1").collect()}
    stays = sum(first[r["vslot"]] == r["shard"] for r in versions.where("version = 2").collect())
    assert moved == sharding.SLOTS and stays > sharding.SLOTS * 0.1


def test_rebalance_moves_little(spark):
    """An even map is left as it is; one more shard takes its share, and what 24 shares of whole slots leave over is all that moves besides."""
    loads = spark.range(sharding.SLOTS).selectExpr("cast(id as int) vslot", "cast(100 as bigint) bytes")
    first = sharding.first_map(spark, 24)
    assert bag(sharding.rebalance(first, loads, 24), "vslot", "shard") == bag(first, "vslot", "shard")
    grown = dict(bag(sharding.rebalance(first, loads, 25), "vslot", "shard"))
    before = dict(bag(first, "vslot", "shard"))
    changed = [v for v in grown if grown[v] != before[v]]
    taken = sum(grown[v] == 24 for v in changed)
    assert taken == sharding.SLOTS // 25 and len(changed) <= 24 * (256 - taken) and max(Counter(grown.values()).values()) == taken + 1


def test_shards_empty(no_docs):
    assert sharding.assign(no_docs)[0].collect() == []


def plain_listed(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, at, prefix in LISTED:
        if (host == at or host.endswith("." + at)) and path.startswith(prefix) and (best is None or len(at + prefix) > len(best[0])):
            best = (at + prefix, verdict)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://A.Example.COM/en/x?y://z#q", "http://www.example.com/en/1", "http://xwww.example.com/en/1",
    "http://example.com/en", "http://b.net/es/1", "http://net/fr/", "http://cnet/es/1", "http://x.org?path=/a", "http://x.org#/en/", "a://b://c/d", "http://É.com/ä", "http://a\n.com/\nb",
]


def test_listed(frame):
    pages = frame("page_id long, url string, tokens string, verdict int, n int", *[(i, u, "t", 1, 2) for i, u in enumerate(URLS + URLS[:7])], (None, URLS[6], "t", 1, 2), (None, None, "t", 1, 2))
    out = url_filter.judge(pages, LISTED).collect()
    assert Counter((r["page_id"], r["url"]) for r in out) == Counter((r["page_id"], r["url"]) for r in pages.collect())
    for r in out:
        host, path, best = plain_listed(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
        assert (r["by"] == "list") == (best is not None)


def test_mined_rules(frame):
    """Rules hold their support and confidence, and none says what a part of it says as surely."""
    rows = [(["host:a", "word:spam", f"path:{i}"], "block") for i in range(50)] + [(["host:a", "word:news", "path:x"], "allow") for _ in range(30)]
    rows += [(["host:b", "word:spam"], "allow") for _ in range(5)] + [(["host:c"], "block"), (["host:c"], "allow")]
    found = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in url_filter.mine(frame("items array<string>, verdict string", *rows), 0.02, 0.9).collect()}
    for (tokens, verdict), confidence in found.items():
        hold = [v for t, v in rows if set(tokens) <= set(t)]
        assert confidence == pytest.approx(hold.count(verdict) / len(hold)) and confidence >= 0.9 and hold.count(verdict) >= 0.02 * len(rows)
        assert not any(set(t) < set(tokens) and v == verdict and c >= confidence for (t, v), c in found.items())
    assert (("word:news",), "allow") in found and (("host:b",), "allow") in found


def test_matching_is_containment(spark, frame):
    rules = [("1", ["a"], "block", 0.9, 0.5, "a"), ("2", ["a", "b"], "allow", 0.95, 0.2, "b"), ("3", ["c", "d"], "block", 0.99, 0.1, "d")]
    rules = spark.createDataFrame(rules, url_filter.RULE_SCHEMA)
    sets = [["a"], ["a", "b"], ["b"], ["c", "d", "a", "b"], ["c"], [], ["d", "x", "c"]]
    pages = frame("page_id long, url string, items array<string>", *[(i, f"u{i}", s) for i, s in enumerate(sets)], (0, "u0", ["a"]))
    assert bag(url_filter.match(pages, rules), "page_id", "mined", "n") == [
        (0, "block", 2), (1, "allow", 1), (2, None, 1), (3, "block", 1), (4, None, 1), (5, None, 1), (6, "block", 1),
    ]


def test_no_pages(frame):
    assert url_filter.judge(frame("page_id long, url string"), LISTED).collect() == []
    out = url_filter.judge(frame("page_id long, url string", (1, "x")), LISTED).collect()
    assert [(r["verdict"], r["by"]) for r in out] == [("allow", "default")]
