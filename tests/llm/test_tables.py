"""Sharding, mixing and URL filters."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing, shards, urls


def test_shards_are_even_and_gapless(spark, documents):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 97).cast("int")).alias("text"))
    for docs, n in ((many, 16), (many, 3)):
        rows = shards.shard_rows(docs, n_shards=n).collect()
        load = Counter()
        for r in rows:
            load[r.shard] += r["size"]
        assert max(load.values()) - min(load.values()) <= 100 and len(load) == n
        for s in range(n):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    got = shards.shard_rows(documents).collect()
    assert len(got) == documents.count() and shards.shard_rows(documents.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_map_versions(spark, tmp_path):
    weight = [random.Random(1).randrange(1000) for _ in range(256)]
    one = shards.SlotMap.first(256, 7)
    two = shards.rebalance(one, weight)
    assert two.version == 2 and {s for s in range(256) if one.shard_of[s] != two.shard_of[s]} == set(two.moved)
    assert shards.rebalance(two, weight).shard_of == two.shard_of
    three = shards.grow(two, weight)
    assert all(three.shard_of[s] in (two.shard_of[s], 7) for s in range(256)) and 7 in three.shard_of
    store = str(tmp_path / "maps")
    for m in (one, two, three):
        shards.save_map(spark, m, store)
    assert shards.load_map(spark, store) == three and shards.load_map(spark, store, 2) == two


def test_main_path_has_no_python(documents):
    plan = shards.shard_rows(documents.select("*"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return target


def test_mix_meets_targets(spark):
    draw = random.Random(9)
    rows = [(i, "w " * draw.choice([0, 1, 5, 9, 30]), draw.choice(["a", "a", "a", "a", "b", "Z", None, "é"]), "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    source = {r[0]: r[2] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
    want = slow_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 15
    mixed = mixing.mixed_documents(docs)
    copies = {r.doc_id: r.taken // r["size"] for r in got if r["size"]}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id", "text").collect() if r.text) == Counter({i: n for i, n in copies.items() if n})


def test_a_row_that_stands_often_draws_each_time(spark):
    """A third of all rows is one row; each source still meets its target, whatever the seed, and the mix itself takes as many."""
    rows = [(i, "w " * (i % 17 + 1), "abc"[i % 3]) for i in range(2000)] + [(5000, "one two three four five", "c")] * 1000 + [(None, None, "a"), (None, "same", None), (None, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {r[0]: r[2] for r in rows}
    for seed in (10, 1, 2):
        got = mixing.mix(docs, seed).collect()
        taken, target = Counter(), {}
        for r in got:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
        assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 9 for s in "abc")
    assert sorted(map(str, mixing.mix(docs, 2).collect())) == sorted(map(str, got))
    assert mixing.mixed_documents(docs, 2).filter("doc_id = 5000 and text like 'one%'").count() == sum(r.taken // 5 for r in got if r.doc_id == 5000)


def test_weighted_documents_are_taken_more(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t", 4.0 if i % 2 else 1.0) for i in range(3000)], "doc_id long, text string, source string, w double")
    got = mixing.mix(docs, weight="w", share_percent=40).collect()
    odd, even = sum(r.taken for r in got if r.doc_id % 2), sum(r.taken for r in got if not r.doc_id % 2)
    assert odd > 3 * even and abs(odd + even - 0.4 * 9000) <= 12


def test_mix_of_odd_rows(spark, documents):
    got = mixing.mix(documents).collect()
    assert len(got) == documents.count() and all(r.taken >= 0 for r in got)
    assert mixing.mix(documents.limit(0)).count() == 0 and mixing.mixed_documents(documents.limit(0)).columns == documents.columns
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


URLS = ["https://a.example.net/en/x", "http://EXAMPLE.net/en", "http://example.net/en/", "http://x.net", "http://x.net/?q", "http://a.net#z", "http://spam-farm.example.org/fr/1", "http://w.spam-farm.example.org/de/1", "http://nospam-farm.example.org/de/", "http://example.com/de/a?b", "http://notexample.com/de/", "http://b.org/fr/", "http://b.org/FR/", "no scheme", "", None, "://", "x://y://z/net/", "http://net/a", "http://a.b.c.d.net/en/", "HTTP://Ünï.NET/ä\nb?x"]


def slow_judge(url, hosts=urls.LISTED_HOSTS):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    below = lambda top: host == top or host.endswith("." + top)
    fit = [(k, v) for v, k in urls.RULES if below(k[: k.index("/")]) and path.startswith(k[k.index("/") :])]
    if fit:
        return (host, path, *max(fit, key=lambda kv: len(kv[0])))
    return host, path, None, "block" if any(below(h) for h in hosts) else "allow"


def test_urls_equal_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == {i: slow_judge(u) for i, u in enumerate(URLS * 2)}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 37).select(F.concat(F.lit("k"), "id").alias("key")).unionAll(spark.sql("SELECT 'absent' AS key"))
    cascade = urls.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.contains(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 37 == 0))
    assert wrong.count() == 0
    assert urls.Cascade(listed.limit(0), universe).levels == [] and urls.Cascade(listed, universe.limit(0)).levels == []


def test_lists_of_many_segments_equal_plain_rules(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# hosts\n\n  Spam.ORG. \nb.com\nbig.example.net\nnet2\n" + "\n".join(f"h{i}.example.info" for i in range(40)))
    listed = urls.read_hosts(spark, str(tmp_path / "hosts.txt"))
    hosts = {r.key for r in listed.collect()}
    assert len(hosts) == 44 and "spam.org" in hosts
    rows = URLS + ["http://a.spam.org/x", "http://nospam.org/x", "http://b.com", "http://x.big.example.net/de/"] + [f"http://w.h{i}.example.info/" for i in range(80)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    plain = sorted(urls.judge_urls(pages, listed_hosts=listed).collect())
    assert sorted(urls.judge_urls(pages, listed_hosts=listed, max_bits=64).collect()) == plain
    assert [(r.host, r.path, r.rule, r.verdict) for r in plain] == [slow_judge(u, hosts) for u in rows]


def test_a_list_of_a_hundred_thousand_hosts(spark):
    def host(column, tail):
        return F.concat(F.lit("h"), column, F.lit(tail))

    listed = spark.range(0, 400_000, 4).select(host("id", ".example.info").alias("key"))
    pages = spark.range(0, 400_000, 2).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www."), host("id", ".example.info/p")).alias("url"))
    got = urls.judge_urls(pages, listed_hosts=listed, max_bits=1 << 17).groupBy(F.col("page_id") % 4 == 0, "verdict").count().collect()
    assert sorted(map(tuple, got)) == [(False, "allow", 100_000), (True, "block", 100_000)]


def test_repeated_rows_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(shards, "REPEATS", 64)
    rows = [(7, "the same row again")] * 1000 + [(i, "x" * (i % 40)) for i in range(1000, 2000)] + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shards.shard_rows(docs, n_shards=8).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t or "") + 1) for i, t in rows)
    held = Counter()
    for r in got:
        held[r.shard] += r["size"]
    assert len(held) == 8 and max(held.values()) - min(held.values()) <= 40
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_the_stored_map_is_loaded_and_edited(spark, tmp_path):
    store = str(tmp_path / "maps")
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(3000)], "doc_id long, text string")
    one = sorted(map(tuple, shards.shard_rows(docs, store=store).collect()), key=str)
    first = shards.load_map(spark, store)
    assert sorted(map(tuple, shards.shard_rows(docs, store=store).collect()), key=str) == one and shards.load_map(spark, store) == first
    more = docs.unionByName(spark.createDataFrame([(9000 + i, "y" * 5000) for i in range(30)], "doc_id long, text string"))
    shards.shard_rows(more, store=store).collect()
    second = shards.load_map(spark, store)
    assert second.version == first.version + 1 and shards.load_map(spark, store, first.version) == first
    assert sum(a != b for a, b in zip(first.shard_of, second.shard_of)) == len(second.moved) < 400
    assert shards.load_map(spark, str(tmp_path / "none")) is None
