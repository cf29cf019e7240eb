"""Operators on texts: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from lectern.llm import bpe, licenses, quality, toxicity, unigram
from lectern.llm.labelled import sample_ids


def slow_counts(text):
    text = text or ""
    spaces = "\t\n\x0b\x0c\r "
    words, now = [], ""
    for c in text + " ":
        if c in spaces:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines = [x for x in text.split("\n") if any(c not in spaces for c in x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_counts_equal_brute_force():
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice(["a ", "b ", "c\n", "é漢", "#|", " \t", "\x85", "x y z w v u t s ", "\r\x0b"]) for _ in range(draw.randrange(90)))
        assert quality.text_counts(text)[:5] == slow_counts(text)
    assert quality.text_counts(None)[:5] == [0] * 5


def labelled(spark, n=600):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [draw.choice(["alpha", "beta", "gamma", "delta", "tree", "river", "stone"]) + str(draw.randrange(40)) + draw.choice("abcdef") for _ in range(draw.randrange(30, 90))]
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["grubling", "grubber", "grubbish", "vilewort"]) + draw.choice(["", "s", "x"])
        rows.append((i, " ".join(w + "##" if bad else w for w in words)))
        labels.append((i, 1 - bad, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rules = quality.learn_rules(docs, labels)
    assert rules and all(len(r) <= quality.MAX_TERMS for r in rules)
    got = quality.judge_quality(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    fold = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.kept == bool(r.quality) for r in fold]) > 0.97
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_rules_need_precision():
    draw = np.random.default_rng(0)
    x = {"a": draw.random(400), "b": draw.random(400)}
    assert quality.learn(x, draw.random(400) < 0.2) == []
    rules = quality.learn(x, (x["a"] > 0.6) & (x["b"] < 0.5))
    assert rules and {t.feature for t in rules[0]} == {"a", "b"}


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    docs, labels = labelled(spark)
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    fold = [r for r in got if r.held_out]
    assert {r.doc_id for r in fold} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == r.toxic for r in fold]) > 0.97
    model = toxicity.learn_toxicity(docs, labels)
    known = toxicity.WordMargins(model)
    clean, unseen = toxicity.score_text(model, "river3a stone4b tree9c", known), toxicity.score_text(model, "river3a grubblingz tree9c", known)
    assert unseen > clean
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_odd_rows_everywhere(spark, documents, labels):
    n = documents.count()
    for rows in (quality.judge_quality(documents, labels), toxicity.score_toxicity(documents, labels), licenses.scan_licenses(documents), unigram.count_tokens(documents), bpe.encode_documents(documents)):
        assert rows.count() == n
    judged = {r.doc_id: r for r in quality.judge_quality(documents, labels).collect()}
    assert judged[2].base_failed and not judged[2].kept and judged[3].n_words == 30_000
    scores = toxicity.score_toxicity(documents, labels).collect()
    assert all(0 <= r.score <= 1 for r in scores)
    nothing, no_labels = documents.limit(0), labels.limit(0)
    for docs, marks in ((nothing, labels), (documents, no_labels)):
        assert quality.judge_quality(docs, marks).count() == docs.count() == toxicity.score_toxicity(docs, marks).count()
        assert quality.good_documents(docs, marks).columns == docs.columns == toxicity.clean_documents(docs, marks).columns
    for rows in (licenses.scan_licenses(nothing), unigram.count_tokens(nothing), bpe.encode_documents(nothing)):
        assert rows.count() == 0


def test_samples_are_bounded_and_skip_conflicts(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(0, 1), (None, 1), (501, None), (502, 7)], "doc_id long, toxic int")
    ids = sample_ids(labels, "toxic", (20, 30))
    assert 0 not in ids and list(ids.values()).count(0) == 20 and list(ids.values()).count(1) == 30
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.parse_ranks(bpe.vocabulary_bytes())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(tokenizer):
    mine, theirs = tokenizer
    draw = random.Random(3)
    pool = "abcdefgh tionethr'\n\t  \x1c\x85 éß漢字🙂١²ⅷ—…0123456789!?_<|endoftext|>"
    texts = ["", " ", "'s 't", "<|endoftext|>"] + ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(draw.choice([draw.randrange(0x300), draw.randrange(0xD800), draw.randrange(0xE000, 0x10000), draw.randrange(0x1F000, 0x1FAFF), draw.randrange(0x20000, 0x2A6D0)])) for _ in range(25)) for _ in range(800)]
    for t in texts:
        assert mine.encode(t).tolist() == theirs.encode_ordinary(t), t


def test_long_pieces_are_read_with_bounded_lookahead(tokenizer, monkeypatch):
    mine, theirs = tokenizer
    monkeypatch.setattr(bpe, "LOOKAHEAD", 48)
    draw = random.Random(4)
    for _ in range(150):
        t = "".join(draw.choice("abtheniosr") for _ in range(draw.randrange(60, 400)))
        assert mine.encode(t).tolist() == theirs.encode_ordinary(t)


def test_neighbours_equal_the_merges(tokenizer):
    t = tokenizer[0].transducer
    draw = random.Random(5)
    for _ in range(5000):
        a, b = draw.choice(list(t.text)[:3000]), draw.randrange(50_000)
        assert t._follows(a, b) == (t.merged(t.text[a] + t.text[b]) == [t.text[a], t.text[b]])


def test_streams_decode_in_any_cuts():
    draw = random.Random(6)
    for _ in range(3000):
        data = bytes(draw.choice([draw.randrange(256), 0xF0, 0x9F, 0x99, 0x82, 0xE2, 0x41, 0xC3, 0xA9]) for _ in range(20))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = draw.randint(1, 4)
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_round_trip_of_documents(spark, documents):
    text = bpe.parse_ranks(bpe.vocabulary_bytes())
    text = {i: b for b, i in text.items()}
    for r in bpe.encode_documents(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        whole = r.text or ""
        if r.doc_id == 4:
            assert r.n_tokens == 3
        assert "".join(bpe.decode_text(np.array(r.ids), text)) == whole and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()


def slow_best(word, scores, byte):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        cuts = [(best[a][0] + scores[word[a:end]], -(end - a), best[a][1] + 1) for a in range(end) if word[a:end] in scores]
        if cuts:
            score, _, n = max(cuts, key=lambda c: (c[0], c[1]))
        else:
            k = len(word[end - 1].encode())
            score, n = best[end - 1][0] + k * byte, best[end - 1][1] + k
        best[end] = (score, n)
    return best[-1][1]


def test_token_counts_equal_dynamic_programming_word_by_word():
    scores = unigram.vocabulary_scores()
    assert math.isclose(sum(math.exp(s) for s in scores.values()), 1, rel_tol=1e-6)
    trie = unigram.CountTrie(scores)
    draw = random.Random(7)
    for _ in range(3000):
        word = unigram.MARK + "".join(draw.choice(["th", "e", "ing", "ti", "on", "漢", "🙂", "é", "q", "zx"]) for _ in range(draw.randrange(9)))
        assert trie.count(word) == slow_best(word, scores, trie.byte)


def test_licenses_by_wording(spark):
    texts = [
        "Some text.\nReleased under the MIT License.\nmore", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "licensed under the  apache license, version 2.0", "He lost his driving license in the rain and nothing helped.", None, "x " * 5000 + "Released under the MIT License. " + "y " * 5000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert got == {0: ["MIT"], 1: ["GPL-3.0"], 2: ["GPL-2.0"], 3: ["CC-BY-NC-4.0"], 4: ["CC-BY-4.0"], 5: ["Apache-2.0"], 6: [], 7: [], 8: ["MIT"]}


def test_every_template_finds_itself():
    scanner = licenses.Scanner()
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert scanner.judge(notice)[0] == name


def test_every_count_of_the_query_equals_brute_force(spark, documents):
    """Scores of a caller's own model; a plain search over all cuts of each word."""
    scores = {"▁": -2.0, "▁w": -3.0, "or": -2.5, "word": -4.0, "w": -5.0, "o": -5.0, "r": -5.0, "d": -5.0, "▁x": -1.0, "e": -2.0, "the": -3.0, "▁the": -2.0}
    byte = min(scores.values()) - 10.0

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            cuts = [(best[at][0] + scores[word[at:end]], -at, best[at][1] + 1) for at in range(end) if word[at:end] in scores]
            n = len(word[end - 1].encode())
            top = max(cuts, key=lambda c: (c[0], -c[1]), default=None)
            best.append((top[0], top[2]) if top else (best[end - 1][0] + n * byte, best[end - 1][1] + n))
        return best[-1][1]

    for r in unigram.count_tokens(documents, scores=scores).join(documents.select(F.col("doc_id").alias("other"), "text"), F.col("doc_id").eqNullSafe(F.col("other"))).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain("▁" + w) for w in words))


def test_span_means_are_plain_averages():
    draw = random.Random(5)
    sizes = [0, 1, 5, 2, 0, 9]
    values = [[draw.random() for _ in range(n)] for n in sizes]
    first, last, doc = toxicity.spans(np.array(sizes), 3)
    got = list(zip(doc.tolist(), toxicity.span_means(np.array(sum(values, [])), first, last).tolist()))
    want = [(i, sum(v[a : a + 3]) / len(v[a : a + 3])) for i, v in enumerate(values) for a in range(max(1, len(v) - 2) if v else 0)]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_score_is_the_softmax_of_the_worst_averaged_bag():
    model = toxicity.train(["bad grubbling day", "fine day today", "grubbling here", "here is a fine one"] * 6, [1, 0, 1, 0] * 6, epochs=20)
    text = "a fine grubblings day 12"
    bag = [0.0 if w.isdigit() else sum(model.weight.get(g, 0.0) for g in toxicity.subwords(w)) / len(toxicity.subwords(w)) for w in text.split()]
    worst = max(sum(bag[i : i + toxicity.SPAN]) / toxicity.SPAN for i in range(len(bag) - toxicity.SPAN + 1))
    assert abs(toxicity.score_text(model, text, toxicity.WordMargins(model)) - 1 / (1 + math.exp(-(worst + model.bias)))) < 1e-9
    assert toxicity.score_text(model, text, toxicity.WordMargins(model)) > 0.5 > toxicity.score_text(model, "a fine day", toxicity.WordMargins(model))


def test_training_on_toxicity_keeps_a_word_once():
    """What the driver holds of the sample's words is four bytes a use, whatever their length."""
    import tracemalloc

    from lectern.llm import toxicity

    texts = [" ".join(f"{'long' * 20}{'abcdefghij'[(i + j) % 10]}" for j in range(3000)) for i in range(100)]
    tracemalloc.start()
    toxicity.train(texts, [i % 2 for i in range(100)], epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36e6
