"""Each numbered operator against brute force, and on odd tables."""

from __future__ import annotations

import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netvigil.llm import (chat_format, common, decontaminate, jaccard_join, license_scan, lm_scoring, packing,
                          quality_classifier, quality_rules, token_counts, url_filters)
from netvigil.llm.common import components, crc_mod, table
from netvigil.llm.tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, root long, quality int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def odd_docs(spark):
    """NULLs, empty and wordless texts, a long text, repeated rows and ids, clashing extra columns."""
    rng = random.Random(5)
    words = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40))
                      for _ in range(n)) for n in (60, 60, 3, 4000)]
    near = words[0].split()
    near[30] = "changed"
    texts = [(1, words[0]), (2, words[0]), (2, words[0]), (3, " ".join(near)), (4, words[1]), (5, words[2]),
             (6, ""), (7, None), (8, " \n\t "), (9, words[3]), (None, words[0]), (None, "only null id"),
             (10, "é" * 50 + "\x00 <|endoftext|> Don't!"), (11, "a\nb\na\n\nb"), (12, "x " * 200)]
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, 0) for i, t in texts], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def as_dict(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# ---- 2 and 8: tokens ------------------------------------------------------------------------

def test_segments_give_the_librarys_ids():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "1", "²", ".", ",", "'", "'s", "'RE", "<|endoftext|>", "<|E", "|>", "#",
                "日本", "。", "́", " ", " ", "\n", "ﬁ", "’", "don't", "the"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", None]
    ids, bound = encoder(vocabulary_path()).encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == library(some)


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    cache = str(tmp_path / "cache")
    got = as_dict(token_counts.token_counts(docs, cache), "n_bytes", "n_tokens")
    want = {i: (len(t.encode()), len(ids)) for (i, t), ids in zip(texts.items(), library(texts.values()))}
    assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # distinct misses only
    n = stored.count()
    more = docs.unionByName(spark.createDataFrame([(-1, "new  text", None, None, None), (-2, "new text ", None, None, None)],
                                                  docs.schema))
    again = as_dict(token_counts.token_counts(more, cache), "n_tokens")
    assert spark.read.parquet(cache).count() == n + 1  # one miss for two spellings of the spaces
    assert again[-1] == again[-2] == (2,)


def test_token_counts_odd(spark, tmp_path):
    out = token_counts.token_counts(odd_docs(spark), str(tmp_path / "c"))
    assert out.count() == 15
    assert as_dict(out, "n_bytes", "n_tokens")[7] == (0, 0)
    assert token_counts.token_counts(empty_docs(spark), str(tmp_path / "d")).count() == 0


def check_packing(rows, texts, capacity=2048):
    bins, own = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, t), ids in zip(texts.items(), library(texts.values())):
        ids = [*ids, 0]
        pieces = sorted(own[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert sum(r.length for r in pieces) == len(ids)
    return len(bins)


def test_packing(spark, docs, texts):
    rows = packing.op8_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, texts)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) * 1.01 + 1


def test_packing_rounds_and_odd(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 60) for _ in range(3000)] + [51] * 40  # many that never share a bin
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    rows = packing.pack(items, capacity=100, nearly_full=99, items_a_task=150).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 100
    assert len(bins) <= 1.03 * sum(lengths) / 100 + 5
    odd = packing.pack_documents(odd_docs(spark)).collect()
    assert len({(r.sequence_id, r.offset) for r in odd}) == len(odd)
    assert sum(r.length == 1 for r in odd) == 3  # empty, NULL and white space: the end id alone
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_packing_deals_equal_rows(spark):
    """A third of all pieces are equal (NULL id): no task of a round gets much more than the mean."""
    rows = [(None, 0, 0, 7, 1)] * 3000 + [(i, 0, 0, 1 + i % 60, i) for i in range(6000)]
    items = common.written(spark.createDataFrame(rows, packing.PIECE).repartition(3), "test-pieces")
    out = packing.pack(items, capacity=100, nearly_full=1, items_a_task=1200).collect()  # every bin is emitted at once
    assert sorted(r.length for r in out) == sorted(r[3] for r in rows)
    tasks = Counter(r.sequence_id >> 32 for r in out)  # a bin's number holds its task's
    assert len(tasks) == 8 and max(tasks.values()) <= 1.25 * len(rows) / 8


# ---- 1 and 3: quality -----------------------------------------------------------------------

def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    repeat = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_fit_holds_its_rows_once():
    rng, n, each = np.random.default_rng(1), 300, 10_000
    size = quality_rules.GROUPS << quality_rules.BITS
    idx, val = rng.integers(0, size, (n, each)).astype("<u4"), rng.random((n, each)).astype("<f4")
    cell = lambda x: pa.array([r.tobytes() for r in x] + [b""], pa.binary())
    tab = pa.table({"quality": pa.array([i % 2 for i in range(n + 1)], pa.int32()), "idx": cell(idx), "val": cell(val)})
    tab = pa.concat_tables([tab.slice(7, 100), tab.slice(107), tab.slice(0, 7)])  # several chunks
    order = [*range(7, n), None, *range(7)]
    w, r = rng.random(size), rng.random(n + 1)
    tracemalloc.start()
    rows = quality_rules._Rows(tab)
    dot, back = rows.dot(w), rows.back(r, size)
    quality_rules.fit_logistic(rows, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(dot, [0 if i is None else (w[idx[i]] * val[i]).sum() for i in order])
    want = np.zeros(size)
    for i, x in zip(order, r):
        if i is not None:
            np.add.at(want, idx[i], x * val[i])
    assert np.allclose(back, want)
    assert peak < 48_000_000, peak  # the rows' own 24 MB lie in Arrow's memory
    assert len(quality_rules._Rows(tab.slice(0, 0)).dot(w)) == 0


def test_quality_rules(spark, docs, texts):
    out = quality_rules.op3_quality_rules(spark, SF)
    assert as_dict(out, *BASE) == {i: base_counts(t) for i, t in texts.items()}
    labels = table(spark, SF, "labels")
    rows = out.join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert all(r.kept == (not r.base_failed and r.probability >= 0.5) for r in out.collect())


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for model_rows in (odd_docs(spark), empty_docs(spark)):
        n = model_rows.count()
        out = quality_rules.quality_rules(model_rows, labels)
        assert out.count() == n
        assert quality_classifier.quality_scores(model_rows, labels).count() == n
        kept = quality_rules.accepted_documents(model_rows, None)
        assert kept.columns == model_rows.columns
        assert kept.count() == out.where("kept").count()
    rows = quality_rules.quality_rules(odd_docs(spark), labels).where("doc_id in (6, 7, 11, 12)")
    assert as_dict(rows, *BASE) == {6: base_counts(""), 7: base_counts(""), 11: base_counts("a\nb\na\n\nb"),
                                    12: base_counts("x " * 200)}


def test_quality_classifier(spark):
    out = quality_classifier.op1_quality_classifier(spark, "/root/testdata/sf0.01")
    rows = out.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


# ---- 4 and 5 --------------------------------------------------------------------------------

def test_chat_linking(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi \"you\""), (1, 1, None, None), (None, None, "user", "x")],
                                     "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame([
        (1, 1, 0, "a", "search", '{"query":"q","limit":3}'), (1, 1, 1, "b", "search", '{"limit":"3","z":[1, {"b":2,"a":1}]}'),
        (1, 2, 0, "a", "search", '{"query":"q","limit":3}'), (1, 3, 0, "c", "search", "[1]"),
        (1, 3, 1, "d", "none", "{}"), (1, 3, 2, "e", "lookup", None)],
        "conv_id long, turn long, idx int, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 0, "b", "early"), (1, 9, "a", "late"), (1, 4, "zz", "orphan"), (1, 5, None, "n")],
                                    "conv_id long, turn long, call_id string, text string")
    schemas = spark.createDataFrame(chat_format.SCHEMAS, "name string, parameter string, type string, required boolean")
    lines = chat_format.format_lines(messages, calls, results, schemas)
    out = {(r.conv_id, r.block): r for r in chat_format.assemble(lines).collect()}
    got = json.loads(out[1, 0].json)
    assert [x.get("tool_call", {}).get("id") or x.get("tool_call_id") or x.get("content") for x in got] == [
        'hi "you"', None, "a", "a", "b", "b", "a", "c", "d", "e", "zz", "n"]
    calls_out = [x["tool_call"] for x in got if "tool_call" in x]
    assert [c.get("errors") for c in calls_out] == [
        None, ["missing query", "type limit", "unknown z"], ["repeated id"], ["arguments"], ["tool"], ["arguments"]]
    assert '"arguments":{"limit":"3","z":[1,{"a":1,"b":2}]}' in out[1, 0].json
    assert json.loads(out[None, -1].json) == [{"content": "x", "role": "user"}]
    parts = chat_format.assemble(lines, part_lines=5).where("conv_id = 1").collect()
    assert sorted(len(json.loads(r.json)) for r in parts) == [2, 5, 5]
    none = chat_format.format_lines(messages.limit(0), calls.limit(0), results.limit(0), schemas)
    assert chat_format.assemble(none).count() == 0


def test_url_aliases(spark):
    link = '<LINK rel="canonical" href="{}">'
    refresh = "<meta http-equiv='refresh' content=\"0;url={}\">"
    rows = [(1, "http://a.org/x", link.format("https://z.example.com/en/1")), (2, "http://b.org/y#f", refresh.format("http://a.org/x")),
            (3, "http://c.org/", "no links"), (4, "http://www.example.com/en/1", ""), (5, None, None), (6, "nothing", ""),
            (7, "HTTP://D.ORG/p", link.format("//q.NET/fr/2?x#y")), (8, "http://e.org/p", refresh.format("http://d.org/p")
                                                            + link.format("http://www.example.com/en/1")),
            (9, "http://q.net/fr/2?x", "<link rel=canonical href=/de/0>"), (9, "http://q.net/fr/2?x", None),
            (10, "http://f.net/es", ""), (11, "http://f.net/es/", "")]
    pages = spark.createDataFrame([(*r, 1, "v") for r in rows], "page_id long, url string, html string, node int, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(pages).collect()}
    assert got == {
        1: ("a.org", "/x", None, "block"), 2: ("b.org", "/y", None, "block"), 3: ("c.org", "/", None, "allow"),
        4: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("d.org", "/p", None, "allow"), 8: ("e.org", "/p", None, "allow"), 9: ("q.net", "/fr/2", "net/fr/", "block"),
        10: ("f.net", "/es", None, "allow"), 11: ("f.net", "/es/", "net/es/", "block")}
    assert url_filters.url_filter(pages.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)]
    edges += [(i, i + 1) for i in range(2000, 2060)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# ---- 6 and 7 --------------------------------------------------------------------------------

def test_lm_base_scores(spark, texts):
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    docs = table(spark, SF, "documents")
    for known in (lm_scoring.KNOWN_WORDS, 50):  # all words held by the tasks, or most of them joined
        out = {r.doc_id: r for r in lm_scoring.lm_scores(docs, crc_mod("doc_id", 7) != 2, known).collect()}
        assert len(out) == len(texts)
        for i, ws in tokens.items():
            r = out[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
            assert -8 * len(texts[i].encode()) - 60 < r.score < 0
        bits = [out[i].bits_per_byte for i in texts if held[i] and len(tokens[i]) > 50]
        assert sum(bits) / len(bits) < 3.5


def test_lm_words_form_a_distribution(spark):
    """The costs of all one-byte continuations of a prefix add up to one."""
    vocabulary = spark.createDataFrame([(1, bytearray(b"the"), 5), (2, bytearray(b"then"), 2), (3, bytearray(b"a"), 3),
                                        (0, bytearray(b""), 4)], "h long, word binary, n long")
    mixer = lm_scoring.train(vocabulary)
    total = 0.0
    for byte in range(256):
        c = lm_scoring.Coded(pa.array([b"the" + bytes([byte])], pa.binary()))
        log = 0.0
        for bit in range(8):
            x, gate, y = mixer.inputs(c, bit)
            p = mixer.refined(mixer.mixed(x, gate), gate)
            log += math.log(p[3] if y[3] else 1 - p[3])
        total += math.exp(log)
    assert total == pytest.approx(1, abs=1e-6)


def test_lm_odd(spark):
    out = lm_scoring.lm_scores(odd_docs(spark), F.lit(True)).collect()
    assert len(out) == 15 and all(r.score < 0 and r.base_score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (6, 7, 8)} == {1}
    assert [r.n_tokens for r in out if r.doc_id == 2] == [61, 61]
    assert lm_scoring.lm_scores(empty_docs(spark), F.lit(True)).count() == 0
    assert lm_scoring.lm_scores(odd_docs(spark), F.lit(False)).where("n_known = 0").count() == 15


def test_lm_codes_texts_not_words(spark):
    """Shuffling a held-out text's words lowers its score and leaves the base score."""
    rng = random.Random(8)
    words = [f"{x}{y}" for x in "kar lom tis ve".split() for y in "an od ur il es".split()]
    after = {w: rng.sample(words, 3) for w in words}

    def prose(n):
        w = [rng.choice(words)]
        while len(w) < n:
            w.append(rng.choice(after[w[-1]]))
        return w
    rows = [(i, " ".join(prose(80)), True) for i in range(60)]
    for i in range(100, 112):
        w = prose(80)
        rows += [(i, " ".join(w), False), (-i, " ".join(rng.sample(w, len(w))), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, taught boolean")
    out = {r.doc_id: r for r in lm_scoring.lm_scores(docs, F.col("taught")).collect()}
    for i in range(100, 112):
        assert out[-i].base_score == pytest.approx(out[i].base_score)
        assert out[-i].score < 1.2 * out[i].score


def test_lm_scores_depend_on_the_data_only(spark, docs, monkeypatch):
    """One partition or seven, rows in another order, contexts held or joined: the same scores."""
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 1 << 16)  # several shards
    some = docs.where("doc_id % 4 = 0").unionByName(docs.where("doc_id = 8")).select("doc_id", "text")
    taught = crc_mod("doc_id", 7) != 2
    got = []
    for rows, known in ((some.coalesce(1), lm_scoring.KNOWN_WORDS), (some.repartition(7, "text"), lm_scoring.KNOWN_WORDS),
                        (some.repartition(3), 50)):
        got.append(sorted((r.doc_id, r.score, r.base_score, r.n_tokens) for r in lm_scoring.lm_scores(rows, taught, known).collect()))
    for other in got[1:]:
        assert [r[0] for r in other] == [r[0] for r in got[0]]
        for a, b in zip(got[0], other):
            assert a == pytest.approx(b, rel=1e-9)
    assert sum(r[0] == 8 for r in got[0]) == 2


def test_lm_counts_keep_contexts_apart(spark, docs, texts):
    """Every context of the corpus has its own exact counts, joined or held alike."""
    streams = docs.mapInArrow(lambda it: lm_scoring._streams(
        b.append_column("train", pa.array([True] * b.num_rows)) for b in it),
        "doc_id long, n long, word binary")
    got = lm_scoring.Counts(lm_scoring.context_table(streams).toArrow())
    follow = defaultdict(Counter)
    for t in texts.values():
        b = " ".join([*WORD.findall(lower(t)), ""]).encode() + b" "
        for j in range(4, len(b)):
            follow[b[j - 4:j]][b[j]] += 1
    some = sorted(follow)[::97]
    for four in some:
        c = lm_scoring.Coded(pa.array([four], pa.binary()))
        n0, n1 = got.bits(c.ctx[:, 4:], c.bytes[4:].astype(np.int64))
        assert n0[4, 0, 0] + n1[4, 0, 0] == sum(follow[four].values())
        assert n1[4, 0, 0] == sum(n for s, n in follow[four].items() if s >= 128)
    unseen = lm_scoring.Coded(pa.array([b"\x01\x02\x03\x04"], pa.binary()))
    n0, n1 = got.bits(unseen.ctx[:, 4:], unseen.bytes[4:].astype(np.int64))
    assert (n0 + n1)[2:5].sum() == 0


def test_license_phrases_and_spans(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = as_dict(license_scan.op7_license_scan(spark, SF), "n_words", "n_base", "first_word", "last_word", "base_labels")
    for i, t in texts.items():
        w = word.findall(lower(t))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hit = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        assert got[i] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    mit = license_scan.TEMPLATES[1][1].split()
    changed = " ".join([*mit[:20], "one", "more", *mit[21:]])  # an insertion shifts the diagonal
    rows = [(1, "x y z " + changed + " tail"), (2, " ".join(mit[:12])), (3, None), (4, "Licensed under CC BY-NC 4.0!"),
            (4, "Licensed under CC BY-NC 4.0!"), (None, "see the MIT license")]
    d = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, label string")
    out = license_scan.license_scan(d)
    assert out.count() == 6
    r = as_dict(out, "labels", "n_spans")
    assert r[1] == ("mit", 1) and r[2] == ("", 0) and r[3] == ("", 0) and r[4] == ("cc-by-nc", 1) and r[None] == ("mit", 0)
    span = license_scan.license_spans(d).where("doc_id = 1").first()
    assert (span.first, span.last) == (3, len(word.findall(lower(" ".join(mit)))) + 3) and span.score > 0.8
    assert license_scan.license_scan(empty_docs(spark)).count() == 0
    assert license_scan.license_scan(odd_docs(spark)).count() == 15


# ---- 9 and 10 -------------------------------------------------------------------------------

def brute_classes(rows, k=5, t=0.8):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (not a and not b) or (both and both >= t * (len(a) + len(b) - both) - 1e-9):
                links[i].add(j)
                links[j].add(i)
    name = [None] * n
    for i in range(n):
        if name[i] is None:
            seen, stack = {i}, [i]
            while stack:
                for v in links[stack.pop()] - seen:
                    seen.add(v)
                    stack.append(v)
            for u in seen:
                name[u] = (min((rows[v][0] for v in seen if rows[v][0] is not None), default=None),)
    return [(rows[i][0], name[i][0], len(links[i])) for i in range(n)]


def edited(rng, base, n, change):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for i in range(60) for r in edited(rng, [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(1, 120))], 3, 3)]
    rows += edited(rng, [f"h{i}" for i in range(120)], 90, 6)  # one large group of near copies
    rows += ["same text of one large group of exact copies"] * 40 + ["", None, " ", "one", "one", "two words"]
    rows = [(i if i != 17 else None, t) for i, t in enumerate(rows)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, root long, bucket string")
    want = sorted(brute_classes(rows), key=str)
    for small in (False, True):  # also with tiles far smaller than the groups
        if small:
            monkeypatch.setattr(jaccard_join, "BUCKET_CHUNK", 16)
            monkeypatch.setattr(jaccard_join, "CLASS_CHUNK", 10)
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(d).collect()), key=str)
        assert got == want
    kept = jaccard_join.distinct_documents(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_jaccard_join_odd(spark):
    out = jaccard_join.jaccard_join(odd_docs(spark))
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out.collect()), key=str) == sorted(brute_classes(rows), key=str)
    assert jaccard_join.jaccard_join(empty_docs(spark)).count() == 0
    assert jaccard_join.distinct_documents(empty_docs(spark)).count() == 0


def test_jaccard_join_shared_ids(spark, monkeypatch):
    """A third of the ids NULL, a third one id: right classes, and a text meets the one set that is its own."""
    rng = random.Random(9)
    rows = [r for i in range(30) for r in edited(rng, [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(8, 90))], 4, 2)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, t) for i, t in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met, rows_of = [], jaccard_join._set_rows

    def counted(k):
        seen = spark.sparkContext.accumulator(0)
        met.append(seen)
        own = rows_of(k)

        def run(batches):
            def through():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b
            yield from own(through())
        return run
    monkeypatch.setattr(jaccard_join, "_set_rows", counted)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(d).collect()), key=str)
    assert got == sorted(brute_classes(rows), key=str)
    assert 0 < met[0].value <= len(rows)


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_distinct_documents_odd(spark, monkeypatch, bits):
    """One row of each class, repeated and NULL ids too; a full key filter changes nothing."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    d = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    classes = brute_classes(rows)
    named = {c for _, c, _ in classes if c is not None}
    kept = jaccard_join.distinct_documents(d)
    got = kept.collect()
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(named)
    assert [r.text for r in got if r.doc_id is None] == ["only null id"]


def test_key_filter(spark):
    keys = spark.createDataFrame([(i,) for i in [*range(0, 400, 4), None]], "k long")
    rows = spark.createDataFrame([(i,) for i in [*range(400), None]], "k long")
    got = common.marked(rows, F.col("k"), common.key_filter(keys)).where("_maybe")
    found = {r.k for r in got.collect()}
    assert found >= {*range(0, 400, 4), None} and len(found) < 110
    none = common.marked(rows, F.col("k"), common.key_filter(keys.limit(0)))
    assert none.where("_maybe").count() == 0 and none.count() == 401


def test_pruning_bound():
    n, t, tol = 64, 0.8, 1e-6
    m = jaccard_join.least_matches(n, t, tol)
    grid = np.linspace(0, 1, 200_001)
    post = lambda m: (grid ** m * (1 - grid) ** (n - m))[grid >= t].sum() / (grid ** m * (1 - grid) ** (n - m)).sum()
    assert post(m) >= tol > post(m - 1)


def brute_passages(docs, items, k=5, t=0.8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    shingles = lambda w: {tuple(w[i:i + min(k, len(w))]) for i in range(max(len(w) - k, 0) + 1)} if w else set()
    target = {i: word.findall(lower(x)) for i, x in items}
    count = Counter(s for w in target.values() for s in shingles(w))
    weigh = lambda x: sum(1 / max(1, count[s]) for s in x)
    out = set()
    for d, text in docs:
        w = word.findall(lower(text))
        for i, v in target.items():
            b = shingles(v)
            best = 0.0
            for s in range(1 - len(v), len(w)):
                a = shingles(w[max(0, s):s + len(v)])
                common = weigh(a & b)
                if common:
                    best = max(best, common / (weigh(a) + weigh(b) - common))
            if best >= t:
                out.add((d, i, round(best, 9)))
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randint(0, 500)}" for _ in range(n))) for i, n in enumerate([3, 5, 9, 15, 17, 30, 44, 46, 60, 100])]
    items += [(20, items[6][1]), (21, ""), (22, None)]
    docs = []
    for i, text in items[:10]:
        w = text.split()
        for cut in (w, w[1:], w[:-1], [*w[:len(w) // 2], "new", *w[len(w) // 2 + 1:]], [*w[:len(w) // 3], "new", *w[len(w) // 3:]],
                    w[:len(w) // 2]):
            docs.append((len(docs), " ".join([f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))] + cut + ["End."])))
    docs += [(900, None), (901, ""), (902, "clean text without any passage at all of those")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_passages(docs, items)
    for block in (2000, 4):
        got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contaminated(d, b, block_items=block).collect()}
        assert got == want
    hit = {x[0] for x in want}
    assert {r.doc_id for r in decontaminate.clean_documents(d, b).collect()} == {i for i, _ in docs} - hit
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    r = decontaminate.contaminated(d, b).where("doc_id = 18 and item_id = 3").first()
    assert docs[18][1].encode()[r.first_byte:r.end_byte].decode() == items[3][1]


def test_decontamination_at_every_alignment(spark):
    """Edits near the ends, passages cut off by the document's ends and stems that items share."""
    rng = random.Random(7)
    docs = []
    stem = [f"stem{j}" for j in range(12)]
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in (16, *range(32, 37))]
    items += [(100 + i, stem + [f"s{i}w{j}" for j in range(20)]) for i in range(4)]
    items += [(200, [f"r{j % 9}" if j % 3 else f"q{j}" for j in range(34)])]
    for _, w in items:
        n = len(w)
        forms = [(w, True), (w[:2] + ["new"] + w[3:], True), (w[:-3] + ["new"] + w[-2:], True),
                 (w[:n // 2] + ["new"] + w[n // 2:], True), (w[6:] if n > 30 else w[2:], True),
                 (w[:12] + ["new"] + w[13:], True)]
        forms += [(w[:-c], False) for c in range(1, 7)]
        for form, after in forms:
            for at in range(16):
                docs.append((len(docs), " ".join([f"x{rng.randint(0, 99)}" for _ in range(at)] + form + ["end"] * (9 * after))))
        docs += [(len(docs) + c, " ".join(w[c:] + ["end"] * 5)) for c in range(1, 7)]
    items = [(i, " ".join(w)) for i, w in items]
    want = brute_passages(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == want
    assert len(want) > 900


# ---- pipeline -------------------------------------------------------------------------------

def test_pipeline(spark, texts):
    docs = table(spark, SF, "documents")
    rules = as_dict(quality_rules.op3_quality_rules(spark, SF), "kept")
    stage = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(f(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        stage[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert stage["quality_rules"] == sorted(i for i, (k,) in rules.items() if k)
    rows = [(i, texts[i]) for i in stage["quality_classification"]]
    assert stage["near_duplicates"] == sorted({c for _, c, _ in brute_classes(rows)})
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    flat = {i: " " + " ".join(word.findall(lower(texts[i]))) + " " for i in stage["near_duplicates"]}
    leaks = {i for i, t in flat.items() for _, x in items if " " + " ".join(word.findall(lower(x))) + " " in t}
    assert leaks and not leaks & set(stage["benchmark_decontamination"])
    packed = corpus_pipeline.run(spark, SF).collect()
    check_packing(packed, {i: texts[i] for i in stage["benchmark_decontamination"]})
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, table(spark, SF, "documents").limit(0), SF).count() == 0
