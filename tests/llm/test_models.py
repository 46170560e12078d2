"""BPE, language model, Jaccard join, HTML, chat and URLs against brute force and round trips."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopline.llm import bpe, chat, html_extract, jaccard, language_model, url_filter
from hopline.llm.components import components
from hopline.llm.queries import HOSTILE, URL_RULES, vocabulary

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (4, "x"), (4, "x"), (5, "a " * 3000), (6, "é ü " * 40)]


def texts(rng, n):
    parts = ["the", "a", " ", "  ", "\n", "1", "ß", "日本", "😀", "'s", "#$%", "<|endoftext|>", "՘", "x" * 40, "abcdefghijk" * 9]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    rows = ODD + [(100 + i, t) for i, t in enumerate(texts(random.Random(1), 200))]
    library = Tokenizer.from_file(vocabulary())
    got = bpe.round_trip(documents(rows), vocabulary(), chars=500).collect()
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == want


def test_cuts_are_certain():
    encoder = bpe.Encoder.load(vocabulary())
    for t in texts(random.Random(2), 300):
        data = t.encode()
        parts = encoder.fragments(data)
        assert b"".join(parts) == data
        assert b"".join(encoder._merge_long(p) for p in parts) == encoder._merge_long(data) if data else True


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 5), (300, 300), (1000, 2**42), (50, 2**63)]:
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        m, bits, low, high = language_model.EliasFano.encode(values)
        level = language_model.EliasFano(m, bits, np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint8))
        assert (level.get(np.arange(len(values))) == values).all()
        wanted = rng.integers(0, top, 200).astype(np.uint64)
        got = level.successor(wanted, np.zeros(200, np.int64), np.full(200, len(values)))
        assert (got == np.searchsorted(values, wanted)).all()


def test_language_model(documents):
    rng = random.Random(3)
    rows = ODD + [(10 + i, " ".join(rng.choice(["A", "b", "c", "é", f"w{i}", f"v{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 80)))) for i in range(80)]
    got = language_model.score_documents(documents(rows), k=6.0, chunk_bytes=2_000).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    c = [collections.Counter(g for i, w in tokens if not held(i) for g in zip(*(w[k:] for k in range(n)))) for n in (1, 2, 3)]
    total, distinct = sum(c[0].values()), len(c[0])
    want = collections.defaultdict(list)
    for i, w in tokens:
        base = [math.log10((c[0][(x,)] + 1) / (total + distinct + 1)) for x in w]
        s = 0.0
        for j, x in enumerate(w):
            p = (c[0][(x,)] + 1) / (total + distinct + 1)
            p = (c[1][w[j - 1], x] + 6 * p) / (c[0][(w[j - 1],)] + 6) if j else p
            p = (c[2][w[j - 2], w[j - 1], x] + 6 * p) / (c[1][w[j - 2], w[j - 1]] + 6) if j > 1 else p
            s += math.log10(p)
        want[i].append((held(i), len(w), sum(c[0][(x,)] > 0 for x in w), sum(base), s))
    for r in got:
        assert r.train_tokens == total
        fits = [x for x in want[r.doc_id] if (r.held_out, r.n_tokens, r.n_known) == x[:3] and abs(r.base_score - x[3]) < 1e-6 * max(1, abs(x[3]))]
        assert fits and min(abs(r.score - x[4]) for x in fits) < 0.05 * r.n_tokens
    assert language_model.score_documents(documents([]).limit(0)).count() == 0


def _groups(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("options", [{}, {"few": 2, "piece": 2, "rounds": 1, "block": 3, "frequent_least": 4}])
def test_jaccard_components(documents, options):
    rng, rows = random.Random(5), []
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    passage = [f"p{k}" for k in range(40)]
    for i in range(120):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            words[rng.randint(0, 59)] = f"n{rng.randint(0, 3000)}"
        if i % 3 == 0:
            words = [f"u{rng.randint(0, 9999)}" for _ in range(50)] + passage
        rows.append((10 + i, " ".join(words)))
    rows += [(200, "one two"), (201, "ONE  two"), (202, "one two three"), (1, None), (2, ""), (3, " ")]
    rows += [(300, "a " * 3000), (301, rows[5][1])]
    got = jaccard.near_duplicates(documents(rows), **options).collect()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    groups = _groups(sets, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), groups[i]) for i in sets}
    left = jaccard.one_of_each(documents(rows), **options)
    assert left.columns == documents(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(groups.values()))


def test_jaccard_of_repeated_rows_and_an_empty_table(documents):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "z"), (None, None)]
    got = jaccard.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.component_id or -1) for r in got) == [(False, 7), (False, 7), (False, 8), (True, -1), (True, 7)]
    left = jaccard.one_of_each(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("7", "a b c d e f"), ("8", "z"), ("None", "None")]
    assert jaccard.near_duplicates(documents([]).limit(0)).count() == 0


def test_jaccard_leaves_no_shuffle_files_behind_its_steps(spark, documents, monkeypatch):
    """Shuffles that still have files, counted where links are looked for."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    known = lambda: set(map(int, str(held.keySet().mkString(" ")).split()))
    before, left, links = known(), [], jaccard._links

    def seen(*args):
        left.append(len(known() - before))
        return links(*args)

    monkeypatch.setattr(jaccard, "_links", seen)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{base} x{i}") for i in range(40)] + [(100 + i, f"{base} y{i // 2} z") for i in range(20)]
    got = jaccard.near_duplicates(documents(rows), few=2, piece=2, block=3, frequent_least=4)
    assert len(left) == 3 and max(left) <= 12, left  # of small tables that are counted; 26 while each step left its own
    assert {r.component_id for r in got.collect()} == {0}


def test_documents_are_not_shuffled_to_drop_copies(documents):
    rows = [(i, f"a b c d e f g{i // 2}") for i in range(20)] + [(1, "a b c d e f g0"), (50, "z z"), (50, "z z"), (51, None), (51, None)]
    for given in (documents(rows[:20]), documents(rows)):
        left = jaccard.one_of_each(given)
        plan = left._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "SortMergeJoin" not in plan and len(moved) == (given.count() > 20), plan  # of the repeated keys alone
    assert sorted(r.doc_id for r in left.collect()) == [*range(0, 20, 2), 50, 51, 51]


def test_trie_finds_exactly_the_similar_sets():
    rng, similar = random.Random(6), jaccard.Similarity(80)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(150)]
    trie = jaccard.Trie(sets)
    for s in sets[:60]:
        both = [len(set(s.tolist()) & set(t.tolist())) for t in sets]
        want = {i for i, (b, t) in enumerate(zip(both, sets)) if b and 100 * b >= 80 * (len(s) + len(t) - b)}
        assert set(trie.partners(s, similar)) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (5, 5), (None, 3), (7, None), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}


def test_components_of_few_edges_take_few_tasks(spark):
    """Every task of a shuffle leaves files; few edges must not leave them for all partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long")
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        found = components(edges, "x", "y")
        assert found.rdd.getNumPartitions() <= 16
        assert dict(found.collect()) == dict.fromkeys(range(61), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_html_layouts_and_odd_pages(spark):
    model, rng = html_extract.fit(), random.Random(99)
    right = found = wanted = 0
    for _ in range(150):
        marked = html_extract.labelled_page(rng)
        page, labels = html_extract._labels(marked)
        want = html_extract.text_of_states(page, [1 if y else 2 for y in labels]).split()
        got = html_extract.extract([re.sub(r" data-(x|main)", "", marked)], model)[0].split()
        both = sum((collections.Counter(want) & collections.Counter(got)).values())
        right, found, wanted = right + both, found + len(got), wanted + len(want)
    assert right >= 0.95 * found and right >= 0.97 * wanted
    page = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three, four five six.</p><p>Seven &lt;b&gt; <i>ei</i>ght, nine ten.<script>x<p></script></article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<<<>>> </p></div><a<b"), (5, "x", "<div>" * 3000 + "deep")]
    out = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), model).collect()
    assert [r.text for r in out if r.page_id == 1] == ["A & B One two three, four five six. Seven <b> eight, nine ten."] * 2
    assert len(out) == 6 and all(r.text == "" for r in out if r.page_id in (2, 3))


def test_html_sibling_features_of_long_lists():
    name = {f: k for k, f in enumerate(html_extract.FEATURES)}
    for n in (5, 63, 64, 65, 185):
        tags = ["p" if k < n // 2 or k % 3 else "div" for k in range(n)]
        page = html_extract.parse("<section>own text" + "".join(f"<{t}>{'x' * (k + 1)}</{t}>" for k, t in enumerate(tags)) + "</section>")
        rows = html_extract.features(page)[2:]
        mean = sum(range(1, n + 1)) / n
        for k, row in enumerate(rows):
            assert row[name["siblings"]] == n and row[name["place"]] == k / (n - 1)
            assert row[name["alike"]] == tags.count(tags[k]) / n
            assert abs(row[name["over_siblings"]] - (k + 1) / mean) < 1e-12


def test_html_long_pages():
    model, rng = html_extract.fit(), random.Random(98)
    right = found = wanted = 0
    for _ in range(40):
        marked = html_extract.long_page(rng)
        page, labels = html_extract._labels(marked)
        assert max(len(x.children) for x in page.nodes) > 64
        want = html_extract.text_of_states(page, [1 if y else 2 for y in labels]).split()
        got = html_extract.extract([re.sub(r" data-(x|main)", "", marked)], model)[0].split()
        both = sum((collections.Counter(want) & collections.Counter(got)).values())
        right, found, wanted = right + both, found + len(got), wanted + len(want)
    assert right >= 0.95 * found and right >= 0.97 * wanted


def test_decoding_never_contradicts_an_ancestor():
    rng = np.random.default_rng(3)
    page = html_extract.parse("<div><p>a</p><div><p>b<ul><li>c<li>d</ul></div></div><p>e")
    for _ in range(300):
        states = html_extract.decode(page, rng.normal(0, 3, len(page.nodes)))
        for node, state in zip(page.nodes[1:], states[1:]):
            above = states[node.parent]
            assert not (above == html_extract.DROPPED and state != html_extract.DROPPED)
            assert not (above == html_extract.CONTENT and state == html_extract.CONTAINER)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = [HOSTILE, "[ANS]", "\\", "\\[", "</s>", "<image:0>", "é", "\n", "[INST:user]"]
    rows = [(c, t, "assistant" if t % 2 else "user", "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(40) for t in range(4)]
    rows += [(99, 0, "sys]tem", None), (99, 0, "sys]tem", None), (None, 1, None, "x"), (98, None, "assistant", "y" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(table)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, "user" if role is None else role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda x: x[0] or 0)
        said = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(r, x)[0]) for _, r, x in turns)


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <image:0> "}, {"type": "image", "url": "i", "width": 57, "height": 28}, {"type": "audio", "url": "a", "seconds": 1.5}, {"type": "document", "url": "d", "pages": 2}, {"type": "new", "x": 1}]
    visitor = chat.flatten(parts)
    assert visitor.attachments == [("image", "i", 3), ("audio", "a", 38), ("document", "d", 1024)]
    assert "".join(visitor.pieces).startswith("see \\<image:0\\> <image:0><audio:1><document:2>")
    row = chat.format_turns(spark.createDataFrame([(1, 0, "user", json.dumps(parts))], "conv_id long, turn long, role string, text string"), parts=True).first()
    assert row.n_attachment_tokens == 3 + 38 + 1024 and [a.ref for a in row.attachments] == ["i", "a", "d"]


def test_url_rules_and_aliases(spark):
    canonical = '<head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.example.net/en/1", None), (2, "http://b.net/x", ""), (3, "http://c.com/x", canonical.format("http://b.net/x#f")),
        (4, "http://d.com/x", canonical.format("http://c.com/x")), (5, "http://e.com/y", canonical.format("http://a.example.net/en/1")), (6, None, None), (7, "no scheme", None),
        (8, "HTTP://Sub.Example.COM/de/1?q#z", None), (9, "http://f.org/fr/1", canonical.format("http://g.net/")), (10, "http://h.com/z", canonical.format("http://g.net/")),
        (11, "http://i.com/p/q", '<meta http-equiv="refresh" content="0; url=/r">'), (12, "http://i.com/r", '<!-- <link rel=canonical href=http://b.net/x> -->'), (13, "http://net", None), (2, "http://b.net/x", ""),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_key", F.lit(1)).withColumn("rule", F.lit(1))
    redirects = spark.createDataFrame([("http://i.com/r", "http://j.net/"), (None, "x"), ("http://k.com/", "http://k.com/")], "src string, dst string")
    got = url_filter.judge(table, URL_RULES, redirects).collect()
    assert len(got) == len(rows)
    verdicts = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdicts[1] == ("example.net/en/", "allow") and verdicts[2] == ("net/", "block")
    assert verdicts[3] == verdicts[4] == (None, "block")  # aliases of a blocked page
    assert verdicts[5] == (None, "allow") and verdicts[6] == verdicts[7] == (None, "allow")
    assert verdicts[8] == ("example.com/de/", "block")
    assert verdicts[9] == ("org/fr/", "allow") and verdicts[10] == (None, "allow")  # an explicit allow in the component
    assert verdicts[11] == verdicts[12] == (None, "block") and verdicts[13] == (None, "allow")
    row = {r.page_id: r for r in got}
    assert (row[8].host, row[8].path, row[6].host, row[7].path) == ("sub.example.com", "/de/1", "", "")
