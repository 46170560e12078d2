"""Quality rules, licenses, personal data, decontamination on odd inputs, against plain loops."""

import itertools
import random
import re

from hopline.llm import decontaminate, licenses, pii, quality

GAP = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (4, "x"), (4, "x"), (5, "a " * 3000), (6, "é ü " * 40)]


def prose(rng, n, words=("the", "of", "and", "stone", "river", "walks", "to", "a", "in", "house", "green")):
    return " ".join(rng.choice(words) for _ in range(n))


def repeated(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)})


def test_quality_counts_and_verdict(documents):
    rng = random.Random(1)
    texts = [prose(rng, n) + "." for n in (5, 49, 50, 120, 400)] + ["w1 w2 w3 " * 30, "a | b | c | d\n" * 9 + "|\n", "#!x% " * 60]
    texts += [" ".join(f"w{rng.randint(0, 40)}" for _ in range(300)) for _ in range(5)]
    texts += [prose(rng, 200, [f"word{i}" for i in range(900)] + ["the", "of", "and"] * 90) for _ in range(8)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts)]
    got = quality.judge(documents(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        words, lines = GAP.findall(t or ""), [x for x in (t or "").split("\n") if GAP.search(x)]
        n = repeated(words)
        want[i] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(words) < 50 or 100 * n > 50 * len(words))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(113, 121)) <= kept


def test_distances_match_a_plain_loop(documents):
    import math

    refs = {"en": ([0.8, 0.1, 0.02, 0.01, 0.03, 0.02, 0.01, 0.01], [1 / 18] * 18)}
    text = "The of and 12 Stones, (walk)! # = é | the " * 12
    row = quality.judge(documents([(1, text)]), refs).first()
    classes = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]"]
    counts = [len(re.findall(c, text)) for c in classes]
    ascii_rest = sum(c < "\x80" for c in text) - sum(counts)
    counts += [ascii_rest, sum(c >= "\x80" for c in text)]

    def jsd(n, q):
        p = [x / sum(n) for x in n]
        half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
        return math.sqrt(half(p, q) / 2 + half(q, p) / 2)

    assert abs(row.char_distance - jsd(counts, refs["en"][0])) < 2e-6
    words = GAP.findall(text)
    common = [sum(w in (c, c.capitalize()) for w in words) for c in quality.COMMON["en"]]
    marks = sum(w in quality.MARKS for w in words)
    assert abs(row.word_distance - jsd([*common, marks, len(words) - sum(common) - marks], refs["en"][1])) < 2e-6


def test_quality_keeps_columns_and_takes_an_empty_table(documents):
    empty = documents([]).limit(0)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).columns == empty.columns


def test_license_places_and_labels(documents):
    texts = {
        10: "Released under the MIT License. mit license, MIT-License!", 11: "see the Apache License; general public license",
        12: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction",
        13: "Permission granted to copy", 14: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        15: "mit apache license license mit", 16: "é" * 50 + " mit license",
    }
    rows = ODD + list(texts.items())
    got = {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        places = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
        every = sorted(k for v in places.values() for k in v)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), min(every, default=None), max(every, default=None))
        assert r.base_labels == ",".join(sorted(k for k, v in places.items() if v))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[12].labels == "mit" and got[14].labels == "bsd" and got[13].labels == "" and got[12].base_labels == ""


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b@", "@", ".", "x.y", "1", "23", "255", "999", "-", " ", "+", "(", ")", "é", "4111111111111111", "\n", "%"]) for _ in range(rng.randint(0, 30)))
        want = [("email", m.start(), m.end()) for m in email.finditer(t)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        want += [("card", m.start(), m.end()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


def test_model_finds_held_out_spans(documents, spark):
    model = pii.fit()
    test = pii.labelled_snippets(200, 1234)
    got = pii.model_spans([t for t, _ in test], model)
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, test))
    assert right >= 0.8 * sum(len(b) for _, b in test) and right >= 0.85 * sum(map(len, got))
    rows = ODD + [(20, "write to me.x@mail.example.com or +1 (743) 555-3824."), (21, "x " * 4000 + "10.0.0.1")]
    out = {(r.doc_id, r.text): r for r in pii.find(documents(rows), model).collect()}
    assert [(s.kind, s.start) for s in out[20, rows[-2][1]].base] == [("email", 9), ("phone", 34)]
    assert [(s.kind, s.start) for s in out[21, rows[-1][1]].spans] == [("ip", 8000)]
    clean = pii.redacted(documents(rows), model)
    assert clean.columns == documents(rows).columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[20].text == "write to <email> or <phone>." and texts[20].n_chars == 28 and texts[1].text is None


def test_windows_cover_every_trigger():
    rng, w = random.Random(2), pii.Windows(10, 5)
    for _ in range(500):
        t = "".join(rng.choice("abc 1@") if rng.random() < 0.2 else "x" for _ in range(rng.randint(0, 60)))
        starts = pii.admissible(t, w)
        last = max(0, -(-(len(t) - w.size) // w.step)) * w.step
        want = [s for s in range(0, last + 1, w.step) if re.search("[0-9@]", t[s : s + w.size])]
        assert starts == want, t


def test_overlaps_against_every_alignment(documents, spark):
    rng = random.Random(8)
    lexicon = [f"w{i}" for i in range(60)]
    items = {i: [rng.choice(lexicon) for _ in range(n)] for i, n in enumerate([6, 4, 12, 30, 45, 20])}
    docs = {}
    for d in range(60):
        words = [rng.choice(lexicon) for _ in range(rng.randint(0, 60))]
        if d % 2:
            piece = list(items[d % 6])
            for k in range(0, len(piece), rng.choice([5, 6, 9, 99])):
                piece[k] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = piece[rng.randint(0, 4) :]
        docs[d] = words
    seeds = decontaminate.Seeds()
    table = documents([(d, " ".join(w).upper()) for d, w in docs.items()] + ODD)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(7, None), (8, ""), (3, " ".join(items[3]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench, seeds).collect()}
    want = set()
    span = len(seeds.masks[0])
    for d, w in docs.items():
        for i, x in items.items():
            if len(x) < seeds.least_words:
                continue
            for at in range(-len(x), len(w)):
                same = [0 <= at + j < len(w) and w[at + j] == x[j] for j in range(len(x))]
                size = min(seeds.window, len(x))
                best = max(sum(same[s : s + size]) for s in range(len(x) - size + 1))
                masks = seeds.masks if len(x) >= span else ("1" * len(x),)
                hit = any(all(same[s + k] for k, c in enumerate(m) if c == "1") for m in masks for s in range(len(x) - len(m) + 1) if 0 <= at + s and at + s + len(m) <= len(w))
                if hit and 100 * best >= (100 if len(x) < span else 80) * size:
                    want.add((d, i))
    assert got == want and len(want) > 10
    clean = decontaminate.clean(table, bench, seeds)
    assert clean.columns == table.columns
    assert clean.count() == table.count() - len({d for d, _ in want})
    few = decontaminate.Seeds(broadcast_rows=1)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench, few).collect()} == want
    assert decontaminate.overlaps(table.limit(0), bench).count() == 0 and decontaminate.overlaps(table, bench.limit(0)).count() == 0


def test_masks_hit_whatever_passes():
    for seeds in (decontaminate.Seeds(), decontaminate.Seeds(least_percent=70), decontaminate.Seeds(masks=("1101110010", "1011010011")), decontaminate.Seeds(patterns=0)):
        for n in range(5, 24):
            size = min(n, seeds.window)
            masks = seeds.masks_for(n)
            for gone in itertools.combinations(range(size), size * (100 - seeds.least_percent) // 100):
                assert any(all(s + k not in gone for k, c in enumerate(m) if c == "1") for m in masks for s in range(size - len(m) + 1)), (n, gone)
    assert decontaminate.Seeds().masks_for(20) == decontaminate.Seeds.masks


def test_every_overlap_that_passes_is_found(documents, spark):
    """Without regard to seeds: each way to replace or cut off a fifth of an item's words."""
    rng = random.Random(12)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (5, 6, 9, 10, 11, 12, 15, 16, 20, 33)}
    docs, want = {}, set()
    for n, x in items.items():
        size = min(n, 20)
        ways = list(itertools.combinations(range(size), size // 5))
        for gone in ways if len(ways) < 100 else rng.sample(ways, 100):
            first = rng.randint(0, n - size)
            words = [f"zz{j}" if j in gone else w for j, w in enumerate(x[first : first + size])]
            docs[len(docs)] = ["a"] * rng.randint(0, 3) + words + ["b"] * rng.randint(0, 3)
            want.add((len(docs) - 1, n))
        for k in range(size // 5 + 1):
            docs[len(docs)] = x[k : size - size // 5 + k]
            want.add((len(docs) - 1, n))
        for gone in rng.sample(list(itertools.combinations(range(size), size // 5 + 1)), 5):
            docs[len(docs)] = [f"zz{j}" if j in gone else w for j, w in enumerate(x[:size])]
    table = documents([(d, " ".join(w)) for d, w in docs.items()])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench).collect()} == want
