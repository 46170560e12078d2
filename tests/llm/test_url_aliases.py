"""Block decisions over many redirect and canonical links, against a plain union-find."""

import random

from hopline.llm import url_filter
from hopline.llm.url_filter import Rule

RULES = [Rule("block", "bad.test", "/"), Rule("block", "mixed.test", "/x"), Rule("allow", "good.test", "/"), Rule("allow", "bad.test", "/fine")]
HOSTS = ["a.test", "b.test", "c.test", "d.test", "e.test", "f.test", "bad.test", "mixed.test", "good.test"]


def verdict(key):
    """The longest rule's, by plain comparison."""
    host, _, path = key.partition("/")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and f"/{path}".startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)).verdict if fits else None


def test_aliases_equal_union_find(spark):
    rng = random.Random(9)
    keys = [f"{rng.choice(HOSTS[:6])}/{kind}{n}" for n in range(3_000) for kind in "p"]
    keys += [f"{host}/{path}{n}" for host in HOSTS[6:] for path in ("x", "fine", "y") for n in range(25)]
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links, pages = [], []
    for i, key in enumerate(keys):
        html = "<p>no link</p>"
        if rng.random() < 0.45:
            # half the targets are near by, so that chains come up; one hub draws many
            to = keys[(i + rng.randrange(1, 9)) % len(keys)] if rng.random() < 0.8 else rng.choice([keys[0], rng.choice(keys)])
            form = rng.choice([f'<link rel="canonical" href="https://{to}">', f"<meta http-equiv=refresh content='0; url=http://{to}'>"])
            html = f"<head>{form}</head>"
            parent[find(key)] = find(to)
        pages.append((i, f"http://{key}", html))
    for _ in range(500):
        i = rng.randrange(len(keys))
        a, b = keys[i], keys[(i + rng.randrange(1, 5)) % len(keys)]
        links.append((f"http://{a}#top", f"https://{b}"))
        parent[find(a)] = find(b)
    says = {}
    for k in keys:
        says.setdefault(find(k), set()).add(verdict(k))
    want = {}
    for i, k in enumerate(keys):
        group = says[find(k)]
        want[i] = verdict(k) or ("block" if "block" in group and "allow" not in group else "allow")
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, root int")
    redirects = spark.createDataFrame(links, "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.judge(table, RULES, redirects).collect()}
    assert got == want and {"block", "allow"} == set(got.values())
    aliases = [i for i, k in enumerate(keys) if verdict(k) is None and want[i] == "block"]
    assert len(aliases) >= 20  # decisions that came over links alone


def test_no_pages_and_no_links(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(empty, RULES).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", "<link rel=canonical href='http://bad.test/'>"), (3, "no scheme", ""), (3, "no scheme", "")], "page_id long, url string, html string")
    assert sorted(map(tuple, url_filter.judge(odd, RULES).collect())) == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (3, "", "", None, "allow")]
