"""Exact top-k search, whitening and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopline.llm import conversation_repair, queries, topk_search, whitening

SF_DIR = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use themselves.
VECTORS = "vec_id long, embedding array<double>, key long, x array<int>, rank int, dim int, stripe int, index long"
TURNS = "conv_id long, turn long, role string, text string, gone boolean, n long, seen boolean, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, [1], 3, 2, 5, 9) for i, v in rows], VECTORS).repartition(3)


def turns(spark, rows):
    return spark.createDataFrame([(*r, True, 5, False, 3) for r in rows], TURNS).repartition(3)


# --- op11 ---------------------------------------------------------------------


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v):
    return [max(-(2**63), min(2**63 - 1, math.floor(64 * c))) for c in v]


def best(rows, k):
    """(query_id, rank, vec_id, score) by comparing everything."""
    rows = [(i, whole(v)) for i, v in rows if usable(v)]
    asked = {(i, tuple(v)) for i, v in rows if i is not None and i % 20 == 0}
    out = []
    for i, q in asked:
        scored = []
        for j, v in rows:
            if j != i and len(v) == len(q):
                s = sum(a * b for a, b in zip(q, v, strict=True))
                scored.append((-max(-(2**63), min(2**63 - 1, s)), j is None, j))
        for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out.append((i, rank + 1, j, -s))
    return sorted(out, key=str)


ODD_VECTORS = [
    (20, None), (40, []), (41, []), (60, [1.0, None]), (61, [float("nan"), 1.0]), (62, [float("inf"), 1.0]),
    (None, [0.5, 0.25]), (80, [0.5, 0.25]), (80, [0.5, 0.25]), (80, [-0.5, 0.25]), (81, [0.5, 0.25]), (82, [0.5, 0.25]),
    (100, [1.0, 2.0, 3.0]), (0, [0.0, 0.0]), (-20, [0.1, -0.1]),
]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e17])
def test_top_k_equals_brute_force(spark, scale):
    """Scores of few and many bits: floats, whole numbers and numbers beyond 64 bits."""
    rng = random.Random(int(scale) % 97)
    rows = ODD_VECTORS + [(200 + i, [rng.uniform(-1, 1) * scale for _ in range(5)]) for i in range(150)]
    rows += [(400 + i, [0.5 * scale] * 5) for i in range(60)]  # many equal scores
    got = topk_search.top_k(vectors(spark, rows), k=4, block_rows=16, query_rows=7, bucket_bytes=2_000)
    assert sorted(map(tuple, got.collect()), key=str) == best(rows, 4)


def test_top_k_returns_all_if_fewer(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    got = topk_search.top_k(vectors(spark, rows)).orderBy("rank").collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert got[0].__fields__ == ["query_id", "rank", "vec_id", "score"]
    assert topk_search.top_k(vectors(spark, [(0, [1.0])])).count() == 0
    assert topk_search.top_k(vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def test_top_k_of_an_empty_table(spark):
    got = topk_search.top_k(vectors(spark, []))
    assert got.count() == 0 and got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    with pytest.raises(ValueError):
        topk_search.top_k(vectors(spark, []), k=0)


def test_a_row_that_is_very_common(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [i / 300, 0.5]) for i in range(300)]
    got = topk_search.top_k(vectors(spark, rows), k=5, block_rows=8)
    assert sorted(map(tuple, got.collect()), key=str) == best(rows, 5)


# --- op12 ---------------------------------------------------------------------


def whitened(rows, components=16):
    """({vec_id: deviations}, {vec_id: rows of whitened values}, shares), from NumPy; values up to sign."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and usable(v)]
    sizes = [len(v) for _, v in kept]
    dim = max(sorted(set(sizes), reverse=True), key=sizes.count)
    kept = [(i, v) for i, v in kept if len(v) == dim]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit], float) / n
    e, ways = np.linalg.eigh(off.T @ off / n)
    e, ways = e[::-1], ways[:, ::-1]
    width = min(components, int((e > e[0] * dim * np.finfo(float).eps).sum()))
    out = []
    for i, v in kept:
        own = [n * x - s for x, s in zip(v, sums, strict=True)]
        values = np.array(own, float) / n @ ways[:, :width] / np.sqrt(e[:width])
        out.append((i, sum(d * d for d in own), values))
    return n, out, e[:width] / e.sum()


def check_whitening(got, rows, components=16):
    n, want, shares = whitened(rows, components)
    table = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-9
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        table.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    assert len(got) == len(want) * len(shares)
    signs = np.zeros(len(shares))
    for i, deviation, values in want:
        mine = np.array([x for _, x in sorted(table[i, deviation])]).reshape(len(shares), -1)
        assert np.ptp(mine, axis=1).max() <= 1e-9
        big = np.abs(values) > 1e-3
        sign = np.sign(mine[:, 0] / np.where(big, values, 1)) * big
        assert not ((sign * signs) < 0).any()
        signs = np.where(sign != 0, sign, signs)
        assert np.abs(np.abs(mine[:, 0]) - np.abs(values)).max() < 1e-6


@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "stripe_blocks": 2}, {"components": 2}])
def test_whitening_equals_numpy(spark, options):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, rng.normal(size=5) * [5, 4, 3, 2, 1]))) for i in range(120)]
    rows += rows[:30] + [(500 + i, rows[3][1]) for i in range(40)]
    rows += [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [1.0] * 4), (None, rows[5][1])]
    got = whitening.whitened(vectors(spark, rows), **options).collect()
    check_whitening(got, rows, options.get("components", 16))


def test_whitening_without_variance(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(8)]  # one direction only
    got = whitening.whitened(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- op13 ---------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) of (role, must go, cut off) by trying all edits, two insertions at a place at most."""
    best = None

    def go(i, cost, audit, roles):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for k in range(3):
            for put in itertools.product("ua", repeat=k):
                here, spent, written = roles + "".join(put), cost + 5 * k, audit + "I" * k
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", here):
                        best = min(best or (spent, written), (spent, written))
                    continue
                role, must, cut_off = rows[i]
                go(i + 1, spent + 2, written + "D", here)
                if not must:
                    if role:
                        go(i + 1, spent + 5 * cut_off, written + "K", here + role[:1])
                    for r in "ua":
                        go(i + 1, spent + 1 + 5 * cut_off, written + "R", here + r)

    go(0, 0, "", "")
    return best


class Colliding(conversation_repair.Audits):
    """Hashes of which a third are equal."""

    def __init__(self):
        super().__init__(base=1, modulus=3)


@pytest.mark.parametrize("held,tree", [(4_096, conversation_repair.Audits), (1, conversation_repair.Audits), (2, Colliding)])
def test_cheapest_audit(held, tree):
    rng = random.Random(held)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "x", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 5))]
        done = conversation_repair.Conversation(lambda *_: None, held, tree)
        for i, (role, must, cut_off) in enumerate(rows):
            done.add(i, role, "t", False, must, cut_off)
        end = done.end()
        assert (end["cost"], end["audit"]) == cheapest([(r, m, c and not m) for r, m, c in rows])


def test_audits_are_ordered_as_strings():
    rng = random.Random(5)
    for tree in (conversation_repair.Audits(), Colliding()):
        nodes = [0]
        for _ in range(300):
            nodes.append(tree.add(rng.choice(nodes), rng.choice("DIKR")))
        for _ in range(2_000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_settled_rows_are_forgotten():
    held, out = [], []
    done = conversation_repair.Conversation(lambda *edit: out.append(edit), 64)
    for i in range(5_000):
        done.add(i, "user" if i % 2 == 0 else "assistant", str(i), False, i % 7 == 0, False)
        held.append(len(done.rows))
    end = done.end()
    assert max(held) <= 128 and len(end["audit"]) >= 5_000 and sum(e[0] != "I" for e in out) == 5_000


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def audited(rows):
    """{conv_id: row} of the damaged rows, by the plain words of the task."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, steps = set(), [], []
        for _, role, text in mine:
            said = text.strip(conversation_repair.SPACES)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            steps.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(steps)
        lines, at, roles = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit in "RI":
                role = "assistant" if roles[-1:] == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                roles += role[:1]
        given = [r[0] for r in mine if r[0] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn * 3, None]), role, rng.choice(["Hi.", "Well", "", None, "é\x0b", "Why? ", "a\nb!"])))
    rows += [(900, None, None, None), (901, 5, "user", "x" * 200_000 + "."), (902, 1, "user", "A."), (902, 1, "user", "A.")]
    damaged = conversation_repair.damaged(turns(spark, rows))
    for held in (1, 4_096):
        got = conversation_repair.audits(damaged, F.col("gone"), held).collect()
        assert {r.conv_id: tuple(r) for r in got} == audited(rows) and len(got) == len({r[0] for r in rows})
    # the repaired turns are what the digest is of
    lines = {}
    for r in conversation_repair.repaired(damaged, F.col("gone")).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in audited(rows).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == row[-1]


def test_repair_of_nothing(spark):
    got = conversation_repair.audits(turns(spark, []))
    assert got.count() == 0 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert conversation_repair.repaired(turns(spark, [])).count() == 0
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = queries_of(spark, [(gone, 0, "user", "Hi.")])
    assert row == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def queries_of(spark, rows):
    damaged = conversation_repair.damaged(turns(spark, rows))
    return tuple(conversation_repair.audits(damaged, F.col("gone")).first())


def test_many_copies_of_a_turn(spark):
    rows = [(1, 0, "user", "Hi.")] * 400 + [(1, 1, "assistant", "Yes.")]
    row = conversation_repair.audits(turns(spark, rows)).first()
    assert (row.duplicate, row.cost, row.audit) == (399, 798, "K" + "D" * 399 + "K")


# --- the queries ---------------------------------------------------------------


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op12_whitening(spark, SF_DIR).collect(), rows)
