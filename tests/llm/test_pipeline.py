"""The pipeline on a small folder of tables, against plain loops; and the registry."""

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, differences
from hopline.llm import decontaminate, pii, quality
from hopline.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_registry():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in contract.queries()) == 1 for n in names) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) is None


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns; all but the last stage keep the columns."""
    long = " ".join(f"word{n % 97} and" for n in range(6_000)) + "."
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a few words only"), (4, long), (4, long), (5, "mail me@example.org now " * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, root int, _d int, kept int"
    given = spark.createDataFrame([(i, t, None, None, 1, "k", 2, 3, 4) for i, t in rows], schema)
    said = lambda df: sorted((str(r.doc_id), r.text) for r in df.filter("text rlike '[a-z]'").collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), SF_DIR).count() == 0
        done = stage(spark, given, SF_DIR)
        if name == "BPE encoding":
            assert sorted(r.n_tokens > 0 for r in done.collect()) == [False] * 2 + [True] * 5
            continue
        assert done.columns == given.columns
        if name == "n-gram Jaccard join":  # of the repeated row one stays, of the texts without words all
            assert [i for i, _ in said(done)] == ["4", "5", "None"] and done.count() == 6
        if name == "benchmark decontamination":
            assert done.count() == 7
        if name == "PII":
            texts = {r.doc_id: r.text for r in done.collect()}
            assert done.count() == 7 and texts[1] is None and texts[4] == long and "example.org" not in texts[5]


def test_stages(spark):
    from tokenizers import Tokenizer

    from hopline.llm.queries import vocabulary

    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = {r.doc_id: r.text for r in given.collect()}
    kept = {r.doc_id for r in quality.judge(given).collect() if r.kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept if (w := docs[i].lower().split())}
    root = {}
    for i in sorted(sets):  # in order, so that a group's first document stands for it
        close = {root[j] for j in root if (n := len(sets[i] & sets[j])) and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)}
        root[i] = min(close, default=i)
        root = {j: root[i] if r in close else r for j, r in root.items()}
    singles = given.filter(given.doc_id.isin(sorted({r for r in root.values()})))
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.overlaps(singles, bench).collect()}
    left = sorted(set(root.values()) - leaked)
    model, library = pii.fit(), Tokenizer.from_file(vocabulary())
    base = [pii.base_spans(docs[i]) for i in left]
    more = pii.model_spans([docs[i] for i in left], model)
    clean = [pii.redact(docs[i], pii.all_spans(docs[i], b, m)) for i, b, m in zip(left, base, more)]
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in zip(left, clean)}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want
