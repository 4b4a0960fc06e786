"""The pipeline's stages one after another, each held on its own input: line, near-copy and substring stages and the
pieces against brute force, the toxicity stage against its classifier's own verdicts."""

import corpus_pipeline
import pytest
from meshrel.llm import minhash_dedup, packing, substring_dedup, toxicity_cnn
from meshrel.llm.tables import save
from test_operators import WORD, brute_substrings, closure, near_copies, rows, shingle_set

FOLDER = "/root/testdata/sf0.001"


def without_repeated_lines(docs):
    places = [(d, k, x) for d, t in docs if d is not None and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({x for _, _, x in places})
    sets = [shingle_set(x) for x in texts]
    root = closure(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    first, at = {}, {x: root[i] for i, x in enumerate(texts)}
    for d, k, x in sorted(places):
        first.setdefault(at[x], (d, k))
    keep = {(d, k) for d, k, x in places if first[at[x]] == (d, k)}
    return [(d, t if d is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (d, k) in keep)) for d, t in docs]


def one_of_each(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = closure(sets, [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    return [(d, t) for d, t in docs if root[d] == d]


def test_stages_against_brute_force(spark, make_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "substring_dedup", "best_fit_packing"]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [*near_copies(40), (100, f"same line here\n\nother {passage} a"), (101, "same line here"), (102, f"first {passage}\nlast"), (103, None), (104, "")]
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity_cnn.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = {r["doc_id"]: r["score"] for r in toxicity_cnn.classify(make_docs(docs), model).collect()}
    got = rows(stages["toxicity"](spark, make_docs(docs), FOLDER), "doc_id", "text")
    assert got == sorted([x for x in docs if scored[x[0]] < toxicity_cnn.CUT], key=repr)
    cut = without_repeated_lines(docs)
    assert rows(stages["line_dedup"](spark, make_docs(docs), FOLDER), "doc_id", "text") == sorted(cut, key=repr)
    copies = near_copies(40)  # lines would leave no copies: this stage has its own input
    assert rows(stages["minhash_dedup"](spark, make_docs(copies), FOLDER), "doc_id", "text") == sorted(one_of_each(copies), key=repr)
    left = {d: (n - gone) for d, n, gone, _ in brute_substrings(docs)}
    cleaned = dict(rows(stages["substring_dedup"](spark, make_docs(docs), FOLDER), "doc_id", "text"))
    assert set(cleaned) == {d for d, _ in docs} and all(len(WORD.findall(cleaned[d] or "")) == left[d] for d in cleaned)
    pieces = stages["best_fit_packing"](spark, make_docs(docs), FOLDER)
    encode = packing.encoder(packing.default_vocabulary())
    assert {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {d: (len(encode(t)) if t else 0) + 1 for d, t in docs}


def test_odd_rows_go_through(spark, make_docs, odd):
    docs = make_docs(odd, True)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = save(stage(spark, docs, FOLDER), "test")
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    assert {r["doc_id"] for r in docs.collect()} >= {None, 1, 2, 3, 9}


def test_equal_rows_of_one_id_stay_once(spark, make_docs):
    docs = make_docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words in here now"), (None, "x"), (None, "x")])
    assert rows(minhash_dedup.keep_one(docs), "doc_id", "text") == sorted([(1, "a b c d e f g"), (3, "other words in here now"), (None, "x"), (None, "x")], key=repr)
    assert substring_dedup.clean(docs).count() == 6


@pytest.mark.parametrize("name", ["toxicity", "minhash_dedup", "substring_dedup", "best_fit_packing", "line_dedup"])
def test_empty_tables(spark, make_docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, make_docs([]), FOLDER).count() == 0
