"""Small tests: brute force, round trips, held-out accuracy, and the odd cases of each operator."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshrel.llm import components as C
from meshrel.llm import components, embedding_dedup, language_mixture, line_dedup, minhash_dedup, packing, quality_knn, quality_rules, sentencepiece_viterbi, substring_dedup, tables, toxicity_cnn
from meshrel.llm import kernels as K

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def near_copies(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrst"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        cut = rng.randrange(5, len(w))
        out.append((i, " ".join(w[:cut]) + "\n" + " ".join(w[cut:])))
    return out


def closure(ids, linked):
    root = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                again = True
    return root


# kernels

def test_words_and_lines_match_python():
    texts = ["", " a  bb\tccc\n", "x", "é ß\vq", "\n\n", "tail\r\nend"]
    raw, offs = K.utf8(pa.array(texts))
    w = K.words(raw, offs)
    for i, t in enumerate(texts):
        got = [raw[s:e].tobytes().decode() for s, e in zip(w.starts[w.borders[i] : w.borders[i + 1]], w.ends[w.borders[i] : w.borders[i + 1]])]
        assert got == WORD.findall(t)
    s, e, b = K.lines(raw, offs)
    assert [[raw[s[k] : e[k]].tobytes().decode() for k in range(b[i], b[i + 1])] for i in range(len(texts))] == [t.split("\n") for t in texts]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 120), (120, 110), (7, 7), (100, 120)]
    got = dict(rows(C.connected_components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    want = closure({x for e in edges for x in e}, edges)
    assert got == want
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1

def test_pieces_round_trip_and_best_score(make_docs, odd):
    a = sentencepiece_viterbi.automaton(sentencepiece_viterbi.default_model())
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sentencepiece_viterbi.default_model(), "rb").read())
    score = {p.piece: p.score for p in m.pieces if p.type == 1}

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - 16), j):
                if word[i:j] in score:
                    top[j] = max(top[j], top[i] + score[word[i:j]])
        return top[-1]

    for text in ["the thenoning ouhe bleen", "Les élèves, c'est ça", "continuation  of two  spaces"]:
        ids = a.encode(text)
        assert a.decode(ids) == text
        assert sum(m.pieces[i].score for i in ids) == best("▁" + text.replace(" ", "▁"))
    for text in ["line\nbreak\t漢\x01", "", " lead", "🙂"]:
        assert a.decode(a.encode(text)) == text
    out = sentencepiece_viterbi.encode(make_docs(odd, True))
    assert out.count() == len(odd) and out.where("not round_trip").count() == 0
    back = dict(rows(sentencepiece_viterbi.decode(out.where("doc_id is not null").dropDuplicates(["doc_id"])), "doc_id", "text"))
    assert all(back[i] == (t or "") for i, t in odd if i is not None)
    assert sentencepiece_viterbi.encode(make_docs([])).count() == 0


# 2

def shingle_set(line, k=line_dedup.WIDTH):
    return {line} if len(line) <= k else {line[i : i + k] for i in range(len(line) - k + 1)}


@pytest.mark.parametrize("light", [1024, 20])
def test_lines_brute_force(make_docs, monkeypatch, light):
    monkeypatch.setattr(components, "LIGHT", light)  # sets above it are compared whole, in the join
    docs = near_copies(40) + [(100, "same line here\n\nother"), (101, "same line here"), (102, "same line here")]
    places = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in places})
    sets = [shingle_set(x) for x in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = closure(range(len(texts)), linked)
    first = {}
    for d, k, x in sorted(places):
        first.setdefault(root[texts.index(x)], (d, k))
    want = sorted((d, k) for d, k, x in places if first[root[texts.index(x)]] != (d, k))
    got = sorted((r["doc_id"], k) for r in line_dedup.summary(make_docs(docs, True)).collect() for k in r["removed_lines"])
    assert got == want
    clean = dict(rows(line_dedup.clean(make_docs(docs, True)), "doc_id", "text"))
    assert clean[101] == "" and clean[100] == "same line here\n\nother"


def test_lines_without_spaces_and_ends(make_docs):
    rng = random.Random(8)
    some = lambda n, lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    pairs = []
    for k in range(150):
        x = some((60, 120, 200)[k % 3], *((0x4E00, 0x9000) if k % 2 else (0x61, 0x7B)))
        pairs.append((x, some(1, 0x3041, 0x3090) + x))  # one more character in front
        y = some(200, 0x61, 0x7B)
        pairs.append((y, y[:-8] + some(8, 0x41, 0x5B)))  # another end
        z = " ".join(some(5, 0x61, 0x7B) for _ in range(20))
        pairs.append((z, z[:-6] + some(6, 0x41, 0x5B)))
    want = [100 * len(shingle_set(a) & shingle_set(b)) >= 80 * len(shingle_set(a) | shingle_set(b)) for a, b in pairs]
    assert all(want)
    got = rows(line_dedup.summary(make_docs([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)])), "doc_id", "n_removed")
    assert sum(n for _, n in got) >= 0.98 * len(pairs)


def test_lines_at_the_threshold(make_docs):
    rng = random.Random(12)
    some = lambda n, lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    pairs = []
    for k in range(600):  # the kind of signature follows the length; the last characters differ
        length, other = ((60, 5), (100, 9), (130, 13), (300, 32))[k % 4]
        x = some(length, *((0x4E00, 0x9000) if k % 8 < 4 else (0x61, 0x7B)))
        pairs.append((x, x[:-other] + some(other, 0x41, 0x5B)))
    alike = [len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) for a, b in pairs]
    assert 0.8 <= min(alike) and max(alike) < 0.82
    got = rows(line_dedup.summary(make_docs([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)])), "doc_id", "n_removed")
    assert sum(n for _, n in got) >= 0.98 * len(pairs)


def test_lines_beyond_the_basic_plane(make_docs):
    rng = random.Random(21)
    some = lambda n, lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    pairs = []
    for k in range(300):  # such characters take two places in a signature: alone, among others, only in one line
        length, other = ((60, 5), (100, 9), (300, 32))[k % 3]
        x = some(length, 0x1F300, 0x1F600) if k % 2 else some(length // 2, 0x61, 0x7B) + some(length - length // 2, 0x1F300, 0x1F600)
        x = some(length, 0x61, 0x7B) if k % 5 == 0 else x
        pairs.append((x, x[:-other] + some(other, 0x1F300, 0x1F600)))
    want = [100 * len(shingle_set(a) & shingle_set(b)) >= 80 * len(shingle_set(a) | shingle_set(b)) for a, b in pairs]
    assert all(want)
    got = rows(line_dedup.summary(make_docs([(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)])), "doc_id", "n_removed")
    assert sum(n for _, n in got) >= 0.98 * len(pairs)


def test_lines_are_signed_at_two_bytes_a_character(make_docs, spark):
    lines = spark.createDataFrame([(1, "x" * 40)], "id long, line string")
    plan = line_dedup.signatures(lines, 4, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "UTF-16BE" in plan and "UTF-32" not in plan


def test_members_are_exchanged_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def look(df, name):
        assert name == "groups"
        assert rows(df, "key", "id", "n") == [(1, 10, 2), (1, 11, 2)]
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(components, "save", look)
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "key long, id long")
    with pytest.raises(Seen, match="ReusedExchange"):
        components.link_groups(members, None, None, None, 80)


def test_sampled_signatures_hash_a_shingle_once(spark):
    lines = spark.createDataFrame([(1, "x" * 40)], "id long, line string")
    plan = line_dedup.signatures(lines, 4, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!xx)hash\(", plan)) == 1


def test_sampled_shingles_count_in_one_band(spark):
    rng = random.Random(33)
    some = lambda n: "".join(chr(rng.randrange(0x61, 0x7B)) for _ in range(n))
    pairs = [(x, x[: -n // 8] + some(n // 8)) for n in (130, 200, 400) for x in (some(n) for _ in range(200))]
    lines = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "id long, line string")
    frame = line_dedup.signatures(lines, line_dedup.RATE, line_dedup.SAMPLED_BANDS)
    assert len(re.findall(r"\bmin\(", frame._jdf.queryExecution().optimizedPlan().toString())) == line_dedup.ROWS
    keys = {r["id"]: {r[f"k{b}"] for b in range(line_dedup.SAMPLED_BANDS)} - {None} for r in frame.collect()}
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs))) >= 0.98 * len(pairs)


def test_common_phrase_alone_gives_no_key(spark):
    frame = line_dedup.signatures(spark.createDataFrame([(i, chr(0x61 + i) * 300) for i in range(26)], "id long, line string"), 1, 2)
    assert all(r["cells"] == 1 and r["k0"] is not None for r in frame.collect())  # whole sets are signed whatever their size
    frame = line_dedup.signatures(spark.createDataFrame([(i, chr(0x61 + i) * 300) for i in range(26)], "id long, line string"), 2, 2)
    found = frame.collect()
    assert found and all(r["cells"] == 1 and r["k0"] is None and r["k1"] is None for r in found)


def test_line_sets_count_repeats_once(spark):
    lines = ["abcdefghijkl" * 6, "abcdefghijkl" * 6 + "x", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaa", "short", "other"]
    known = spark.createDataFrame(list(enumerate(lines)), "id long, payload string")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "a long, b long")
    frame = line_dedup.similar(pairs, known, 80)
    assert "array_distinct" not in frame._jdf.queryExecution().optimizedPlan().toString()
    for r in frame.collect():
        x, y = shingle_set(lines[r["a"]]), shingle_set(lines[r["b"]])
        assert r["similarity"] == len(x & y) / len(x | y) and r["ok"] == (100 * len(x & y) >= 80 * len(x | y))


def test_groups_that_their_centre_settles_are_not_crossed(spark, monkeypatch):
    crossed, save = [], tables.save

    def look(df, name):
        out = save(df, name)
        crossed.extend(rows(out, "id") if name == "mixed" else [])
        return out

    monkeypatch.setattr(components, "save", look)
    payloads = {10: "p", 11: "q", 20: "r", 21: "s", 22: "t"}
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21), (2, 22)], "key long, id long")

    def verify(pairs, known):  # only 21 and 22 are alike, and neither is the centre
        ok = "least(a, b) = 21 and greatest(a, b) = 22"
        return pairs.selectExpr("a", "b", "0.7D as similarity", f"{ok} as ok")

    known = spark.createDataFrame(list(payloads.items()), "id long, payload string")
    found = components.link_groups(members, verify, lambda ids: known.join(ids, "id", "left_semi"), F.array(F.xxhash64(F.lit("same"))), 80)
    assert rows(found, "id", "component") == [(21, 21), (22, 21)]
    assert sorted(crossed) == [(21,), (22,)]  # 11 has met the only other member of its group


def test_saved_tables_leave_no_shuffle_files(spark):
    made = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    for keep in (tables.save, lambda df, name: tables.save_bucketed(df, name, "k")):
        before = made()
        out = keep(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "test")
        end = time.time() + 20  # files go in the background
        while made() - before and time.time() < end:
            time.sleep(0.2)
        assert not made() - before
        assert out.count() == 7


def test_saving_gives_native_memory_back(spark, monkeypatch):
    assert tables.trim(spark)  # the JVM of the tests can
    calls = []
    monkeypatch.setattr(tables, "trim", calls.append)
    assert tables.save(spark.range(3), "test").count() == 3
    assert tables.save_bucketed(spark.range(3), "test", "id").count() == 3
    assert calls == [spark, spark]


def test_parities_bound_the_difference(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(300)]
    sets = {i: set(base[: 300 - 20 * i]) | {rng.getrandbits(63) for _ in range(15 * i)} for i in range(8)}
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id bigint, items array<bigint>")
    got = {r["id"]: r for r in components.parities(frame).collect()}
    for i in sets:
        assert got[i]["size"] == len(sets[i])
        for j in sets:
            bits = sum(((got[i][f"p{w}"] ^ got[j][f"p{w}"]) & (2**64 - 1)).bit_count() for w in range(components.PARITY_WORDS))
            assert bits <= len(sets[i] ^ sets[j]) and (bits > 0) == (i != j)


def test_lines_odd(make_docs, odd):
    got = rows(line_dedup.summary(make_docs(odd, True)), "doc_id", "n_lines", "n_removed")
    assert len(got) == len(odd) and (1, 0, 0) in got and (3, 3, 0) in got and (7, 1, 1) in got and (6, 1, 0) in got
    assert line_dedup.summary(make_docs([])).count() == 0


# 3, 8, 10

def labelled(make_docs, spark, n=400):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("sto", "mar", "lin", "ven", "tor") for b in ("en", "al", "is", "um", "ea")]
    docs, y = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(40)] = "vileword"
        junk = i % 5 == 0
        docs.append((i, " | ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)))
        y.append((i, int(not junk), int(bad)))
    return make_docs(docs, True), spark.createDataFrame(y, "doc_id long, quality int, toxic int")


def test_quality_votes(make_docs, spark, odd):
    docs, labels = labelled(make_docs, spark)
    out = quality_knn.classify(docs, quality_knn.fit(docs, labels)).join(labels, "doc_id")
    assert out.where("held_out and predicted <> quality").count() == 0
    model = quality_knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_knn.classify(make_docs(odd), model).collect()} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in quality_knn.classify(make_docs(odd), quality_knn.fit(docs, labels)).collect())
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}
    assert all(held[r["doc_id"]] == r["held_out"] for r in out.collect())


def test_toxicity(make_docs, spark, odd):
    docs, labels = labelled(make_docs, spark)
    model = toxicity_cnn.fit(docs, labels)
    out = toxicity_cnn.classify(docs, model).join(labels, "doc_id")
    assert out.where("held_out and predicted <> toxic").count() <= 2
    kept = toxicity_cnn.drop_toxic(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 300) <= 4
    assert toxicity_cnn.classify(make_docs(odd), model).count() == len(odd)
    empty = toxicity_cnn.fit(docs, labels.limit(0))
    assert toxicity_cnn.classify(docs, empty).where("predicted = 1").count() == 0


def test_languages(spark, make_docs, odd):
    rng = random.Random(1)
    kinds = {"aa": ["thing", "other", "whether"], "bb": ["über", "schön", "gefühl"]}
    data = [(i, " ".join(rng.choice(kinds["aa" if i % 2 else "bb"]) for _ in range(20)), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_mixture.fit(docs)
    out = language_mixture.identify(docs, model).join(docs, "doc_id")
    assert out.where("lang <> lang_pred").count() == 0
    odd_rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_mixture.identify(make_docs(odd), model).collect()}
    assert odd_rows[1] == odd_rows[2] == odd_rows[3] == ("und", 0.0) and odd_rows[9][0] != "und"
    mixed = "thing other whether " * 10 + "über schön gefühl " * 10
    raw, offs = K.utf8(pa.array([mixed]))
    share = model.proportions(language_mixture.gram_counts(raw, offs))[0]
    assert 0.3 < share[0] < 0.7
    assert language_mixture.identify(docs, language_mixture.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


# 4

def test_rules_brute_force(make_docs, odd):
    docs = near_copies(30) + [(50, "r s t u v w x y z a\n" * 6), (51, "### *** <a> | b\n### *** <a> | b\n \n \n")] + [(i + 100 if i else None, t) for i, t in odd]
    field = quality_rules.fit_rows(pa.array([t for _, t in docs if t]), steps=40)
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(make_docs(docs, True), field).collect()}
    for d, t in docs:
        w = WORD.findall(t or "")
        r = got[d, len(w)]
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = {}
        for x in win:
            times[x] = times.get(x, 0) + 1
        cover = {p for i, x in enumerate(win) if times[x] > 1 for p in range(i, i + 8)}
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_rules_fit_takes_all_texts(make_docs, spark):
    """A mark that only few texts bear, and a short line that recurs in all of them only, reach the model."""
    rng = np.random.default_rng(12)
    plain = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 12)) + ".\nAll rights kept\n" * (i % 40 == 0) for i in range(2400)]
    docs = [(i, t + "\n## ** || ##" * (i % 7 == 0)) for i, t in enumerate(plain)] + [(9000, None), (9001, "")]
    got = quality_rules.fit(make_docs(docs, True).repartition(5))
    want = quality_rules.fit_rows(pa.array([t for _, t in docs]))
    np.testing.assert_allclose(got.emit, want.emit, atol=2e-3)
    np.testing.assert_allclose(got.step, want.step, atol=2e-3)
    part = quality_rules.fit_rows(pa.array([t for _, t in docs[:2000]]))
    assert np.abs(part.emit - want.emit).max() > 1e-2
    assert quality_rules.fit(make_docs([])).emit[0] == 1


def test_line_sums_are_a_gradient():
    rng = np.random.default_rng(4)
    x, y, borders = rng.standard_normal((500, quality_rules.FEATURES)), rng.integers(0, 2, 500), np.array([0, 1, 1, 30, 450, 500])
    w = rng.standard_normal(quality_rules.FEATURES + 4) / 3
    at = lambda v: quality_rules.line_sums(x, y, borders, v)
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-5
        assert at(w)[2 + k] == pytest.approx((at(w + e)[1] - at(w - e)[1]) / 2e-5, rel=1e-5, abs=1e-5)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    field = quality_rules.LineField(rng.standard_normal(quality_rules.FEATURES), rng.standard_normal((2, 2)))
    borders = np.array([0, 1, 6, 8])
    x = rng.standard_normal((8, quality_rules.FEATURES))
    got = field.decode(x, borders)
    for a, b in zip(borders[:-1], borders[1:]):
        n = b - a
        score = lambda y: sum(x[a + t] @ field.emit * y[t] for t in range(n)) + sum(field.step[y[t], y[t + 1]] for t in range(n - 1))
        best = max(([(k >> t) & 1 for t in range(n)] for k in range(1 << n)), key=score)
        assert list(got[a:b]) == best


# 5

def brute_substrings(docs, window=13):
    least, out = {}, []
    words = sorted((d, WORD.findall(t or "")) for d, t in docs)
    for d, w in words:
        for i in range(len(w) - window + 1):
            least.setdefault(tuple(w[i : i + window]), d)
    for d, w in words:
        gone = {p for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substrings_brute_force(make_docs, odd):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = near_copies(60) + [(100 + i, " ".join(f"u{rng.random()}" for _ in range(rng.randrange(12))) + " " + passage + f" tail{i}") for i in range(20)]
    docs += [(i + 200, t) for i, t in odd if i is not None and i != 5] + [(205, "a b\nc d\na b"), (205, "a b\nc d\na b")]
    got = rows(substring_dedup.digest(make_docs(docs, True)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_substrings(docs), key=repr)
    assert substring_dedup.digest(make_docs([])).count() == 0
    cleaned = substring_dedup.clean(make_docs([*docs, (None, passage)], True))
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert texts[119].endswith("tail19") and passage not in texts[119] and texts[None] == passage and texts[201] is None


def test_cover_has_every_difference():
    differences = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.PERIOD))


# 6

def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    data = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.3, 1.0])
        data.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    data += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, base[0].tolist(), None), (304, [1.0, 2.0], 1), (305, [2.0, 4.0], 1), (306, [None] * 64, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("size", F.lit(3)).withColumn("id", F.lit(0))
    good = {i: np.float32(v).astype(float) for i, v, y in data if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in data}
    linked = [(i, j) for i in good for j in good if j < i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.93]
    got = {r["vec_id"]: r for r in embedding_dedup.links(df).collect()}
    assert len(got) == len(data)
    found, true = sum(r["n_links"] for r in got.values()), 2 * len(linked)
    assert 0.9 * true <= found <= true
    if found == true:
        root = closure(label, linked)
        assert all(r["component_id"] == root[i] and r["kept"] == (root[i] == i) for i, r in got.items())
    assert embedding_dedup.links(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dims", "pivots"), [(64, 256), (64, 1024), (256, 256)])
def test_embedding_recall_near_the_threshold(dims, pivots):
    """Pairs at cosines from 0.93 to 0.95 share enough pivots; nine in ten of them at least."""
    rng = np.random.default_rng(dims)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((4000, dims)))
    aside = rng.standard_normal(x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.93, 0.95, (4000, 1))
    y = c * x + np.sqrt(1 - c * c) * aside
    p = embedding_dedup.choose_pivots(x, pivots)
    assert len(p) == pivots
    a, b = (embedding_dedup._description(v, p) for v in (x, y))
    common = (a[:, :, None] == b[:, None, :]).any(2).sum(1)
    assert (common >= embedding_dedup.SHARED).mean() >= 0.95


def test_embedding_pivots_do_not_follow_the_size(spark, monkeypatch):
    """As many pivots for a large label as for a small one, and recall with them."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    counts, choose = [], embedding_dedup.choose_pivots
    monkeypatch.setattr(embedding_dedup, "choose_pivots", lambda *a: counts.append(len(out := choose(*a))) or out)
    x = unit(rng.standard_normal((12000, 32)))
    for n in (2000, 12000):
        embedding_dedup.links(spark.createDataFrame([(i, v, 0) for i, v in enumerate(x[:n].tolist())], "vec_id long, embedding array<double>, label int"))
    assert counts == [embedding_dedup.PIVOTS] * 2
    aside = rng.standard_normal(x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    p = choose(x[:4096])
    a, b = (embedding_dedup._description(v[8000:], p) for v in (x, 0.935 * x + np.sqrt(1 - 0.935**2) * aside))
    assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= embedding_dedup.SHARED).mean() >= 0.98


def test_embedding_threshold_is_alike_in_short_and_long_lists():
    """A cosine that is the threshold itself links its pair, however long the list is."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((embedding_dedup.SMALL + 40, 61))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, ids = np.tile(np.arange(3), (len(v), 1)), np.arange(len(v))

    def found(n, cosine):
        zeros = np.zeros(n, np.int64)
        return embedding_dedup.compare(zeros, v[:n], near[:n], zeros + 2, zeros, zeros > 0, ids[:n], zeros + 1, 3, cosine)

    for i in range(1, 60):
        cosine = np.einsum("ij,ij->i", v[:1], v[i : i + 1])[0]
        for n in (embedding_dedup.SMALL, len(v)):
            out = found(n, cosine)
            assert i in out[0] and 0 in out[0]
            linked = np.einsum("ij,kj->ik", v[:n], v[:n])[0] >= cosine + 1e-9
            assert out[1][list(out[0]).index(0)] == linked[1:].sum() + 1


# 7

@pytest.mark.parametrize("width", [2, 5])
def test_minhash_brute_force(make_docs, odd, width):
    docs = near_copies(80) + [(i + 200, t) for i, t in odd if i is not None]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closure(ids, linked)
    got = minhash_dedup.components(make_docs(docs, True), width, 80).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert minhash_dedup.components(make_docs([])).count() == 0


def test_sketch_hashes_only_for_open_coordinates(monkeypatch):
    rng, t, sizes = np.random.default_rng(3), minhash_dedup.COORDINATES, [0, 1, 3, 300, 2000]
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in sizes]
    mixed, mix = [], K.mix
    with monkeypatch.context() as m:
        m.setattr(K, "mix", lambda x: mixed.append(len(x)) or mix(x))
        got = minhash_dedup.sketch(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    assert sum(mixed[1::2]) < sum(sizes) + 2 * t * len(sizes)  # places and values take turns
    for x, found in zip(sets[1:], got[1:], strict=True):
        want = np.full(t, np.uint64(2**64 - 1))
        for r in range(2 * t):  # every round, every shingle
            y = mix(x * minhash_dedup._ROUND[r] + np.uint64(r))
            place = ((y >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if r < t else np.full(len(x), r - t, np.uint64)
            np.minimum.at(want, place.astype(np.int64), (np.uint64(r) << np.uint64(54)) | (mix(y) & np.uint64((1 << 54) - 1)))
        assert (found == want).all()
    assert not got[0].any()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    h = rng.integers(1, 2**63, 1200).astype(np.uint64)
    a, b = np.sort(h[:1000]), np.sort(h[200:])
    s = minhash_dedup.sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    one = minhash_dedup.sketch(h[:3], np.array([0, 3]))
    assert (one != np.uint64(2**64 - 1)).all()  # few elements, every coordinate filled


# 9

def test_packing(make_docs, odd):
    from tokenizers import Tokenizer

    docs = near_copies(50) + [(i + 200 if i else None, t) for i, t in odd] + [(300, "<|endoftext|> it's 1234  !!\n\n x y퟿")]
    slow = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for d, t in docs:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [2]
        at, k, size = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want.append((d, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, k, size = at + size, k + 1, 1024
    out = packing.pack(make_docs(docs, True))
    assert rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert packing.pack(make_docs([])).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(8)
    lengths = np.minimum(rng.lognormal(5.5, 1, 20000).astype(int) + 1, 1023)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    found, bound, program = packing.solve(counts)
    again = {}
    for times, config in found:
        assert sum(k * a for k, a in config.items()) <= 1024
        for k, a in config.items():
            again[k] = again.get(k, 0) + a * times
    assert again == counts
    total = sum(t for t, _ in found)
    assert bound >= lengths.sum() / 1024 * (1 - 1e-5) and bound <= total <= 1.005 * bound
    assert program >= 0.9 * total  # sequences that the program gave


def test_plan_odd_histograms():
    assert packing.solve({}) == ([], 0.0, 0)
    for counts in ({1024: 3}, {600: 7}, {1: 5}, {600: 4, 300: 4, 124: 4}, {512: 3, 513: 2}):
        found, bound, _ = packing.solve(counts)
        again = {}
        for times, config in found:
            for k, a in config.items():
                again[k] = again.get(k, 0) + a * times
        total = sum(t for t, _ in found)
        assert again == counts and bound <= total
        assert total == {1024: 3, 600: 7 if counts == {600: 7} else 4, 1: 1, 512: 4}[max(counts) if max(counts) != 513 else 512]
