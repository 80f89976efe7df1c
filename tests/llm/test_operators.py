"""The training-data operators against brute force on small tables, and on odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import (ann, license_scan, mixing, ngram_join, packing, quality_rules, suffix_dedup, syncmers,
                      toxicity, url_rules)
from kiln.llm.words import blocks, buffers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, row int, n int, part int"


@pytest.fixture(scope="module")
def corpus():
    """Passages shared by documents, near and exact copies, and odd rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    texts = {i: rng.choices(words, k=rng.randint(1, 160)) for i in range(60)}
    passage = rng.choices(words, k=55)
    for i in (3, 9, 21):
        texts[i][len(texts[i]) // 2:len(texts[i]) // 2] = passage
    for i, j in ((30, 31), (31, 32), (5, 33)):
        texts[j] = [w if rng.random() > 0.02 else "edit" for w in texts[i]]
    texts[40] = texts[41] = texts[12]
    texts[50], texts[51] = ["same"] * 120, []
    out = {i: " ".join(t).replace(" w7 ", "\n W7\t") for i, t in texts.items()}
    out[52], out[53] = None, "   "
    out[54] = "ab " * 3000
    return out


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), "x", 1, 2, 3) for i, t in texts.items()], DOCS)


@pytest.fixture(scope="module")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    _frame(spark, corpus).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "e")
    docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")


def _words(t):
    return (t or "").encode().lower().split()


def test_words_are_exact(docs):
    for text in ("A b\tC\x0bd e  \n", "", "x" * 3_000_000 + " y " * 10, "É é"):
        import pyarrow as pa
        data, off = buffers(pa.array([text, text]))
        got = [data[off[i + k]:off[i + k + 1]].tobytes()[s:e].lower() for i, j, w in blocks(data, off)
               for k in range(j - i) for s, e in zip(w.start[w.ptr[k]:w.ptr[k + 1]], w.end[w.ptr[k]:w.ptr[k + 1]])]
        assert got == _words(text) * 2


def test_jaccard_components(docs, corpus):
    sets = {}
    for d, t in corpus.items():
        w = _words(t)
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_components(docs).collect()}
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}
    kept = {r.doc_id for r in ngram_join.keep_one_per_component(docs).collect()}
    assert kept == {d for d in sets if root[d] == d}


def test_one_row_of_each_component_stays(spark, corpus, tmp_path):
    """Repeated rows, and different texts under one doc_id."""
    rows = [(1, corpus[30])] * 4 + [(2, corpus[3]), (2, corpus[31]), (2, None), (2, " "), (2, " "), (3, corpus[9]), (3, corpus[9]), (4, corpus[9])]
    rows += [(5, corpus[21]), (5, corpus[21] + " end")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "o"))
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one_per_component(spark.read.parquet(str(tmp_path / "o"))).collect()]
    five = [t for d, t in got if d == 5]
    assert len(five) == 1 and five[0].startswith(corpus[21])
    assert sorted((d, t or "") for d, t in got if d != 5) == sorted([(1, corpus[30]), (2, corpus[3]), (2, ""), (2, " "), (2, " "), (3, corpus[9])])


def test_null_ids_take_part(spark, corpus, tmp_path):
    """A near copy, a bridge between two documents and shared passages in rows without doc_id."""
    rng = random.Random(8)
    w = [f"v{i}" for i in range(130)]
    far = w[:12] + [f"q{i}" for i in range(6)] + w[18:]           # links with 9 only through the whole ``w``
    passage = rng.choices(w, k=60)
    rows = [(7, " ".join(far)), (None, " ".join(w)), (9, " ".join(w[:-18] + [f"r{i}" for i in range(6)] + w[-12:])),
            (None, " ".join(passage + ["own", "tail"])), (11, " ".join(["head", "here"] + passage)), (None, " ".join(["other"] * 5 + passage))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "n"))
    docs = spark.read.parquet(str(tmp_path / "n"))
    comp = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicate_components(docs, percent=80).collect())
    assert comp == {(7, 7): 1, (None, 7): 1, (9, 7): 1, (11, 11): 1, (None, 11): 2}
    kept = collections.Counter(r.doc_id for r in ngram_join.keep_one_per_component(docs, percent=80).collect())
    assert kept == {7: 1, 11: 1}
    tails = spark.createDataFrame(rows[3:], "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(tails).collect()
    assert [(r.doc_id, r.spans[0].start, r.spans[0].end, r.removable) for r in spans] == [(11, 2, 62, [])]
    left_over = sorted(r.text for r in suffix_dedup.remove_repeats(tails).collect())
    assert left_over == sorted([rows[4][1], "own tail", "other other other other other "])


def test_repeated_spans(docs, corpus):
    where = collections.defaultdict(set)
    for d, t in corpus.items():
        w = _words(t)
        for i in range(len(w) - 49):
            where[tuple(w[i:i + 50])].add(d)
    want = {}
    for d, t in corpus.items():
        w, span, cut = _words(t), set(), set()
        for i in range(len(w) - 49):
            owners = where[tuple(w[i:i + 50])]
            if len(owners) > 1:
                span |= set(range(i, i + 50))
                if min(owners) < d:
                    cut |= set(range(i, i + 50))
        if span:
            want[d] = (span, cut)
    flat = lambda s: {x for z in s for x in range(z["start"], z["end"])}
    got = {r.doc_id: (flat(r.spans), flat(r.removable)) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == want and {3, 9, 21} <= set(got)
    after = {r.doc_id: _words(r.text) for r in suffix_dedup.remove_repeats(docs).collect()}
    for d, t in corpus.items():
        left = [w for i, w in enumerate(_words(t)) if i not in want.get(d, ((), ()))[1]]
        assert after.get(d, []) == left


def test_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    """A passage is cut from the text that holds it, not from another text of that doc_id; of equal ids one text keeps it."""
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(100))
    rows = [(1, passage), (5, passage + " two"), (5, other), (5, other), (7, "x " + other), (9, "a " + " ".join(f"z{i}" for i in range(70))),
            (9, "b " + " ".join(f"z{i}" for i in range(70)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "s"))
    left = sorted((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "s"))).collect())
    assert left[:5] == [(1, passage), (5, other), (5, other), (5, "two"), (7, "x ")]
    assert sorted(len(t.split()) for d, t in left[5:]) == [1, 71]


def test_equal_keys_of_other_words_are_no_repeat():
    """A forced clash of the first hash alone makes no match."""
    import pyarrow as pa
    rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([7, 7, 7], [1, 1, 2], [10, 11, 12], [3, 2, 1], [0, 0, 0])],
                                      names=["key", "sub", "owner", "doc_id", "pos"])
    out = pa.Table.from_batches(list(suffix_dedup._windows(50)(iter([rows.slice(0, 1), rows.slice(1, 1), rows.slice(2)])))).to_pylist()
    assert [(r["owner"], r["first"], r["first_owner"]) for r in out] == [(10, 2, 11), (11, 2, 11)]


def test_mix(docs, corpus):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(corpus) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id: r["size"] for r in rows} == {d: len(_words(t)) for d, t in corpus.items()}
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect())
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        key = f"s{r.doc_id % 5}" if r.doc_id % 7 else None
        by[key] = [by[key][0] + r.taken, r.target]
    assert all(abs(a - b) <= mixing.BLOCK_WORDS for a, b in by.values())
    words = collections.Counter(r.doc_id for r in mixing.mix_documents(docs).collect() for _ in _words(r.text))
    assert words == collections.Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_targets_and_tree(spark):
    assert mixing.targets([100, 100, 100]).tolist() == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 1000]).tolist() == pytest.approx([30.0, 980.0])
    quota = np.array([1000, 3, 77])
    rows = mixing.splitting_tree(spark, quota, 9, 1).collect()
    for s, q in enumerate(quota):
        ranks = [x for r in rows if r.src == s for x in range(r.lo, r.hi)]
        assert sorted(ranks) == list(range(q))
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r.hi - r.lo
    assert max(load.values()) - min(load.values()) <= 1
    big = mixing.split_counts(np.random.default_rng(0), np.array([3 * 10**9, 10**9]), 2 * 10**9)
    assert big.sum() == 2 * 10**9
    draws = np.array([mixing.split_counts(np.random.default_rng(i), np.array([10**9, 2 * 10**9, 5]), 3 * 10**8) for i in range(200)])
    assert (draws.sum(1) == 3 * 10**8).all() and (draws >= 0).all() and (draws[:, 2] <= 5).all()
    assert abs(draws[:, 0].mean() - 10**8) < 4 * 7746 / 200 ** 0.5 and 0.8 < draws[:, 0].std() / 7746 < 1.25     # the hypergeometric deviation


def test_rows_keep_their_numbers(spark, tmp_path):
    """Files are split otherwise while the result is read than while it was planned, as when executors come or go."""
    rng = random.Random(3)
    texts = [(i % 97 if i % 5 else None, " ".join(f"w{rng.randrange(800)}" for _ in range(rng.randint(1, 400))), f"s{i % 3}") for i in range(600)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(13).write.parquet(str(tmp_path / "n"))
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "40")
        docs = spark.read.parquet(str(tmp_path / "n"))
        packed, mixed, sizes = packing.pack_documents(docs), mixing.mix_documents(docs), mixing.mix_sources(docs)
        spark.conf.set(key, "2")
        load = collections.Counter()
        for r in packed.collect():
            load[r.sequence_id] += r.length
        assert max(load.values()) <= 1024
        words = collections.Counter()
        for r in mixed.collect():
            words[r.doc_id] += len(_words(r.text))
        unfiled = collections.Counter()                      # a table without files of its own
        for r in mixing.mix_documents(docs.select("source", F.concat("text", F.lit("")).alias("text"), "doc_id").distinct()).collect():
            unfiled[r.doc_id] += len(_words(r.text))
        assert unfiled == words
        taken = collections.Counter()
        for r in sizes.collect():
            taken[r.doc_id] += r.taken
        assert words == +taken
        again = mixing.mix_sources(spark.read.parquet(str(tmp_path / "n"))).collect()
        assert sorted(((r.doc_id or -1), r["size"], r.taken) for r in again) == sorted(((r.doc_id or -1), r["size"], r.taken) for r in sizes.collect())
    finally:
        spark.conf.unset(key)


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs).collect()
    places = collections.defaultdict(list)
    for d, t in corpus.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            places[r.sequence_id].append((r.offset, r.length))
        assert all(r.length == 1024 for r in own[1:])
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1]] and sum(n for _, n in p) <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) + 1


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "x<|endoftext|>y", "don't 12 %% É  z", "\t\t", "a\n\n\nb c"])
def test_token_ids(text):
    enc = packing._Encoder.of(packing.default_tokenizer())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_texts_are_encoded_whole():
    """A call of the encoder for each rare word costs more than the text."""
    enc, calls = packing._Encoder(packing.default_tokenizer()), []
    fast = enc.fast
    enc.fast = type("Counted", (), {"encode_ordinary": lambda self, text: calls.append(text) or fast.encode_ordinary(text)})()
    text = " ".join(f"{i:x}q{i * i:x}" for i in range(5000))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids
    assert len(calls) == 1


@pytest.mark.parametrize("elites", [[], [[0, 0, 1, 1, 2, 2, 3, 3]]])
def test_packing_goes_through_every_generation(monkeypatch, elites):
    """shards whose first packing needs no more bins than their room asks for get the whole population and all generations too."""
    calls = collections.Counter()
    for name in ("_best_fit", "_crossover"):
        def counted(*args, name=name, real=getattr(packing, name)):
            calls[name] += 1
            return real(*args)
        monkeypatch.setattr(packing, name, counted)
    bins = packing.evolve([512] * 8, elites, 1024, [1, 2, 3], population=4, generations=5)
    assert collections.Counter(bins.tolist()) == {0: 2, 1: 2, 2: 2, 3: 2}
    assert calls == {"_best_fit": 4 - len(elites), "_crossover": 5}


def test_packing_of_odd_shards():
    for sizes in ([7], [1024], [1, 1], [1023, 1, 600, 500]):
        bins = packing.evolve(sizes, [], 1024, [1, 2, 3])
        load = collections.Counter()
        for k, size in zip(bins.tolist(), sizes):
            load[k] += size
        assert len(bins) == len(sizes) and max(load.values()) <= 1024
    assert packing.evolve([5, 6], [], 1024, [1], population=1).tolist() == [0, 0]


def test_fingerprints(docs, corpus):
    rows = {r.doc_id: r for r in syncmers.fingerprint_documents(docs).collect()}
    order = sorted(corpus)
    assert sorted(rows) == order
    for d, nxt in zip(order, order[1:] + order[:1]):
        t, n = corpus[d] or "", corpus[nxt] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + n[:half]
        r = rows[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == syncmers.to_text(syncmers.anchors(t)) and r.edited_fingerprint == syncmers.to_text(syncmers.anchors(new))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(t) > 200 and d < 25:
            assert r.near_edited > r.near_next
    assert rows[40].fingerprint == rows[41].fingerprint and rows[40].near_next == 1


def test_nearest(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    v[100:600] = v[100]                                   # one very common vector
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [1.0, None] * 4, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e"))
    table = spark.read.parquet(str(tmp_path / "e"))
    got = collections.defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    x = v.astype(float)
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - sc) < 1e-12 for i, sc in found)
        hit += len({i for i, _ in found} & set(order))
        if 100 <= q < 600:
            assert [i for i, _ in found] == order
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0


@pytest.mark.parametrize("clusters,leaves,spread", [(20, 600, 0.05), (300, 900, 0.02), (3, 500, 0.3)])
def test_searched_lists_on_clusters(clusters, leaves, spread):
    """Clusters of more centroids than the graph has edges, and more clusters than entries: the walk finds the lists."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(clusters, 16))
    x = np.vstack([m + spread * rng.normal(size=(12_000 // clusters, 16)) for m in middle])
    longest = float(np.sqrt((x * x).sum(1).max()))
    lift = np.hstack([x, np.sqrt(np.maximum(0, longest ** 2 - (x * x).sum(1)))[:, None]])
    index = ann.Index(ann.halved(lift, leaves, rng), longest)
    index.calibrate(x, 20, ann.AIM, rng)
    pick = rng.choice(len(x), 200, replace=False)
    scores = x[pick] @ x.T
    scores[np.arange(200), pick] = -np.inf
    true = np.argpartition(-scores, 19, axis=1)[:, :20]
    lists, hit, work = index.listed(x[true.ravel()]), 0, 0
    for i, searched in enumerate(index.searched(x[pick])):
        work += len(searched)
        hit += sum(bool(set(searched) & set(at)) for at in lists[i * 20:i * 20 + 20])
    assert hit / (20 * 200) >= 0.93 and work < 200 * leaves / 2
    seen = {0}
    todo = [0]
    while todo:                                           # the graph is connected, and both ways
        for j in index.edges[todo.pop()].tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == leaves
    assert all(i in index.edges[j] for i in range(leaves) for j in index.edges[i].tolist())


def test_every_row_but_the_querys_own(spark, tmp_path):
    """Repeated rows, several vectors under one vec_id, ties, clashing columns."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [1.0, 0.0]), (7, [0.0, 2.0]), (3, [0.9, 0.1]), (40, [-1.0, 0.0])]
    spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, gid int, low int, score double").write.parquet(str(tmp_path / "q"))
    got = collections.Counter(map(tuple, ann.nearest(spark.read.parquet(str(tmp_path / "q")), k=4).collect()))
    want = collections.Counter()
    x = [np.array(v, np.float32).astype(float) for _, v in rows]
    for i, (q, _) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float((x[i] * x[j]).sum()), rows[j][0]) for j in range(len(rows)) if j != i)[:4]
            want.update((q, r + 1, v, -s) for r, (s, v) in enumerate(near))
    assert got == want


def test_quality_and_toxicity_learn(spark, tmp_path):
    rng = random.Random(1)
    base = [f"v{i}" for i in range(400)]
    rows, truth = [], []
    for i in range(600):
        w = rng.choices(base, k=80)
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(["scumbag", "lowlife"]) + rng.choice(["", "ish", "er"])
        rows.append((i, (" ".join(w).upper() + "!!" if bad else " ".join(w)) if i else None))
        truth.append((i, int(not bad), int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, labels = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    for scored, k in ((quality_rules.score_quality(docs, labels), 1), (toxicity.score_toxicity(docs, labels), 2)):
        out = scored.collect()
        assert len(out) == 600 and all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
        held = [r for r in out if r.held_out and r.doc_id]
        assert np.mean([r.predicted == truth[r.doc_id][k] for r in held]) > 0.95


def test_rules_compile_to_their_paths():
    text = "If (feature 0 <= 1.5)\n If (feature 1 > 2.0)\n  Predict: 1.0\n Else (feature 1 <= 2.0)\n  Predict: 0.0\nElse (feature 0 > 1.5)\n Predict: 0.0\n"
    got = quality_rules.tree_rules(text)
    a, b = quality_rules.STATISTICS[:2]
    assert sorted(got) == sorted([((a, False, 1.5),), ((a, True, 1.5),), tuple(sorted([(a, False, 1.5), (b, True, 2.0)])), tuple(sorted([(a, False, 1.5), (b, False, 2.0)]))])


def test_url_rules(spark):
    urls = {1: "https://A.example.NET/en/x?y", 2: "http://b.net/q", 3: "http://net", 4: "x.net/", 5: None, 6: "ftp://u.example.com/de/#z",
            7: "http://evil.org/win/1.html", 8: "http://org/fr/", 9: "http://notexample.net/en/", 10: "http://h.io?x=/"}
    pages = [(i, u, "h") for i, u in urls.items()] + [(100 + i, f"http://s{i}.org/{'ok' if i % 4 else 'win'}/{i}", "h") for i in range(80)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), labels).collect()}
    assert len(got) == 90
    want = {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.net", "/q", "net/", "block"), 3: ("net", "", None, "allow"),
            4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("u.example.com", "/de/", "example.com/de/", "block"),
            7: ("evil.org", "/win/1.html", None, "block"), 8: ("org", "/fr/", "org/fr/", "allow"), 9: ("notexample.net", "/en/", "net/", "block"),
            10: ("h.io", "", None, "allow")}
    assert {i: (got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in want} == want
    assert all(got[100 + i].verdict == ("allow" if i % 4 else "block") for i in range(80))


def test_mined_url_rules_equal_brute_force(spark):
    """All sets of tokens counted one by one; a url of twenty words that many pages repeat; chance rules fall."""
    import itertools
    import math
    rng = random.Random(3)
    sets = [sorted({f"path:{rng.choice('abcdef')}" for _ in range(4)}) for _ in range(300)]
    rows = [(s, ("path:a" in s and "path:b" in s) or ("path:f" in s and rng.random() < 0.8)) for s in sets]
    long = [f"path:word{i:02d}" for i in range(20)]
    rows += [(sorted(["path:c", *long]), True)] * 100
    mined, items = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    of = {r.token: r.item for r in items.collect()}
    assert {of[w] for w in long} == {"path:word00"} and all(of[f"path:{x}"] == f"path:{x}" for x in "abcdef")
    names, share = sorted(set(of.values())), sum(b for _, b in rows) / len(rows)
    want = {}
    baskets = [({of[t] for t in s}, b) for s, b in rows]
    for k in range(1, len(names) + 1):
        for pick in itertools.combinations(names, k):
            hit = [b for s, b in baskets if s.issuperset(pick)]
            n, p = len(hit), sum(hit) / max(1, len(hit))
            if sum(hit) < url_rules.MIN_COUNT or p < url_rules.MIN_CONFIDENCE:
                continue
            z = url_rules.SURE
            if (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > share:
                want[pick] = p
    want = {r: p for r, p in want.items() if not any(want.get(x, -1) >= p for x in itertools.combinations(r, len(r) - 1))}
    got = {tuple(r.needs): r.confidence for r in mined.collect()}
    assert set(got) == set(want) and all(abs(got[r] - p) < 1e-9 for r, p in want.items())
    assert ("path:a", "path:b") in got and ("path:word00",) in got
    seen = url_rules.match_rules(spark.createDataFrame([(["path:a", "path:b", "x"],), (["path:word07"],), (["path:c"],)], "tokens array<string>"), mined, items)
    assert {tuple(r.tokens) for r in seen.collect()} == {("path:a", "path:b", "x"), ("path:word07",)}


def test_licences(spark, docs, tmp_path):
    notices = {i: t for i, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)}
    family = dict(enumerate(f for f, ts in license_scan.TEMPLATES.items() for _ in ts))
    rows = [(i, f"some words here\n{t}\nmore words") for i, t in notices.items()] + [(100, "I lost my driving licence today"), (101, None), (102, "")]
    extra = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    extra.write.parquet(str(tmp_path / "l"))
    got = license_scan.scan_licences(spark.read.parquet(str(tmp_path / "l"))).collect()
    hits = {r.doc_id: r.family for r in got if r.confirmed}
    assert all(r.family == "unknown" for r in got if not r.confirmed) and 100 not in hits and not any(d >= 1000 for d in hits)
    assert sum(hits.get(i) == f for i, f in family.items()) >= 0.8 * len(family)


def test_cues_leave_out_nothing_that_could_be_confirmed():
    """Of no notice can CONFIRM of the 3-grams be held without a cue."""
    import re
    cue = re.compile(license_scan._HAS_CUE)
    for t in (t for ts in license_scan.TEMPLATES.values() for t in ts):
        w = re.findall(r"\d+(?:\.\d+)+|[^\W_]+", t.lower())
        three = {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
        assert three and sum(not cue.search(g) for g in three) < license_scan.CONFIRM * len(three), t


def test_wrapped_licences(spark, docs, tmp_path):
    """Notices on one line, wrapped, wrapped in comments, and inside a long paragraph; odd blanks."""
    import textwrap
    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    rows, lines = [], "\n".join(f"u{i} v{i} w{i} x{i}" for i in range(40))
    for i, (_, t) in enumerate(notices):
        wrapped = textwrap.fill(t, 40)
        rows += [(i, t), (100 + i, wrapped), (200 + i, textwrap.indent(wrapped, " * ")), (300 + i, f"{lines}\n{wrapped}\n{lines}")]
    rows += [(400, "All\nrights\nreserved."), (401, "All rights\treserved."), (402, "All rights\u00a0reserved."),
             (403, "Released under the MIT License.\nLicensed under the GNU Lesser General Public License, version 2.1.")]
    rows.append((404, "This program is free software: you can redistribute it and/or modify\n"
                      "it under the terms of the GNU General Public License as published by\n"
                      "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."))
    plain = docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    spark.createDataFrame(rows, "doc_id long, text string").unionByName(plain).write.parquet(str(tmp_path / "w"))
    got = {(r.doc_id, r.family) for r in license_scan.scan_licences(spark.read.parquet(str(tmp_path / "w"))).collect() if r.confirmed}
    share = [sum((at + i, f) in got for i, (f, _) in enumerate(notices)) / len(notices) for at in (0, 100, 200, 300)]
    print("share found", share, [(at, t) for at in (0, 100, 200, 300) for i, (f, t) in enumerate(notices) if (at + i, f) not in got])
    assert not any(d >= 1000 for d, _ in got)
    assert share[0] == share[1] == share[2] == 1
    assert {(400, "Proprietary"), (401, "Proprietary"), (402, "Proprietary"), (403, "MIT"), (403, "LGPL"), (404, "GPL-3.0")} <= got


def test_licence_grams_of_long_lines(spark):
    """The words of a line are taken once, not for every gram of it; cues as the expression finds them."""
    import re
    known = license_scan.notice_grams(spark)
    rng = random.Random(5)
    pool = [*{w for g in known for w in g.split()}, "dog", "2.0", "\u0130x"]
    lines = {i: " ".join(rng.choices(pool, k=k)) for i, k in enumerate((1, 2, 3, 40, 4000))}
    lines |= {10: "CC--by", 11: "ccby", 12: "public\n_domain", 13: "Rights are reserved", 14: "LICEN\u017fE", 15: "free soft ware", 16: None, 17: "LICENCE"}
    rows = spark.createDataFrame(list(lines.items()), "id long, text string")
    held = license_scan._held_grams(rows, known)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    for r in held.where("id < 10").collect():
        words = re.findall(r"\d+(?:\.\d+)+|[^\W_]+", lines[r.id].lower())
        assert r.grams == sorted({g for g in [*words, *map(" ".join, zip(words, words[1:]))] if g in set(known)}), r.id
    for r in rows.select("id", "text", license_scan.has_cue(F.col("text")).alias("cue"), F.col("text").rlike(license_scan._HAS_CUE).alias("want")).collect():
        assert r.cue == r.want, r


def test_empty_tables(spark, empty, labels):
    assert ngram_join.near_duplicate_components(empty).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert syncmers.fingerprint_documents(empty).count() == 0
    assert quality_rules.score_quality(empty, labels).count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert license_scan.scan_licences(empty).count() == 0
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), labels).count() == 0


def test_repeated_rows_and_null_ids(spark, corpus, tmp_path):
    rows = spark.createDataFrame([(1, corpus[3]), (1, corpus[3]), (None, corpus[3]), (2, corpus[9]), (None, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    rows.write.parquet(str(tmp_path / "r"))
    docs = spark.read.parquet(str(tmp_path / "r"))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.near_duplicate_components(docs).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]
    assert {r.doc_id for r in suffix_dedup.repeated_spans(docs).collect()} == {1, 2}
    assert mixing.mix_sources(docs).count() == syncmers.fingerprint_documents(docs).count() == 5
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {1, 2, None}


def test_shared_bound_is_never_too_low():
    """The suffix filter's bound holds for sets of any sizes, and says nothing where a count is cut."""
    rng = np.random.default_rng(5)
    for n1, n2 in [(1, 1), (3, 4), (40, 31), (600, 800), (5000, 9000)]:
        both = rng.integers(0, 1 << 64, min(n1, n2) * 2 // 3, dtype=np.uint64)
        x, y = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, n - len(both), dtype=np.uint64)))) for n in (n1, n2))
        bound = ngram_join._most_shared(*(ngram_join._bucket_counts(ngram_join._signature(s)) for s in (x, y)))
        assert len(np.intersect1d(x, y)) <= bound <= min(n1, n2)
    one_bucket = ngram_join._bucket_counts(ngram_join._signature(np.arange(20, dtype=np.uint64)))
    assert ngram_join._most_shared(one_bucket, one_bucket) is None


@pytest.mark.parametrize("at_once", [1 << 20, 64])
def test_components_of_any_shape(spark, monkeypatch, at_once):
    """Chains, stars, cycles and random graphs over several partitions, against a search on the driver."""
    from kiln.llm import shared
    monkeypatch.setattr(shared, "EDGES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, i) for i in range(2000, 2100)] + [(3000 + i, 3000 + (i + 1) % 30) for i in range(30)]
    edges += [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(260)] + [(7, 7), (-3, 9), (9, -3)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = shared.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    alone = {7} | {v for v in root if all(a == b for a, b in edges if v in (a, b))}
    assert {r.node: r.root for r in got} == {v: r for v, r in root.items() if v not in alone} and len(got) == len(root) - len(alone)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _rows_of_joins(spark, df) -> list[int]:
    """Rows that each join of ``df`` makes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        made, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().length())]
        return made
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_repeats_inside_a_document_do_not_multiply_joined_rows(spark):
    """One head at 400 positions of each of two documents, in two chains, and a head of its own."""
    rows = [(o, 7, p % 2, p, 50 * (p % 2)) for o in (1, 2) for p in range(400)] + [(1, 8, 3, 900, 60), (2, 8, 3, 901, 60)]
    hits = spark.createDataFrame(rows, "owner long, key long, sub long, pos long, len long")
    got = {r.owner: sorted((m.pos, m.heads, m.chains) for m in r.marks) for r in suffix_dedup._marked(hits).collect()}
    assert got == {o: [(p, 800, 400 * (p % 2)) for p in range(400)] + [(899 + o, 2, 2)] for o in (1, 2)}
    assert max(_rows_of_joins(spark, suffix_dedup._marked(hits))) <= 6


def test_neighbours_have_a_row_a_document_and_chain():
    """Positions of a chain that a document repeats make one row, in one batch or over several; a chain without another document has no length."""
    import pyarrow as pa
    rows = [(1, 5, 10, 100, p, 20) for p in range(30)] + [(1, 5, 11, 90, p, 20) for p in range(40)] + [(1, 6, 12, 80, 3, 20)] + [(2, 7, 10, 100, 9, 20)]
    table = pa.table(dict(zip(("key", "sub", "owner", "doc_id", "pos", "len"), map(list, zip(*rows)))))
    for size in (len(rows), 7):
        out = [r for b in suffix_dedup._neighbours(iter(table.to_batches(size))) for r in b.to_pylist()]
        places = collections.defaultdict(list)
        for r in out:
            places[r["key"], r["sub"], r["owner"], r["doc_id"]] += [(p["pos"], p["len"]) for p in r["places"]]
        assert places == {(1, 5, 10, 100): [(p, 20) for p in range(30)], (1, 5, 11, 90): [(p, 20) for p in range(40)], (1, 6, 12, 80): [(3, 0)]}
        assert len(out) == 3 if size == len(rows) else len(out) < 25


def test_toxicity_learns_from_every_labelled_document(spark):
    """Also from those above 5,000 words; held-out and unlabelled ones stay out, repeated rows count each."""
    texts = {i: " ".join(f"w{i % 7}x{k}" for k in range(5001 + i if i % 5 == 0 else 20)) for i in range(120)} | {5: None}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    blocks_ = toxicity.labelled_blocks(docs, labels).collect()
    learnt = [i for i in [*range(100), 7] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sum(r.docs for r in blocks_) == len(learnt)
    assert sum(r.positives for r in blocks_) == sum(i % 3 == 0 for i in learnt)
    sizes = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in blocks_])
    assert sorted(sizes) == sorted(len((texts[i] or "").split()) for i in learnt)


def test_toxicity_texts_meet_labels_and_shard_by_id(spark, monkeypatch):
    """All texts of an id are in one shard, so that one shuffle joins and deals them; rows without a label or a text for it add nothing."""
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(ids[0], f"text {i} " * 4) for i in range(40)] + [(i, f"text of {i}") for i in ids[1:20]] + [(None, "none"), (ids[20], None)], "doc_id long, text string")
    one = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[30], 1), (None, 1), (ids[1], None)], "doc_id long, toxic int")
    got = toxicity.labelled_blocks(docs, one).collect()
    assert len({r.shard for r in got}) == 1 and sum(r.docs for r in got) == sum(r.positives for r in got) == 40
    every = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.labelled_blocks(docs, every).collect()
    assert len({r.shard for r in got}) > 4 and sum(r.docs for r in got) == 60
    assert sum(r.positives for r in got) == 40 * (ids[0] % 2) + sum(i % 2 for i in ids[1:21])


def test_toxicity_bar_is_the_best_f1(spark):
    rng = random.Random(5)
    rows = [(float(z), int(rng.random() < z / 20)) for z in (rng.randrange(20) for _ in range(300))]
    f1 = {z: 2 * sum(t for x, t in rows if x >= z) / (sum(x >= z for x, _ in rows) + sum(t for _, t in rows)) for z, _ in rows}
    best = max(f1, key=lambda z: (f1[z], z))
    below = max(z for z in f1 if z < best)
    assert toxicity._bar(spark.createDataFrame(rows, "z double, toxic long")) == (best + below) / 2


def test_licences_learn_from_every_line_without_a_cue(spark):
    """5,000 different lines, one of them in 200 documents more, and lines with a cue, which stay out."""
    texts = ["\n".join(f"line {i} {k} of the text" for k in range(100)) for i in range(50)] + ["line 0 0 of the text\nAll rights reserved."] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan._training_rows(docs, license_scan.notice_grams(spark)).where("label = 0")
    lines = spark.createDataFrame([(x,) for t in texts for x in t.split("\n") if "rights" not in x], "text string")
    n = {r["o"]: r["n"] for r in lines.groupBy((F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("o")).agg(F.count("*").alias("n")).collect()}
    weight = {r["left_out"]: r["w"] for r in rows.groupBy("left_out").agg(F.sum("weight").alias("w")).collect()}
    bare = 6                                                 # lines of the module itself
    assert abs(weight[False] - bare - license_scan.UNKNOWN_WEIGHT) < 1e-6
    assert abs(weight[True] - license_scan.UNKNOWN_WEIGHT * n[True] / n[False]) < 1e-6
