"""Norm-bucket search, disclosure and resampling against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from kiln.llm import disclosure, impact_search, resampling
from kiln.llm.terms import term_lists

CLASHING = "doc_id long, text string, row int, item int, key string, n int, score double, rank string, terms string, kind int, _terms int"


def _terms(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 15, 60, 200])))) for i in range(300)]
    out += [(300, None), (301, ""), (302, " ;; "), (303, "É_É w1 W1\x00w2"), (304, "w1 " * 400_000), (None, out[5][1]), (None, None)]
    out += [out[7]] * 30 + [(400 + i, out[9][1]) for i in range(90)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "d")
    spark.createDataFrame([(d, t, 1, 2, "k", 3, 0.5, "r", "t", 4, 5) for d, t in rows], CLASHING).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


ITEMS = [(0, "w1 w2 w7 W9 w399"), (1, "w3"), (2, None), (3, "nothing here"), (4, "w5 w5 w6 w8 w12 w13 w44 w45"), (4, "w1"), (None, "w10 w11")]


def _found(rows, items, k):
    c = [collections.Counter(_terms(t)) for _, t in rows]
    size = [sum(x.values()) for x in c]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    df = collections.Counter(t for x in c for t in x)
    out = []
    for item, text in items:
        scores = []
        for (d, _), x, n in zip(rows, c, size):
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * x[t]) // (1000 * x[t] + 20 * m))
                    for t in set(_terms(text)) if x[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block_terms,first", [(50, 1 << 16, 4096), (7, 6, 20)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, k, block_terms, first):
    monkeypatch.setattr(impact_search, "FIRST_ROUND", first)             # several rounds, several blocks of items
    monkeypatch.setattr(impact_search, "ROUND_GROWTH", 2)
    items = spark.createDataFrame([(i, t, 7, 8) for i, t in ITEMS], "item_id long, text string, item int, terms int")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in impact_search.search(docs, items, k, block_terms).collect()]
    assert sorted(got, key=str) == _found(rows, ITEMS, k)


def test_search_bounds_lose_nothing():
    """Survivors of the bounds hold every vector that reaches the threshold, and the bounds do prune."""
    rng = np.random.default_rng(3)
    left = 0
    for _ in range(60):
        n, v = 200, 50
        x = (rng.random((n, v)) < 0.2) * rng.integers(1, 1000, (n, v))
        x[:, 0] += 1
        ptr = np.concatenate(([0], np.cumsum((x > 0).sum(1))))
        where = np.nonzero(x)
        block = impact_search.Block(np.arange(n), np.zeros(n, bool), np.arange(n), np.sqrt((x * x).sum(1).astype(float)), ptr, where[1], x[where])
        terms = rng.choice(v, 12, replace=False)
        w = rng.integers(1, 9000, 12)
        true = x[:, terms] @ w
        level = int(np.sort(true)[-10])
        kept = block.survivors(impact_search.item_vector(0, terms, w, 0), level)
        assert set(np.flatnonzero(true >= max(1, level))) <= set(kept)
        dense = np.zeros(v, np.int64)
        dense[terms] = w
        assert (block.scores(kept, dense) == true[kept]).all()
        left += n - len(kept)
    assert left > 0


def test_search_of_empty_tables(spark, docs):
    none, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert impact_search.search(docs, none).count() == 0
    assert impact_search.search(docs.limit(0), item).count() == 0
    assert impact_search.search(docs, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts(monkeypatch):
    from kiln.llm import terms
    monkeypatch.setattr(terms, "PIECE_BYTES", 64)
    text = " ".join(f"Wörd{i}é-{'x' * (i % 90)}" for i in range(500))
    assert [t.decode() for p in term_lists(text.encode()) for t in p] == _terms(text)


def _resampled(rows, target, ngram=1, buckets=10_000, percent=10, least=20, seed=2024):
    feats = lambda t: [" ".join(w[i:i + k]) for w in [_terms(t)] for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    own = [[bucket(f) for f in feats(x)] for _, x in rows]
    for o in own:
        s.update(o)
    for x in target:
        t.update(map(bucket, feats(x)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    gains = {b: gain(b) for b in s}
    out, order = [], []
    for (d, text), o in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in o) // len(o) if o else 0
        out.append([d, len(o), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if len(_terms(text)) >= least:
            order.append((-out[-1][3], d is None, d or 0, len(out) - 1))
    for rank, (*_, i) in enumerate(sorted(order)[:percent * len(order) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("options", [{}, {"segment_rows": 5}, {"ngram": 2, "buckets": 70_000, "percent": 60, "segment_rows": 3}, {"percent": 100, "least_words": 0}])
def test_resampling_equals_brute_force(spark, docs, rows, options):
    target = [t for _, t in ITEMS] + ["w5 w5 w6 w7"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.ranked(docs, frame, **options).collect()), key=str)
    brute = {"least" if k == "least_words" else k: v for k, v in options.items() if k != "segment_rows"}
    assert got == _resampled(rows, target, **brute)


def test_drawn_rows(spark, docs, rows):
    frame = spark.createDataFrame([("w5 w6",)], "text string")
    drawn = {d for d, _, _, _, rank in _resampled(rows, ["w5 w6"], percent=30) if rank}
    out = resampling.draw_documents(docs, frame, percent=30)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == drawn
    assert resampling.ranked(docs.limit(0), frame).count() == 0
    assert resampling.ranked(docs, frame.limit(0)).where("rank is not null").count() > 0


def test_uneven_samples_are_split_again(spark):
    """Runs whose samples miss most rows: the counts show it, and closer samples split what is too large."""
    n = 4000
    runs = spark.createDataFrame([(i, i, i, 1, 1, i // 1000, True) for i in range(n)], resampling._ROW).repartition(40).sortWithinPartitions("score")
    splitters, counts = resampling.splitters_of(runs.orderBy("score", ascending=False), n, 60)
    assert counts.sum() == n and counts.max() <= resampling.MOST_TIMES * 60 and len(counts) == len(splitters) + 1


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base(text):
    """The four kinds by plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choices("ab@@..-+ 00112259()é_%\n", k=rng.randint(0, 60)))
        assert [(a, k, b) for a, k, b, _ in disclosure.base_spans(text)] == _base(text), text
    for text in ["4111 1111 1111 1111", "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "007.1.2.3", "x@y..z", "+" + "1" * 16, "4111-1111 1111-1111 9"]:
        assert [(a, k, b) for a, k, b, _ in disclosure.base_spans(text)] == _base(text), text
    for odd in ("1" * 2_000_000, "a" * 2_000_000 + "@", "1." * 1_000_000, "+1" + "(" * 1_000_000, "@" * 500_000):
        disclosure.base_spans(odd)                       # in linear time


def _private_rows():
    rng = random.Random(9)
    filler = [f"f{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(filler, k=40))) for i in range(400)]
    for i in range(12):                                   # "Zorblax" stands by one address in ever new words, and nowhere else
        rows.append((500 + i, " ".join(rng.choices(filler, k=15)) + " Zorblax Ann@Example.com " + " ".join(rng.choices(filler, k=15)) + " zorblax"))
    for i in range(12):                                   # so does "Tomatina", but "tom..." is said of much else
        rows.append((600 + i, " ".join(rng.choices(filler, k=15)) + " +1 743 555 3824 Tomatina " + " ".join(rng.choices(filler, k=15))))
    rows += [(700 + i, " ".join(rng.choices(filler, k=20)) + f" tomas{i}") for i in range(300)]
    copy = "copied words near 10.0.0.1 are no evidence by themselves"
    rows += [(1100 + i, copy) for i in range(40)] + [(None, copy), (None, None), (1200, ""), (1201, "mail me: solo@else.org"), (1202, "ring +49 30 1234567")]
    return rows


def test_disclosing_terms(spark, tmp_path):
    rows = _private_rows()
    spark.createDataFrame([(d, t, 1, 2, "k", 3, 0.5, "r", "t", 4, 5) for d, t in rows], CLASHING).repartition(4).write.parquet(str(tmp_path / "p"))
    docs = spark.read.parquet(str(tmp_path / "p"))
    got = disclosure.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    text = {d: t for d, t in rows if d is not None}
    kinds = {500: "email", 600: "phone"}
    for r in got:
        t = text.get(r.doc_id, rows[-5][1] if r.n_ip else "")
        base = _base(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        joined = ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        added = [s.split(":") for s in r.spans.split(",") if s and s.split(":")[0] in disclosure.ADDED]
        words = [(k, t[int(a):int(b)]) for k, a, b in added]
        if r.doc_id is not None and r.doc_id // 100 * 100 in kinds:
            want = [("removed", "Zorblax"), ("removed", "zorblax")] if r.doc_id < 600 else [("general", "Tomatina")]
            assert words == want, (r.doc_id, words)
        else:
            assert r.spans == joined
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert set(clean) == {d for d, _ in rows}
    assert "orblax" not in clean[500] and "[EMAIL]" in clean[500] and "Tomat" not in clean[600].replace("Toma*", "") and "[PHONE]" in clean[600]
    assert clean[1201] == "mail me: [EMAIL]" and clean[1200] == "" and clean[3] == text[3]
    assert disclosure.sanitise(docs).columns == docs.columns
    assert disclosure.find_personal_data(docs.limit(0)).count() == 0


def test_context_words():
    far = "x" * 3000
    text = f"far {far} a b c d e f g h i j 1.2.3.4 k l +1 743 555 3824 m n o p q r s t u v w"
    near = disclosure.contexts(text)
    assert near["ip", "1.2.3.4"] == set("abcdefghij") | set("klmnopqrst")
    assert near["phone", "17435553824"] == set("cdefghij") | set("kl") | set("mnopqrstuv")
    assert disclosure.contexts(f"{far} 1.2.3.4")["ip", "1.2.3.4"] == {far}
    assert disclosure.cleaned("abcdef", [(0, "ip", 2, "[IP]"), (1, "phone", 4, "[PHONE]"), (4, "card", 5, "")]) == "[IP]f"
