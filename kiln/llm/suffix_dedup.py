"""Repeated passages by sparse suffix arrays (operator 4).

A passage of at least ``min_words`` words (lower-cased A-Z, white space ignored) that occurs in
two documents is found whole, wherever it lies:

1. Suffixes are kept only at content-selected positions: the minimisers of every window of
   ``min_words - head + 1`` head hashes.  Two equal passages select the same positions.
2. The kept suffixes are dealt out by the hash of their first ``head`` words, sorted by (head,
   chain to a later kept position, document), and neighbours compared in
   one pass over the sorted stream.  A group of any size passes in bounded memory.
3. Matches are extended: to the right over the chain of kept positions that agree, and left and
   right of its ends word by word, by comparing the ``min_words`` windows there in the same sorted
   way, equal if two 64-bit hashes are.  A window is left out of this only if every occurrence of its kept position lies in
   the same chain, which then covers it everywhere, so no repeat is lost.

Spans are in words, half open, and merged per document.  A document is a (doc_id, text): different texts under
one doc_id are different documents, rows that repeat both are one.  Documents are in order of doc_id, null last, and
of a hash of their content; ``removable`` is what an earlier document holds.  Repeats inside one
document only are not reported.  Null or empty texts, and texts below ``min_words`` words, have no
spans.  Rows without doc_id (or with the largest 64-bit one) are compared like all others and have no row of spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kiln.llm.shared import Scratch, lean, renamed, repeated, split_by_ids, stored, text_batches
from kiln.llm.words import blocks, buffers, mix, prefix_hash, span_hash

MIN_WORDS, HEAD = 50, 16
_U = np.uint64
_I = np.int64
_PLACE = 28            # bits of a position inside a block of words
_NO_ID = np.iinfo(_I).max
_SECOND = _U(0xA0761D6478BD642F)


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def _minimisers(words, head: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hashes, starts of all ``min_words`` windows inside a document, the kept position of
    each window)."""
    n = len(words.h)
    pre = prefix_hash(words.h)
    reach = min_words - head + 1
    if n < min_words:
        none = np.empty(0, _I)
        return pre, none, none
    at = np.arange(n - head + 1)
    low = (span_hash(pre, at, at + head) >> _U(_PLACE) << _U(_PLACE)) | at.astype(_U)
    step, m = 1, low
    while step * 2 <= reach:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    m = np.minimum(m[:len(m) - (reach - step)], m[reach - step:]) if reach > step else m
    end = np.repeat(words.ptr[1:], np.diff(words.ptr))
    starts = np.arange(n - min_words + 1)
    starts = starts[starts + min_words <= end[starts]]
    return pre, starts, (m[starts] & _U((1 << _PLACE) - 1)).astype(_I)


def _chains(words, kept: np.ndarray, head: int, min_words: int) -> np.ndarray:
    """For each kept position the end of its chain: the head of the first kept position by which all
    windows up to the next kept position have ended; 0 if the document ends before."""
    if not len(kept):
        return kept
    last = len(kept) - 1
    nxt = np.minimum(np.arange(1, len(kept) + 1), last)
    far = np.searchsorted(kept, kept[nxt] + (min_words - head))
    to = kept[np.minimum(far, last)]
    doc = np.searchsorted(words.ptr, kept, "right")
    ok = (far <= last) & (nxt > np.arange(len(kept))) & (doc == np.searchsorted(words.ptr, to, "right"))
    return np.where(ok, to + head, 0)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each owner in a task."""
    seen: set[int] = set()
    for b in batches:
        new = [not (o in seen or seen.add(o)) for o in b.column("owner").to_pylist()]
        yield b if all(new) else b.filter(pa.array(new, pa.bool_()))


def _suffixes(head: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):
            owner, order = batch.column("owner").to_numpy(), batch.column("doc_id").to_numpy()
            data, off = buffers(batch.column("text"))
            for i, j, words in blocks(data, off):
                pre, _, place = _minimisers(words, head, min_words)
                if not len(place):
                    continue
                kept = np.unique(place)
                end = _chains(words, kept, head, min_words)
                key = span_hash(pre, kept, kept + head).view(_I)
                sub = np.where(end > 0, span_hash(pre, kept, np.maximum(end, kept)).view(_I), 0)
                doc = np.searchsorted(words.ptr, kept, "right") - 1
                yield _batch(key=key, sub=sub, owner=owner[i:j][doc], doc_id=order[i:j][doc], pos=kept - words.ptr[doc], len=np.where(end > 0, end - kept, 0))
    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """``repeated`` without rows that repeat the one before (tasks repeat an owner)."""
    last = None
    for r in repeated(batches, ("key", "sub"), "owner", "doc_id"):
        same = np.ones(len(r["key"]), bool)
        for f in ("key", "sub", "owner", "pos"):
            same[1:] &= r[f][1:] == r[f][:-1]
        same[0] = last == tuple(r[f][0] for f in ("key", "sub", "owner", "pos"))
        last = tuple(r[f][-1] for f in ("key", "sub", "owner", "pos"))
        yield {k: v[~same] for k, v in r.items()}


_PLACES = "places array<struct<pos:bigint,len:bigint>>"


def _chained(r: dict, length: np.ndarray) -> pa.RecordBatch:
    """Rows sorted by (key, sub, owner) with a document's positions of a chain as one row."""
    new = np.ones(len(r["key"]), bool)
    new[1:] = np.any([r[f][1:] != r[f][:-1] for f in ("key", "sub", "owner")], axis=0)
    at = np.flatnonzero(new)
    flat = pa.StructArray.from_arrays([pa.array(r["pos"]), pa.array(length)], names=["pos", "len"])
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(new)), pa.int32()), flat)
    return _batch(key=r["key"][at], sub=r["sub"][at], owner=r["owner"][at], doc_id=r["doc_id"][at], places=places, first=r["first"][at], first_owner=r["first_owner"][at])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that share their head with another document, a document's of a chain as one row; ``len`` > 0 if they share the chain as well."""
    for r in _shared_rows(batches):
        both = r["same_sub"] & (r["len"] > 0)
        yield _chained(r, np.where(both, r["len"], 0))


def _ends(head: int, min_words: int):
    """Windows that a shared kept position stands for, but for those inside a chain that every
    occurrence of that position's head shares (as many chains as heads)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            marks, owner, order = batch.column("marks"), batch.column("owner").to_numpy(), batch.column("doc_id").to_numpy()
            flat, mo = marks.flatten(), marks.offsets.to_numpy()
            mo = mo - mo[0]
            pos, heads, chains = (flat.field(f).to_numpy() for f in ("pos", "heads", "chains"))
            for i, j, words in blocks(data, off):
                pre, starts, place = _minimisers(words, head, min_words)
                if not len(starts):
                    continue
                base = np.repeat(words.ptr[:-1], np.diff(mo[i:j + 1]))
                p = pos[mo[i]:mo[j]] + base
                n_heads, n_chains = np.zeros((2, len(words.h) + 1), _I)
                n_heads[p], n_chains[p] = heads[mo[i]:mo[j]], chains[mo[i]:mo[j]]
                kept = np.unique(place)
                before = np.searchsorted(kept, starts, "right") - 1
                chain = np.where(before >= 0, n_chains[kept[np.maximum(before, 0)]], 0)
                take = starts[(n_heads[place] > 0) & (chain != n_heads[place])]
                if not len(take):
                    continue
                doc = np.searchsorted(words.ptr, take, "right") - 1
                key = span_hash(pre, take, take + min_words).view(_I)
                sub = span_hash(prefix_hash(mix(words.h ^ _SECOND)), take, take + min_words).view(_I)
                yield _batch(key=key, sub=sub, owner=owner[i:j][doc], doc_id=order[i:j][doc], pos=take - words.ptr[doc])
    return run


def _marked(hits: DataFrame) -> DataFrame:
    """(owner, marks): each shared position with the number of rows that have its head, and its chain.

    ``hits`` has a row a position, or a row for a document's ``places`` of a chain.  They are joined as one row, so that a passage it repeats does not multiply the joined rows."""
    if "places" not in hits.columns:
        hits = hits.groupBy("owner", "key", "sub").agg(F.collect_list(F.struct("pos", "len")).alias("places"))
    chains = hits.groupBy("key", "sub").agg(F.sum(F.size("places")).alias("chains"))
    heads = chains.groupBy("key").agg(F.sum("chains").alias("heads"))
    counted = hits.select("owner", "key", "sub", "places").join(chains, ["key", "sub"]).join(heads, "key").select("owner", F.transform("places", lambda p: F.struct(
        p["pos"].alias("pos"), F.col("heads"), F.when(p["len"] > 0, F.col("chains")).otherwise(0).alias("chains"))).alias("marks"))
    return counted.groupBy("owner").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def _windows(min_words: int):
    def run(batches):
        for r in _shared_rows(batches):
            r = {k: v[r["same_sub"]] for k, v in r.items()}
            yield _batch(owner=r["owner"], doc_id=r["doc_id"], pos=r["pos"], len=np.full(len(r["pos"]), min_words, _I),
                         first=r["first"], first_owner=r["first_owner"])
    return run


def _owned(docs: DataFrame) -> DataFrame:
    """(owner, doc_id, text): ``owner`` names a document by its content, ``doc_id`` gives its order."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("owner"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID))).alias("doc_id"), "text")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """(doc_id, spans, removable): per document with passages that another document holds too, their
    spans, and the part of them that an earlier document holds."""
    return _owner_spans(docs, min_words, head).where(F.col("doc_id") != int(_NO_ID)).drop("owner")


def _owner_spans(docs: DataFrame, min_words: int, head: int) -> DataFrame:
    """``repeated_spans`` with the owner, also of rows without doc_id."""
    text_batches(docs.sparkSession)
    docs = _owned(docs)
    kind = "first long, first_owner long"
    rows = docs.mapInArrow(lean(_suffixes(head, min_words)), "key long, sub long, owner long, doc_id long, pos long, len long")
    rows = rows.repartition("key").sortWithinPartitions("key", "sub", "owner", "pos")
    own = Scratch()
    hits = own.stored(rows.mapInArrow(_neighbours, f"key long, sub long, owner long, doc_id long, {_PLACES}, {kind}"), "suffix-hits")

    marked = _marked(hits)
    maybe, _ = split_by_ids(docs, hits.select("owner").distinct(), "owner")
    ends = maybe.mapInArrow(_once, maybe.schema).join(marked, "owner").mapInArrow(lean(_ends(head, min_words)), "key long, sub long, owner long, doc_id long, pos long")
    ends = ends.repartition("key").sortWithinPartitions("key", "sub", "owner", "pos")
    windows = ends.mapInArrow(lean(_windows(min_words)), f"owner long, doc_id long, pos long, len long, {kind}")
    windows = windows.select("owner", "doc_id", F.array(F.struct("pos", "len")).alias("places"), "first", "first_owner")
    spans = hits.where("exists(places, p -> p.len > 0)").drop("key", "sub").unionByName(windows)
    merged = stored(spans.groupBy("owner").applyInArrow(_union_spans, "owner long, doc_id long, spans array<struct<start:bigint,end:bigint>>, removable array<struct<start:bigint,end:bigint>>"), "spans")
    own.clear()
    return merged


def _union(a: np.ndarray, b: np.ndarray) -> list[dict]:
    if not len(a):
        return []
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return [{"start": int(x), "end": int(y)} for x, y in zip(a[new], b[np.append(new[1:], len(a)) - 1])]


def _union_spans(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    owner, doc = table.column("owner").to_numpy(), table.column("doc_id").to_numpy()
    places = table.column("places").chunk(0)
    row = np.repeat(np.arange(len(owner)), np.diff(places.offsets.to_numpy()))
    pos, ln = (places.flatten().field(f).to_numpy() for f in ("pos", "len"))
    row, pos, ln = (v[ln > 0] for v in (row, pos, ln))
    first, first_owner = (table.column(c).to_numpy()[row] for c in ("first", "first_owner"))
    later = (first < doc[0]) | (first == doc[0]) & (first_owner < owner[0])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"owner": pa.array(owner[:1]), "doc_id": pa.array(doc[:1]), "spans": pa.array([_union(pos, pos + ln)], kind),
                     "removable": pa.array([_union(pos[later], (pos + ln)[later])], kind)})


def _cut(batches):
    """Texts without their ``removable`` word spans (with the white space after each removed word)."""
    for batch in batches:
        text, spans = batch.column("text"), batch.column("removable").to_pylist()
        data, off = buffers(text)
        out = text.to_pylist()
        for i, j, words in blocks(data, off):
            for k in range(i, j):
                if not spans[k]:
                    continue
                a = words.ptr[k - i]
                raw, at, parts = data[off[k]:off[k + 1]].tobytes(), 0, []
                n = words.ptr[k - i + 1] - a
                for s in spans[k]:
                    lo, hi = s["start"], min(s["end"], n)
                    if lo >= hi:
                        continue
                    parts.append(raw[at:words.start[a + lo]])
                    at = int(words.start[a + hi]) if hi < n else len(raw)
                out[k] = (b"".join(parts) + raw[at:]).decode()
        cols = {f: (pa.array(out, pa.string()) if f == "text" else batch.column(f)) for f in batch.schema.names if f != "removable"}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """``docs`` with every repeated passage left only in the first document that holds it.

    ``n_chars``, where present, is counted anew; a document of which nothing but white space is left
    goes.  Documents without repeats keep their text byte for byte."""
    docs, own_names = renamed(docs)
    spans = _owner_spans(docs, min_words, head).where(F.size("removable") > 0).select("owner", "removable")
    names = docs.columns
    maybe, sure = split_by_ids(docs.withColumn("owner", F.xxhash64(F.col("doc_id").cast("long"), "text")), spans, "owner")
    both = maybe.join(spans, "owner", "left").select(*names, "removable")
    cut = both.where("removable is not null").mapInArrow(lean(_cut), docs.schema).where(r"text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    plain = both.where("removable is null").select(*names)
    return sure.select(*names).unionByName(plain).unionByName(cut.select(*names)).toDF(*own_names)
