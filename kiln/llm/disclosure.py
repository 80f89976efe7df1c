"""Personal data by patterns, and terms that reveal it by information-theoretic sanitisation (operator 12).

1. Patterns find emails, IP addresses, card and phone numbers in whole texts (the base spans).  Each value found is a
   protected entity: emails in lower case, cards and phones by their digits.
2. The corpus tells how strongly a term reveals an entity.  With N documents, n(c) that hold entity c, n(t) that hold
   term t and n(c, t) in which t stands within WINDOW terms of c, the term discloses
   ``PMI = log2(N n(c,t) / (n(c) n(t)))`` of the ``IC = log2(N / n(c))`` bits that c is worth.
3. A term exceeds the threshold if the PMI is at least ``alpha`` of IC(c) and more than the information that its kind
   alone has (some email, some phone), over at least ``support`` different contexts.  Contexts whose two least term
   hashes agree are one, so that copies of a document are no evidence.
4. A term above the threshold is generalised to its first half if that form stays below the threshold, else
   removed, wherever it stands in a document that holds the entity.

Pairs are counted only for entities of ``support`` documents, pre-aggregated before their shuffle; n(t) takes a second
pass that counts candidate terms only.  Nothing but four totals reaches the driver, and 2**20 flags at most the tasks.

Nulls, empty texts: no spans.  Repeated rows are documents of their own.  A null doc_id is kept.  Empty tables give no
rows.  Extra columns are ignored by ``find_personal_data`` and kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kiln.llm.ngram_join import keyed
from kiln.llm.shared import Scratch, renamed, split_by_ids, stored
from kiln.llm.terms import term_lists, texts

KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "removed")
WINDOW, SUPPORT, ALPHA = 10, 3, 0.8
_SLOTS = 1 << 20
_HELD, _BATCH_ROWS = 1 << 17, 1 << 13

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run, for it would have started earlier otherwise.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NOT_DIGIT = str.maketrans("", "", " -().+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part is all that its characters reach back from an @, so each is looked at once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        local = text[done:at]
        start = done + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d * (i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value), sorted."""
    out = [(a, 0, b, text[a:b].translate(_LOWER)) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].translate(_NOT_DIGIT)) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end(), d))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(d := m[0].translate(_NOT_DIGIT)) <= 15:
                out.append((m.start(), 3, m.end(), d))
    return sorted(out)


def general_form(term: str) -> str:
    """The first half of a term, standing for all terms that begin so."""
    return term[:(len(term) + 1) // 2] + "*"


def _general_form(term: Column) -> Column:
    return F.concat(F.substring(term, F.lit(1), F.floor((F.length(term) + 1) / 2).cast("int")), F.lit("*"))


class _Covered:
    """What the base spans of a text cover."""

    def __init__(self, spans: list[tuple[int, int, int, str]]) -> None:
        self.starts, self.ends = [], []
        for a, _, b, _ in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, span: tuple[int, int]) -> bool:
        i = bisect_left(self.starts, span[1]) - 1
        return i >= 0 and self.ends[i] > span[0]


def _terms_before(text: str, at: int, covered: _Covered) -> list[str]:
    reach = 256
    while True:
        lo = max(0, at - reach)
        found = [m for m in _TERM.finditer(text, lo, at) if m.span() not in covered]
        if lo and found and found[0].start() == lo:
            found = found[1:]                                # perhaps the end of a longer term
        if len(found) >= WINDOW or not lo:
            return [m[0].translate(_LOWER) for m in found[-WINDOW:]]
        reach *= 4


def _terms_after(text: str, at: int, covered: _Covered) -> list[str]:
    free = (m for m in _TERM.finditer(text, at) if m.span() not in covered)
    return [m[0].translate(_LOWER) for m in islice(free, WINDOW)]


def contexts(text: str) -> dict[tuple[str, str], set[str]]:
    """The terms near each entity of a text."""
    spans = base_spans(text)
    covered = _Covered(spans)
    out: dict[tuple[str, str], set[str]] = {}
    for a, kind, b, value in spans:
        near = out.setdefault((KINDS[kind], value), set())
        near.update(_terms_before(text, a, covered))
        near.update(_terms_after(text, b, covered))
    return out


def _context_name(terms: set[str]) -> int:
    least = sorted(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest()) for t in terms)[:2]
    return sum(h << (31 * i) for i, h in enumerate(least)) & ((1 << 63) - 1)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "kind", "value", "first", "context", "terms"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        for key, raw in zip(b.column("key").to_pylist(), texts(b.column("text"))):
            seen: set[str] = set()
            for (kind, value), near in contexts(raw.decode()).items():
                rows.append((key, kind, value, not (kind in seen or seen.add(kind)), _context_name(near), sorted(near)))
                if len(rows) >= _BATCH_ROWS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


def _slot(form: str) -> int:
    return crc32(form.encode()) % _SLOTS


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_slot(t) for t in b.column("term").to_pylist()], pa.int64())], names=["slot"])


def _document_counts(flags: np.ndarray):
    """(term, n): documents by term or general form, for those in a flagged slot; partial counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for raw in texts(b.column("text")):
                words: set[bytes] = set()
                for piece in term_lists(raw):
                    words.update(piece)
                forms = {w.decode() for w in words}
                forms |= {general_form(w) for w in forms}
                for f in forms:
                    if flags[_slot(f)]:
                        held[f] = held.get(f, 0) + 1
                if len(held) >= _HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()
    return run


def disclosing_terms(docs: DataFrame, own: Scratch, support: int = SUPPORT, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(mentions: key, kind, value, first, context, terms; disclosing: kind, value, term, removed, pmi, ic) of ``docs``
    (key, text)."""
    mentions = own.stored(docs.mapInArrow(_mentions, "key long, kind string, value string, first boolean, context long, terms array<string>"), "mentions")
    entity = ["kind", "value"]
    n_docs = docs.count()
    per_kind = mentions.groupBy("kind").agg(F.count_if("first").alias("n_kind"))
    often = mentions.groupBy(*entity).agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    both = F.concat("terms", F.array_distinct(F.transform("terms", _general_form)))     # a form counts once a document
    near = mentions.join(often, entity).select(*entity, "n_c", "context", F.explode(both).alias("term"))
    pairs = (near.groupBy(*entity, "term", "context").agg(F.count("*").alias("n"), F.first("n_c").alias("n_c"))
             .groupBy(*entity, "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts"), F.first("n_c").alias("n_c"))
             .where(F.col("contexts") >= support))
    pairs = own.stored(pairs, "pairs")
    flags = np.zeros(_SLOTS, bool)
    flags[[r["slot"] for r in pairs.select("term").distinct().mapInArrow(_slots_of, "slot long").distinct().collect()]] = True
    n_t = docs.select("text").mapInArrow(_document_counts(flags), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    judged = (pairs.join(n_t, "term").join(F.broadcast(per_kind), "kind")       # four kinds
              .withColumn("pmi", F.log2(F.col("n_ct") * F.lit(float(n_docs)) / (F.col("n_c") * F.col("n_t"))))
              .withColumn("ic", F.log2(F.lit(float(n_docs)) / F.col("n_c")))
              .withColumn("tells", (F.col("pmi") >= F.lit(alpha) * F.col("ic")) & (F.col("pmi") > F.log2(F.lit(float(n_docs)) / F.col("n_kind")))))
    judged = own.stored(judged.select(*entity, "term", "pmi", "ic", "tells"), "judged")
    general = judged.where(F.col("term").endswith("*")).select(*entity, F.col("term").alias("form"), F.col("tells").alias("removed"))
    terms = judged.where(F.col("tells") & ~F.col("term").endswith("*")).withColumn("form", _general_form(F.col("term")))
    return mentions, terms.join(general, [*entity, "form"], "left").select(*entity, "term", F.coalesce("removed", F.lit(True)).alias("removed"), "pmi", "ic")


def _spans_of(text: str, terms: list[str] | None, removed: list[bool] | None) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, replacement), by start, then kind."""
    base = base_spans(text)
    out = [(a, k, KINDS[k], b, f"[{KINDS[k].upper()}]") for a, k, b, _ in base]
    if terms:
        act, covered = dict(zip(terms, removed)), _Covered(base)
        for m in _TERM.finditer(text):
            t = m[0].translate(_LOWER)
            if t in act and m.span() not in covered:
                out.append((m.start(), 5, "removed", m.end(), "") if act[t] else (m.start(), 4, "general", m.end(), general_form(m[0])))
    return [(a, kind, b, new) for a, _, kind, b, new in sorted(out)]


def cleaned(text: str, spans: list[tuple[int, str, int, str]]) -> str:
    """``text`` with its spans replaced; of spans that overlap the first to start speaks for all."""
    out, at = [], 0
    for a, _, b, new in spans:
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, _ in spans)


_RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, sha, every = [], [], []
        for raw, terms, removed in zip(texts(b.column("text")), b.column("_terms").to_pylist(), b.column("_removed").to_pylist()):
            spans = _spans_of(raw.decode(), terms, removed)
            base = [s for s in spans if s[1] in KINDS]
            counts.append([sum(s[1] == k for s in base) for k in KINDS])
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            every.append(_joined(spans))
        c = np.array(counts, np.int64).reshape(-1, len(KINDS))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c[:, i]) for i in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                                         names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _clean_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = []
        for text, terms, removed in zip(b.column("text").to_pylist(), b.column("_terms").to_pylist(), b.column("_removed").to_pylist()):
            new.append(None if text is None else cleaned(text, _spans_of(text, terms, removed)))
        names = [c for c in b.schema.names if not c.startswith("_")]
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column(c) for c in names], names=names)


def _with_terms(docs: DataFrame, own: Scratch, support: int, alpha: float) -> DataFrame:
    """``docs`` (key, text, ...) with ``_terms`` and ``_removed``, what to treat in a document; null if nothing."""
    mentions, disclosing = disclosing_terms(docs.select("key", "text"), own, support, alpha)
    entity = ["kind", "value"]
    named = mentions.join(disclosing.select(*entity).distinct(), entity, "left_semi").select("key", *entity, F.explode("terms").alias("term")).distinct()
    treat = (named.join(disclosing.select(*entity, "term", "removed"), [*entity, "term"])
             .groupBy("key", "term").agg(F.max("removed").alias("removed"))
             .groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("t"))
             .select("key", F.col("t.term").alias("_terms"), F.col("t.removed").alias("_removed")))
    treat = own.stored(treat, "treat")
    maybe, sure = split_by_ids(docs, treat, "key")
    return maybe.join(treat, "key", "left").unionByName(
        sure.withColumn("_terms", F.lit(None).cast("array<string>")).withColumn("_removed", F.lit(None).cast("array<boolean>")))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs`` (doc_id, text)."""
    own = Scratch()
    rows = _with_terms(keyed(docs.select("doc_id", "text")), own, support, alpha)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stored(rows.select("doc_id", "text", "_terms", "_removed").mapInArrow(_report, f"doc_id {kind}, {_RESULT}"), "personal-data")
    own.clear()
    return out


def sanitise(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with personal data replaced by its kind and disclosing terms generalised or removed."""
    docs, own_names = renamed(docs)
    own = Scratch()
    rows = _with_terms(keyed(docs), own, support, alpha).select(*docs.columns, "_terms", "_removed")
    out = stored(rows.mapInArrow(_clean_texts, docs.schema), "sanitised")
    own.clear()
    return out.toDF(*own_names)
