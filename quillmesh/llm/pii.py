"""Personal data: patterns, and terms that reveal what the patterns protect.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. The words of the documents that hold one are
candidate terms. Corpus co-occurrence says how strongly a term reveals an entity: of the documents that hold the term, the
share that hold that very entity, p(entity | term). Terms with enough support (windows that differ, so that
copies of one passage count once) whose share reaches ``generalise`` are generalised, and from ``remove`` on removed, wherever they
stand in a document that holds the entity; documents without it keep the term. Counts of terms cover all documents.

Offsets are code points. Null and empty texts have no spans; repeated rows get equal results; an empty table gives no rows; more
columns of the input are left alone, whatever their names (``sanitise`` keeps them). Documents are told apart by doc_id and text.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, per_batch, unused

KINDS = ("email", "ip", "card", "phone")
TERM, REMOVED = "term", "term_removed"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Tried at the start of a run of digits only: what fails there fails all along the run, and a match takes runs whole.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&=/\\"
COMMON = 1_000_000  # bound on the terms whose counts are known to all tasks, to leave pairs out early that cannot reach the share
Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @: the local part reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    out: list[Span] = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def terms_of(text: str, spans: list[Span]) -> list[tuple[str, int, int, int]]:
    """(term, start, end, index of the word) of each word outside the spans that can be a term."""
    out, at = [], 0
    hidden = sorted((s, e) for _, s, e in spans)
    latest = 0  # the furthest end of the spans that start before the word ends
    for i, m in enumerate(WORD.finditer(text)):
        s, e = m.span()
        while at < len(hidden) and hidden[at][0] < e:
            latest = max(latest, hidden[at][1])
            at += 1
        if latest > s:
            continue
        if len(term := bare(m[0])) >= 3 and term[0].isalpha():
            shift = m[0].lower().find(term)
            if shift >= 0 and len(term) == len(m[0].strip(EDGES)):
                out.append((term, s + shift, s + shift + len(term), i))
    return out


def entity_of(text: str, span: Span) -> str:
    return f"{KINDS[span[0]]}:{text[span[1]:span[2]].lower()}"


def contexts(text: str, spans: list[Span], reach: int, holders: dict[str, int], common: dict[str, int], generalise: float) -> list[tuple[str, str, list[int]]]:
    """(term, entity, hashes of windows) of the text's words with each entity in holders that can reach the share.

    holders has the number of documents of an entity, which bounds those it shares with a term; common has the documents
    of frequent terms. A term near the entity has the entity's window, another the entity's window and its own.
    """
    wanted = [x for x in spans if entity_of(text, x) in holders]
    if not wanted:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    places: dict[str, list[int]] = {}
    for term, _, _, i in terms_of(text, spans):
        places.setdefault(term, []).append(i)
    hidden = sorted((s, e) for _, s, e in spans)
    begins = [s for s, _ in hidden]
    furthest = list(itertools.accumulate((e for _, e in hidden), max))

    def shown(i: int) -> bool:
        k = bisect_left(begins, ends[i])
        return k == 0 or furthest[k - 1] <= starts[i]

    found: dict[tuple[str, str], set[int]] = {}
    for span in wanted:
        entity = entity_of(text, span)
        before, after = bisect_right(ends, span[1]), bisect_left(starts, span[2])
        near = [i for i in (*range(max(0, before - reach), before), *range(after, min(len(words), after + reach))) if shown(i)]
        around = " ".join(text[starts[i] : ends[i]] for i in near)
        window = xxhash.xxh64_intdigest(around, 3) >> 1
        most, close = holders[entity], set(near)
        for term, where in places.items():
            if most < generalise * common.get(term, 0):
                continue
            own = found.setdefault((term, entity), set())
            if close.intersection(where):
                own.add(window)
            else:
                i = min(where, key=lambda i: abs(starts[i] - span[1]))
                own.add(xxhash.xxh64_intdigest(around + "\n" + " ".join(text[starts[k] : ends[k]] for k in range(max(0, i - reach), min(len(words), i + reach + 1))), 3) >> 1)
    return [(term, entity, sorted(windows)) for (term, entity), windows in found.items()]


_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "doc_id long, text_key long, base array<struct<kind:int,start:long,end:long>>, entities array<struct<entity:string,n:long>>, text string"
_ENTITIES = pa.list_(pa.struct([("entity", pa.string()), ("n", pa.int64())]))


def _scan(b: pa.RecordBatch) -> pa.RecordBatch:
    """Base spans, entities with how often they occur, and the text where there are any."""
    base, entities, texts = [], [], []
    for text in b.column("text").to_pylist():
        spans = base_spans(text) if text else []
        base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
        entities.append([{"entity": e, "n": n} for e, n in Counter(entity_of(text, s) for s in spans).items()])
        texts.append(text if spans else None)
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(base, _BASE), pa.array(entities, _ENTITIES), pa.array(texts, pa.string())], names=["doc_id", "text_key", "base", "entities", "text"])


def _together(reach: int, common: dict[str, int], generalise: float, most: int = 50_000):
    """Terms of each document with its entities, in batches of a bounded number of rows besides one document's."""
    names = ("doc_id", "text_key", "term", "entity", "windows")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for b in batches:
            for doc_id, key, text, base, holders in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "base", "holders")), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                out += [(doc_id, key, *c) for c in contexts(text, spans, reach, {h["entity"]: h["held"] for h in holders}, common, generalise)]
                if len(out) > most:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return run


def _placed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of all occurrences of a document's terms."""
    added = []
    for text, base, terms in zip(*(b.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
        kinds: dict[str, list[str]] = {}
        for t in terms:
            kinds.setdefault(t["term"], []).append(t["kind"])
        spans = [(s["kind"], s["start"], s["end"]) for s in base]
        found = {(kind, s, e) for term, s, e, _ in terms_of(text, spans) for kind in kinds.get(term, ())}
        added.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in sorted(found)])
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(added, _ADDED)], names=["_doc", "_key", "added"])


_ADDED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _term_counts(most: int = 200_000):
    """Documents of the task that hold each term: a row for each term and flush."""

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    counts.update({bare(w) for w in set(WORD.findall(text))})
                if len(counts) > most:
                    yield flush(counts)
                    counts.clear()
        if counts:
            yield flush(counts)

    return run


def find(docs: DataFrame, reach: int = 6, support: int = 3, generalise: float = 0.5, remove: float = 0.9) -> DataFrame:
    """doc_id, text_key, base and added (arrays of spans) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = checkpoint(rows.mapInArrow(per_batch(_scan), FOUND))
    held = checkpoint(found.where(F.size("base") > 0).dropDuplicates(["doc_id", "text_key"]))
    each = held.select("doc_id", "text_key", F.explode("entities").alias("e")).select("doc_id", "text_key", "e.entity", "e.n")
    # Each occurrence gives one window at most, so a rarer entity has no term with enough support.
    enough = each.groupBy("entity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")).where(F.col("n") >= support).select("entity", "held")
    holders = each.join(enough, "entity").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("entity", "held")).alias("holders"))
    own = lambda df, *more: df.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), *more)
    same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    counts = checkpoint(docs.select("text").mapInArrow(_term_counts(), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // COMMON + 1
    common = {r.term: r.n for r in counts.where(F.col("n") >= least).collect()}  # COMMON rows at most
    asked = held.join(own(holders, "holders"), same).select("doc_id", "text_key", "text", "base", "holders")
    met = checkpoint(asked.mapInArrow(_together(reach, common, generalise), "doc_id long, text_key long, term string, entity string, windows array<long>"))
    together = met.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("together"))
    windows = met.select("term", "entity", F.explode("windows").alias("w")).distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= support)
    share = F.col("together") / F.col("n")
    revealing = together.join(windows, ["term", "entity"]).join(counts, "term").withColumn("share", share).where(F.col("share") >= generalise)
    chosen = met.select("doc_id", "text_key", "term", "entity").join(revealing.select("term", "entity", F.when(F.col("share") >= remove, REMOVED).otherwise(TERM).alias("kind")), ["term", "entity"])
    terms = chosen.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("term", "kind")).alias("terms"))
    told = held.join(own(terms, "terms"), same).select("doc_id", "text_key", "text", "base", "terms")
    added = told.mapInArrow(per_batch(_placed), "_doc long, _key long, added array<struct<kind:string,start:long,end:long>>")
    joined = found.select("doc_id", "text_key", "base").join(added, same, "left")
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select("doc_id", "text_key", "base", F.coalesce("added", nothing).alias("added"))


def listed(base, added=None):
    """kind:start:end of spans, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    parts = F.transform(base, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")))
    if added is not None:
        parts = F.concat(parts, F.transform(added, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return F.array_join(parts, ",")


def is_kind(k: int):
    return lambda s: s["kind"] == k


def digests(docs: DataFrame, **how) -> DataFrame:
    """Counts by kind, a checksum of the base spans and all spans."""
    found = find(docs, **how)
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("base"), F.col("added")).alias("spans"))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; removed terms leave nothing; spans that overlap become one of the first's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], "" if kind == REMOVED else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with spans masked in text; the other columns stay."""
    found = find(docs, **how).where("size(base) > 0 or size(added) > 0").dropDuplicates(["doc_id", "text_key"])
    names = docs.columns
    own, doc, key, hidden = (unused(c, names) for c in ("_own", "_doc", "_key", "_spans"))
    named = F.transform("base", lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.concat(named, "added").alias(hidden))
    joined = docs.withColumn(own, F.xxhash64("text")).join(spans, (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [masked(t, [(s["kind"], s["start"], s["end"]) for s in spans] if spans else []) for t, spans in zip(b.column("text").to_pylist(), b.column(hidden).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    return joined.select(*names, hidden).mapInArrow(per_batch(run), docs.schema)
