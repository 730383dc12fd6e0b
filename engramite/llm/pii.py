"""Personal data by pattern, and information-theoretic sanitisation of the terms that reveal it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_dir, sliced, table, text_columns, text_key

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehinds and possessive repeats change no match; they keep the search linear on long runs.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile("[0-9]")
#: Disclosing terms up to which their set is broadcast (about 60 bytes each); beyond it documents meet them in a join.
BROADCAST_TERMS = 500_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            out.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    if DIGITS.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _terms(text: str) -> set[str]:
    """Lower-cased after they are split: a word whose lower case has another length stays one term."""
    return {t.lower() for t in set(TERM.findall(text))}


def _together(text: str, spans: list) -> dict[tuple[str, ...], set[str]]:
    """By the entities of a line, in order, the terms on the lines that hold just these; what entities are made of is no
    term. As long as the text at most: entities and terms aren't paired here."""
    parts, at = [], 0
    for s, e, _ in sorted(spans):
        if e > at:
            parts += [text[at:s], " " * (e - max(s, at))]
            at = e
    bare, on = "".join([*parts, text[at:]]), {}
    for s, e, kind in spans:
        entity = hashlib.blake2b(f"{kind}:{text[s:e]}".encode("utf-8", "replace"), digest_size=12).hexdigest()
        on.setdefault(text.rfind("\n", 0, s) + 1, set()).add(entity)
    met: dict[tuple[str, ...], set[str]] = {}
    for start, entities in on.items():
        end = text.find("\n", start)
        met.setdefault(tuple(sorted(entities)), set()).update(_terms(bare[start : end if end >= 0 else len(bare)]))
    return met


def _statistics(batches, most: int = 200_000):
    out = pa.schema([("term", pa.string()), ("entity", pa.string()), ("n", pa.int64())])
    send = lambda c: pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(c.values(), pa.int64())], schema=out)
    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            text = text or ""
            seen[None, None] += 1
            seen.update((t, None) for t in _terms(text))
            seen.update((None, e) for e in {e for entities in _together(text, base_spans(text)) for e in entities})
            if len(seen) > most:
                yield send(seen)
                seen = Counter()
    yield send(seen)


def _lines(batches):
    """(doc, line, entities, terms): :func:`_together` of each text; ``doc`` is the digest of all of it, so that copies,
    whatever stands on their other lines, are one document that is counted often."""
    out = pa.schema([("doc", pa.binary()), ("line", pa.int32()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])
    for b in batches:
        rows = []
        for text in b.column(0).to_pylist():
            lines = sorted((list(e), sorted(t)) for e, t in _together(text, base_spans(text)).items()) if text else []
            digest = hashlib.blake2b("\n".join(" ".join([*e, *t]) for e, t in lines).encode("utf-8", "replace"), digest_size=16).digest()
            rows += [(digest, i, e, t) for i, (e, t) in enumerate(lines)]
        yield batch(out, *(zip(*rows, strict=True) if rows else [[]] * 4))


def _classes(lines: DataFrame, column: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, class) and (doc, line, class): items of ``known(item, n)`` that are on the same lines everywhere and occur in
    as many documents are one class, told by 128 bits of their lines' hashes."""
    each = lines.select("doc", "line", F.explode(column).alias("item")).distinct().join(known, "item")
    at = lambda *c: F.bit_xor(F.xxhash64(*c))
    of = each.groupBy("item").agg(F.struct(F.first("n").alias("n"), F.count("*").alias("lines"), at("doc", "line").alias("a"), at("line", "doc").alias("b")).alias("class"))
    return of, each.join(of, "item").select("doc", "line", "class").distinct()


def disclosing_terms(docs: DataFrame, min_bits: float = 4.0, min_share: float = 0.5, min_docs: int = 2) -> DataFrame:
    """``(term, share)``: terms that reveal an entity.

    Counted over all documents: in how many each term occurs, each entity, and each pair of them on one line. A term
    discloses an entity when they met in ``min_docs`` documents or more, the pair's pointwise information is ``min_bits``
    or more, and ``share``, the part of the term's documents in which it is on a line with the entity, is ``min_share`` or
    more. An entity in more than 1 of 2 ** ``min_bits`` documents is disclosed by nothing.

    Pairs are never written for a line as it stands. Terms and entities that occur too rarely or too often to disclose or be
    disclosed go first, which drops no pair that could count; copies of a document's lines are one document with a weight;
    and what is on the same lines everywhere is one class, so that a line of thousands of addresses and words that stands
    in two documents is one pair of classes. What is left grows with the classes that meet on a line.
    """
    spark = docs.sparkSession
    counts, counted = table(docs.select("text").mapInArrow(sliced(_statistics), "term string, entity string, n long").groupBy("term", "entity").agg(F.sum("n").alias("n")), "counts")
    n_all = float(counts.where("term is null and entity is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    fits = (F.col("n") >= int(min_docs)) & (F.col("n") * 2.0**min_bits <= n_all * (1 + 1e-9))
    terms = counts.where("term is not null").where(fits).select(F.col("term").alias("item"), "n")
    entities = counts.where("entity is not null").where(fits).select(F.col("entity").alias("item"), "n")
    lines, written = table(docs.select("text").mapInArrow(sliced(_lines), "doc binary, line int, entities array<string>, terms array<string>"), "lines")
    copies = lines.where("line = 0").groupBy("doc").agg(F.count("*").alias("copies"))
    _, e = _classes(lines, "entities", entities)
    term_class, t = _classes(lines, "terms", terms)
    met = e.withColumnRenamed("class", "of").join(t, ["doc", "line"]).where(F.col("of.n") >= min_share * F.col("class.n"))  # pairs are no more than entities
    pairs = met.select("doc", "of", "class").distinct().join(copies, "doc").groupBy("of", "class").agg(F.sum("copies").alias("n_pair"))
    told = pairs.where(F.col("n_pair") >= int(min_docs)).withColumn("share", F.col("n_pair") / F.col("class.n"))
    told = told.withColumn("bits", F.log2(F.col("n_pair") * F.lit(n_all) / (F.col("class.n") * F.col("of.n"))))
    best = told.where((F.col("bits") >= min_bits) & (F.col("share") >= min_share)).groupBy("class").agg(F.max("share").alias("share"))
    found = cut(term_class.join(best, "class").select(F.col("item").alias("term"), "share"))
    for path in (counted, written):
        drop_dir(spark, path)
    return found


def all_spans(text: str, base: list, terms) -> list[tuple[int, int, str]]:
    """Base spans and those of ``terms`` (lower case) that touch none of them."""
    out, k = list(base), 0
    ends = sorted((s, e) for s, e, _ in base)
    for m in TERM.finditer(text) if terms else ():
        if m[0].lower() not in terms:
            continue
        s, e = m.span()
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        if not any(a < e and s < b for a, b in ends[k : k + 4]):
            out.append((s, e, "term"))
    order = (*KINDS, "term")
    return sorted(out, key=lambda x: (x[0], order.index(x[2])))


def sanitised(text: str, spans: list, shares: dict[str, float], remove_at: float = 0.9) -> str:
    """The text with entities generalised to their kind, and disclosing terms removed (share ``remove_at`` or more) or
    generalised."""
    out, at = [], 0
    for s, e, kind in spans:
        if s < at:
            continue
        out += [text[at:s], "" if kind == "term" and shares.get(text[s:e].lower(), 0) >= remove_at else f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


FOUND = "doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``FOUND``, one row per row of ``docs``, over whole texts; offsets are code points, ends exclusive.

    Null and empty texts have no spans; null ids and repeated rows are answered row by row; an empty table gives no rows;
    very long texts are read whole; other columns are not read, whatever their
    names.
    """
    rows = text_columns(docs, id_col, text_col).select("doc_id", text_key().alias("tkey"), "text")
    terms = disclosing_terms(rows)
    if terms.count() <= broadcast_terms:
        known = rows.sparkSession.sparkContext.broadcast({r.term: r.share for r in terms.collect()})  # counted above
        joined = rows.select("doc_id", "text", F.lit(None).cast("map<string,double>").alias("own"))
    else:
        known = None

        def every(batches):
            for b in batches:
                ids, keys, out = [], [], []
                for i, k, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = _terms(text or "")
                    ids += [i] * len(own)
                    keys += [k] * len(own)
                    out += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["own_id", "own_key", "term"])

        each = rows.mapInArrow(sliced(every), f"own_id {dict(rows.dtypes)['doc_id']}, own_key long, term string").distinct().join(terms, "term")
        own = each.groupBy("own_id", "own_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("own"))
        joined = rows.join(own, rows.doc_id.eqNullSafe(own.own_id) & (rows.tkey == own.own_key), "left").select("doc_id", "text", "own")

    def run(batches):
        for b in batches:
            ids, texts, owns = (c.to_pylist() for c in b.columns)
            out = []
            for text, own in zip(texts, owns, strict=True):
                text, shares = text or "", known.value if known else dict(own or {})
                base = base_spans(text)
                spans = all_spans(text, base, shares)
                n = Counter(k for _, _, k in base)
                digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
                out.append((*(n[k] for k in KINDS), digest, ",".join(f"{k}:{s}:{e}" for s, e, k in spans), sanitised(text, spans, shares)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "sanitised"])

    return joined.mapInArrow(sliced(run), FOUND.format(kind=dict(rows.dtypes)["doc_id"]))
