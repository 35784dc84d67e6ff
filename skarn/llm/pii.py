"""Personal data and information-theoretic sanitisation (op 10).

Base spans are emails, IP addresses, card and phone numbers found by pattern. Each found
value is a protected entity. Other words of its documents, runs of letters and digits, may
disclose it: by corpus co-occurrence, a term t discloses entity c when

    PMI(c; t) = log2(p(c, t) / (p(c) p(t)))  >=  IC(c) / ALPHA = -log2 p(c) / ALPHA

that is, when seeing t gives away most of the information that c carries. p(t), p(c) and
p(c, t) are shares of all documents, a copy counting like any other. A disclosing term
becomes a span wherever it stands in a document that holds its entity; sanitising replaces
numbers and addresses by their kind, and terms by their shape's general word or nothing.

One pass over the texts gives base spans, document counts of words, and the entities and
words of documents with any. Pairs of entity and term whose counts can't reach the bound,
whatever their co-occurrence, are left out before they are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.shared import drop_kept, fresh, join_groups, slices, trim, written

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information a term may give away; characters a term needs.
ALPHA, LEAST_CHARS = 1.25, 3
#: Most frequent words and entities whose counts all tasks know, to leave out pairs early; others pass.
LISTED = 100_000
#: Bytes of disclosing pairs, or of documents' terms, that a join may broadcast.
MOST_BROADCAST = 64_000_000
#: Distinct words whose document counts a task holds before it passes them on.
HELD_WORDS = 120_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a run of digits either matches from its first one or not at all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; every match holds one @ with its local part right before it."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the four kinds, by kind and start; a match that fails its check is dropped, not retried."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or (kind == 'ip' and c == '.'))}"


def shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case word) of the words that touch no span."""
    taken = sorted((a, b) for _, a, b in spans)
    k, end = 0, 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            end = max(end, taken[k][1])
            k += 1
        if end <= s and e - s >= LEAST_CHARS:
            yield s, e, m[0].lower()


def located(text: str, terms: Iterable[str]) -> list[tuple[int, int]]:
    """Where the terms stand outside base spans."""
    terms = set(terms)
    return [(s, e) for s, e, w in words_outside(text, base_spans(text)) if w in terms] if terms else []


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass, three kinds of rows (``tag``): 0 documents with base spans, 1 entities and other words of those with any, 2 documents per word.

    (``row_id``, ``text_hash``) tells documents apart; rows equal in both are alike in all results.
    """
    kinds = {
        "tag": ("tinyint", pa.int8()), "row_id": ("bigint", pa.int64()), "text_hash": ("bigint", pa.int64()),
        **{f"n_{k}": ("bigint", pa.int64()) for k in KINDS}, "base_sha256": ("string", pa.string()), "spans": ("string", pa.string()),
        "entities": ("string", pa.string()), "words": ("string", pa.string()), "term": ("string", pa.string()), "docs": ("bigint", pa.int64()),
    }

    def rows(tag: int, cols: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols = {"tag": [tag] * n} | cols
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, (_, t) in kinds.items()], [*kinds])

    def counted(held: Counter) -> Iterator[pa.RecordBatch]:
        words = [w for w in held if len(w) >= LEAST_CHARS]
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield rows(2, {"term": part, "docs": [held[w] for w in part]})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        held: Counter = Counter()
        for b in slices(it):
            base: dict[str, list] = {c: [] for c in ("row_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
            held_by: dict[str, list] = {c: [] for c in ("row_id", "text_hash", "entities", "words")}
            for key, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = base_spans(text)
                list_ = shown(spans)
                counts = Counter(k for k, _, _ in spans)
                for c, v in zip(base.values(), (key, mark, *(counts[k] for k in KINDS), hashlib.sha256(list_.encode()).hexdigest(), list_), strict=True):
                    c.append(v)
                if spans:
                    own = sorted({entity(kind, text[x:y]) for kind, x, y in spans})
                    for c, v in zip(held_by.values(), (key, mark, " ".join(own), " ".join(sorted({w for _, _, w in words_outside(text, spans)}))), strict=True):
                        c.append(v)
                held.update({w.lower() for w in set(_WORD.findall(text))})
                if len(held) > HELD_WORDS:
                    yield from counted(held)
                    held = Counter()
            yield rows(0, base)
            if held_by["row_id"]:
                yield rows(1, held_by)
        yield from counted(held)
        held.clear()
        trim()

    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = ", ".join(f"{c} {t}" for c, (t, _) in kinds.items())
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(batches, schema)


def pairs(held: DataFrame, documents: int, words: DataFrame, mentions: DataFrame, alpha: float) -> DataFrame:
    """``row_id``, ``text_hash``, ``entity``, ``term`` of all documents with entities.

    PMI is largest when t stands in every text that holds c: n_t may then be as large as
    N ** (1 - 1 / alpha) * n_c ** (1 / alpha). Pairs over that by the counts listed are left out.
    """
    spark = held.sparkSession

    def listed(counts: DataFrame, name: str, n: str) -> tuple[dict[str, int], int]:
        top = counts.orderBy(F.desc(n), name).limit(LISTED).toArrow()
        n_top = top.column(n).to_pylist()
        return dict(zip(top.column(name).to_pylist(), n_top, strict=True)), (n_top[-1] if len(n_top) == LISTED else 1)

    often = listed(words.where(F.col("n_t") > documents ** (1 - 1 / alpha)), "term", "n_t")[0]
    known = spark.sparkContext.broadcast((often, *listed(mentions.where("n_c > 1"), "entity", "n_c")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, entities, others = known.value
        cols: tuple[list, ...] = ([], [], [], [])
        kinds = {"row_id": pa.int64(), "text_hash": pa.int64(), "entity": pa.string(), "term": pa.string()}
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], [*kinds])

        for b in slices(it):
            for row, mark, own, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = [(w, often.get(w, 0)) for w in words.split()]
                for c in own.split():
                    most = documents ** (1 - 1 / alpha) * entities.get(c, others) ** (1 / alpha) * (1 + 1e-9)
                    terms = [w for w, n in counts if n <= most]
                    for col, v in zip(cols, ([row] * len(terms), [mark] * len(terms), [c] * len(terms), terms), strict=True):
                        col += v
                    if len(cols[0]) > 50_000:
                        yield batch()
                        cols = ([], [], [], [])
        yield batch()
        trim()

    return held.select("row_id", "text_hash", "entities", "words").mapInArrow(batches, "row_id long, text_hash long, entity string, term string")


def terms_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """Base rows of all documents, and (``row_id``, ``text_hash``, ``terms``) of those with disclosing terms: their words."""
    all_rows = written(scanned(docs, id_col, text_col), "sanitise")
    base = all_rows.where("tag = 0")
    held = all_rows.where("tag = 1")
    documents = max(1, base.count())
    entities = held.select(F.explode(F.split("entities", " ")).alias("entity"))
    mentions = written(entities.groupBy("entity").agg(F.count("*").alias("n_c")), "entities")
    words = written(all_rows.where("tag = 2").groupBy("term").agg(F.sum("docs").alias("n_t")), "word-counts", "zstd")
    found = pairs(held, documents, words, mentions, alpha)
    together = found.groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    information = F.log2(F.lit(float(documents)) / F.col("n_c"))
    pmi = F.log2(F.col("n_ct") * F.lit(float(documents)) / (F.col("n_c") * F.col("n_t")))
    disclosing = words.join(together, "term").join(mentions, "entity").where(pmi >= information / alpha - 1e-9)
    disclosing = written(disclosing.select("entity", "term", F.col("n_ct").alias("size")), "disclosing")
    # Each document's own pairs meet the disclosing ones, so no list of an entity's terms is gathered.
    size = disclosing.agg(F.coalesce(F.sum(F.octet_length("entity") + F.octet_length("term") + 40), F.lit(0))).first()[0]
    key = ["entity", "term"]
    met = found.join(F.broadcast(disclosing.select(*key)), key) if size <= MOST_BROADCAST else join_groups(found, disclosing, key, "text_hash")
    return base, written(met.groupBy("row_id", "text_hash").agg(F.collect_set("term").alias("terms")), "document-terms")  # of one document


def with_terms(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` and a last column, the disclosing words of each."""
    row, mark, own = fresh(docs, "row_id", "text_hash", "terms")
    terms = terms.select(F.col("row_id").alias(row), F.col("text_hash").alias(mark), F.col("terms").alias(own))
    small = terms.agg(F.coalesce(F.sum(F.size(own) * 20 + 60), F.lit(0))).first()[0]
    text = F.coalesce(F.col(text_col), F.lit(""))
    on = docs[id_col].cast("long").eqNullSafe(F.col(row)) & (F.xxhash64(text) == F.col(mark))
    return docs.join(F.broadcast(terms) if small <= MOST_BROADCAST else terms, on, how).select(*docs.columns, own)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` of every row.

    Offsets are code points, ends exclusive. ``spans``: base spans by kind and start, then
    disclosing terms (kind ``term``) by start. A null text is empty and has no spans.
    Repeated rows count as one document and have the same spans; other columns are left
    out, whatever their names; an empty table gives none.
    """
    base, terms = terms_of(docs, id_col, text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            texts, own = b.column(2).to_pylist(), b.column(3).to_pylist()
            found = [shown(("term", s, e) for s, e in located(t, x)) for t, x in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["row_id", "text_hash", "term_spans"])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    own = with_terms(rows, terms, "row_id", "text", "inner").mapInArrow(batches, "row_id long, text_hash long, term_spans string")
    own = written(own, "term-spans").dropDuplicates(["row_id", "text_hash"])
    both = base.alias("b").join(own.alias("t"), F.expr("b.row_id <=> t.row_id and b.text_hash = t.text_hash"), "left")
    spans = F.array_join(F.filter(F.array(F.col("b.spans"), F.coalesce("t.term_spans", F.lit(""))), lambda x: x != ""), ",")
    return both.select(F.col("b.row_id").alias(id_col), *(f"b.n_{k}" for k in KINDS), "b.base_sha256", spans.alias("spans"))


def replaced(text: str, terms: list[tuple[int, int]]) -> str:
    """A text whose base spans give way to their kind in brackets; terms to ``[NAME]`` if capitalised, else to nothing."""
    spans = sorted([(a, -b, f"[{k.upper()}]") for k, a, b in base_spans(text)] + [(a, -b, "[NAME]" if text[a].isupper() else "") for a, b in terms])
    out, at = [], 0
    for a, b, by in spans:
        if a >= at:  # of spans that overlap, the first and longest
            out += [text[at:a], by]
            at = -b
        else:
            at = max(at, -b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and rows, personal data in ``text_col`` replaced; see :func:`replaced`. A null text stays null."""
    _, terms = terms_of(docs, id_col, text_col)
    joined = with_terms(docs, terms, id_col, text_col, "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            place = b.schema.names.index(text_col)
            texts = b.column(place).to_pylist()
            terms = b.column(b.num_columns - 1).to_pylist()
            new = [None if t is None else replaced(t, located(t, own or ())) for t, own in zip(texts, terms, strict=True)]
            columns = [pa.array(new, pa.string()) if k == place else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])
        trim()

    return joined.mapInArrow(batches, docs.schema)
