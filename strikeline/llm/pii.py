"""Personal data: patterns, then information-theoretic sanitisation of the terms that give protected entities away.

The patterns find base mentions. A protected entity is a mentioned value, or a class that values fall in: a mail domain, a network,
the first digits of a number. Most values stand in one or two texts only, too few to tell anything; their classes stand in more.
The corpus tells how much a term t says about an entity e: with N, df(t), df(e) and df(t, e) all counted in different texts
(copies of a text count once), the last those where t stands within CONTEXT_WORDS of a mention of e,

    PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e)))

is set against the information of the entity itself, IC(e) = -log2(df(e) / N), its greatest possible value. For a class,
SMOOTHING is added to df(t), as if the term had also been seen that often elsewhere: many values share a class, and a few
coincidences should tell less than many. A term seen with e in at least MIN_SUPPORT texts is removed where PMI reaches REMOVE_AT of IC, generalised to the entity's kind
where it reaches GENERALISE_AT. The decision holds for the term in every text, as the term alone would disclose.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import Words, byte_table, gathered, map_arrow, materialise, slices, small, text_digest

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT_WORDS = 4
MIN_SUPPORT = 3
GENERALISE_AT, REMOVE_AT = 0.75, 0.95
SMOOTHING = 1.0
#: How classes are told from values.
_CLASS = "^email:@|[.-]$"
#: Terms that workers hold as a set, a few MB; with more, texts and terms are joined.
HELD_TERMS = 100_000
#: Text bytes whose terms are counted together.
COUNT_BYTES = 8 << 20
#: Letters only, so that a mention's own digits and signs are not terms.
LETTERS = byte_table({*range(0x61, 0x7B), *range(0x80, 0x100)})

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits without a following part has no match that begins inside it, so none is tried there.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each @ with the longest local part before it, found from the @ in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def mentions(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) in code points, by start and kind. Overlaps between kinds stay."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """What is protected: digits alone for numbers, lower case for addresses."""
    a, b, kind = span
    value = text[a:b]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def classes(value: str) -> list[str]:
    """The classes that an entity falls in: the domain of an address and its last two names, the networks of an ip, the first
    digits of a number. Each is written as an entity of its kind."""
    kind, _, own = value.partition(":")
    if kind == "email":
        domain = own.rpartition("@")[2]
        return [f"email:@{d}" for d in dict.fromkeys((domain, ".".join(domain.split(".")[-2:])))]
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in own.split(".")]
        return [f"ip:{'.'.join(parts[:k])}." for k in (3, 2)]
    return [f"{kind}:{own[:k]}-" for k in ((6, 4) if kind == "card" else (4, 2))]


def _covered(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Where the stretches under mentions begin and end, in order and without overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free_words(text: str, lo: int, hi: int, covered: tuple[list[int], list[int]]) -> Iterator[re.Match]:
    """The words of a stretch, in order, that no mention overlaps."""
    starts, ends = covered
    for m in _WORD.finditer(text, lo, hi):
        k = bisect_right(ends, m.start())  # the first stretch that ends after the word begins
        if k == len(starts) or starts[k] >= m.end():
            yield m


def nearby(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int, int], set[str]]]:
    """Each mention with the terms within CONTEXT_WORDS of it on its line. Every line is read once."""
    covered, line_end, begins, ends, terms = _covered(base), -1, [], [], []
    for span in base:
        a, b, _ = span
        if a >= line_end:
            line_at, line_end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            line_end = len(text) if line_end < 0 else line_end
            words = [(m.start(), m.end(), m[0].translate(_LOW)) for m in _free_words(text, line_at, line_end, covered)]
            begins, ends, terms = (list(x) for x in zip(*words, strict=True)) if words else ([], [], [])
        before, after = bisect_right(ends, a), bisect_left(begins, b)
        yield span, {*terms[max(0, before - CONTEXT_WORDS) : before], *terms[after : after + CONTEXT_WORDS]}


def _has_mark(text: str) -> bool:
    return "@" in text or "+" in text or _ANY_DIGIT.search(text) is not None


_ANY_DIGIT = re.compile("[0-9]")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: set[tuple[str, str | None, bytes]] = set()
        for text, copy in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), strict=True):
            if not text or not _has_mark(text):
                continue
            base = mentions(text)
            if not base:
                continue
            for span, terms in nearby(text, base):
                value = entity(text, span)
                out.update((e, t, copy) for e in (value, *classes(value)) for t in (None, *terms))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["entity", "term", "copy"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts): in how many texts of a slice each term stands."""
    for batch in slices(gathered(batches, COUNT_BYTES), limit=COUNT_BYTES):
        words = Words(batch.column("text"), LETTERS)
        coded = words.tokens.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(codes):
            continue
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), words.counts)
        once = np.unique(row * len(coded.dictionary) + codes) % len(coded.dictionary)
        texts = np.bincount(once, minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(texts, pa.int64())], names=["term", "texts"])


def disclosing_terms(docs: DataFrame, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(term, kind, disclosure): terms and the greatest part of an entity's information that each gives away, at most 1.

    Every text counts once, however many rows hold it; null counts as an empty text. Entities in fewer than min_support
    texts cannot have a supported term.
    """
    docs = docs.select("text", text_digest(F.col("text")).alias("copy"))
    texts = materialise(docs.groupBy("copy").agg(F.count("*").alias("rows")), "texts")
    n = texts.count()
    repeated = materialise(texts.filter("rows > 1").select("copy"), "repeated")
    seen = materialise(map_arrow(docs, _contexts, "entity string, term string, copy binary"), "contexts")
    pairs = seen.groupBy("entity", "term").agg(F.countDistinct("copy").alias("together"))
    pairs = materialise(pairs.filter(F.col("together") >= min_support), "supported")
    of_entity = pairs.filter("term is null").select("entity", F.col("together").alias("mentions"))
    linked = pairs.filter("term is not null").join(of_entity, "entity")
    wanted = materialise(linked.select("term").distinct(), "wanted")
    # Only texts of several rows move; their copies combine before that.
    once = docs.join(small(repeated), "copy", "left_anti").select("text")
    once = once.unionByName(docs.join(small(repeated), "copy", "left_semi").dropDuplicates(["copy"]).select("text"))
    counts = map_arrow(once, _term_counts, "term string, texts long").join(small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("texts").alias("texts"))
    total = F.lit(float(max(n, 1)))
    smoothing = F.when(F.col("entity").rlike(_CLASS), SMOOTHING).otherwise(0.0)
    pmi = F.log2(total * F.col("together") / ((F.col("texts") + smoothing) * F.col("mentions")))
    information = -F.log2(F.col("mentions") / total)
    scored = linked.join(counts, "term").withColumn("disclosure", F.when(information > 0, pmi / information)).filter(F.col("disclosure") >= generalise_at)
    kind = F.substring_index("entity", ":", 1)
    best = F.struct("disclosure", kind.alias("kind"))
    return materialise(scored.groupBy("term").agg(F.max(best).alias("best")).select("term", "best.kind", "best.disclosure"), "disclosing")


def _sanitise(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            names = batch.schema.names
            own = batch.column("terms").to_pylist() if "terms" in names else None
            base_out, all_out, clean_out, counts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                base = mentions(text) if _has_mark(text) else []
                terms = held.value if held is not None else {t["term"]: (t["kind"], t["disclosure"]) for t in own[i] or ()}
                added = []
                if terms:
                    added = [(m.start(), m.end(), 4) for m in _free_words(text.translate(_LOW), 0, len(text), _covered(base)) if m[0] in terms]
                spans = sorted(base + added, key=lambda s: (s[0], s[2]))
                base_out.append(base)
                all_out.append(spans)
                counts.append([sum(s[2] == k for s in base) for k in range(4)])
                clean_out.append(_rewrite(text, spans, terms))
            columns = [
                batch.column("row"),
                *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                pa.array(map(render, base_out), pa.string(), size=len(counts)),
                pa.array(map(render, all_out), pa.string(), size=len(counts)),
                pa.array(clean_out, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *(f"n_{k}" for k in KINDS[:4]), "base_spans", "spans", "sanitised"])

    return run


def _rewrite(text: str, spans: list[tuple[int, int, int]], terms: dict) -> str:
    """Mentions become their kind; terms are removed or become the kind they point to. Overlapping spans are one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out.append(text[at:a])
            if kind < 4:
                out.append(f"[{KINDS[kind]}]")
            else:
                of, disclosure = terms[text[a:b].translate(_LOW)]
                out.append("" if disclosure >= REMOVE_AT else f"[{of} context]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def _doc_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"), LETTERS)
        row = batch.column("copy").take(pa.array(np.repeat(np.arange(batch.num_rows), words.counts)))
        yield pa.RecordBatch.from_arrays([row, words.tokens.cast(pa.string())], names=["copy", "term"])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs without text, plus n_email, n_ip, n_card, n_phone, base_spans, spans (base and term spans) and sanitised.

    Null counts as an empty text, which has no spans. Repeated rows are judged alike, each for itself. Columns of docs
    named like the results are replaced.
    """
    spark = docs.sparkSession
    added = [*(f"n_{k}" for k in KINDS[:4]), "base_spans", "spans", "sanitised"]
    docs = docs.drop(*added)
    terms = disclosing_terms(docs, **options)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")
    held = None
    if terms.count() <= HELD_TERMS:
        held = spark.sparkContext.broadcast({r.term: (r.kind, r.disclosure) for r in terms.toLocalIterator()})
    else:
        named = rows.withColumn("copy", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        pairs = map_arrow(named.select("copy", "text"), _doc_terms, "copy string, term string").distinct().join(terms, "term")
        own = pairs.groupBy("copy").agg(F.collect_list(F.struct("term", "kind", "disclosure")).alias("terms"))
        rows = named.join(own, "copy", "left").select("row", "text", "terms")
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in added[:4]), *(T.StructField(c, T.StringType()) for c in added[4:])])
    return map_arrow(rows, _sanitise(held), schema).select("row.*", *added)
