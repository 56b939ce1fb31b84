"""Text operators: documents to normalised text, keys, chunks, entities, signals, events, search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.operators.pattern_tables import EVENT_PATTERNS, LEXICON, SIGNAL_PATTERNS, THEME_ENTITIES
from tessellar.functions.scalars import amount, content_key, url_key
from tessellar.operators.relational import BROADCAST_ROWS

# Characters replaced while normalising, and lines that are dropped.
REPLACEMENTS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " ", "ﬁ": "fi", "ﬂ": "fl"}
DROPPED_LINE = r"(?imu)^[ \t]*(?:\d{1,4}|page \d+(?: of \d+)?|confidential|draft|private (?:&|and) confidential)[ \t]*$"


#: Between words: letters with their marks, digits and underscores belong to words.
WORD_CUT = r"[^\p{L}\p{M}\p{N}_]+"


def normalize(text: Column, least: int = 50) -> Column:
    """Plain quotes and dashes, no page-number or marking lines, folded blanks and breaks, no
    control characters; null below ``least`` characters."""
    out = text
    for bad, good in REPLACEMENTS.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, DROPPED_LINE, "")
    out = F.regexp_replace(out, r"\t", " ")
    out = F.regexp_replace(out, r" {2,}", " ")
    out = F.regexp_replace(out, r"(?m) +$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return F.when(F.length(out) >= least, out)


#: Space separators (Unicode class Zs), which close a title's line; tabs and the like stay.
BLANKS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def title(text: Column) -> Column:
    """First line of more than five characters without blanks at its ends, cut at 200."""
    # a lambda of one argument: trim's second would get the line's number as characters to strip
    lines = F.transform(F.split(text, "\n"), lambda l: F.trim(l, F.lit(BLANKS)))
    return F.substring(F.try_element_at(F.filter(lines, lambda l: F.length(l) > 5), F.lit(1)), 1, 200)


def chunks(text: Column, words: int = 400, overlap: int = 50) -> Column:
    """Overlapping windows of words, joined by blanks; the last may be short."""
    step = words - overlap
    all_words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(all_words)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    bound = F.transform(F.array(all_words), lambda w: F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, words), " ")))
    return bound[0]


def dedupe(docs: DataFrame, arrival: str, url: str = "url", text: str = "text") -> DataFrame:
    """Add status NEW, URL_DUPLICATE or CONTENT_DUPLICATE by arrival.

    Order-free contract: the earliest of an address key stays, then of those the earliest
    of a content key. Content met only in an address duplicate does not count as seen.
    """
    keyed = docs.withColumn("__u", url_key(F.col(url))).withColumn("__c", content_key(F.col(text)))
    by_url = F.row_number().over(Window.partitionBy("__u").orderBy(arrival))
    keyed = keyed.withColumn("__first", F.when(F.col("__u").isNull(), 1).otherwise(by_url))
    by_text = F.row_number().over(Window.partitionBy("__c", F.col("__first") == 1).orderBy(arrival))
    status = F.when(F.col("__first") > 1, "URL_DUPLICATE").when(by_text > 1, "CONTENT_DUPLICATE").otherwise("NEW")
    return keyed.withColumn("status", status).drop("__u", "__c", "__first")


def lexicon_rows(spark: SparkSession, groups=LEXICON) -> DataFrame:
    """The engine's keywords as (keyword, entity_type, confidence); one word may have several types."""
    return spark.createDataFrame([(w, kind, c) for kind, c, words in groups for w in words], "keyword string, entity_type string, confidence double")


def keyword_entities(docs: DataFrame, lexicon: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keyword, entity_type) for lexicon words found as whole words, any case.

    Without ``lexicon`` the engine's own (:func:`lexicon_rows`) is used.

    One-word keywords join the documents' distinct words; phrases are looked for in the
    documents that hold their first word, whose texts are fetched then. No document meets
    the whole lexicon, which is broadcast up to BROADCAST_ROWS rows.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), WORD_CUT))).alias("__w"))
    lexicon = lexicon_rows(docs.sparkSession) if lexicon is None else lexicon
    lex = lexicon.withColumn("__k", F.lower("keyword")).withColumn("__h", F.element_at(F.split("__k", WORD_CUT), 1))
    if lex.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lex = F.broadcast(lex)
    hits = words.join(lex, F.col("__w") == F.col("__h"))
    out = ["doc_id", "keyword", "entity_type"]
    phrases = hits.filter(F.col("__k") != F.col("__h")).select(*out, "__k").distinct()
    bodies = docs.select(F.col(doc_id).alias("__d"), F.lower(F.col(text)).alias("__t"))
    whole = F.rlike("__t", F.concat(F.lit(r"(?U)\b\Q"), F.col("__k"), F.lit(r"\E\b")))
    met = phrases.join(bodies, F.col("doc_id").eqNullSafe(F.col("__d"))).filter(whole)
    return hits.filter(F.col("__k") == F.col("__h")).select(*out).unionByName(met.select(*out)).distinct()


def amounts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, at, raw, value, unit) of all amounts of money in dollars or rupees."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?iu)(?:\$|rs\.?\s?|inr\s?|₹)\s?[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:lakh crore|trillion|billion|million|thousand|crore|lakh|bn|mn|cr|[bmk])?\b"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("at", "raw"))
    parsed = rows.withColumn("__a", amount(F.col("raw")))
    return parsed.select("doc_id", "at", "raw", F.col("__a.value").alias("value"), F.col("__a.unit").alias("unit"))


SIGNALS = (
    "doc_id long, seq int, signal_type string, direction string, confidence double, start int, end int, context string, value double, unit string, entity string"
)
# Amounts in dollars.
_MONEY = r"\$\s?(\d+(?:\.\d+)?)\s*(billion|million|trillion|B|M|bn|mn)?"
_SCALE = {"trillion": 1e12, "billion": 1e9, "million": 1e6, "bn": 1e9, "mn": 1e6, "b": 1e9, "m": 1e6}


def extract_signals(
    docs: DataFrame, patterns=SIGNAL_PATTERNS, doc_id: str = "doc_id", text: str = "text", least: float = 0.5, most: int | None = 100, window: int = 100,
    near: int = 500, entities=THEME_ENTITIES,
) -> DataFrame:
    """Pattern hits with spans, context, amount and the first named theme entity, thinned to one a type within ``near`` characters.

    Spans need Python's matcher, so documents pass as Arrow batches; nothing is shuffled.
    ``most`` is tested between patterns, as part of the contract; None keeps all. Null texts have no hits.
    """
    columns = [f.split()[0] for f in SIGNALS.split(", ")]
    find = signal_finder(patterns, least, most, window, near, entities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_text = find()
        for pdf in batches:
            rows = [(key, i, *hit) for key, body in zip(pdf["doc_id"], pdf["text"], strict=True) for i, hit in enumerate(of_text(body))]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null").mapInPandas(run, SIGNALS)


def signal_finder(patterns, least: float, most: int | None, window: int, near: int, entities) -> Callable[[], Callable[[str | None], list[tuple]]]:
    """Maker of a function from a text to its signals; workers call it, so compiled patterns are not shipped."""
    rules = [(k, d, c, p) for k, d, c, p in patterns if c >= least]

    def make() -> Callable[[str | None], list[tuple]]:
        compiled = [(k, d, c, re.compile(p, re.I)) for k, d, c, p in rules]
        money, named = re.compile(_MONEY, re.I), [(name, re.compile(p, re.I)) for name, p in entities]

        def of_text(body: str | None) -> list[tuple]:
            hits: list[tuple] = []
            for k, d, c, p in compiled:
                hits += [(k, d, c, m.start(), m.end()) for m in p.finditer(body or "")]
                if most is not None and len(hits) >= most:
                    break
            kept: dict[str, int] = {}
            out: list[tuple] = []
            for k, d, c, s, e in sorted(hits, key=lambda h: -h[2]):
                if k not in kept or abs(s - kept[k]) > near:
                    kept[k] = s
                    context = body[max(0, s - window) : e + window].strip()
                    a = money.search(context)
                    unit = (a[2] or "").lower() if a else ""
                    about = next((name for name, p in named if p.search(context)), "")
                    out.append((k, d, c, s, e, context, float(a[1]) * _SCALE.get(unit, 1.0) if a else None, f"USD_{unit or 'units'}" if a else None, about))
            return out

        return of_text

    return make


def register(spark: SparkSession) -> None:
    """Offer ``signal_extract(text)`` in SQL: an array of structs, by the engine's patterns, as ``extract_signals`` finds them."""
    fields = SIGNALS.split(", ")[2:]
    find = signal_finder(SIGNAL_PATTERNS, 0.5, 100, 100, 500, THEME_ENTITIES)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_text = find()
        for texts in batches:
            yield pd.Series([[dict(zip([f.split()[0] for f in fields], hit, strict=True)) for hit in of_text(body)] for body in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    spark.udf.register("signal_extract", F.pandas_udf(run, "array<struct<" + ", ".join(f.replace(" ", ": ") for f in fields) + ">>"))


EVENTS = "doc_id long, event_type string, direction string, confidence double, start int, magnitude double, unit string, context string"


def extract_events(docs: DataFrame, patterns=EVENT_PATTERNS, doc_id: str = "doc_id", text: str = "text", bucket: int = 200, most: int | None = 200, least: float = 0.65) -> DataFrame:
    """First hit of a type in each ``bucket`` of characters, with its amount; by position, at most ``most`` (None: all).

    ``patterns`` are (type, direction, confidence, pattern) in order of preference; those under ``least`` are not searched.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(k, d, c, re.compile(p, re.I)) for k, d, c, p in patterns if c >= least]
        money = re.compile(r"\$\s?([\d,]+(?:\.\d+)?)\s?(billion|million|thousand)?", re.I)
        scale = {"billion": 1e9, "million": 1e6, "thousand": 1e3, "": 1.0}
        for pdf in batches:
            rows = []
            for key, body in zip(pdf["doc_id"], pdf["text"], strict=True):
                seen: dict[tuple[str, int], tuple] = {}
                for k, d, c, p in compiled:
                    for m in p.finditer(body or ""):
                        near = body[max(0, m.start() - 100) : m.end() + 200]
                        a = money.search(near)
                        unit = (a[2] or "").lower() if a else ""
                        seen.setdefault((k, m.start() // bucket), (key, k, d, c, m.start(), float(a[1].replace(",", "")) * scale[unit] if a else None, f"USD_{unit}".rstrip("_") if a else None, near))
                rows += sorted(seen.values(), key=lambda r: r[4])[:most]
            yield pd.DataFrame(rows, columns=["doc_id", "event_type", "direction", "confidence", "start", "magnitude", "unit", "context"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null").mapInPandas(run, EVENTS)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index rows (doc_id, term, tf, length)."""
    words = F.filter(F.split(F.lower(F.col(text)), WORD_CUT), lambda w: w != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), words.alias("__w"))
    rows = rows.select("doc_id", F.size("__w").cast("bigint").alias("length"), F.explode("__w").alias("term"))
    return rows.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, mean): documents and their mean number of words, empty and null ones included."""
    length = F.size(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_CUT), ""))
    return docs.agg(F.count("*").alias("n"), F.avg(length).alias("mean"))


def _bm25(tf: Column, df: Column, length: Column, k1: float, b: float) -> Column:
    idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1.0)
    return idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / F.col("mean")))


def snippet(text: Column, query: list[str], words: int = 40, before: int = 8) -> Column:
    """``words`` words of a text from ``before`` words ahead of its first hit on, hits in <b></b>, cuts as ``...``.

    Words are runs between white space; one is a hit if a word of the query stands in it.
    Without a hit the text's start is shown; null stays null.
    """
    terms = F.array(*[F.lit(t.lower()) for t in query]) if query else F.array().cast("array<string>")

    def is_hit(word: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(word), WORD_CUT), terms)

    whole = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # bound once: the position needs the words, the window both
    parts = F.transform(F.array(whole), lambda w: F.struct(w.alias("w"), F.greatest(F.array_position(F.transform(w, is_hit), True) - before, F.lit(1)).cast("int").alias("at")))

    def cut(p: Column) -> Column:
        shown = F.transform(F.slice(p["w"], p["at"], words), lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
        return F.concat(F.when(p["at"] > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size(p["w"]) >= p["at"] + words, "...").otherwise(""))

    return F.when(text.isNotNull(), F.transform(parts, cut)[0])


def search(
    docs: DataFrame, query: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", text: str = "text", every: bool = False, words: int | None = None
) -> DataFrame:
    """BM25 over the documents: doc_id and score of the k best (ties: smaller id).

    ``every`` keeps documents that hold all words of the query; ``words`` adds a snippet
    of that many words, made after the k best are known.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))  # not null, else null tests repeat the split
    rows = docs.select(F.col(doc_id).alias("doc_id"), low.alias("__t"), *([F.col(text).alias("__text")] if words else []))

    def counted(part: DataFrame) -> DataFrame:
        part = part.withColumn("__w", F.array_remove(F.split("__t", WORD_CUT), ""))
        return part.withColumn("length", F.size("__w")).withColumns({f"tf{i}": F.size("__w") - F.size(F.array_remove("__w", t.lower())) for i, t in enumerate(query)}).drop("__w", "__t")

    stats = counted(rows).agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(query))])
    may_hit = F.lit(every)
    for t in query:
        may_hit = may_hit & F.contains("__t", F.lit(t.lower())) if every else may_hit | F.contains("__t", F.lit(t.lower()))
    score, all_met = F.lit(0.0), F.lit(True)
    for i in range(len(query)):
        score = score + _bm25(F.col(f"tf{i}").cast("double"), F.col(f"df{i}").cast("double"), F.col("length"), k1, b)
        all_met = all_met & (F.col(f"tf{i}") > 0)
    hits = counted(rows.filter(may_hit)).crossJoin(F.broadcast(stats)).withColumn("score", score).filter("score > 0")
    best = (hits.filter(all_met) if every else hits).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select("doc_id", "score", *([snippet(F.col("__text"), query, words).alias("snippet")] if words else []))


def search_postings(index: DataFrame, total: DataFrame, query: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """The answer of :func:`search` from stored :func:`postings` and :func:`totals`: only the rows of the query's words are read.

    Document ids must be unique. Terms of the query are few, so their counts are broadcast.
    """
    uses = {t: [q.lower() for q in query].count(t) for t in {q.lower() for q in query}}
    rows = index.filter(F.col("term").isin(*uses))
    counts = rows.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # one row for a word of the query
    times = F.element_at(F.create_map(*[F.lit(x) for t, n in uses.items() for x in (t, float(n))]), F.col("term")) if uses else F.lit(0.0)
    scored = rows.join(F.broadcast(counts), "term").crossJoin(F.broadcast(total))
    scored = scored.withColumn("score", times * _bm25(F.col("tf").cast("double"), F.col("df"), F.col("length"), k1, b))
    met = scored.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("terms"))
    return met.filter(F.col("terms") >= (len(uses) if every else 1)).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def search_phrase(docs: DataFrame, phrase: str, latest: str, k: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold the phrase anywhere, any case, the latest first (ties: smaller id): search without an index."""
    held = docs.filter(F.contains(F.lower(F.col(text)), F.lit(phrase.lower())))
    return held.orderBy(F.desc_nulls_last(latest), doc_id).limit(k)


# Element names whose content is no text.
_DROPPED = "script|style|header|footer|nav"


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, header, footer and menu, blanks folded."""
    out = F.regexp_replace(html, rf"(?is)<({_DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def phrase_hits(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """Number of phrases that the text holds, any case."""
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(p.lower())), 1).otherwise(0) for p in phrases), F.lit(0))


def sentiment(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """(p - n) / (p + n) over phrase hits, 0 without any."""
    p, n = phrase_hits(text, positive), phrase_hits(text, negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)
