"""Regular-expression spans with offsets, built from SQL functions only.

Spark's regular-expression functions return matches without positions. ``split`` on the
same pattern returns the text between the matches, found by the same leftmost
non-overlapping scan, so offsets follow from the running lengths of both lists.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,match:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; a lambda would repeat an outer expression at each element."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def find_spans(text: Column, pattern: str, kind: str, kind_no: int) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as an array of spans.

    Starts are running sums, taken by blocks of about the square root of the number of
    matches, so texts with very many matches stay far from quadratic.
    """
    seen = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )

    def spans(v: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(v["hits"]))).cast("int")
        moves = F.zip_with(F.slice(v["gaps"], 1, F.size(v["hits"])), v["hits"], lambda g, h: g + F.length(h))
        return let(F.struct(v["gaps"].alias("gaps"), v["hits"].alias("hits"), moves.alias("moves"), block.alias("block")), placed)

    def placed(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.size(v["hits"]) / v["block"]).cast("int") - 1)
        sums = F.transform(steps, lambda j: _sum(F.slice(v["moves"], j * v["block"] + 1, v["block"])))
        heads = let(sums, lambda s: F.transform(steps, lambda j: _sum(F.slice(s, 1, j))))

        def span(heads: Column):
            def make(hit: Column, i: Column) -> Column:
                at = F.floor(i / v["block"]).cast("int")
                start = F.element_at(heads, at + 1) + _sum(F.slice(v["moves"], at * v["block"] + 1, i % v["block"])) + F.element_at(v["gaps"], i + 1)
                return F.struct(
                    start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + F.length(hit)).alias("end"), F.lit(kind).alias("kind"), hit.alias("match")
                )

            return make

        return let(heads, lambda h: F.transform(v["hits"], span(h)))

    return let(seen, lambda v: F.when(F.size(v["hits"]) > 0, spans(v)).otherwise(no_spans()))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    return F.array_sort(spans)


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; spans must be ordered."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _chunks(ordered_spans: Column) -> Column:
    """Ordered spans in runs of about the square root of their number."""
    some = F.greatest(F.ceil(F.sqrt(F.size(ordered_spans))).cast("int"), F.lit(1))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ordered_spans) / some).cast("int") - 1, F.lit(0)))
    return F.transform(steps, lambda j: F.slice(ordered_spans, j * some + 1, some))


def blocks(spans: Column) -> Column:
    """Spans in blocks with the stretch each covers, so that :func:`overlapping` need not look at all of them."""
    cut = F.filter(let(ordered(spans), _chunks), lambda c: F.size(c) > 0)
    return F.transform(cut, lambda c: F.struct(c[0]["start"].alias("lo"), F.array_max(F.transform(c, lambda s: s["end"])).alias("hi"), c.alias("spans")))


def overlapping(blocks: Column, s: Column) -> Column:
    """The spans of ``blocks`` that share a character with ``s``."""

    def met(o: Column, start: str, end: str) -> Column:
        return (o[start] < s["end"]) & (o[end] > s["start"])

    return F.flatten(F.transform(F.filter(blocks, lambda b: met(b, "lo", "hi")), lambda b: F.filter(b["spans"], lambda o: met(o, "start", "end"))))


def redact(text: Column, spans: Column, mask: str) -> Column:
    """Replace the union of ordered spans by one ``mask`` per connected stretch.

    Works by blocks of spans, each on its own piece of the text.
    """

    def last_end(some: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), F.lit(0))

    def masked(v: Column) -> Column:
        heads = F.transform(v["chunks"], lambda _, j: F.coalesce(F.array_max(F.slice(v["ends"], 1, j)), F.lit(0)))

        def piece(head: Column, chunk: Column) -> Column:
            def one(part: Column) -> Column:
                def make(s: Column, i: Column) -> Column:
                    at = F.greatest(head, last_end(F.slice(chunk, 1, i)))
                    gap = F.substring(part, at - head + 1, s["start"] - at)
                    return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(gap, F.lit(mask)))

                return F.array_join(F.transform(chunk, make), "")

            return let(F.substring(text, head + 1, F.greatest(last_end(chunk) - head, F.lit(0))), one)

        rest = let(F.array_max(v["ends"]), lambda e: F.substring(text, e + 1, F.length(text)))
        return F.concat(F.array_join(F.zip_with(heads, v["chunks"], piece), ""), rest)

    cut = let(_chunks(spans), lambda c: let(F.struct(c.alias("chunks"), F.transform(c, last_end).alias("ends")), masked))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
