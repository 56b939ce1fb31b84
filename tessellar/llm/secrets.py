"""Secret scans: keyword, key-id and hex rules, plus sliding-window entropy.

Everything runs as DataFrame expressions. Three base rules give exact spans. The
entropy method then looks at candidate strings of one character class: a window slides
over the candidate, its symbol counts (one character each of a string) change by one
entering and one leaving symbol, and the sum of c*log2(c) is updated from those two
counts, so a step never recounts the window. Sums are whole numbers (scaled by ``SCALE``), so results do not depend on order.
Stretches of windows above the class's threshold become ``entropy`` spans unless an
allow-list pattern or a base span explains them.

Null texts count as empty; empty texts have no spans; repeated rows give repeated
results; other columns of the input are ignored (``find_secrets`` keeps them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.spans import SPAN, blocks, digest_text, find_spans, let, no_spans, ordered, overlapping, redact, sha256_hex

SCALE = 1_000_000
#: Counts are kept as characters from this one on.
ZERO = 48

# Base rules. Possessive quantifiers change no match here (what follows a run never starts
# with a symbol of it) and keep long texts linear.
ASSIGN = (
    r"(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)"
    r"[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
)
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"


@dataclass(frozen=True)
class EntropyClass:
    """One character class: candidates, alphabet, window length and entropy threshold in bits."""

    name: str
    candidate: str
    alphabet: str
    window: int
    bits: float


#: The classes scanned by default. A random window of 20 symbols has about
#: 3.4 bits over 16 symbols and about 4.1 bits over 64.
CLASSES = (
    EntropyClass("hex", r"^[0-9a-fA-F]{20,}$", "0123456789abcdefABCDEF", 20, 3.0),
    EntropyClass(
        "base64", r"^[A-Za-z0-9+/_=-]{20,}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.75
    ),
)
# The look-behind changes no match and lets the scan skip the insides of words.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Candidates that are known not to be secrets.
ALLOW = (
    r"^[^0-9]*+$",  # words, paths and rules without a digit
    r"^[0-9_+/=-]*+$",  # numbers, dates, telephone numbers
    r"^[a-z]+(?:[_/-][a-z0-9]{1,12})+$",  # slugs and paths
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|sample|placeholder|xxxx|0123456789abcdef",
)


def base_spans(text: Column) -> Column:
    """Exact spans of the three base rules, unordered; the rules run only where their marks occur."""
    assign = F.filter(
        find_spans(text, ASSIGN, "assign", 0),
        lambda s: F.length(F.regexp_replace(s["match"], ASSIGN_VALUE, "")) >= 8,
    )
    assign = F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), assign).otherwise(no_spans())
    access = F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, "access", 1)).otherwise(no_spans())
    # a run of 32 hex digits is one of 20 candidate symbols, too
    return F.concat(assign, access, F.when(text.rlike(CANDIDATE), find_spans(text, HEX, "hex", 2)).otherwise(no_spans()))


def _fold_windows(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """Stretches [start, end) of the candidate covered by windows of at least ``bits``."""
    weight = F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0) for c in range(window + 2)])
    most = round(SCALE * window * (math.log2(window) - bits))
    symbols = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    state = F.struct(
        F.lit(chr(ZERO) * len(alphabet)).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(-1).alias("from"),
        F.lit(-1).alias("to"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def w(count: Column) -> Column:
        return F.element_at(weight, count + 1)

    def count(counts: Column, symbol: Column) -> Column:
        return F.ascii(F.substring(counts, symbol, F.lit(1))) - ZERO

    def put(counts: Column, symbol: Column, value: Column) -> Column:
        return F.overlay(counts, F.char(value + ZERO), symbol, F.lit(1))

    def step(acc: Column, move: Column) -> Column:
        came, left, i = move["came"], move["left"], move["i"]
        c_in = count(acc["counts"], came)
        c_out = F.when(left > 0, count(acc["counts"], left) + F.when(left == came, 1).otherwise(0))
        total = acc["sum"] + w(c_in + 1) - w(c_in) + F.when(left > 0, w(c_out - 1) - w(c_out)).otherwise(F.lit(0))
        added = put(acc["counts"], came, c_in + 1)
        counts = F.when(left > 0, put(added, left, c_out - 1)).otherwise(added)
        high = (i + 1 >= window) & (total <= most)
        start = i + 1 - window
        joins = (acc["from"] >= 0) & (start <= acc["to"])
        closed = F.when(
            high & ~joins & (acc["from"] >= 0),
            F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end")))),
        ).otherwise(acc["out"])
        return F.struct(
            counts.alias("counts"),
            total.cast("bigint").alias("sum"),
            F.when(high & ~joins, start).otherwise(acc["from"]).alias("from"),
            F.when(high, i + 1).otherwise(acc["to"]).alias("to"),
            closed.alias("out"),
        )

    def moving(known: Column) -> Column:
        return F.transform(
            known,
            lambda s, i: F.struct(
                s.alias("came"),
                F.when(i >= window, F.element_at(known, F.greatest(i - window + 1, F.lit(1)))).otherwise(0).alias("left"),
                i.alias("i"),
            ),
        )

    moves = let(symbols, moving)
    return F.aggregate(
        moves,
        state,
        step,
        lambda acc: F.when(
            acc["from"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))
        ).otherwise(acc["out"]),
    )


def entropy_spans(text: Column, base: Column, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of kind ``entropy``: high-entropy stretches that neither allow list nor base explain."""
    seen = F.when(text.rlike(CANDIDATE), find_spans(text, CANDIDATE, "entropy", 3)).otherwise(no_spans())
    allowed = "|".join(f"(?:{p})" for p in allow)
    seen = F.filter(seen, lambda c: ~c["match"].rlike(allowed))

    def stretches(c: Column) -> Column:
        found = F.array().cast("array<struct<start:int,end:int>>")
        for k in reversed(classes):
            found = F.when(c["match"].rlike(k.candidate), _fold_windows(c["match"], k.alphabet, k.window, k.bits)).otherwise(found)
        return F.transform(
            found,
            lambda r: F.struct(
                (c["start"] + r["start"]).alias("start"),
                F.lit(3).alias("kind_no"),
                (c["start"] + r["end"]).alias("end"),
                F.lit("entropy").alias("kind"),
                F.substring(c["match"], r["start"] + 1, r["end"] - r["start"]).alias("match"),
            ).cast(SPAN),
        )

    least = min(k.window for k in classes)

    def beside(s: Column, met: Column) -> Column:
        """The stretch without what base spans cover at its ends."""
        start = F.aggregate(met, s["start"], lambda a, b: F.when(b["start"] <= s["start"], F.greatest(a, b["end"])).otherwise(a))
        end = F.aggregate(met, s["end"], lambda a, b: F.when(b["start"] > s["start"], F.least(a, b["start"])).otherwise(a))
        return let(
            F.struct(start.alias("a"), end.alias("e")),
            lambda c: F.struct(
                c["a"].alias("start"), s["kind_no"].alias("kind_no"), c["e"].alias("end"), s["kind"].alias("kind"),
                F.substring(s["match"], c["a"] - s["start"] + 1, F.greatest(c["e"] - c["a"], F.lit(0))).alias("match"),
            ).cast(SPAN),
        )

    def cut(c: Column) -> Column:
        found = F.flatten(F.transform(c, stretches))
        free = let(blocks(base), lambda bl: F.transform(found, lambda s: let(overlapping(bl, s), lambda met: beside(s, met))))
        return F.filter(free, lambda s: s["end"] - s["start"] >= least)

    return let(seen, lambda c: F.when(F.size(c) > 0, cut(c)).otherwise(no_spans()))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: the ordered spans (base and entropy) of each row's whole text."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = df.withColumn("__base", base_spans(whole))
    return held.withColumn(out, ordered(F.concat(F.col("__base"), entropy_spans(whole, F.col("__base"))))).drop("__base")


def secret_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base rules, the digest of their spans, and all spans as text."""
    found = find_secrets(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind_no"] < 3)

    def count(no: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind_no"] == no)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        sha256_hex(digest_text(base)).alias("base_sha256"),
        digest_text(spans).alias("spans"),
    )


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """Replace every found secret in ``text``; null texts stay null, other columns stay as they are."""
    columns = df.columns
    found = find_secrets(df, text, "__secrets")
    return found.withColumn(text, redact(F.col(f"`{text}`"), F.col("__secrets"), mask)).select(*[F.col(f"`{c}`") for c in columns])
