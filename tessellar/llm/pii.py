"""Personal data: exact base rules, and boosted trees over overlapping candidates.

Base rules give exact spans of e-mail, IP, card and telephone numbers. Besides, generators
of high recall propose further spans, which may overlap each other: card numbers inside
longer digit chains, telephone numbers without country code, national ids, account
numbers, addresses in disguise, IPv6. Each candidate gets format features (digits, length,
checksums, plausible prefix) and context features (words before it, neighbouring
characters). Gradient-boosted trees score it; a calibrated threshold of its kind selects
it; of overlapping selected ones the longest stays (ties: the first).

No table holds labelled personal data, so the trees are fitted on ``EXAMPLES`` snippets
written from the formats' own grammars, positive and negative ones. The snippets go through
the same expressions as documents; only their small feature rows reach the driver. The
fitted trees become literals of a column expression: scoring runs without Python.

Null texts count as empty; empty texts have no spans; repeated rows give repeated results;
other columns are ignored (``find_personal_data`` keeps them).
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.spans import blocks, digest_text, find_spans, let, no_spans, ordered, overlapping, redact, sha256_hex

EXAMPLES = 3000
ROUNDS = 30
RATE = 0.3
PRECISION = 0.95

# Base rules. Possessive quantifiers and the look-behinds keep long texts linear and change
# no match: a run's leftmost match starts at the run, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators (kind, pattern), numbered from 4 on.
GENERATORS = (
    ("card_part", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    ("phone_local", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("email_disguised", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+ ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z]{2,24}"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
)
# Words before a candidate that speak for and against it.
FOR = r"(?i)\b(?:call|phone|tel|telephone|mobile|fax|contact|cell|card|visa|mastercard|amex|credit|ssn|social|security|passport|iban|account|bank|mail|e-mail|email|reach|write|address|host|ip)\b"
AGAINST = r"(?i)\b(?:order|invoice|ref|reference|version|isbn|item|serial|total|price|part|tracking|ticket|batch|build|model|sku|code|sample|page|lot)\b"


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    worth = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Exact spans of the four base rules, unordered."""

    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

    def card(s: Column) -> Column:
        d = _digits(s["match"])
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))

    figures = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL, "email", 0)).otherwise(no_spans())
    ip = F.filter(find_spans(text, IP, "ip", 1), lambda s: F.forall(F.split(s["match"], r"\."), part))
    cards = F.filter(find_spans(text, CARD, "card", 2), card)
    phone = F.filter(find_spans(text, PHONE, "phone", 3), lambda s: F.length(_digits(s["match"])).between(10, 15))
    return F.concat(email, F.when(figures, F.concat(ip, cards, phone)).otherwise(no_spans()))


FEATURES = ("kind", "digits", "length", "luhn", "distinct", "separators", "prefix", "mod97", "for", "against", "glued_before", "glued_after")


def _features(text: Column, s: Column) -> Column:
    """Format and context features of a candidate span, as doubles."""
    match, digits = s["match"], _digits(s["match"])
    before = F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30)))
    last, following = F.substring(before, -1, 1), F.substring(text, s["end"] + 1, 1)
    size = F.length(digits)

    def yes(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    prefix = (
        F.when(s["kind_no"] == 4, digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
        .when(s["kind_no"] == 5, digits.rlike("^[2-9]..[2-9]"))
        .when(s["kind_no"] == 6, ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^...00|0000$"))
        .otherwise(F.lit(True))
    )
    # IBAN: the first four symbols behind the rest, letters as two digits, modulo 97
    flat = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(value, F.lit(0), lambda a, x: (F.when(x > 9, a * 100).otherwise(a * 10) + x) % 97)
    return F.array(
        s["kind_no"].cast("double"),
        size.cast("double"),
        F.length(match).cast("double"),
        yes(F.when(size.between(12, 19), _luhn(digits)).otherwise(F.lit(False))),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        (F.length(match) - F.length(F.regexp_replace(match, "[ ().-]", ""))).cast("double"),
        yes(prefix),
        yes(F.when(s["kind_no"] == 7, rest == 1).otherwise(F.lit(False))),
        yes(before.rlike(FOR)),
        yes(before.rlike(AGAINST)),
        yes(last.rlike("[A-Za-z0-9#$€£_/.-]")),
        yes(following.rlike("[A-Za-z0-9%€_/-]")),
    )


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans that no base span overlaps: array of (span, features)."""
    figures, at = text.rlike("[0-9]"), text.rlike(r"[\[({]at[\])}]")
    groups = []
    for no, (kind, pattern) in enumerate(GENERATORS, 4):
        groups.append(F.when(at if kind == "email_disguised" else figures, find_spans(text, pattern, kind, no)).otherwise(no_spans()))
    free = let(blocks(base), lambda bl: F.filter(F.concat(*groups), lambda s: F.size(overlapping(bl, s)) == 0))
    return F.transform(free, lambda s: F.struct(s.alias("span"), _features(text, s).alias("x")))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (root, left and right split, four leaves), start value, thresholds by kind."""

    trees: tuple[tuple[int, float, int, float, int, float, float, float, float, float], ...]
    start: float
    thresholds: dict[int, float]

    def score(self, x: Column) -> Column:
        """Sum of the trees for a feature array."""
        names = "f0 t0 f1 t1 f2 t2 a b c d".split()
        grown = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)]) for t in self.trees])

        def leaf(t: Column) -> Column:
            low = F.element_at(x, t["f0"] + 1) <= t["t0"]
            left = F.when(F.element_at(x, t["f1"] + 1) <= t["t1"], t["a"]).otherwise(t["b"])
            right = F.when(F.element_at(x, t["f2"] + 1) <= t["t2"], t["c"]).otherwise(t["d"])
            return F.when(low, left).otherwise(right)

        return F.aggregate(grown, F.lit(self.start), lambda acc, t: acc + leaf(t))

    def selected(self, c: Column) -> Column:
        """Whether a candidate's score reaches its kind's threshold."""
        limit = F.lit(float("inf"))
        for kind, value in self.thresholds.items():
            limit = F.when(c["span"]["kind_no"] == kind, value).otherwise(limit)
        return self.score(c["x"]) >= limit


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Feature and threshold of the best second-order gain (0, inf if none)."""
    best = (1e-9, 0, float("inf"))
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            best = max(best, (gain, f, float(t)))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[tuple, float]:
    """Trees of depth two for the logistic loss."""
    start = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    z, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f0, t0 = _split(x, g, h)
        low, leaves, splits = x[:, f0] <= t0, [], []
        for side in (low, ~low):
            f, t = _split(x[side], g[side], h[side]) if side.sum() > 1 else (0, float("inf"))
            splits += [f, t]
            for part in (side & (x[:, f] <= t), side & (x[:, f] > t)):
                value = float(rate * g[part].sum() / (h[part].sum() + 1.0))
                leaves.append(value)
                z[part] += value
        trees.append((int(f0), float(t0), int(splits[0]), float(splits[1]), int(splits[2]), float(splits[3]), *leaves))
    return tuple(trees), start


def evaluate(trees: tuple, start: float, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), start)
    for f0, t0, f1, t1, f2, t2, a, b, c, d in trees:
        z += np.where(x[:, f0] <= t0, np.where(x[:, f1] <= t1, a, b), np.where(x[:, f2] <= t2, c, d))
    return z


def examples(n: int = EXAMPLES, seed: int = 3) -> list[tuple[str, int]]:
    """Snippets with one candidate each, from the formats' grammars: (text, 1 if personal data)."""
    rng = random.Random(seed)

    def num(k: int, first: str = "123456789") -> str:
        return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))

    def luhn_sum(s: str) -> int:
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10

    def card(good: bool) -> str:
        s = num(16, "4562" if good else "0123456789")[:15] + "0"
        s = s[:-1] + str((10 - luhn_sum(s)) % 10)
        if not good:
            s = s[:-1] + str((int(s[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice([s, s, "-".join(s[i : i + 4] for i in range(0, 16, 4)), " ".join(s[i : i + 4] for i in range(0, 16, 4))])

    def iban(good: bool) -> str:
        body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), num(18)
        turned = "".join(str(ord(c) - 55) if c.isalpha() else c for c in body[1] + body[0] + "00")
        check = 98 - int(turned) % 97
        if not good:
            check = (check + rng.randint(1, 90)) % 97 + 1
        s = f"{body[0]}{check:02d}{body[1]}"
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def word() -> str:
        return "".join(rng.choice("aeinorstlm") for _ in range(rng.randint(3, 9)))

    speak = ["call", "phone", "tel", "mobile", "card", "ssn", "iban", "bank", "mail", "contact"]
    against = ["order", "invoice", "ref", "version", "isbn", "serial", "total", "part", "ticket", "code"]
    out = []
    for i in range(n):
        good, kind = bool(rng.getrandbits(1)), i % 6
        pull = rng.random()
        lead = rng.choice(speak if (pull < 0.5) == good else against) if pull < 0.8 or good != (kind in (0, 3)) else word()
        if kind in (0, 3):  # checksums decide
            # a single right card is a base span; two in a row are one chain that the base rule drops
            made, lead = f"{card(good)} {card(good)}" if kind == 0 else iban(good), rng.choice([word(), word(), rng.choice(speak), rng.choice(against)])
        elif kind == 1:
            made = f"{num(3, '23456789' if good else '01')}{rng.choice(' -.')}{num(3, '23456789')}{rng.choice('-.')}{num(4)}"
            made = made if rng.random() < 0.6 else f"({made[:3]}) {made[4:]}"
            lead = rng.choice(speak[:4] if good else against)
        elif kind == 2:
            made = f"{num(3, '12345' if good else '09')}-{num(2)}-{num(4)}"
            lead = rng.choice(["ssn", "social security", "social"] if good else against)
        elif kind == 4:
            made = f"{word()}{rng.choice(['', '.' + word()])} [at] {word()} {rng.choice(['[dot] ', '[dot] '])}{rng.choice(['com', 'org', 'net'])}"
            lead = rng.choice(speak[-2:] if good else against)
        else:
            made = ":".join(f"{rng.getrandbits(16):x}" for _ in range(8))
            lead = rng.choice(["host", "ip", "address", word()] if good else against)
        tail = rng.choice([" ", ". ", ", ", "! "]) + word()
        if not good and rng.random() < 0.3:
            tail = rng.choice(["%", "/7", "_x"]) + tail
        out.append((f"{word()} {word()} {lead}{rng.choice([' ', ': ', ' is '])}{made}{tail} {word()}", int(good)))
    return out


def fit(spark: SparkSession, n: int = EXAMPLES) -> Trees:
    """Fit and calibrate on the examples; every fourth is kept for the thresholds."""
    return _fit(spark, n)


@lru_cache(4)
def _fit(spark: SparkSession, n: int) -> Trees:
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples(n))], "i int, text string, y int")
    base = made.withColumn("base", base_spans(F.col("text")))
    rows = base.select("i", "y", F.explode(candidates(F.col("text"), F.col("base"))).alias("c")).select("i", "y", "c.x").collect()
    rows.sort(key=lambda r: (r["i"], r["x"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    held = np.array([r["i"] // 6 % 4 == 0 for r in rows])
    trees, start = boost(x[~held], y[~held])
    z, thresholds = evaluate(trees, start, x[held]), {}
    for no in range(4, 4 + len(GENERATORS)):
        own = x[held][:, 0] == no
        score, truth = z[own], y[held][own]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        last = np.append(score[order][1:] < score[order][:-1], True)  # equal scores go together
        good = np.nonzero((right >= PRECISION) & last)[0] if len(order) else []
        if len(good):
            thresholds[no] = max(0.0, float(score[order][good[-1]]))
    return Trees(trees, start, thresholds)


def _longest(spans: Column) -> Column:
    """Of spans that overlap, the longest; among equals the first."""

    def beats(a: Column, b: Column) -> Column:
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        return (la > lb) | ((la == lb) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind_no"] < b["kind_no"]))))

    return let(blocks(spans), lambda bl: F.filter(spans, lambda s: ~F.exists(overlapping(bl, s), lambda o: beats(o, s))))


def find_personal_data(df: DataFrame, text: str = "text", out: str = "personal") -> DataFrame:
    """Add ``out``: the ordered spans (base and selected candidates) of each row's whole text."""
    model = fit(df.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = df.withColumn("__base", base_spans(whole)).withColumn("__more", candidates(whole, F.col("__base")))
    chosen = F.transform(F.filter("__more", model.selected), lambda c: c["span"])
    held = held.withColumn("__more", F.when(F.size("__more") > 0, chosen).otherwise(no_spans()))
    return held.withColumn(out, ordered(F.concat(F.col("__base"), _longest(F.col("__more"))))).drop("__base", "__more")


def personal_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base rules, the digest of their spans, and all spans as text."""
    found = find_personal_data(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    spans = F.col("personal")
    base = F.filter(spans, lambda s: s["kind_no"] < 4)

    def count(no: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind_no"] == no)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_email"),
        count(1).alias("n_ip"),
        count(2).alias("n_card"),
        count(3).alias("n_phone"),
        sha256_hex(digest_text(base)).alias("base_sha256"),
        digest_text(spans).alias("spans"),
    )


def redact_personal_data(df: DataFrame, text: str = "text", mask: str = "<PERSONAL>") -> DataFrame:
    """Replace every found span in ``text``; null texts stay null, other columns stay as they are."""
    columns = df.columns
    found = find_personal_data(df, text, "__personal")
    return found.withColumn(text, redact(F.col(f"`{text}`"), F.col("__personal"), mask)).select(*[F.col(f"`{c}`") for c in columns])
