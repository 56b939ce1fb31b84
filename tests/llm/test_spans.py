"""Secrets and personal data against brute force."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tessellar.llm import pii, secrets
from tessellar.llm.spans import SPAN, blocks, find_spans, ordered, overlapping, redact

SCHEMA = "doc_id long, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans)).encode()).hexdigest()


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_personal(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def fuzz(rng, pieces, n):
    return [None, "", "é" * 40, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def test_offsets_equal_finditer(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab😀é\n") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = frame(spark, texts).select("doc_id", find_spans(F.col("text"), "[ab]b+", "k", 0).alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["end"], s["match"]) for s in r["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]b+", texts[r["doc_id"]])]


def test_secret_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    pieces = [*"aF0=: \"'.é😀", "token", "API_KEY", "apikey", "PassWord", "secret", "AKIA", "AKIAABCDEFGHIJKLM", "0af3" * 9, "=", "deadbeef1"]
    texts = fuzz(rng, pieces, 400)
    for r in secrets.secret_digest(frame(spark, texts)).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == k for w in want) for k in range(3)]
        assert {f"{k}:{a}:{e}" for a, _, e, k in want} <= set(r["spans"].split(","))


def test_entropy_windows_equal_direct_counts(spark):
    rng = random.Random(6)
    k = secrets.CLASSES[1]
    texts = ["".join(rng.choice(k.alphabet if rng.random() < 0.7 else "ab1") for _ in range(rng.randint(20, 90))) for _ in range(40)]
    texts += ["a" * 60 + "1", "".join(rng.choice(k.alphabet) for _ in range(45)) + "a1" * 30 + "".join(rng.choice(k.alphabet) for _ in range(45))]
    fold = secrets._fold_windows(F.col("text"), k.alphabet, k.window, k.bits)
    most = round(secrets.SCALE * k.window * (math.log2(k.window) - k.bits))
    for r in frame(spark, texts).select("doc_id", fold.alias("s")).collect():
        t, want = texts[r["doc_id"]], []
        for a in range(len(t) - k.window + 1):
            w = t[a : a + k.window]
            if sum(round(secrets.SCALE * c * math.log2(c)) for c in map(w.count, set(w))) <= most:
                if want and a <= want[-1][1]:
                    want[-1][1] = a + k.window
                else:
                    want.append([a, a + k.window])
        assert [[s["start"], s["end"]] for s in r["s"]] == want


def test_allow_list_and_redaction(spark):
    rng = random.Random(7)
    high = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(44))
    texts = [f"x {high}1 y", "id 123e4567-e89b-12d3-a456-426614174000", "some/long/path-to/a_file2", "donaudampfschifffahrtsgesellschaft", f"token = '{high}'!"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_digest(df).collect()}
    assert spans[0].startswith("entropy:2:")
    assert spans[1] == spans[2] == spans[3] == ""
    assert spans[4].startswith("assign:0:") and "entropy" not in spans[4]
    out = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert out[0]["text"] == "x <SECRET> y" and out[4]["text"] == "<SECRET>'!" and out[3]["text"] == texts[3]
    assert all(r["base"] == "keep" for r in out.values())


def test_personal_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    pieces = [*"0123456789..--  ++@ab()%_é\n", "@a.b", "255.", "4111111111111111", "+1 (555) 123-4567"]
    texts = fuzz(rng, pieces, 600)
    for r in pii.personal_digest(frame(spark, texts)).collect():
        want = brute_personal(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w[1] == k for w in want) for k in range(4)]


def test_trees_add_spans_and_leave_plain_numbers_alone(spark):
    texts = [
        "two cards 5500005555555559 4111111111111111 here",
        "my ssn 123-45-6789 please",
        "write to jo.doe [at] mail [dot] com today",
        "order 1234567890123456 of 2024-01-02",
        "version 10.2.3 build 555 and pages 100-200",
        "call (212) 555-0187 now",
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_digest(frame(spark, texts)).collect()}
    assert "card_part:" in got[0] and "national_id:7:18" in got[1] and "email_disguised:" in got[2] and "phone_local:" in got[5]
    assert got[3] == got[4] == ""


def test_column_scores_equal_numpy(spark):
    model = pii.fit(spark)
    df = spark.createDataFrame(pii.examples(300, seed=9), "text string, y int").withColumn("b", pii.base_spans(F.col("text")))
    rows = df.select(F.explode(pii.candidates(F.col("text"), F.col("b"))).alias("c")).select("c.x", model.score(F.col("c.x")).alias("z")).collect()
    import numpy as np

    assert rows and np.allclose(pii.evaluate(model.trees, model.start, np.array([r["x"] for r in rows])), [r["z"] for r in rows])


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.secret_digest(empty).count() == pii.personal_digest(empty).count() == 0
    long = frame(spark, ["1." * 50_000 + "a@b.c" + " 1-2" * 50_000, "token" + " " * 200_000, "f" * 200_000, "f" * 200_000])
    assert [r["n_hex"] for r in secrets.secret_digest(long).orderBy("doc_id").collect()] == [0, 0, 1, 1]
    assert [r["n_email"] for r in pii.personal_digest(long).orderBy("doc_id").collect()] == [1, 0, 0, 0]


def test_blocks_and_redaction_equal_plain_loops(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(0, 400)))
        spans = sorted({(a, 0, min(len(text), a + rng.randint(1, 9)), "k", "") for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 5, 90]) if text else 0))})
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans array<{SPAN}>")
    probe = F.transform("spans", lambda s: F.transform(overlapping(blocks(F.col("spans")), s), lambda o: o["start"]))
    for r in df.select("doc_id", redact(F.col("text"), ordered(F.col("spans")), "#").alias("out"), probe.alias("met")).collect():
        _, text, spans = rows[r["doc_id"]]
        out, at = "", 0
        for a, _, e, _, _ in spans:
            out, at = (out if a < at else out + text[at:a] + "#"), max(at, e)
        assert r["out"] == out + text[at:]
        assert [sorted(m) for m in r["met"]] == [sorted(o[0] for o in spans if o[0] < s[2] and o[2] > s[0]) for s in spans]


def test_personal_selection_equals_brute_force(spark):
    """Generators, the base spans' precedence, thresholds and the longest of overlapping ones, against plain loops."""
    import numpy as np

    rng = random.Random(22)
    pieces = [t for t, _ in pii.examples(200, seed=5)] + [" ", " call ", "4111111111111111", "123-45-6789", "a@b.cd ", "DE", "1234 ", "::", "+1 (555) 123-4567"]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(250))]
    model = pii.fit(spark)
    df = frame(spark, texts).withColumn("base", pii.base_spans(F.coalesce("text", F.lit(""))))
    scored = {r["doc_id"]: r["c"] for r in df.select("doc_id", pii.candidates(F.coalesce("text", F.lit("")), F.col("base")).alias("c")).collect()}
    some = 0
    for r in pii.personal_digest(frame(spark, texts)).collect():
        text, base = texts[r["doc_id"]] or "", brute_personal(texts[r["doc_id"]])
        found = []
        for no, (kind, pattern) in enumerate(pii.GENERATORS, 4):
            found += [(m.start(), no, m.end(), kind) for m in re.finditer(pattern, text)]
        found = [f for f in found if not any(b[0] < f[2] and b[2] > f[0] for b in base)]
        x = {(c["span"]["start"], c["span"]["kind_no"], c["span"]["end"], c["span"]["kind"]): list(c["x"]) for c in scored[r["doc_id"]]}
        assert sorted(x) == sorted(found)
        good = [f for f in found if pii.evaluate(model.trees, model.start, np.array([x[f]]))[0] >= model.thresholds.get(f[1], np.inf)]
        rank = lambda f: (f[0] - f[2], f[0], f[1])
        kept = [f for f in good if not any(o != f and o[0] < f[2] and o[2] > f[0] and rank(o) < rank(f) for o in good)]
        some += len(kept)
        assert r["spans"] == ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(base + kept))
    assert some > 50
