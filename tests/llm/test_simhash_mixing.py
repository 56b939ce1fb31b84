"""SimHash components against all pairs; the cube method's balances."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessellar.llm import mixing, simhash
from tessellar.llm.graph import components


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near(rng, n, groups):
    base, out = [rng.getrandbits(64) for _ in range(groups)], []
    for _ in range(n):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


def test_fingerprint_equals_definition(spark):
    texts = [None, "", "  ", "a b", "A b c", "the É cat sat\x0bon a\x85b  mat the cat sat", "x " * 50]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    # Spark's xxhash64 is the same hash
    df = spark.createDataFrame([("the é cat",)], "s string").select(F.xxhash64("s"))
    assert df.first()[0] % 2**64 == xxhash.xxh64_intdigest("the é cat".encode(), 42)


def test_links_within_and_across_shards_equal_all_pairs(spark):
    rng = random.Random(3)
    for groups, shard in ((3, 40), (40, 60)):
        fps = sorted(set(near(rng, 260, groups) + [rng.getrandbits(64) for _ in range(100)]))
        want = brute_components(fps)
        got = simhash.link(np.array(fps, np.uint64), np.ones(len(fps), bool), leaf=16)
        assert got.tolist() == want
        df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
        stars = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df, shard=shard)).collect()}
        classes = {}
        for f, w in zip(fps, want):
            classes.setdefault(w, set()).add(stars.get(f, f))
        assert all(len(x) == 1 for x in classes.values()) and len(set().union(*classes.values())) == len(classes)


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, i) for i in range(201, 260)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges] + [(7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100 and all(got[i] == 200 for i in range(201, 260))
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_of_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    long = [rng.choice(words) for _ in range(600)]
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(long).upper(), None, "", " ", "other text here now", "a"]
    rows = [(i, t, f"f{i}") for i, t in enumerate(texts)] + [(None, "lonely words of nobody at all", "n"), (3, None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    by = {}
    for (i, _, _), c in zip(rows, label):
        if i is not None:
            by[c] = min(by.get(c, i), i)
    want = [str((i, f"{f:016x}", by.get(c))) for (i, _, _), f, c in zip(rows, fps, label)]
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == sorted(want)
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(by.values())) and kept.count(None) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()


def test_targets_share_again():
    assert mixing.source_targets([("a", 10), ("b", 10), ("c", 10)]) == [5.0, 10.0, 15.0]
    got = mixing.source_targets([("a", 1000), ("b", 1), ("c", 1), (None, 0)])
    assert got[1:] == [3.0, 3.0, 0.0] and abs(sum(got) - 1002) < 1e-9
    assert mixing.source_targets([]) == []


def test_flight_keeps_totals():
    rng = random.Random(6)
    size = [float(rng.randint(1, 900)) for _ in range(500)]
    chance = [rng.random() for _ in size]
    done = mixing.flight(size, chance, 2)
    assert sum(0 < x < 1 for x in done) <= 2 and abs(sum(done) - sum(chance)) < 1e-6
    assert abs(np.dot(size, done) - np.dot(size, chance)) < 1e-4
    assert mixing.flight([5.0] * 9, [0.5] * 9, 2).count(0.5) <= 2


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 80, 300])), rng.choice(["s1", "s2", "S3", None]), "x") for i in range(900)]
    rows += [(1000, None, "s1", "x"), (1001, "", "tiny", "x"), (1002, " \n", None, "x"), (5, rows[5][1], rows[5][2], "x"), (None, "a b", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    whole = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "BLOCK", 64)
    for got in (whole, mixing.mix(df).collect()):
        assert len(got) == len(rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        by = {}
        for r in got:
            t = by.setdefault((r["source_size"], r["target"]), [0, 0])
            t[0] += r["taken"]
            t[1] += r["size"]
        for (size, target), (taken, own) in by.items():
            assert own == size and abs(taken - target) <= max(3, 0.003 * target)
    again = mixing.mix(df.repartition(7)).collect()
    monkeypatch.undo()
    again2 = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, whole)) == sorted(map(key, again2)) and len(again) == len(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0cd\r\n", "x\x85y z\xa0w", "xx x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n"))
    for r in df.collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["i"]] or ""))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    en, de = ["the", "of", "and", "with", "over", "thing"], ["der", "und", "nicht", "über", "schön", "keit"]

    def doc(lang):
        return " ".join(rng.choice(en if lang == "en" else de) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(30, 120)))

    rows = [(i, doc("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", 5) for i in range(80)]
    rows += [(90, "12345 !!!", "en", "s1", 9), (91, rows[3][1], "en", "s1", 9), (92, None, None, "s2", None)]
    rows += [(93, doc("en") + " password: hunter2hunter2", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r["doc_id"] for r in s} for s in seen]
    assert 90 not in ids[0] and 92 not in ids[0] and {3, 91, 93} <= ids[0] and len(ids[0]) >= 80
    assert 91 not in ids[1] and 3 in ids[1] and len(seen[1]) == len(ids[1])
    masked = {r["doc_id"]: r for r in seen[2]}
    assert masked[93]["text"].endswith("<SECRET>") and masked[93]["n_chars"] == len(masked[93]["text"]) and ids[2] == ids[1]
    words = sum(len(r["text"].split()) for r in seen[2])
    assert abs(sum(len(r["text"].split()) for r in seen[3]) - words) < 0.2 * words and ids[3] <= ids[2]
    assert len(seen[4]) == len(seen[3]) and corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_mix_decides_row_by_row(spark):
    rng = random.Random(12)

    def rows_of(source, n, words, ids):
        return [(i, f"{source} {rng.random()}" + " w" * (words - 2), source, "x") for i in ids(n)]

    nobody, one, own = (lambda n: [None] * n), (lambda n: [7] * n), (lambda n: range(1000, 1000 + n))
    # targets: a 5003 of 15010 words, b 10006 of 10000 (so 6 words are a part), c 15010 of 5010
    rows = rows_of("a", 1501, 10, nobody) + rows_of("b", 500, 20, one) + rows_of("c", 250, 20, own) + rows_of("c", 1, 10, nobody)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    got = corpus_pipeline.mix_sources(spark, df, "")
    assert got.columns == df.columns
    got = got.collect()
    words = {}
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    sizes = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in "abc"}
    targets = dict(zip("abc", mixing.source_targets([(s, sizes[s]) for s in "abc"])))
    # what is delivered is what op8 takes, word by word
    taken = {}
    for r in mixing.mix(df).collect():
        s = next(x for x in "abc" if abs(targets[x] - r["target"]) < 1e-6)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert words == taken and all(abs(words[s] - targets[s]) <= 0.002 * targets[s] + 1 for s in words)
    whole = {t for _, t, _, _ in rows}
    assert all(r["text"] in whole or any(t.startswith(r["text"]) for t in whole) for r in got)
    again = corpus_pipeline.mix_sources(spark, df.repartition(5), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert corpus_pipeline.mix_sources(spark, df.limit(0), "").count() == 0


def test_first_words(spark):
    texts = ["a b c", "  a\tb\n ", "one", " x  y z "]
    df = spark.createDataFrame([(t, k) for t in texts for k in range(1, 4)], "t string, k long").withColumn("cut", mixing.first_words(F.col("t"), F.col("k")))
    for r in df.collect():
        assert r["cut"].split() == r["t"].split()[: r["k"]] and r["t"].startswith(r["cut"])


def test_mix_hot_class_and_many_sources(spark, monkeypatch):
    """A third of all rows is one repeated row; sources planned in Spark get the same targets as on the driver."""
    rows = [(None, "a b c", "hot")] * 700 + [(i, "w " * (i % 9 + 1), f"s{i % 37}é" if i % 5 else None) for i in range(1300)] + [(9, "big " * 5000, "s1é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in mixing.mix(df).collect() if r["doc_id"] is not None)
    hot = [r for r in mixing.mix(df).collect() if r["doc_id"] is None]
    assert len(hot) == 700 and abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3 and {r["taken"] for r in hot} <= {0, 1, 2, 3, 6, 9}
    monkeypatch.setattr(mixing, "EXPAND", 64)
    assert sorted(tuple(r) for r in mixing.mix(df).collect() if r["doc_id"] is not None) == want
    totals = df.select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("classes"))
    here, most = mixing.plan_sources(totals)
    there, most2 = mixing.plan_sources(totals, driver_sources=3)
    assert sorted(map(str, here.collect())) == sorted(map(str, there.collect())) and most == most2


def test_keep_one_row_by_row(spark):
    """Rows that share an id stay if their texts differ; copies go, with and without id."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    near = text[5] + " end"
    assert bin(simhash.fingerprint(text[5]) ^ simhash.fingerprint(near)).count("1") <= 2
    rows = [(1, text[0], "x"), (1, text[1], "y"), (1, text[1], "z"), (2, text[0], "x"), (None, text[2], "n"), (None, text[2], "n"), (None, text[3], "n"), (5, text[3], "v")]
    rows += [(None, text[5], "n"), (None, near, "m"), (4, text[4], "k"), (4, text[4], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("row", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    out = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(1, text[0]), (1, text[1]), (None, text[2]), (5, text[3]), (4, text[4]), next(o for o in out if o[1] in (text[5], near))]))
    again = simhash.keep_one(df.repartition(4)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.collect()))


def test_shards_keep_their_size():
    rng = np.random.default_rng(8)
    assert [simhash.sample_size(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [16_384, 16_384, 80_000, 8_000_000, 8_000_000]
    for total in (10**6, 10**8, 10**9):
        sample = rng.integers(0, 2**64, simhash.sample_size(total), dtype=np.uint64)
        tree = simhash.ShardTree(sample, total)
        fresh = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
        at_home = np.zeros(tree.leaves, int)
        for no, at, home in tree.route(fresh):
            if home:
                at_home[no] += len(at)
        assert at_home.sum() == len(fresh)
        # few shards get more fresh ones than the mean of a full shard, by chance alone
        assert np.mean(at_home * (total / len(fresh)) > 4 * simhash.SHARD) < 0.02 + (total > 10**8) * 0.2


def test_components_split_hot_nodes(spark, monkeypatch):
    from tessellar.llm import graph

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(30)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(250)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = sorted(map(tuple, graph.components(df).collect()))
    for name, value in (("BROADCAST_EDGES", 0), ("HOT", 20), ("SALTS", 4)):
        monkeypatch.setattr(graph, name, value)
    assert sorted(map(tuple, graph.components(df).collect())) == want
