"""BPE against the tokenizers library; media against exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessellar.llm import bpe, media

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts(n):
    rng = random.Random(1)
    pieces = [*"abcdefgh  \n\t'sTHEre19!?.<|>éÉßΣσİıſ\x1c\x85\xa0 ́한글漢字😀ǅﬁẞK", "<|endoftext|>", "<|startoftext|>", "'ll", "'re"]
    return [None, "", " \n", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)), "ab" * 5000 + " x" * 500]


def test_encoding_equals_library(library):
    with open(PATH, encoding="utf-8") as f:
        coder = bpe.Encoder(f.read())
    for t in texts(3000):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = coder.encode(t or "")
        assert packed == struct.pack(f"<{len(ids)}I", *ids), t
        assert coder.decode(bpe.unpack(packed)) == library.decode(ids, skip_special_tokens=False)
    odd = "\0<|STARTOFTEXT|> x"
    assert bpe.unpack(coder.encode(odd)) == library.encode(odd, add_special_tokens=False).ids


def test_every_merge_goes_through_a_tree(library):
    """The trees' counter holds exactly the merges of the distinct pieces, short and long ones."""
    with open(PATH, encoding="utf-8") as f:
        coder = bpe.Encoder(f.read())
    words = ["a", "of", "the", "merging", "internationalisation", "x" * 40, "ab" * 3000]
    for n, w in enumerate(words):
        before = coder.merged[0]
        ids = bpe.unpack(coder.encode(w))
        assert coder.merged[0] - before == len(w) - len(ids), w
        assert coder.encode(w) and coder.merged[0] - before == (len(w) - len(ids)) * (2 if len(w) > bpe.MEMO_LENGTH else 1)


def test_tree_equals_repeated_search():
    rng = random.Random(2)
    pairs = [(a, b) for a in range(40) for b in range(40)]
    rng.shuffle(pairs)
    pairs += pairs[:50]  # a pair given twice keeps its first rank
    made = [rng.randint(0, 39) for _ in pairs]
    merges, ranks = bpe.Merges(pairs[:1000], made[:1000]), {p: r for r, p in reversed([*enumerate(pairs[:1000])])}
    pieces = [[rng.randint(0, 39) for _ in range(n)] for n in [0, 1, 2, 3, 5, 17, 32, 33, 200, 1500] + [rng.randint(2, 40) for _ in range(300)]]
    want, done = [], 0
    for piece in pieces:
        piece = list(piece)
        while len(piece) > 1:
            best = min((ranks.get(p, 10**9), i) for i, p in enumerate(zip(piece, piece[1:])))
            if best[0] == 10**9:
                break
            piece[best[1] : best[1] + 2] = [made[best[0]]]
            done += 1
        want.append(piece)
    for few in (0, 8, 10**9):  # together, or each alone
        bpe.FEW, kept, counter = few, bpe.FEW, [0]
        flat, sizes = bpe.merge_pieces(np.array([x for p in pieces for x in p]), np.array([len(p) for p in pieces]), merges, counter)
        bpe.FEW = kept
        assert flat.tolist() == [x for p in want for x in p] and sizes.tolist() == [len(p) for p in want] and counter == [done]
    assert len(bpe.merge_pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), merges)[0]) == 0


def test_columns_and_digest(spark, library):
    t = texts(60)
    df = spark.createDataFrame([(i if i else None, x, "x") for i, x in enumerate(t)] + [(1, "", "x")], "doc_id long, text string, ids string")
    ids = bpe.encode_column(df, PATH, out="coded")
    back = bpe.decode_column(ids, PATH, ids="coded").collect()
    for r in back:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["coded"]) == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.token_digest(df, PATH).count() == len(t) + 1 == bpe.token_rows(df, PATH).count()
    for r in bpe.token_rows(df, PATH).collect():
        assert r["n_tokens"] == len(r["ids"])
        assert hashlib.sha256(library.decode(list(r["ids"]), skip_special_tokens=False).encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.token_digest(df.limit(0), PATH).count() == 0


def test_media_round_trip(spark):
    t = [None, "", "a" * 575, "a" * 576, "é" * 300, "RIFF GIF89a %PDF-1.4 BM", "x" * 500_000]
    df = spark.createDataFrame([(i, x, b"z") for i, x in enumerate(t)], "doc_id long, text string, media binary")
    got = {r["doc_id"]: r for r in media.media_digest(df).collect()}
    for i, x in enumerate(t):
        raw = (x or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
        stored = media.store_wav(want)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert media.read_wav(stored) == want and r["feature"].startswith("audio/wav")
    assert got[0]["feature"] == got[1]["feature"]


def png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x11\xff\0\x22\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    ogg = b"OggS\0\x02" + b"\0" * 20 + b"\x01\x03abc"
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    wav = media.store_wav(b"abc")
    return {
        "image/png": png(), "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/ogg": ogg,
        "application/pdf": pdf, "audio/wav": wav, "application/gzip": gzip.compress(b"hello" * 99), "application/zip": z.getvalue(),
    }


def test_sniffing_corrects_and_carves(spark):
    made = samples()
    for kind, b in made.items():
        assert media.sniff(b) == [(0, len(b), kind)], kind
        assert media.sniff(b"junk RIFF BM " + b + b" tail GIF89a") == [(13, 13 + len(b), kind)], kind
        assert media.sniff(b[:-1]) == [] or kind == "audio/wav" and len(b) % 2 == 0
    rows = [(1, made["image/png"], "image/gif"), (2, b"text " + made["image/png"] + b".." + made["image/gif"], "text/plain"), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, media binary, declared_type string")
    out = {r["id"]: r for r in media.sniff_column(df).collect()}
    assert out[1]["corrected_type"] == "image/png" and out[1]["is_wrong"]
    assert [c["type"] for c in out[2]["carved"]] == ["image/png", "image/gif"] and out[2]["corrected_type"] == "text/plain"
    assert bytes(out[2]["carved"][1]["bytes"]) == made["image/gif"] and out[3]["carved"] == [] and not out[3]["is_wrong"]


def test_sniffing_equals_naive_scan():
    """Random joins of media, cut media, magic bytes and closing marks, against a look at every offset."""
    rng = random.Random(11)
    made = samples()
    scraps = [*made.values(), *(b[: len(b) // 2] for b in made.values()), *(m for m, _, _ in media.FORMATS), *media.CLOSING, b"x", b"\0" * 9]
    closers = {m: (lambda b, m=m: [i for i in range(len(b)) if b.startswith(m, i)]) for m in media.CLOSING}
    for _ in range(300):
        b = b"".join(rng.choice(scraps) for _ in range(rng.randint(0, 8)))
        zips, starts, ends = (closers[m](b) for m in media.CLOSING)
        marks = media.Marks(media.zip_ends(b, zips), starts, ends)
        want, free = [], 0
        for at in range(len(b)):
            for magic, kind, valid in media.FORMATS:
                if at >= free and b.startswith(magic, at):
                    size = valid(b, at, marks) if valid in (media._zip, media._pdf) else valid(b, at)
                    if size:
                        want.append((at, at + size, kind))
                        free = at + size
        assert media.sniff(b) == want


def test_hostile_values_stay_bounded():
    import gzip
    import time
    import tracemalloc

    bomb = gzip.compress(bytes(64 << 20))
    tracemalloc.start()
    assert media.sniff(bomb + b"tail") == [(0, len(bomb), "application/gzip")]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    began = time.perf_counter()
    assert media.sniff(b"PK\x03\x04" * 100_000) == [] == media.sniff(b"%PDF-1.4 " * 100_000)
    assert time.perf_counter() - began < 10


def test_digests_of_odd_tables(spark):
    df = spark.createDataFrame([("7", "a b", "x"), ("7", "a b", "x"), (None, None, "x"), ("8", "", "x")], "doc_id string, text string, media_sha256 string")
    for rows in (media.media_digest(df).collect(), bpe.token_digest(df, PATH).collect()):
        assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "8", "None"]
        assert len({tuple(r)[1:] for r in rows}) == 2  # equal texts, equal values; null as empty
    assert media.media_digest(df.limit(0)).count() == 0 == bpe.token_digest(df.limit(0), PATH).count()
