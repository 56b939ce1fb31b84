"""Oracle SQL against the operators, on texts that exercise every branch."""

import random

import duckdb

from tessellar.llm import secrets
from tessellar.llm.oracles import SECRETS


def test_secret_scans_equal_sql(spark, tmp_path):
    rng = random.Random(11)
    high = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = lambda n, a=high: "".join(rng.choice(a) for _ in range(n))
    pieces = [" ", " ", "é ", "token=", "secret: ", "AKIA", "AKIAABCDEFGHIJKLM", "a1" * 20, "xxxx"]
    texts = [None, ""] + ["".join(rng.choice([*pieces, run(30), run(24, "0123456789abcdef"), run(40, "0123456789ABCDEF"), run(35, "0123456789abcdef"), run(50)]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in secrets.secret_digest(df).collect())
    con = duckdb.connect()
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    con.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
    want = sorted(con.execute(f"select doc_id, n_assign, n_access, n_hex, base_sha256, spans from ({SECRETS})").fetchall())
    assert sum("entropy" in w[5] for w in want) > 100
    assert [g for g, w in zip(got, want) if g != w] == []
