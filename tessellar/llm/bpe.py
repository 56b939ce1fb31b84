"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf holds the merge rank of one adjacent pair, each inner node the least rank below
it, so the root yields the lowest rank and, since ranks carry their place, its leftmost
place. A merge changes at most three leaves, each a logarithmic update, until the root
holds no mergeable pair. Every piece of two symbols or more goes through its tree; the
trees of many pieces of like length advance together, one merge each a round, as numpy
arrays. Texts are decoded from their ids.

The vocabulary file is read by the driver and broadcast (its size is checked). Texts are
normalised and cut into words as the file says; words between blanks are encoded once
per worker and kept in a bounded memo.

Null texts count as empty: no tokens, empty decoded text. Texts of any length are
encoded whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import plain, ship, slices, small_batches, spread

NO_MERGE = np.int64(1) << 62
#: Largest vocabulary file that is broadcast, words kept per worker, and their length.
MAX_VOCABULARY_BYTES = 64 << 20
MEMO_WORDS = 150_000
MEMO_LENGTH = 64
#: Leaves of all trees that advance together, trees that do not, and texts looked up together.
CELLS = 1 << 19
FEW = 8
TEXTS = 256
#: Texts made of these alone are normalised by Python itself: NFC leaves them as they are
#: and lower case does not depend on neighbours. Others go through the file's normaliser.
_OTHER = re.compile("[^\t-\r -ʯ‐-‧]")


class PairTrees:
    """Segment trees of pair ranks, one a row, over symbol rows of at most ``leaves`` + 1 symbols.

    Node 1 is the root, node i has the children 2i and 2i + 1, and the leaves come last. A
    value is rank * leaves + place, so the least one is the leftmost of the lowest rank.
    """

    def __init__(self, ranks: np.ndarray):
        n, self.leaves = ranks.shape
        self.bits = self.leaves.bit_length() - 1
        self.nodes = np.full((n, 2 * self.leaves), NO_MERGE, np.int64)
        self.nodes[:, self.leaves :] = self.value(ranks, np.arange(self.leaves))
        width = self.leaves // 2
        while width:
            np.minimum(self.nodes[:, 2 * width : 4 * width : 2], self.nodes[:, 2 * width + 1 : 4 * width : 2], out=self.nodes[:, width : 2 * width])
            width //= 2

    def value(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, NO_MERGE, (rank << self.bits) + place)

    def least(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that still have a mergeable pair, its rank and its place."""
        root = self.nodes[rows, 1]
        live = root < NO_MERGE
        root = root[live]
        return rows[live], root >> self.bits, root & (self.leaves - 1)

    def put(self, rows: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        """Set leaves (rank below 0: no merge) and renew the nodes above them."""
        flat, base = self.nodes.reshape(-1), rows * (2 * self.leaves)
        at = place + self.leaves
        flat[base + at] = self.value(rank, place)
        for _ in range(self.bits):
            at >>= 1
            two = base + 2 * at
            flat[base + at] = np.minimum(flat[two], flat[two + 1])


class Merges:
    """The merge table: ranks by pair of ids, and the id each rank makes."""

    def __init__(self, pairs: Iterable[tuple[int, int]], made: Iterable[int]):
        pairs = [*pairs]
        keys = np.array([(a << 32) + b for a, b in pairs], np.int64)
        self.keys, first = np.unique(keys, return_index=True)  # of a repeated pair the first rank
        self.ranks, self.made = first.astype(np.int64), np.array([*made], np.int64)
        self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no merge."""
        if not len(self.keys):
            return np.full(left.shape, -1, np.int64)
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def _merge_rows(ids: np.ndarray, merges: Merges) -> int:
    """Merge the symbol rows in place (-1: none there; a power of two and one columns); the merges done."""
    n, width = ids.shape
    trees = PairTrees(merges.rank(ids[:, :-1], ids[:, 1:]))
    # neighbours of each symbol still there; column ``width`` stands for none
    after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    rows, done = np.arange(n), 0
    while True:
        rows, rank, i = trees.least(rows)
        if not len(rows):
            return done
        done += len(rows)
        j = after[rows, i]
        k = after[rows, j]
        h = before[rows, i]
        new = merges.made[rank]
        ids[rows, i], ids[rows, j] = new, -1
        after[rows, i], before[rows, k] = k, i
        right = np.where(k < width, ids[rows, np.minimum(k, width - 1)], -1)
        left = np.where(h >= 0, ids[rows, np.maximum(h, 0)], -1)
        gone, held = j < width - 1, h >= 0
        trees.put(
            np.concatenate([rows, rows[gone], rows[held]]),
            np.concatenate([i, j[gone], h[held]]),
            np.concatenate([merges.rank(new, right), np.full(int(gone.sum()), -1), merges.rank(left, new)[held]]),
        )


def _merge_one(ids: np.ndarray, merges: Merges) -> int:
    """Merge one row of symbols in place, its tree as a list; the merges done."""
    n, leaves = len(ids), len(ids) - 1
    size = 1 << max(leaves - 1, 1).bit_length()
    bits = size.bit_length() - 1
    none = int(NO_MERGE)
    ranks, table, made = merges.rank(ids[:-1], ids[1:]).tolist(), merges.table, merges.made
    nodes = [none] * size + [none if r < 0 else (r << bits) + i for i, r in enumerate(ranks)] + [none] * (size - leaves)
    for node in range(size - 1, 0, -1):
        nodes[node] = min(nodes[2 * node], nodes[2 * node + 1])
    row, done = ids.tolist(), 0
    before, after = list(range(-1, n)), list(range(1, n + 1))

    def put(place: int, left: int, right: int) -> None:
        rank = table.get((left << 32) + right, -1) if right >= 0 else -1
        at = place + size
        nodes[at] = none if rank < 0 else (rank << bits) + place
        while at > 1:
            at >>= 1
            low = min(nodes[2 * at], nodes[2 * at + 1])
            if nodes[at] == low:
                break
            nodes[at] = low

    while (root := nodes[1]) < none:
        rank, i = root >> bits, root & (size - 1)
        j = after[i]
        k, h = after[j], before[i]
        row[i], row[j] = int(made[rank]), -1
        after[i], before[k] = k, i
        if j < leaves:
            put(j, -1, -1)
        put(i, row[i], row[k] if k < n else -1)
        if h >= 0:
            put(h, row[h], row[i])
        done += 1
    ids[:] = row
    return done


def merge_pieces(flat: np.ndarray, sizes: np.ndarray, merges: Merges, counter: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all pieces, one after the other, merged lowest rank first and leftmost among equals; and their new sizes.

    Trees of like length advance together, in blocks of at most ``CELLS`` leaves; where only
    a few are left, each goes alone. ``counter[0]`` grows by the merges done.
    """
    flat, ends = flat.copy(), np.cumsum(sizes)
    starts, width, done = ends - sizes, np.zeros(len(sizes), np.int64), 0
    some = sizes > 1
    width[some] = 1 << np.ceil(np.log2(sizes[some] - 1)).astype(np.int64)
    for leaves in np.unique(width[some]).tolist():
        members = np.nonzero(width == leaves)[0]
        step = max(1, CELLS // leaves)
        for at in range(0, len(members), step):
            block = members[at : at + step]
            if len(block) < FEW:
                done += sum(_merge_one(flat[starts[m] : ends[m]], merges) for m in block)
                continue
            there = np.arange(leaves + 1)[None, :] < sizes[block][:, None]
            place = (starts[block][:, None] + np.arange(leaves + 1)[None, :])[there]
            ids = np.full(there.shape, -1, np.int64)
            ids[there] = flat[place]
            done += _merge_rows(ids, merges)
            flat[place] = ids[there]
    if counter is not None:
        counter[0] += done
    kept = np.concatenate([[0], np.cumsum(flat >= 0)])
    return flat[flat >= 0], kept[ends] - kept[starts]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next letter from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Encoder:
    """A vocabulary file of the tokenizers library, with merging done by :func:`merge_pieces`."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        self.normalizer = Tokenizer.from_str(source).normalizer
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        cut, mapped = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        supported = (
            (spec["normalizer"] or {}).get("normalizers") == known
            and (cut.get("type"), cut.get("behavior"), cut.get("invert")) == ("Split", "Removed", True)
            and (mapped.get("type"), mapped.get("add_prefix_space"), mapped.get("use_regex")) == ("ByteLevel", False, False)
            and spec.get("decoder") is None
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        )
        if not supported:
            raise ValueError("only vocabulary files with this normaliser and cutting, plain added tokens and no decoder are supported")
        self.cut = regex.compile(cut["pattern"]["Regex"])
        letters = _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)  # ids of bytes inside a piece
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)  # and at its end
        self.memo: dict[str, bytes] = {}
        self.merged = [0]

    def _symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces' bytes, one piece after the other, and their number in each; bytes that the vocabulary lacks are left out."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        letters = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ids = self.inner[letters]
        ids[ends - 1] = self.final[letters[ends - 1]]
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        return ids[ids >= 0], np.diff(known[ends], prepend=0)

    def _learn(self, words: set[str]) -> None:
        """Put words that the memo lacks into it."""
        memo, find = self.memo, self.cut.findall
        mixed = [(w, find(w)) for w in words if not (w.isascii() and w.isalpha())]
        new = {w for w in words if w.isascii() and w.isalpha()}
        new.update(p for _, ps in mixed for p in ps if p not in memo)
        pieces = [*new]
        if pieces:
            flat, sizes = merge_pieces(*self._symbols(pieces), self.merges, self.merged)
            packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            memo.update(zip(pieces, map(packed.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        for word, parts in mixed:
            if len(parts) != 1 or parts[0] != word:
                memo[word] = b"".join([memo[p] for p in parts])

    def _words(self, text: str) -> list[str]:
        """The text's words, normalised; an added token comes with a blank before it."""
        parts = self.special.split(text) if self.special and "<" in text else (text,)
        words: list[str] = []
        for part in parts:
            if part in self.added:
                words.append(" " + part)
            elif part and _OTHER.search(part):
                words += filter(None, self.normalizer.normalize_str(part).split(" "))
            else:
                words += part.lower().split()
        return words

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        for token, i in self.added.items():
            memo[" " + token] = i.to_bytes(4, "little")
        for at in range(0, len(texts), TEXTS):
            cut = [self._words(t) for t in texts[at : at + TEXTS]]
            missing = set().union(*cut).difference(memo)
            if missing:
                self._learn(missing)
            for words in cut:
                yield b"".join(map(memo.__getitem__, words))
            for word in [w for w in missing if len(w) > MEMO_LENGTH]:
                del memo[word]
            if len(memo) > MEMO_WORDS:
                for old in [*islice(memo, len(memo) - MEMO_WORDS // 2)]:
                    del memo[old]
                for token, i in self.added.items():
                    memo[" " + token] = i.to_bytes(4, "little")

    def encode(self, text: str) -> bytes:
        return [*self.encode_all([text])][0]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings joined by blanks, as for a file without decoder; unknown ids are left out."""
        names = self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except KeyError:
            return " ".join([names[i] for i in ids if i in names])


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@lru_cache(2)
def _encoder(source: str) -> Encoder:
    return Encoder(source)


def _broadcast(df: DataFrame, path: str):
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary file has over {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(source)


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of each whole text as array<long>."""
    source = _broadcast(df, path)

    @F.pandas_udf("array<long>")
    def run(col: pd.Series) -> pd.Series:
        coder = _encoder(source.value)
        return pd.Series([unpack(p) for p in coder.encode_all([t or "" for t in col])])

    return df.withColumn(out, run(F.col(f"`{text}`")))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the decoded text of each id list (null: null)."""
    source = _broadcast(df, path)

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        coder = _encoder(source.value)
        return pd.Series([None if x is None else coder.decode([*x]) for x in col])

    return df.withColumn(out, run(F.col(f"`{ids}`")))


def token_digest(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens, and digests of the ids and of the text decoded from them."""
    source = _broadcast(df, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(source.value)
        for batch in slices(batches):
            n, ids, back = [], [], []
            for packed in coder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(coder.decode(unpack(packed)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names
            )

    return spread(plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and the digest of the text decoded from them."""
    source = _broadcast(df, path)
    names = ["doc_id", "n_tokens", "ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(source.value)
        for batch in slices(batches):
            packed, back, ends = [], [], [0]
            for ids in coder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                packed.append(ids)
                ends.append(ends[-1] + len(ids) // 4)
                back.append(hashlib.sha256(coder.decode(unpack(ids)).encode("utf-8")).hexdigest())
            flat = pa.py_buffer(b"".join(packed))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, flat])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                    pa.array(back, pa.string()),
                ],
                names,
            )

    return spread(plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
