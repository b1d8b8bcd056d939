"""Byte-level BPE encoding and decoding of whole texts by a rank file, with recursive DuckDB queries in each task.

A pattern cuts a text into pieces, and each piece is encoded by itself: a piece that is a token is that token, any other
one starts as a row for each of its bytes (piece, position, token, next token). A recursive query joins the rows with
the merge table (pair of tokens -> token), contracts the leftmost pair of least rank of every piece, and ends when no
piece has a pair in the table. Ids are decoded by a join with the vocabulary and an aggregation in the order of
positions. A task does both for all pieces that are new in a slice of its texts, and keeps a bounded number of pieces.

The query does one contraction of a piece in a step, so its work grows with the square of a piece's length. Pieces of
more than ``PIECE`` bytes (long unsplit text) are therefore cut, their parts are encoded by the same query, and parts are
joined as a tree: at each join the tokens around it are encoded again in a window that grows until its outer tokens are
those of the two sides. A list of tokens is the encoding of its bytes exactly when each neighbouring pair is the
encoding of its own bytes, so this is exact. All joins of a level run in one query.

Null texts count as empty: no tokens, no bytes. Special tokens aren't looked for. All columns of the documents stay but
one of the name of the result; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes from which a piece is cut, and tokens on either side of a join that are encoded again at first.
PIECE, WINDOW = 128, 4
#: Characters of text that a task holds as pieces at a time; longer texts are cut between two pieces.
SLICE_CHARS = 1 << 20
#: Pieces that a task keeps, at about 250 bytes each, and the rows of all steps of a recursive query.
CACHE_PIECES, QUERY_ROWS = 1 << 19, 1 << 21
ENCODED = "struct<n_tokens: long, ids: binary, decoded: binary>"

#: Fixed value: the pattern of the public rank files.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The same over Latin-1, for the standard library, which is twice as fast.
_LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: A row is (w, p, t, n): piece, position, token, and the next token of the piece or -1; a step contracts one pair of each piece.
MERGE_SQL = """
WITH RECURSIVE state AS (
  SELECT w, p, t, n, 0 AS step FROM pieces
  UNION ALL
  (WITH best AS (
     SELECT w, min((m.rank << 16) | p) AS b FROM state JOIN merges m ON m.pair = (t << 32) + n GROUP BY w),
   pick AS (SELECT w, b & 65535 AS spot, b >> 16 AS token FROM best)
   SELECT s.w, p - CAST(p > spot AS BIGINT), CASE WHEN p = spot + 1 THEN token ELSE t END, CASE WHEN p + 1 = spot THEN token ELSE n END, step + 1
   FROM state s JOIN pick ON pick.w = s.w WHERE p <> spot)),
ends AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT w, list(t ORDER BY p) AS ids FROM state JOIN ends USING (w, step) GROUP BY w ORDER BY w
"""
DECODE_SQL = "SELECT w, list(bytes ORDER BY p) AS parts FROM tokens JOIN vocabulary USING (id) GROUP BY w ORDER BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _foreign(pattern: str) -> str:
    """Letters and numbers of the newest Unicode versions that the library of the rank files doesn't take for such, as ranges."""
    import regex
    import tiktoken

    def same_piece(base: str, letters: list[str]) -> set[str]:
        ranks = {bytes([b]): b for b in range(256)} | {base.encode() + bytes([b]): 256 + b for b in range(256)}
        own = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return {c for c in letters if own.encode_ordinary(base + c)[0] >= 256}

    new = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    letters, numbers = regex.findall(r"\p{L}", new), regex.findall(r"\p{N}", new)
    points = np.array(sorted(map(ord, (set(letters) - same_piece("a", letters)) | (set(numbers) - same_piece("1", numbers)))))
    return "".join(f"{chr(points[lo])}-{chr(points[hi - 1])}" for lo, hi in _runs(points - np.arange(len(points))))


class Coder:
    """The merge table and the vocabulary of a rank file in DuckDB, and a bounded cache of pieces."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        pairs = [(left << 32 | right, rank) for token, rank in self.ranks.items() for left, right in self._halves(token)]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), rank=pa.array([r for _, r in pairs], pa.int64()))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int64()), bytes=pa.array(list(self.ranks), pa.binary()))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern, self.latin = regex.compile(pattern), _LATIN if pattern == WORDS else None
        self.cut = regex.compile(r"(?<=\S)\s")
        foreign = _foreign(pattern)
        self.may_differ = self.careful = None
        if foreign:
            self.may_differ = regex.compile(f"[{foreign[0]}-\U0010ffff]")
            own = {rf"\p{{{kind}}}": rf"[\p{{{kind}}}--[{foreign}]]" for kind in "LN"}
            self.careful = regex.compile("(?V1)" + functools.reduce(lambda p, k: p.replace(k, own[k]), own, pattern))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _halves(self, token: bytes) -> Iterator[tuple[int, int]]:
        for k in range(1, len(token)):
            left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if left is not None and right is not None:
                yield left, right

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    # --- encoding ---

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens that the merges leave of each piece, four bytes each; the pieces have a byte or more."""
        out: list[bytes] = []
        sizes = np.array([len(p) for p in pieces], np.int64)
        batch = (np.cumsum(sizes * sizes) - 1) // QUERY_ROWS if len(pieces) else sizes
        for lo, hi in _runs(batch):
            data, size = np.frombuffer(b"".join(pieces[lo:hi]), np.uint8), sizes[lo:hi]
            ends = np.cumsum(size)
            tokens = self.byte_ids[data]
            following = np.append(tokens[1:], -1)
            following[ends - 1] = -1
            self.db.register("pieces", pa.table({
                "w": np.repeat(np.arange(hi - lo), size), "p": np.arange(len(data)) - np.repeat(ends - size, size), "t": tokens, "n": following,
            }))
            ids = self.db.sql(MERGE_SQL).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("pieces")
            data, edges = ids.flatten().to_numpy().astype("<u4").tobytes(), [0, *np.cumsum(4 * ids.value_lengths().to_numpy()).tolist()]
            out += [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def long_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """As ``merged``, for pieces of any length."""
        parts = [[p[k : k + PIECE] for k in range(0, len(p), PIECE)] for p in pieces]
        flat = iter(self.merged([x for p in parts for x in p]))
        trees = [[next(flat) for _ in p] for p in parts]
        while any(len(tree) > 1 for tree in trees):
            joined = iter(self._join([(tree[k], tree[k + 1]) for tree in trees for k in range(0, len(tree) - 1, 2)]))
            trees = [[next(joined) for _ in range(len(tree) // 2)] + tree[len(tree) // 2 * 2 :] for tree in trees]
        return [tree[0] for tree in trees]

    def _join(self, sides: list[tuple[bytes, bytes]]) -> list[bytes]:
        """The encodings of the texts of pairs of encodings. A token is four bytes here."""
        done = [b""] * len(sides)
        todo = [(k, 4 * WINDOW, 4 * WINDOW) for k in range(len(sides))]
        while todo:
            spans = [(k, min(a, len(sides[k][0])), min(b, len(sides[k][1]))) for k, a, b in todo]
            windows = self.merged(self.decode([sides[k][0][-a:] + sides[k][1][:b] for k, a, b in spans]))
            todo = []
            for (k, a, b), window in zip(spans, windows, strict=True):
                left, right = sides[k]
                left_ok, right_ok = a == len(left) or window[:4] == left[-a : 4 - a or None], b == len(right) or window[-4:] == right[b - 4 : b]
                if left_ok and right_ok:
                    done[k] = left[: len(left) - a] + window + right[b:]
                else:
                    todo.append((k, a if left_ok else 2 * a, b if right_ok else 2 * b))
        return done

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of all these pieces into the young half of the cache."""
        if len(self.young) + len(pieces) > CACHE_PIECES // 2:
            self.old, self.young = self.young, {}
        short, long = [], []
        for piece in pieces:
            if piece in self.young:
                continue
            known = self.old.get(piece)
            data = b"" if known else piece.encode()
            if known is None and data in self.ranks:
                known = self.ranks[data].to_bytes(4, "little")
            if known is not None:
                self.young[piece] = known
            else:
                (short if len(data) <= PIECE else long).append((piece, data))
        for found, coded in ((short, self.merged), (long, self.long_pieces)):
            for (piece, _), ids in zip(found, coded([data for _, data in found]), strict=True):
                self.young[piece] = ids

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of a stretch at a time: between no space and a space two pieces meet in any case."""
        at = 0
        while at < len(text):
            end = self.cut.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
            part = text[at : end.start()] if end else text[at:]
            if self.latin and _is_latin(part):
                yield self.latin.findall(part)
            else:
                yield (self.careful if self.careful and self.may_differ.search(part) else self.pattern).findall(part)
            at += len(part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            self.learn(set().union(*(p for _, p in held)))
            for k, pieces in held:
                out[k].append(b"".join(map(self.young.__getitem__, pieces)))
            held.clear()

        for k, text in enumerate(texts):
            for pieces in self.pieces(text or ""):
                held.append((k, pieces))
                size += sum(map(len, pieces))
                if size >= SLICE_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    # --- decoding ---

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; an unknown id raises an error."""
        out, sizes = [b""] * len(ids), np.array([len(x) // 4 for x in ids], np.int64)
        batch = np.cumsum(sizes) // QUERY_ROWS
        for lo, hi in _runs(batch):
            size = sizes[lo:hi]
            tokens = np.frombuffer(b"".join(ids[lo:hi]), "<u4").astype(np.int64)
            self.db.register("tokens", pa.table({"w": np.repeat(np.arange(lo, hi), size), "p": np.arange(len(tokens)), "id": tokens}))
            found = self.db.sql(DECODE_SQL).to_arrow_table().combine_chunks()
            self.db.unregister("tokens")
            if pc.sum(pc.list_value_length(found.column("parts"))).as_py() != (len(tokens) or None):
                raise ValueError("an id isn't in the vocabulary")
            for w, parts in zip(found.column("w").to_pylist(), found.column("parts"), strict=True):
                first, last, data = _span(parts.values)
                out[w] = data[first:last].to_pybytes()
        return out


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _span(parts: pa.Array) -> tuple[int, int, pa.Buffer]:
    """Where the bytes of consecutive binary values begin and end in their buffer."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)
    return int(offsets[parts.offset]), int(offsets[parts.offset + len(parts)]), parts.buffers()[2]


def _runs(batch: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal numbers."""
    cuts = np.flatnonzero(np.diff(batch)) + 1
    edges = [0, *cuts.tolist(), len(batch)] if len(batch) else []
    return list(zip(edges[:-1], edges[1:], strict=True))


@functools.lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker and file."""
    return Coder(path, pattern)


def _slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    return _runs(np.cumsum(np.array(sizes, np.int64)) // most)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "encoded") -> DataFrame:
    """``docs`` with a column ``out`` of n_tokens, ids (little-endian unsigned 32-bit numbers) and what they decode to."""

    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        own, done = coder(path, pattern), []
        for lo, hi in _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 4 * SLICE_CHARS):  # few Python strings at a time
            ids = own.encode(texts.slice(lo, hi - lo).to_pylist())
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())]
            done.append(pa.StructArray.from_arrays(columns, names=["n_tokens", "ids", "decoded"]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]))

    return docs.drop(out).withColumn(out, encode(F.col(text_col)))


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out`` of the bytes of ids as ``encode_texts`` gives them; null ids give null."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own, values = coder(path, pattern), ids.to_pylist()
        return pa.array([None if x is None else y for x, y in zip(values, own.decode([x or b"" for x in values]), strict=True)], pa.binary())

    return df.drop(out).withColumn(out, decode(F.col(ids_col))) if out != ids_col else df.withColumn(out, decode(F.col(ids_col)))
