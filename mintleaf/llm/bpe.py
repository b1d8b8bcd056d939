"""BPE encoding and decoding of whole texts with a given tokenizer file; tree concatenation for long text.

A tokenizer that drops white space before BPE encodes every word of a text by itself, so tasks keep a bounded cache
from pieces of words to their tokens. A text of ``long_text`` characters or more isn't encoded in one go, as one task
would have it alone, and BPE on unsplit text is slow: it is cut into leaves of ``leaf`` characters, in the middle of the
word that a leaf ends on, and longer unsplit pieces into as many leaves as they need. The leaves of all texts are
encoded in parallel by Spark, and the results are joined as a tree. At each join the last tokens of the left side and
the first of the right side are encoded again as one window, which grows until its first token is the left side's and
its last one the right side's. A token list is the BPE encoding of its piece exactly when each neighbouring pair is, so
the joined list is exact; between pieces nothing merges.

For any other tokenizer than the word-splitting one long texts are encoded whole.

Null texts count as empty: no tokens and an empty decoded text. All columns of the documents stay; repeated rows are
encoded each. The ids come as decimal numbers joined by one space (``token_ids`` makes an array of them).
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintleaf.llm.common import fresh, written

#: Characters from which a text is cut into leaves, and the characters of a leaf.
LONG_TEXT, LEAF = 1 << 15, 1 << 13
#: Pieces that a task's cache holds, at about 250 bytes each.
CACHE_PIECES = 1 << 17
#: Texts of an Arrow batch that are Python strings at a time.
SLICE = 256
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 8
ENCODED = "struct<n_tokens: long, ids: string, decoded: string>"

#: Fixed value: the pattern of the word-splitting tokenizer for which the word cache holds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over lower-cased Latin-1, where normalisation changes nothing else.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \n0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
_PLAIN_BYTES = bytes([0x0A, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_WORDS = re.compile(r"[^ \n]+")


def _plain(text: str) -> bool:
    """Whether a text holds only Latin-1 letters and signs, spaces and line feeds."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return False


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Cache(dict):
    """Key -> made value, in two generations: what isn't asked for while one fills up goes with the older one."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        if len(key) > 512:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


class Encoder:
    """The tokenizer of a file, with caches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = bool(steps) and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("invert") and spec["decoder"] is None
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.whole = models.BPE(vocab=model["vocab"], merges=merges, **({"end_of_word_suffix": self.suffix} if self.suffix else {}))
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")") if spec["added_tokens"] else None
        self.letters = _byte_letters()
        self.pieces = _Cache(self._piece, CACHE_PIECES)
        self.words = _Cache(self._word, CACHE_PIECES // 8)
        self.token_of = {str(i): t for t, i in self.ids.items()}

    def _piece(self, piece: str) -> str:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return " ".join([str(t.id) for t in self.whole.tokenize(letters)])

    def _word(self, word: str) -> str:
        return " ".join(map(str, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def encode(self, text: str) -> str:
        """The ids."""
        if not self.by_word:
            return self._word(text)
        if _plain(text) and "<|" not in text:
            return " ".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return " ".join(filter(None, map(self.words.__getitem__, _WORDS.findall(text))))

    def decode(self, ids: str) -> str:
        if self.by_word:  # without a decoder the tokens are joined by spaces
            return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""
        return self.tokenizer.decode(list(map(int, ids.split())), skip_special_tokens=False)

    # --- long pieces ---

    def tokens(self, letters: str, last: bool) -> list[str]:
        """Token strings of byte letters that end a piece (last) or lie inside one."""
        return [t.value for t in (self.whole if last else self.inner).tokenize(letters)]

    def join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        """The encoding of the text of two lists of tokens; ``last``: the right one ends its piece."""
        if not left or not right:
            return left or right
        a = b = WINDOW
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            ends = last and b == len(right)
            letters = "".join(left[-a:]) + "".join(right[:b])
            window = self.tokens(letters.removesuffix(self.suffix) if ends and self.suffix else letters, ends)
            left_ok, right_ok = a == len(left) or window[0] == left[-a], b == len(right) or window[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_ok else 2 * a, b if right_ok else 2 * b

    def join_all(self, leaves: list[list[str]]) -> list[str]:
        """Joins neighbours, level by level."""
        while len(leaves) > 1:
            last = len(leaves) // 2 * 2 == len(leaves)
            pairs = [self.join(leaves[k], leaves[k + 1], last and k + 2 == len(leaves)) for k in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(leaves) // 2 * 2 :]
        return leaves[0] if leaves else []

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[int, bool, str]]:
        """(piece number or -1 for whole words, whether it ends its piece, words or byte letters), in text order.

        Pieces are cut where the words before them fill a leaf, and where they are longer than a leaf.
        """
        piece, plain, size = 0, [], 0
        for word in _WORDS.findall(text):
            if size + len(word) < leaf:
                plain.append(word)
                size += len(word)
                continue
            for part in self.special.split(word) if self.special else [word]:
                if not part:
                    continue
                if self.special and self.special.fullmatch(part):
                    plain.append(part)
                    continue
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    if plain:
                        yield -1, True, " ".join(plain)
                        plain, size = [], 0
                    step = leaf if len(letters) > leaf else max(1, len(letters) // 2)
                    for at in range(0, len(letters), step):
                        yield piece, at + step >= len(letters), letters[at : at + step]
                    piece += 1
        if plain:
            yield -1, True, " ".join(plain)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def _struct(ids: list[str], decoded: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
        names=["n_tokens", "ids", "decoded"],
    )


def token_ids(ids: Column) -> Column:
    """Array of the ids in a joined string."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", out: str = "encoded", long_text: int = LONG_TEXT, leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column ``out`` of type struct<n_tokens, ids, decoded>; a column of that name gives way."""

    @F.arrow_udf(ENCODED)
    def whole(texts: pa.Array) -> pa.Array:
        own, parts = encoder(path), []
        for at in range(0, max(len(texts), 1), SLICE):  # few Python strings at a time
            ids = [own.encode(t) for t in texts.slice(at, SLICE).to_pylist()]
            parts.append(_struct(ids, [own.decode(x) for x in ids]))
        return pa.concat_arrays(parts)

    docs = docs.drop(out)
    text, uid = F.coalesce(F.col(text_col), F.lit("")), fresh(docs, "_uid")
    if not encoder(path).by_word:
        return docs.withColumn(out, whole(text))
    is_long = F.length(text) >= long_text
    plain = docs.filter(~is_long).withColumn(out, whole(text))
    # numbered and written with all columns, so that leaves and rows have the same numbers
    long = written(docs.filter(is_long).withColumn(uid, F.monotonically_increasing_id()), "longtexts")
    joined = _encode_long(long.select(F.col(uid).alias("uid"), text.alias("text")), path, leaf)
    return plain.unionByName(long.join(joined.withColumnsRenamed({"uid": uid, "encoded": out}), uid).select(*[F.col(f"`{c}`") for c in plain.columns]))


def _encode_long(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """(uid, encoded) of long texts: their leaves are dealt out, encoded, and joined for each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(uid, k, *x) for k, x in enumerate(encoder(path).leaves(text, leaf))]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["uid", "seq", "piece", "last", "text"])

    @F.arrow_udf("string")
    def encode_leaf(piece: pa.Array, last: pa.Array, text: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.encode(t) if p < 0 else " ".join(own.tokens(t, e)) for p, e, t in zip(piece.to_pylist(), last.to_pylist(), text.to_pylist(), strict=True)])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:  # one text
        own, ids, open_leaves, at = encoder(path), [], [], None
        rows = table.sort_by("seq").select(["piece", "tokens"]).to_pylist()
        for row in [*rows, {"piece": None, "tokens": ""}]:
            if open_leaves and row["piece"] != at:
                ids += [str(own.ids[t]) for t in own.join_all(open_leaves)]
                open_leaves = []
            at = row["piece"]
            if at == -1:
                ids += row["tokens"].split()
            elif at is not None:
                open_leaves.append(row["tokens"].split(" "))
        joined = " ".join(ids)
        return pa.table({"uid": pa.array([key[0].as_py()], pa.int64()), "encoded": _struct([joined], [own.decode(joined)])})

    leaves = long.mapInArrow(cut, "uid long, seq long, piece long, last boolean, text string").repartition("uid", "seq")
    return (
        leaves.withColumn("tokens", encode_leaf("piece", "last", "text")).select("uid", "seq", "piece", "tokens")
        .groupBy("uid").applyInArrow(join, f"uid long, encoded {ENCODED}")
    )
