"""The Merkle manifest, byte-level BPE and the prefix trie against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from mintleaf.llm import byte_bpe, merkle, prefix_trie, queries
from mintleaf.llm.common import with_row_index

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def run(query, spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return query(spark, str(tmp_path))


def test_row_index(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    df = with_row_index(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "index")
    assert [r["index"] for r in df.orderBy("a", "b").collect()] == list(range(3000))


# --- 11 ---


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            at = own[k] % 8
            mates = nodes[own[k] - at : own[k] - at + 8]
            path.append(("".join(mates[:at]), "".join(mates[at + 1 :])))
            own[k] //= 8
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0] if nodes else None, paths


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def manifest_of(rows):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [tree_of([leaf_of(r) for r in langs[x]]) for x in order]
    root, upper = tree_of([t[0] for t in trees])
    for x, (subroot, paths), rest in zip(order, trees, upper, strict=True):
        for row, path in zip(langs[x], paths, strict=True):
            path = path + rest
            now = leaf_of((*row[:4], lower(row[4]))) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else leaf_of(row)
            for left, right in path:
                now = sha(left + now + right)
            yield row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in path)), now, now == root


@pytest.mark.parametrize(("n", "langs"), [(0, 1), (1, 1), (9, 2), (1200, 1), (1500, 14)])
def test_merkle_manifest(spark, tmp_path, n, langs):
    rng = random.Random(n)
    names = [None, "Å", *(f"l{k}" for k in range(langs))][: langs + 1]
    rows = [(k, rng.choice(["s", None]), rng.choice(names[:langs]), rng.choice([5, None]), rng.choice(["Abc é", "abc", None, ""])) for k in range(n)]
    if langs > 1:
        rows += [rows[0], (None, *rows[1][1:]), rows[3], (-7, "x", "only one", 1, "A" * 30000)]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"tree": F.lit("t"), "digest": F.lit(1), "id": F.lit(2)})
    found = run(queries.op11_merkle_manifest, spark, tmp_path, "documents", df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(found.collect()) == by_text(manifest_of(rows))


# --- 12 ---


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def odd_texts():
    rng = random.Random(1)
    texts = ["", "a" * 3000, "".join(rng.choice("acgt") for _ in range(5000)), "日本語テキスト" * 300, " " * 2000, "\n\n  x  \n", "it's we'll I'M 'S", "՘a1՘", "😀" * 300, "é́​ x\x1c\x1dy\xa0\x85 z", "1234567890" * 99, "<|endoftext|>"]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(150)) for _ in range(60)]


def test_byte_bpe_is_the_library(spark, tmp_path, library):
    texts = [*odd_texts(), None, "again", "again"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"encoded": F.lit(1), "ids": F.lit(1), "w": F.lit(0)})
    found = {r[0]: tuple(r)[1:] for r in run(queries.op12_byte_bpe, spark, tmp_path, "documents", df).collect()}
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert found[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(text or "")), text
    decoded = byte_bpe.decode_ids(byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN).select("text", "encoded.ids"), RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "").encode() for r in decoded.collect())
    assert byte_bpe.encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_letters_of_every_script(library):
    """Every code point behind a letter, a number and a sign is cut as the library cuts it."""
    coder = byte_bpe.coder(RANKS, public_tokenizers.PATTERN)
    texts = ["".join(f"a{chr(k)}1{chr(k)}!{chr(k)} " for k in range(lo, lo + 256) if not 0xD800 <= k < 0xE000) for lo in [*range(0, 0x3400, 256), *range(0x10000, 0x20000, 256)]]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_long_pieces_and_stretches(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 6)
    monkeypatch.setattr(byte_bpe, "WINDOW", 1)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 40)
    monkeypatch.setattr(byte_bpe, "QUERY_ROWS", 500)
    coder = byte_bpe.Coder(RANKS, public_tokenizers.PATTERN)
    texts = [*odd_texts(), "  two  spaces and\n\n lines " * 30]
    coded = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(coded) == [t.encode() for t in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode([np.array([5, 60000], "<u4").tobytes()])


# --- 13 ---


def trie_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {c: tuple(own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + turns[zlib.crc32(str(c).encode()) % 9 :]) for c, turns in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in children[node])
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        yield min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], sha(ends)


def conversations(case):
    rng = random.Random(4)
    if case == "few texts":
        return [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yé", "", None])) for c in range(60) for t in range(rng.randrange(1, 20))]
    if case == "copies":
        rows = [(c, t, "u", f"t{t}") for c in range(30) for t in range(40)] + [(1000 + c, t, "u", f"t{t if t != 3 * c else 99}") for c in range(12) for t in range(40)]
        return rows + [(c, 1, "u", "dup") for c in (3, 3, 4)] + [(None, 1, "u", "x"), (50, None, "a", "n"), (50, 0, "a", "m")]
    if case == "long":
        sizes = {2000: (1500, 9999), 2005: (1500, 9999), 2010: (1400, 1100), 3000: (512, 9999), 3005: (504, 9999)}
        return [(c, t, "u", f"t{t if t < turned else -t}") for c, (n, turned) in sizes.items() for t in range(n)]
    return {"none": [], "one": [(7, None, None, None)]}[case]


@pytest.mark.parametrize("case", ["none", "one", "few texts", "copies", "long"])
def test_prefix_trie(spark, tmp_path, monkeypatch, case):
    if case == "copies":
        monkeypatch.setattr(prefix_trie, "PACK", 3)
        monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    rows = conversations(case)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"k": F.lit(1), "digest": F.lit("d"), "at": F.lit(0), "index": F.lit(0)})
    found = run(queries.op13_prefix_trie, spark, tmp_path, "conversations", df)
    assert by_text(found.collect()) == by_text(trie_of(rows))
