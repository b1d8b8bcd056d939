"""Segmentation of reviews into clauses, with and without character offsets. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintleaf.functions.arrays import let, sums_before

_MARK = "\u0001"
#: The words at which a clause ends.
CONCESSIVE = r"despite(?:\s+the\s+fact\s+that)?|in\s+spite\s+of|regardless\s+of|even\s+though|even\s+if|although|though|whereas|while"
CONTRASTIVE = r"but|however|yet|nevertheless|nonetheless|on\s+the\s+other\s+hand|on\s+the\s+contrary|except\s+that|except\s+for"
LEADING = r"and|but|or|so|yet|because|although|though|despite|while|however|whereas"
_SPACES = " \t\n\f\r"
_S, _WORD = r"[ \t\n\f\r]", "[A-Za-z0-9_]"
#: Fixed value: clause boundaries where offsets are kept. Space, end of text and end of a word are written out, as engines
#: differ in what their short forms mean beyond ASCII, and ſ, which is an s to engines that fold case by Unicode.
BOUNDARY = (
    rf"\r\n|\n|[.!?]+(?:{_S}+|(?![\s\S]))|{_S}*;{_S}*|{_S}*,{_S}*(?=(?:(?:but|however|although|while|yet|whereas|and{_S}+al[sſ]o)(?!{_WORD})|whereaſ(?={_WORD})))"
    rf"|{_S}+(?:but|however|although|wherea[sſ]){_S}+"
)
#: The same without look-ahead, for engines that lack it.
SIMPLE_BOUNDARY = r"\n|[.!?]+|;"
#: Spans are looked up in blocks of 2 ** 8 code points of a text.
_BITS = 8


def clauses(text: Column) -> Column:
    """Array of clauses: sentences cut at concessive and contrastive words and at punctuation, cleaned, of two words or more.

    A sentence that starts with a concessive word is also cut at its comma. If nothing is left, the whole text is the
    one clause; null and blank texts have none.
    """
    whole = F.trim(text)
    marked = F.regexp_replace(whole, r"([.!?;\n—])", f"$1{_MARK}")
    # the comma that closes a concessive opening is a boundary of its own
    marked = F.regexp_replace(marked, rf"(?i)(^|{_MARK})(\s*)(?:{CONCESSIVE})\s+([^,{_MARK}]+),\s*", f"$1$2$3{_MARK}")
    marked = F.regexp_replace(marked, rf"(?i)\b(?:{CONCESSIVE}|{CONTRASTIVE})\b", _MARK)
    strip = lambda c: F.regexp_replace(c, r"^[ ,;:\-—\n\r\t]+|[ ,;:\-—\n\r\t]+$", "")
    parts = F.transform(F.split(marked, _MARK), lambda c: F.trim(F.regexp_replace(strip(c), rf"(?i)^(?:{LEADING})\s+", "")))
    kept = F.filter(parts, lambda c: F.size(F.split(c, r"\s+")) >= 2)
    return F.when(F.coalesce(F.length(whole), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.size(kept) == 0, F.array(whole)).otherwise(kept)


_CLAUSES = "array<struct<start: int, end: int, text: string>>"


def spans(text: Column, boundary: str = BOUNDARY, fallback: bool = True) -> Column:
    """Array of (start, end, text) clauses with text = substring from start to end; clauses without a word character (of ASCII) go.

    Without any clause a text that isn't blank is one clause, trimmed; without ``fallback`` it has none.
    """
    cut = _cut(text, boundary)
    # pieces at even places are clauses, those at odd places boundaries; their lengths add up to the offsets.
    # each piece is looked at once
    pieces = F.transform(cut, lambda p, i: _piece(p, (i % 2 == 0) & p.rlike(r"\w")))
    found = let(pieces, lambda ps: F.filter(F.zip_with(ps, sums_before(F.transform(ps, lambda p: p["n"].cast("long"))), lambda p, at: F.when(p["own"], _moved(at, p))), lambda c: c.isNotNull()))
    if not fallback:
        return F.when(text.isNotNull(), found)
    whole = F.when(F.trim(text, F.lit(f"{_SPACES}\x0b")) == "", F.array().cast(_CLAUSES)).otherwise(F.array(_moved(F.lit(0), _piece(text, F.lit(True)))))
    return F.when(text.isNotNull(), let(found, lambda cs: F.when(F.size(cs) > 0, cs).otherwise(whole)))


def _cut(text: Column, boundary: str) -> Column:
    return F.split(F.regexp_replace(text, f"(?i)({boundary})", f"{_MARK}$1{_MARK}"), _MARK)


def clause_texts(text: Column, boundary: str = BOUNDARY) -> Column:
    """The texts of ``spans`` without fallback, for uses that need no offsets."""
    return F.transform(F.filter(_cut(text, boundary), lambda p, i: (i % 2 == 0) & p.rlike(r"\w")), lambda p: F.trim(p, F.lit(_SPACES)))


def _piece(text: Column, own: Column) -> Column:
    """A piece's length, white space on its left, and bare text."""
    bare = F.ltrim(text, F.lit(_SPACES))
    return F.struct(own.alias("own"), F.length(text).alias("n"), (F.length(text) - F.length(bare)).alias("left"), F.rtrim(bare, F.lit(_SPACES)).alias("text"))


def _moved(at: Column, piece: Column) -> Column:
    start = at + piece["left"]
    return F.struct(start.cast("int").alias("start"), (start + F.length(piece["text"])).cast("int").alias("end"), piece["text"].alias("text"))


def clause_rows(reviews: DataFrame, text_col: str = "Review", boundary: str = BOUNDARY, fallback: bool = True) -> DataFrame:
    """(review_id, clause_id, clause_idx, clause_text, clause_start_char, clause_end_char), ids REV_00001_C01 and so on.

    Clauses of a review without an id have none.
    """
    rows = reviews.filter(F.col(text_col).isNotNull()).select("review_id", F.posexplode(spans(F.col(text_col), boundary, fallback)).alias("clause_idx", "c"))
    return rows.select(
        "review_id", F.when(F.col("review_id").isNotNull(), F.format_string("%s_C%02d", F.col("review_id"), F.col("clause_idx") + 1)).alias("clause_id"), "clause_idx", F.col("c.text").alias("clause_text"),
        F.col("c.start").alias("clause_start_char"), F.col("c.end").alias("clause_end_char"),
    )


def clause_checks(text: Column, boundary: str = BOUNDARY, fallback: bool = True) -> Column:
    """struct(n, matches): a text's clauses, and those that the text holds between their offsets.

    Offsets leave out U+0001, at which texts are cut besides, so the text is taken without it.
    """
    bare = F.replace(text, F.lit(_MARK), F.lit(""))
    return let(spans(text, boundary, fallback), lambda cs: F.struct(_size(cs).alias("n"), _size(held(bare, cs)).alias("matches")))


def held(text: Column, found: Column) -> Column:
    """Those of the (start, end, text) spans that the text holds between their offsets.

    A place in a text is found by counting from its start, so each span is looked up in the few blocks that it lies in: the
    work is in proportion to the text and its spans.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{1 << _BITS}}}"), F.lit(0))
    block = lambda at: F.shiftright(at, _BITS)

    def between(of: Column, s: Column) -> Column:
        near = F.array_join(F.slice(of, block(s["start"]) + 1, block(s["end"]) - block(s["start"]) + 1), "")
        return F.substring(near, s["start"] % (1 << _BITS) + 1, s["end"] - s["start"])

    return let(blocks, lambda of: F.filter(found, lambda s: between(of, s) == s["text"]))


def clause_numbers(reviews: DataFrame, text_col: str = "Review", boundary: str = BOUNDARY, fallback: bool = True) -> DataFrame:
    """(review_id, n) for each review: its number of clauses, 0 for null."""
    return reviews.select("review_id", _size(spans(F.col(text_col), boundary, fallback)).alias("n"))


def _size(values: Column) -> Column:
    return F.coalesce(F.array_size(values), F.lit(0)).cast("long")


def assertion_id(clause_id: Column, number: Column) -> Column:
    return F.format_string("%s_A%02d", clause_id, number)


def span_offset(text: Column, span: Column, start: Column) -> Column:
    """Place of the span in the text at or after ``start``; null if missing or blank."""
    at = F.call_function("locate", span, text, start + 1)
    return F.when(F.coalesce(span, F.lit("")) == "", None).when(at > 0, at - 1)
