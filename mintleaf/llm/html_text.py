"""Main-text extraction: a bidirectional LSTM in numpy labels the text blocks of a page.

A page becomes its sequence of leaf blocks in page order. A block enters as the hashed names of its tag path (elements
with their class, id and role words; the names in KNOWN have a place each, others are hashed), whether one of them
is a foreign word, the hashed words of its text and a few counts. One LSTM reads the sequence
forwards and one backwards, so each block is judged in the context of the whole page; blocks labelled as main text are
joined. Scripts, styles, titles and text fields are no text and aren't read as blocks. What stands in an svg, template,
object, noscript or iframe element gives blocks of its own behind the block around it, so it is labelled by itself.

The labeller is trained on ``sample`` pages (those of the least url and id hash, of SAMPLE_BYTES at most; the bound is a parameter) with labels
from the pages' own markup: what stands in an article or main container is main text unless an element or a class
word between says menu, footer, advert and so on. In each epoch foreign blocks are set in and containers renamed, so
the labels hold for page forms that the sample lacks. Every page of the input is labelled as a whole.

A page is read in one pass, however broken. A tag that no ``>`` outside quotes ends is text. What follows an unclosed comment,
``script``, ``style`` or ``title`` belongs to it, up to the end of the page, and elements open within 512 others are read as
text of the last of these; browsers do the same.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined by two
line feeds; nothing else is dropped. A null or empty page, or one without main text, gives the empty text. Rows with
null ids or urls are handled as any other; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mintleaf.llm.common import string_bytes, word_hashes, word_spans

SAMPLE_PAGES, EPOCHS, BATCH, HIDDEN = 96, 20, 16, 16
#: Longer pages are trained on only where there are too few others.
SAMPLE_BYTES = 1 << 20
OTHER_BINS, WORD_BINS, COUNTS = 128, 32, 7

_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = frozenset("script style title textarea".split())
_APART = frozenset("noscript iframe svg template object".split())
_NESTED = 512  # open elements; those further inside are read as their parent's text, as browsers do
_DEEPEST = 20  # of elements set apart within each other; beyond it they are read in place
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_BARRIER = frozenset("article aside blockquote body div fieldset figure footer form header main nav section table td th ul ol li".split())
#: Words in tags, classes, ids and roles that mark foreign blocks, and containers of main text.
FOREIGN = frozenset(
    "nav navigation menu menubar footer aside form sidebar ad ads advert adverts advertisement sponsor sponsored promo comment comments reply replies discussion cookie cookies consent notice banner "
    "newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs toolbar popup modal masthead contentinfo complementary search widget pagination pager tags button select legal copyright".split()
)
CONTAINER = frozenset("article main content post entry story".split())
#: Names with a place of their own in the path, so that none is taken for another; the class body isn't the element.
KNOWN = {w: k for k, w in enumerate(sorted(FOREIGN | CONTAINER | _BLOCK | _APART | set(".body a abbr b br cite code em i img math q s small span strong sub sup u".split())))}
PATH_BINS = len(KNOWN) + OTHER_BINS
WIDTH = PATH_BINS + WORD_BINS + COUNTS


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0  # characters in links


class _Scanner:
    """Finds the markup of a page from left to right, in one pass over the page however broken it is.

    A tag ends at the first ``>`` outside quotes; one that has none is text. Where quotes open depends on where the tag
    begins, so what a walk from an opening quote comes to is remembered for that quote, and so is the place of the next
    sign of each kind, which later tags would look for again.
    """

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] = {}  # an opening quote -> the end of the tag that goes on there, or -1
        self.seen: dict[str, int] = {}  # kind of sign -> the next place found

    def _next(self, kind: str, at: int) -> int:
        """The first place from ``at`` on of a sign of a kind, or the page's length; ``at`` grows from call to call."""
        found = self.seen.get(kind, -1)
        if found < at:
            m = _SIGNS[kind].search(self.page, at)
            found = self.seen[kind] = m.start() if m else len(self.page)
        return found

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        sign, walked, end = self._next("end", at), [], -1
        while sign < len(self.page):
            if self.page[sign] == ">":
                end = sign
                break
            if sign in self.ends:
                end = self.ends[sign]
                break
            walked.append(sign)
            close = self.page.find(self.page[sign], sign + 1)
            m = _SIGNS["end"].search(self.page, close + 1) if close >= 0 else None
            sign = m.start() if m else len(self.page)
        self.ends.update(dict.fromkeys(walked, end))
        return end

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, tag, attributes) of the next markup; comments and the like have no tag, CDATA its content as attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            sign = page[start + 1 : start + 2]
            if sign in ("!", "?") and sign:
                for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if page.startswith(opening, start):
                        end = page.find(closing, start + len(opening))
                        inner = page[start + len(opening) : end if end >= 0 else len(page)] if opening != "<!--" else ""
                        return start, end + 3 if end >= 0 else len(page), "", "", inner
                end = self._next(">", start)
                if end < len(page):
                    return start, end + 1, "", "", ""
            slash = "/" if sign == "/" else ""
            first = page[start + 1 + len(slash) : start + 2 + len(slash)]
            if first.isascii() and first.isalpha():
                begin = start + 1 + len(slash)
                stop = self._next("name", begin)
                end = self._tag_end(stop)
                if end < 0 and (quote := self._next("quote", begin)) < stop:  # a quote in the name opens the attributes
                    stop, end = quote, self._tag_end_from_quote(quote)
                if end >= 0:
                    return start, end + 1, slash, page[begin:stop].lower(), page[stop:end]
            at = start + 1
        return None

    def _tag_end_from_quote(self, quote: int) -> int:
        """As ``_tag_end``, from a sign before the one that was found last."""
        held = self.seen["end"]
        self.seen["end"] = quote
        end = self._tag_end(quote)
        self.seen["end"] = held
        return end


_SIGNS = {"end": re.compile("[\"'>]"), "name": re.compile(r"[\s/>]"), "quote": re.compile("[\"']"), ">": re.compile(">")}


@dataclass
class _Parser:
    names: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def tokens(self, tag: str, attributes: str) -> tuple[str, ...]:
        """The tag, and its class, id and role words."""
        found = self.names.get((tag, attributes))
        if found is None:
            words = [w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())]
            found = (tag, *(f".{w}" for w in words))
            if len(attributes) < 200 and len(self.names) < 1 << 14:  # others are read each time
                self.names[tag, attributes] = found
        return found

    def blocks(self, page: str, around: tuple[tuple[str, tuple[str, ...]], ...] = (), depth: int = 0) -> list[Block]:
        out: list[Block] = []
        later: list[Block] = []
        stack: list[tuple[str, tuple[str, ...]]] = list(around)  # open elements, each with the path to it
        opened = Counter(tag for tag, _ in stack)
        parts: list[str] = []
        linked, at = 0, 0
        scanner = _Scanner(page)

        def close() -> None:
            nonlocal parts, linked
            if parts:
                joined = "".join(parts)
                text = " ".join((html_lib.unescape(joined) if "&" in joined else joined).split())
                if text:
                    out.append(Block(stack[-1][1] if stack else (), text, linked))
                parts, linked = [], 0
            out.extend(later)
            later.clear()

        def leave(k: int) -> None:
            while len(stack) > k:
                opened[stack.pop()[0]] -= 1

        def inside(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
            return tag, (stack[-1][1] if stack else ()) + self.tokens(tag, attributes)

        while m := scanner.after(at):
            start, end, slash, tag, attributes = m
            if start > at:
                parts.append(page[at:start])
                if stack and stack[-1][0] == "a":
                    linked += start - at
            at = end
            if not tag:
                if attributes:
                    parts.append(attributes.replace("&", "&amp;"))  # no references in there
                continue
            if slash:
                if tag in _BLOCK:
                    close()
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        leave(k)
                        break
                    if tag not in _BLOCK and stack[k][0] in _BARRIER:
                        break
                continue
            if tag in _RAW:
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at) if not attributes.endswith("/") else None
                at = at if attributes.endswith("/") else end.end() if end else len(page)
                continue
            if tag in _APART and depth < _DEEPEST and not attributes.endswith("/"):
                end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                inner = page[at : end.start() if end else len(page)]
                if inner.strip():
                    later += self.blocks(inner, (*stack, inside(tag, attributes)), depth + 1)
                at = end.end() if end else len(page)
                continue
            if tag in _BLOCK:
                close()
                if tag == "p" or tag in ("li", "dd", "dt", "tr", "td", "th", "option") or tag in _BARRIER:
                    for k in range(len(stack) - 1, -1, -1):  # an open paragraph, or sibling, ends here
                        if stack[k][0] == tag and tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") or stack[k][0] == "p":
                            leave(k)
                            break
                        if stack[k][0] in _BARRIER or stack[k][0] in ("tr", "dl", "select"):
                            break
            elif tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            if tag not in _VOID and not attributes.endswith("/") and len(stack) < _NESTED:
                stack.append(inside(tag, attributes))
                opened[tag] += 1
        parts.append(page[at:])
        close()
        return out


def markup_label(path: tuple[str, ...]) -> bool:
    """Whether the markup says that a block is main text."""
    words = [t.removeprefix(".") for t in path]
    inside = False
    for word, token in zip(words, path, strict=True):
        if word in FOREIGN or word == "header" and not inside:
            return False
        inside |= word in CONTAINER or token == ".body"
    return inside or not any(w in CONTAINER for w in words) and bool(path) and path[-1] in ("p", "h1", "h2", "h3", "b", "i", "blockquote", "pre")


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_bin(token: str) -> int:
    """The place of a tag, or of a class, id or role word (with a dot before it)."""
    own = KNOWN.get(token)
    own = KNOWN.get(token.removeprefix(".")) if own is None else own
    return len(KNOWN) + zlib.crc32(token.removeprefix(".").encode()) % OTHER_BINS if own is None else own


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH_BINS, np.float32)
        for t in path:
            found[path_bin(t)] = 1
        if len(_PATHS) < 1 << 14:
            _PATHS[path] = found
    return found


def _is_foreign(path: tuple[str, ...]) -> bool:
    return any(t.removeprefix(".") in FOREIGN for t in path)


def vectors(blocks: list[Block]) -> np.ndarray:
    """The input row of each block."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    data, offsets = string_bytes(pa.array([b.text for b in blocks], pa.large_string()))
    starts, ends, words = word_spans(data, offsets)
    bins = (word_hashes(data, starts, ends, 10) % np.uint64(WORD_BINS)).astype(np.int64)
    n_words = np.diff(words)
    owner = np.repeat(np.arange(len(blocks)), n_words)
    counts = np.bincount(owner * WORD_BINS + bins, minlength=len(blocks) * WORD_BINS).reshape(-1, WORD_BINS)
    out[:, :PATH_BINS] = [_path_vector(b.path) for b in blocks]
    out[:, PATH_BINS : PATH_BINS + WORD_BINS] = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1)
    chars = np.array([len(b.text) for b in blocks])
    ends_sentence = [b.text[-1] in ".!?…" for b in blocks]
    link = np.array([b.linked for b in blocks]) / np.maximum(chars, 1)
    out[:, -COUNTS:] = np.stack([np.log1p(n_words) / 5, np.log1p(chars) / 7, ends_sentence, np.minimum(link, 1), [len(b.path) / 10 for b in blocks], [_is_foreign(b.path) for b in blocks], np.ones(len(blocks))], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, sequence, width) and the mask of real steps."""
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows), 1), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


class Labeller:
    """Forward and backward LSTM and a logistic output. Parameters of each direction: input, recurrent, bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p |= {f"x{d}": make(WIDTH, 4 * HIDDEN), f"h{d}": make(HIDDEN, 4 * HIDDEN), f"c{d}": bias}
        self.p |= {"out": make(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states in the order of direction d; ``keep``: what the backward pass needs."""
        steps, n, _ = x.shape
        given = x.reshape(-1, WIDTH) @ self.p[f"x{d}"] + self.p[f"c{d}"]
        given = given.reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc))
            m = mask[t]
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, saved

    def probabilities(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(rows)
        order = sorted((k for k, r in enumerate(rows) if len(r)), key=lambda k: len(rows[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and (to - at + 1) * len(rows[order[to]]) <= 16384:
                to += 1
            own = order[at:to]
            x, mask = _padded([rows[k] for k in own])
            states = np.concatenate([self._read(x, mask, d, False)[0] for d in "fb"], axis=2)
            p = _sigmoid(states @ self.p["out"] + self.p["bias"])[:, :, 0]
            for j, k in enumerate(own):
                out[k] = p[: len(rows[k]), j]
            at = to
        return out

    def gradients(self, rows: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = _padded(rows)
        y = _padded([v[:, None] for v in labels])[0]
        read = {d: self._read(x, mask, d, True) for d in "fb"}
        states = np.concatenate([read[d][0] for d in "fb"], axis=2)
        error = (_sigmoid(states @ self.p["out"] + self.p["bias"]) - y) * mask / mask.sum()
        grad = {"out": states.reshape(-1, 2 * HIDDEN).T @ error.reshape(-1, 1), "bias": error.sum((0, 1))}
        back = error @ self.p["out"].T
        for k, d in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            wh, dwh = self.p[f"h{d}"], np.zeros_like(self.p[f"h{d}"])
            dh_next = dc_next = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc in reversed(read[d][1]):
                m = mask[t]
                dh = back[t, :, k * HIDDEN : (k + 1) * HIDDEN] + dh_next
                dc = m * (dh * o * (1 - tc**2) + dc_next)
                own = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), m * dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz[t] = own
                dwh += h.T @ own
                dh_next, dc_next = (1 - m) * dh + own @ wh.T, dc * f + (1 - m) * dc_next
            grad |= {f"x{d}": x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * HIDDEN), f"h{d}": dwh, f"c{d}": dz.sum((0, 1))}
        return grad


def _varied(page: list[Block], labels: list[bool], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page with foreign blocks set in and its containers renamed."""
    foreign, containers = sorted(FOREIGN | {"header"}), [("article",), ("main",), ("div", ".content"), ("div", ".post"), ("section", ".story"), ("div", ".article", ".body"), ("div", ".entry", ".content")]
    renamed = containers[rng.integers(len(containers))] if rng.random() < 0.5 else ("article",)
    blocks = [Block(tuple(x for t in b.path for x in (renamed if t == "article" else (t,))), b.text, b.linked) for b in page]
    labels = list(labels)
    for _ in range(rng.integers(0, 4) if blocks else 0):
        word = foreign[rng.integers(len(foreign))]
        own = (word,) if word in ("nav", "menu", "footer", "aside", "form", "button", "header") and rng.random() < 0.7 else (("div", "section", "ul", "p")[rng.integers(4)], f".{word}")
        at = int(rng.integers(len(blocks) + 1))
        within = word != "header" and 0 < at < len(blocks) and labels[at - 1] and rng.random() < 0.6
        prefix = tuple(x for x in blocks[at - 1].path if x not in ("p", "h1", "b", "i", "a")) if within else ("html", "body")
        for _ in range(rng.integers(1, 6)):
            like = blocks[rng.integers(len(blocks))].text.split()
            n = min(len(like), int(rng.integers(1, 40)))
            leaf = (("p",), ("li", "a"), (), ("div",), ("span",), ("h3",), ("a",))[rng.integers(7)]
            text = " ".join(like[:n])
            blocks.insert(at, Block((*prefix, *own, *leaf), text, len(text) if "a" in leaf else 0))
            labels.insert(at, False)
    return blocks, labels


def train(pages: list[str], seed: int = 7, epochs: int = EPOCHS, longest: int = 48) -> Labeller:
    """A labeller from the markup of some pages; sequences of the training (not of the labelling) are cut in stretches."""
    parser, rng, model = _Parser(), np.random.default_rng(seed), Labeller(seed)
    parsed = [(b, [markup_label(x.path) for x in b]) for b in map(parser.blocks, pages) if b]
    if parsed:  # few pages are read more often, so that the steps are as many
        epochs *= -(-SAMPLE_PAGES // len(parsed))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs if parsed else 0):
        rows, labels = [], []
        for b, y in parsed:
            b, y = _varied(b, y, rng) if epoch % 4 else (b, y)
            x, y = vectors(b), np.array(y, np.float32)
            for at in range(0, len(x), longest):
                rows.append(x[at : at + longest])
                labels.append(y[at : at + longest])
        order = rng.permutation(len(rows))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            for k, g in model.gradients([rows[i] for i in own], [labels[i] for i in own]).items():
                g = np.clip(g, -1, 1)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                model.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _label(shared, id_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, model = _Parser(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [parser.blocks(h) if h else [] for h in part.column(id_fields).to_pylist()]
                flat = vectors([b for p in pages for b in p])
                cuts = np.cumsum([0, *map(len, pages)])
                likely = model.probabilities([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
                texts = ["\n\n".join([b.text for b, p in zip(page, own.tolist(), strict=True) if p >= 0.5]) for page, own in zip(pages, likely, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(id_fields)), pa.array(texts, pa.string())], names=[*part.schema.names[:id_fields], "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # long pages come after all others, so that the sample is small in bytes too
    order = F.struct((F.octet_length("html") > SAMPLE_BYTES).alias("long"), F.xxhash64(F.col("url"), F.col("page_id").cast("string")).alias("hash"))
    hashed = rows.filter("html != ''").withColumn("o", order)
    # the hashes are few and small; of the pages only the chosen ones leave their task
    last = hashed.select("o").distinct().orderBy("o").limit(sample).agg(F.max("o").alias("o")).first()["o"]
    chosen = hashed.filter(F.col("o") <= F.struct(F.lit(last["long"]).alias("long"), F.lit(last["hash"]).alias("hash"))).groupBy("o").agg(F.min("html").alias("html")).orderBy("o").limit(sample).collect() if last else []
    model = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in chosen]))
    return rows.mapInArrow(_label(model, 2), StructType([*rows.schema.fields[:2], StructField("text", StringType())]))
