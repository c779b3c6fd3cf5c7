"""Personal data: patterns with exact checks, and a character tagger that finds spans written in other ways.

The tagger, a bidirectional LSTM with CRF transitions, learns from the patterns' own spans and from
disguised copies of them ("at" for @, spaced or bracketed dots, other separators). It reads a
text in overlapping windows, leaving out only those that can change no result (``windows``); parts of a span from several windows are joined
and overlaps settled over the whole text. A span it adds has to pass the check of its kind once its
disguise is undone.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.char_tagger import BATCH, CODES, LETTER, PAD, Tagger, char_codes, encoded
from lakeloom.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 112, 56  # characters of a window, and from one to the next
CONTEXT = 40  # characters on both sides of a place
FIT_ROWS = 20_000  # documents that training windows are drawn from, about
FIT_WINDOWS = 600  # of each kind, and of none
SURE = 0.5  # least mean confidence of an added span
SLICE, MOST_WINDOWS = 500, 4_096  # rows and windows that are worked on at a time
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match starts with its run of digits, so runs are not tried twice
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where training windows are drawn: at a sign for "at", or four digits close to each other.
_PLACE = re.compile(r"@|[\[({]\s?[Aa][Tt]\s?[\])}]|\b(?:at|AT) [A-Za-z0-9-]{1,40} ?[\[(]?(?:dot\b|DOT\b|\. ?[A-Za-z0-9])|[0-9](?:(?:[^0-9A-Za-z]{0,3}|[\[( ]dot[\]) ])[0-9]){3,}+")
_DIGITS, _LETTERS = (np.zeros(CODES, bool) for _ in range(2))
_DIGITS[[ord(c) - 31 for c in "0123456789"]] = True
_LETTERS[[LETTER, *(ord(c) - 31 for c in string.ascii_letters if c not in "dotDOT")]] = True
_AT_SIGN = re.compile(r"@|\b[Aa][Tt]\b")
_DOMAIN_PARTS = re.compile(r"\s*+[\])}]?+\s*+(?:[A-Za-z0-9-]++(?:\s*+[\[({]?+\s*+(?:\.|[Dd][Oo][Tt]\b)\s*+[\])}]?+\s*+)?+)*+")
_AT = re.compile(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*[\[({]?\s*(?:\.|\bdot\b)\s*[\])}]?\s*", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap within their kind, those that fail their check dropped; in linear time."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            out.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def plausible(kind: str, text: str) -> bool:
    """Whether a span passes the check of its kind once its disguise is undone."""
    digits = _digits(text)
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", text))
        return base_spans(plain) == [("email", 0, len(plain))] and plain[0].isalnum()
    if kind == "ip":
        plain = _DOT.sub(".", text)
        return base_spans(plain)[:1] == [("ip", 0, len(plain))]
    gaps = re.findall(r"[^0-9]+", text)
    if any(c.isalnum() for gap in gaps for c in gap) or not text or not text[-1].isdigit():
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and text[0].isdigit() and len(set(gaps)) <= 1 and len(gaps) <= 5
    return 9 <= len(digits) <= 15 and text.startswith(("+", "00")) and len(gaps) <= 7 and max(map(len, gaps), default=0) <= 3


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text around the places that training windows are drawn from, with context, merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in _PLACE.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _digit_parts(codes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal parts of a text without letters, other than those of "dot", that hold four digits: no address, card or phone is plausible across or outside them."""
    ends = np.flatnonzero(_LETTERS[codes])
    bounds = np.concatenate([[0], ends + 1]), np.append(ends, len(codes))
    digits = np.concatenate([[0], np.cumsum(_DIGITS[codes])])
    many = digits[bounds[1]] - digits[bounds[0]] >= 4
    return list(zip(bounds[0][many].tolist(), bounds[1][many].tolist(), strict=True))


def _mail_parts(text: str) -> list[tuple[int, int]]:
    """Parts of a text around each "at" that a domain with a dot follows, as far as name and domain can go: no mail is plausible across or outside them."""
    out: list[tuple[int, int]] = []
    read, good = 0, False
    for m in _AT_SIGN.finditer(text):
        if m.end() >= read:  # otherwise it stands within a domain that has been read
            read = _DOMAIN_PARTS.match(text, m.end()).end()
            good = "." in (said := text[m.end() : read]) or "dot" in said.lower()
        if not good:
            continue
        start, least = m.start(), out[-1][1] if out else 0
        while start > least:
            gap = start
            while gap > least and (text[gap - 1].isspace() or text[gap - 1] in "[](){}."):
                gap -= 1
            spelled = text[max(gap - 3, 0) : gap].lower() == "dot"
            if start < m.start() and gap < start and "." not in text[gap:start] and not spelled:
                break
            name = gap
            while name > least and text[name - 1] in _LOCAL:
                name -= 1
            if name == gap:
                break
            start = name
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(read, out[-1][1]))
        else:
            out.append((start, read))
    return out


def all_windows(text: str) -> list[tuple[int, int]]:
    """Windows of at most ``WIDTH`` over the whole text, each ``STRIDE`` from the one before."""
    starts = range(0, max(len(text) - WIDTH + STRIDE - 1, 0) // STRIDE * STRIDE + 1, STRIDE) if text else ()
    return [(start, min(start + WIDTH, len(text))) for start in starts]


def windows(text: str) -> list[tuple[int, int]]:
    """Those of ``all_windows`` that meet a part where a span can be plausible: the others can change no result.

    An added span is plausible, so it lies within one such part, and so do the tagged runs that were
    joined to it; each of their windows meets the part. A run that leaves the part makes what it is joined to
    implausible, whichever windows are read.
    """
    found = _digit_parts(char_codes(text)) + _mail_parts(text)
    every = all_windows(text)
    if not found or not every:
        return []
    steps = np.zeros(len(every) + 1, np.int64)
    a, b = np.array(found, np.int64).T
    # window k is k * STRIDE to k * STRIDE + WIDTH
    np.add.at(steps, np.clip((a - WIDTH) // STRIDE + 1, 0, len(every)), 1)
    np.add.at(steps, np.clip((b - 1) // STRIDE + 1, 0, len(every)), -1)
    return [every[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) > 0)]


def tags_of(spans: Iterable[Span], start: int, end: int) -> np.ndarray:
    """Tags of a window: 0 outside, 1 + 2 k where a span of kind k begins, 2 + 2 k within; parts cut off at its start count as within."""
    out = np.zeros(end - start, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        if a < end and b > start:
            out[max(a, start) - start : b - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    return out


def tagged_spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, mean confidence) of the runs of a window's tags."""
    out, at = [], 0
    for k in np.flatnonzero(tags):
        if k < at:
            continue
        kind = (tags[k] - 1) // 2
        at = k + 1
        while at < len(tags) and tags[at] == 2 + 2 * kind:
            at += 1
        out.append((KINDS[kind], int(k), int(at), float(sure[k:at].mean())))
    return out


def disguised(kind: str, text: str, rng: np.random.Generator) -> str:
    """The same value, written in another way."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        at = pick(" at ", "(at)", "[at]", " (at) ", " [at] ", " @ ", "@")
        name, _, domain = text.partition("@")
        return name + at + domain.replace(".", pick(".", ".", " dot ", "(dot)", "[dot]", " . ") if at != "@" else pick(" dot ", "[dot]", "(dot)", " . "))
    if kind == "ip":
        return text.replace(".", pick("[.]", " . ", "(.)", "[dot]", ". "))
    if kind == "card":
        digits, sep = _digits(text), pick(".", "/", "_", "  ", " - ")
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    start = pick("00", "00 ", "+", "+ ")
    sep = pick("/", ".", " / ", "_", " . ") if start.startswith("+") else pick(" ", "-", "/", ".")
    return start + sep.join(re.findall(r"[0-9]+", text))


def _drawn(kept: list[tuple[str, int, list[Span]]], rng: np.random.Generator) -> Callable[[], tuple[np.ndarray, np.ndarray]]:
    """Batches of training windows: half of them with a span disguised, windows shifted at random."""
    with_spans = [k for k, row in enumerate(kept) if row[2]]
    without = [k for k, row in enumerate(kept) if not row[2]] or with_spans
    by_kind = [mine for kind in KINDS if (mine := [k for k in with_spans if any(s[0] == kind for s in kept[k][2])])]

    def draw() -> tuple[np.ndarray, np.ndarray]:
        texts, tags = [], np.zeros((BATCH, WIDTH), np.int64)
        for row in range(BATCH):
            pool = without if row % 3 == 0 else by_kind[row % len(by_kind)]
            text, _, spans = kept[pool[rng.integers(len(pool))]]
            if spans and rng.random() < 0.6:
                kind, a, b = spans[rng.integers(len(spans))]
                if all(s == (kind, a, b) or s[2] <= a or s[1] >= b for s in spans):
                    new = disguised(kind, text[a:b], rng)
                    moved = len(new) - (b - a)
                    text = text[:a] + new + text[b:]
                    spans = [(k, s, e + moved) if (k, s, e) == (kind, a, b) else (k, s + moved, e + moved) if s >= b else (k, s, e) for k, s, e in spans]
            skip = int(rng.integers(0, max(1, min(CONTEXT, len(text) // 3)))) if rng.random() < 0.5 else 0
            skip = max(skip, len(text) - WIDTH) if len(text) - skip > WIDTH and rng.random() < 0.5 else skip
            texts.append(text[skip : skip + WIDTH])
            tags[row, : len(texts[-1])] = tags_of(spans, skip, skip + len(texts[-1]))
        return encoded(texts, WIDTH), tags

    return draw


def train(kept: list[tuple[str, int, list[Span]]], seed: int = 0) -> Tagger | None:
    """A tagger from (text, place, spans) windows; None if no window has a span."""
    if not any(row[2] for row in kept):
        return None
    tagger = Tagger.new(1 + 2 * len(KINDS), seed=seed)
    tagger.fit(_drawn(kept, np.random.default_rng(seed)))
    return tagger


def _training_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, spans) of the regions of each text, those of one window at most."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for start, end in regions(text):
                mine = [(k, a - start, b - start) for k, a, b in spans if a >= start and b <= end]
                if end - start <= WIDTH:
                    rows.append((mine[0][0] if mine else "", text[start:end], [f"{k}:{a}:{b}" for k, a, b in mine]))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], ["label", "text", "spans"])


def training_windows(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS, fit_windows: int = FIT_WINDOWS) -> list[tuple[str, int, list[Span]]]:
    """At most ``fit_windows`` different windows of each kind and of none, by hash, from about ``fit_rows`` documents."""
    rows = docs.count()
    share = min(1.0, fit_rows / max(rows, 1))
    place = F.pmod(F.xxhash64(*docs.columns[:1], F.col(text_col)), F.lit(1 << 20))
    texts = docs.where(place < int(share * (1 << 20)) + 1).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.mapInArrow(_training_windows, "label string, text string, spans array<string>").groupBy("label", "text").agg(F.first("spans").alias("spans"))
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "text"))
    kept = found.withColumn("k", first).where(F.col("k") <= fit_windows).orderBy("label", "k").collect()
    parse = lambda s: (s.split(":")[0], *map(int, s.split(":")[1:]))
    return [(r["text"], r["k"], [parse(s) for s in r["spans"]]) for r in kept]


def reconciled(found: list[tuple[str, int, int, float]], base: list[Span], text: str) -> list[Span]:
    """Spans to add to the base ones: parts from several windows joined, then the surest that overlap nothing, over the whole text."""
    joined: list[list] = []
    for kind, a, b, sure in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2])):
        if joined and joined[-1][0] == kind and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
            joined[-1][3] = max(joined[-1][3], sure)
        else:
            joined.append([kind, a, b, sure])
    taken, out = [(a, b) for _, a, b in base], []
    for kind, a, b, sure in sorted(joined, key=lambda s: (-s[3], s[1], s[2])):
        if sure >= SURE and all(b <= x or a >= y for x, y in taken) and plausible(kind, text[a:b]):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def _windowed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, character classes, start, end) of the windows of all texts, ``MOST_WINDOWS`` at a time."""
    places = np.array([(k, a, b) for k, t in enumerate(texts) for a, b in windows(t)], np.int64).reshape(-1, 3)
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes) - sizes
    codes = np.concatenate([char_codes("".join(texts)), np.zeros(WIDTH, np.int16)])
    for first in range(0, len(places), MOST_WINDOWS):
        k, a, b = places[first : first + MOST_WINDOWS].T
        rows = codes[(at[k] + a)[:, None] + np.arange(WIDTH)]
        rows[np.arange(WIDTH) >= (b - a)[:, None]] = PAD
        yield k, rows, a, b


def found_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, in order."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if tagger:
        for k, row, a, b in _windowed(texts):
            tags, sure = tagger.decode(row)
            for n in np.flatnonzero((tags > 0).any(1)):
                added[k[n]] += [(kind, int(a[n]) + s, int(a[n]) + e, p) for kind, s, e, p in tagged_spans(tags[n, : b[n] - a[n]], sure[n])]
    out = []
    for text, own, more in zip(texts, base, added, strict=True):
        spans = [(*s, True) for s in own] + [(*s, False) for s in reconciled(more, own, text)]
        out.append(sorted(spans, key=_order))
    return out


def redacted(text: str, spans: Iterable[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at, end = [], 0, 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def _finder(tagger: Tagger | None, redact: bool):
    fields = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            texts = batch.column(1).to_pylist()
            spans = found_spans(texts, tagger)
            listed = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in mine] for mine in spans], pa.list_(fields))
            columns = [batch.column(0), listed] + ([pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if redact else [])
            yield pa.record_batch(columns, ["id", "spans", "redacted"][: len(columns)])

    return find


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, fit_rows: int = FIT_ROWS, fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """(id, spans[, redacted]) of every document: kind, start, end in code points, and whether a pattern found it.

    The tagger is fitted on the driver from a bounded sample of windows, on labels that the patterns
    give; where they find nothing in it there is no tagger and the patterns' spans are all. Each text
    is read whole, where it is; nothing is shuffled. Null texts are empty and have no spans, rows of
    one id and equal rows each have their own, an empty table gives no rows, and other columns are
    left out, so their names do not matter.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tagger = train(training_windows(rows, "text", fit_rows, fit_windows))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}" + (", redacted string" if redact else "")
    return rows.mapInArrow(_finder(tagger, redact), schema).withColumnRenamed("id", id_col)


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Per document: spans of each kind, base or added, how many were added, a digest of the base ones, and all spans."""
    found, spans = personal_data(docs), F.col("spans")
    many = lambda test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda kind: many(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(spans_text(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), spans_text(spans).alias("spans"), many(lambda s: ~s["base"]).alias("n_added"))
