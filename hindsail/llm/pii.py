"""Personal data: exact base patterns plus a linear-chain CRF over word shapes.

The base patterns (email, ip, card, phone) hold by definition; the CRF adds
spans of the same kinds in forms the patterns miss, such as `555 123 4567`,
`(555) 123-4567` or `ann [at] mail [dot] org`. It is trained on the driver from
a small labelled table of fixed size and shipped as a few kilobytes of weights.
A text is decoded around its digits, at-signs and bracketed at or dot: tokens
further than REACH characters from one, and from the word that stands there,
belong to no sequence and are never personal data. A decoded span is added if
it passes its kind's check and touches no base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import crf
from .common import slices

# Kinds in the order of results, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

REACH = 40
MAX_LABELLED = 2000
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
TRIGGER = re.compile(r"[0-9]+|@|[\[(](?:at|dot)[\])]")
CUES = frozenset("at dot com org net example mail email call phone tel fax mobile card visa ip server host from id order page in of year version".split())
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain: a local part reaches back from its at-sign to the last match's end at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        found = DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            done = found.end()
            yield lo, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by start, then kind as listed. Failing matches are dropped and not tried again."""
    spans = list(_emails(text))
    spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 if len(x) < 20 else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    spans += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of REACH characters around triggers, grown to white space and merged where they meet."""
    lo = hi = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if b <= hi:
            continue
        while a > max(hi, 0) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if lo >= 0 and a <= hi:
            hi = b
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = a, b
    if lo >= 0:
        yield lo, hi


def shape(token: str) -> str:
    """Word shape: a cue word itself, letters by case, digits by count, else the character."""
    if token[0].isascii() and token[0].isdigit():
        return f"9{min(len(token), 7)}"
    if token.isascii() and token.isalpha():
        return low if (low := token.lower()) in CUES else "x" if token == low else "X" if token.isupper() else "Xx"
    return token if token.isascii() else "~"


def features(tokens: list[tuple[int, int]], text: str, lo: int = 0, hi: int | None = None) -> list[list[str]]:
    """Features of each token from lo to hi: its shape, its neighbours' and whether they touch it."""
    hi, n = len(tokens) if hi is None else hi, len(tokens)
    shapes = ["^"] * max(0, 2 - lo) + [shape(text[a:b]) for a, b in tokens[max(0, lo - 2) : hi + 2]] + ["$"] * max(0, hi + 2 - n)
    touch = [0 < i < n and tokens[i - 1][1] == tokens[i][0] for i in range(lo, hi + 1)]
    out = []
    for i in range(hi - lo):
        p, q, s, n, m = shapes[i : i + 5]
        g = f"{touch[i]:d}{touch[i + 1]:d}"
        out.append([f"s{s}", f"p{p}", f"q{q}", f"n{n}", f"m{m}", f"g{g}", f"gs{g}{s}", f"qs{q} {s}", f"sn{s} {n}", f"qsn{q} {s} {n}"])
    return out


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, lo, hi)]


def labelled_rows() -> list[tuple[str, str]]:
    """The labelled table: (text, spans as kind:start:end joined by commas), 360 rows from fixed patterns and a fixed seed."""
    r = random.Random(7)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstdlmu") for _ in range(r.randint(2, 8)))
    name = lambda: word().capitalize()
    forms = [
        ("phone", lambda: f"({n(3)}) {n(3)}-{n(4)}"), ("phone", lambda: f"{n(3)}-{n(3)}-{n(4)}"), ("phone", lambda: f"{n(3)} {n(3)} {n(4)}"), ("phone", lambda: f"{n(3)}.{n(3)}.{n(4)}"),
        ("phone", lambda: f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}"), ("phone", lambda: f"+{n(2)} {n(3)} {n(4)} {n(3)}"),
        ("email", lambda: f"{word()}.{n(2)}@{word()}{n(1)}.example.com"), ("email", lambda: f"{word()} [at] {word()} [dot] com"), ("email", lambda: f"{word()} (at) {word()}.org"), ("email", lambda: f"{word()}{n(2)} @ {word()}.example.net"),
        ("ip", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))), ("ip", lambda: "[.]".join(str(r.randint(0, 255)) for _ in range(4))),
        ("card", lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}"), ("card", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}"), ("card", lambda: f"{n(4)}.{n(4)}.{n(4)}.{n(4)}"),
        (None, lambda: n(16)), (None, lambda: f"20{n(2)}-{r.randint(10, 12)}-{n(2)}"), (None, lambda: f"version {n(1)}.{n(1)}.{n(2)}"), (None, lambda: f"token = \"{n(2)}af{n(4)}bd{n(2)}c{n(6)}\""), (None, lambda: f"{n(2)},{n(3)}"), (None, lambda: f"page {n(3)}"), (None, lambda: f"order {n(8)}"), (None, lambda: f"{word()}{n(2)} ({n(4)})"), (None, lambda: f"{n(1)} | {word()} | {n(2)} |"),
    ]
    rows = []
    for i in range(360):
        kind, make = forms[i % len(forms)]
        before = " ".join(r.choice((word, name))() for _ in range(r.randint(0, 4)))
        after = r.choice(("", ".", ",", "!!", " |")) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        text = (before + " " if before else "") + (made := make())
        rows.append((text + after, f"{kind}:{len(text) - len(made)}:{len(text)}" if kind else ""))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, spans string")


def train_tagger(table: DataFrame) -> crf.Crf:
    """CRF from a labelled table (text, spans); more than MAX_LABELLED rows are a ValueError, since all are held on the driver."""
    rows = table.select("text", "spans").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    return _fitted(tuple(sorted((r.text, r.spans or "") for r in rows if r.text and tokens_of(r.text, 0, len(r.text)))))


@functools.lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[str, str], ...]) -> crf.Crf:
    """The CRF of these rows (text, spans), fitted once a process."""
    names, gold = [], []
    for text, spans in rows:
        tokens = tokens_of(text, 0, len(text))
        own = [0] * len(tokens)
        for kind, lo, hi in (s.split(":") for s in spans.split(",") if s):
            inside = [i for i, (a, b) in enumerate(tokens) if a >= int(lo) and b <= int(hi)]
            for i in inside:
                own[i] = LABELS.index(f"{'B' if i == inside[0] else 'I'}-{kind}")
        names.append(features(tokens, text))
        gold.append(own)
    return crf.train(names, gold, len(LABELS))


def plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return bool(re.search(r"@|[\[(]at[\])]", text)) and bool(re.search(r"\.|[\[(]dot[\])]", text)) and len(text) >= 6
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", text))


def add_spans(texts: list[str], base: list[list[Span]], model: crf.Crf) -> list[list[Span]]:
    """For each text its base spans and the CRF's further ones, ordered."""
    where = [(k, tokens) for k, text in enumerate(texts) for lo, hi in windows(text) if (tokens := tokens_of(text, lo, hi))]
    decoded = model.decode([len(tokens) for _, tokens in where], lambda i, lo, hi: features(where[i][1], texts[where[i][0]], lo, hi))
    more: list[list[Span]] = [[] for _ in texts]
    for (k, tokens), labels in zip(where, decoded):
        i = 0
        while i < len(labels):
            if not labels[i]:
                i += 1
                continue
            kind, j = LABELS[labels[i]][2:], i + 1
            while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
                j += 1
            lo, hi = tokens[i][0], tokens[j - 1][1]
            if plausible(kind, texts[k][lo:hi]) and all(hi <= a or b <= lo for a, b, _ in base[k]):
                more[k].append((lo, hi, kind))
            i = j
    return [sorted({*own, *extra}, key=_order) for own, extra in zip(base, more)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, model: crf.Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FOUND for every row: base counts by kind, SHA-256 of the base spans, all spans as kind:start:end (code points), and their number. Null texts count as empty; repeated rows stay; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            every = add_spans(texts, base, model)
            counts = [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_joined(s) for s in every], pa.string()), pa.array([len(s) for s in every], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def merged(spans: list[Span]) -> list[Span]:
    """Spans without overlap: what overlaps becomes one, named after the kind that starts first."""
    out: list[Span] = []
    for a, b, k in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, k))
    return out


def mask_pii(docs: DataFrame, model: crf.Crf, text_col: str = "text") -> DataFrame:
    """docs with every found span of text_col replaced by [KIND]; all other columns and rows as they are, null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            plain = [x or "" for x in texts]
            out = []
            for text, whole, spans in zip(texts, plain, add_spans(plain, [base_spans(x) for x in plain], model)):
                parts, last = [], 0
                for a, b, k in merged(spans):
                    parts += [whole[last:a], f"[{k.upper()}]"]
                    last = b
                out.append(None if text is None else "".join([*parts, whole[last:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
