"""Personal data in deployment notes: weak labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Kinds in the order of the report, and what a span of each kind looks like.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails as a whole fails from each of its digits, so it is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wider looks, for spans that only the votes can tell.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,24}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
}
#: Gazetteers and context words.
_DOMAINS = frozenset("com org net edu gov mil int info io de fr es it uk us eu ca au jp cn ru br nl ch at se no".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
_CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse", "login"),
    "card": ("card", "credit", "visa", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
}
_CODE = ("token", "sha", "hash", "version", "uuid", "commit", "build", "isbn", "doi")
NEAR = 40


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict matches, leftmost and apart within each kind."""
    out = []
    if "@" in text:
        free = 0
        for m in _HOST.finditer(text):
            i = m.start()
            while i > free and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((i, 0, m.end()))
                free = m.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _wide_spans(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of the wider looks that overlap no strict span."""
    for kind, name in enumerate(KINDS):
        if name == "email" and "dot" not in text:
            continue
        for m in _WIDE[name].finditer(text):
            if all(m.end() <= a or b <= m.start() for a, _, b in taken):
                yield m.start(), kind, m.end()


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> str:
    """One letter for each labeler: y (personal data), n (not), - (abstains).

    Strict pattern, usual grouping, number rules, gazetteer, context words before, code around.
    """
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    before = text[max(0, start - NEAR) : start].lower()
    if name == "email":
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        grouped, ruled, known = tail.isalpha(), len(tail) >= 2 and not span[0] in ".-", tail in _DOMAINS
    elif name == "ip":
        parts = re.split("[.:]", span)
        grouped = all(p == "0" or p[0] != "0" for p in parts)
        ruled = len(parts) == 8 or _octets(span)
        known = len(parts) == 8 or 0 < int(parts[0].lstrip("0") or 0) < 224
    elif name == "card":
        groups = re.split("[^0-9]+", span)
        grouped = len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])
        ruled, known = luhn(digits) and 12 <= len(digits) <= 19, digits[0] in "3456"
    else:
        groups = re.findall("[0-9]+", span)
        grouped = len(groups) > 1 and 3 <= len(groups[-1]) <= 4
        ruled, known = 9 <= len(digits) <= 15, digits.startswith(_CALLING) if span[0] == "+" else span[0] in "(0"
    around = text[start - 1 : start] + text[end : end + 1]
    code = any(c.isalnum() or c in "_=/\\" for c in around) or any(w in before[-16:] for w in _CODE)
    cue = any(w in before for w in _CUES[name])
    return ("y" if strict else "-") + "".join("ny"[x] for x in (grouped, ruled, known)) + ("y" if cue else "-") + ("n" if code else "-")


def _pattern(text: str, start: int, kind: int, end: int, strict: bool) -> str:
    """Kind, votes and shape of a span, as a short string: what the classifier sees."""
    kinds = lambda c: "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"
    size = min((end - start) // 8, 4)
    return f"{kind}{votes(text, start, kind, end, strict)}{size}{kinds(text[start - 1 : start])}{kinds(text[end : end + 1])}"


def _find(df: DataFrame) -> DataFrame:
    """``k, t`` → ``k, spans`` with every strict and wider span and its pattern."""
    schema = f"k {df.schema['k'].dataType.simpleString()}, spans array<struct<start:int,kind:int,end:int,strict:boolean,pattern:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("pattern", pa.string())]))

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                strict = base_spans(text)
                found = [(*s, True) for s in strict] + [(*s, False) for s in _wide_spans(text, strict)]
                out.append([{"start": a, "kind": k, "end": b, "strict": s, "pattern": _pattern(text, a, k, b, s)} for a, k, b, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["k", "spans"])

    return df.mapInArrow(run, schema)


def reliabilities(patterns: list[str], counts: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each pattern is personal data, P(vote | class) by labeler) by expectation-maximisation.

    Two classes; labelers vote independently given the class, each kind has a prior of its own. The
    start trusts the majority of votes.
    """
    ballots = np.array([["yn-".index(c) for c in p[1:7]] for p in patterns])
    kinds = np.array([int(p[0]) for p in patterns])
    p = ((ballots == 0).sum(1) + 0.5) / (((ballots == 0) | (ballots == 1)).sum(1) + 1.0)
    table = np.zeros((2, ballots.shape[1], 3))
    for _ in range(steps):
        for c, weight in enumerate((1 - p, p)):
            for v in range(3):
                table[c, :, v] = 1.0 + (counts[:, None] * weight[:, None] * (ballots == v)).sum(0)
        table /= table.sum(2, keepdims=True)
        prior = np.array([(1 + (counts * p)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))])[kinds]
        each = np.log(table[:, np.arange(ballots.shape[1]), ballots]).sum(2)
        p = 1 / (1 + np.exp(np.clip(np.log((1 - prior) / prior) + each[0] - each[1], -50, 50)))
    return p, table


def classifier(patterns: list[str], counts: np.ndarray, p: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Probability of each pattern by a logistic regression on its letters, trained on the EM's probabilities."""
    letters = sorted({(i, c) for x in patterns for i, c in enumerate(x)} | {(0, x[0], i, c) for x in patterns for i, c in enumerate(x[1:7])}, key=str)
    place = {x: i for i, x in enumerate(letters)}
    rows = np.zeros((len(patterns), len(letters) + 1))
    rows[:, -1] = 1
    for r, x in enumerate(patterns):
        for i, c in enumerate(x):
            rows[r, place[i, c]] = 1
        for i, c in enumerate(x[1:7]):
            rows[r, place[0, x[0], i, c]] = 1
    weight = np.sqrt(counts) / np.sqrt(counts).sum()  # rare shapes count too
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (weight * q * (1 - q))[:, None]).T @ rows + ridge * np.eye(len(w))
        step = np.linalg.solve(h, rows.T @ (weight * (q - p)) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))


def private_spans(deployments: DataFrame, *, key: str = "platform_id", note: str = "note", threshold: float = 0.5) -> DataFrame:
    """One row for each record: ``key, spans``, the personal data in its whole note.

    ``spans`` is an array of ``(start, kind, end, strict)`` in code points, end exclusive, in the
    order of start and of the kinds email, ip, card, phone. Strict matches are always in: leftmost
    and apart within a kind; addresses ``local@host.domain``, four numbers of at most 255, 12 to 19 digits with a right
    check digit, and 9 to 15 digits after a plus. Wider looks (spelled-out addresses, IPv6, other
    separators, national phone numbers) are added where the classifier gives ``threshold`` or more.

    Six labelers vote on every span (strict pattern, grouping, number rules, gazetteers, context
    words, code around). Votes of all notes are counted by pattern; there are at most a few thousand
    patterns, whatever the input, and only their counts reach the driver. There expectation-maximisation estimates how
    reliable each labeler is, and a logistic regression on votes and shape is trained on its
    probabilities. Null and empty notes have no spans. Notes are read once, whole; each pattern
    search is linear in the text. Other columns are ignored; repeated records give repeated rows.
    """
    shared.small_batches(deployments.sparkSession)
    found = shared.cut(_find(deployments.select(F.col(key).alias("k"), F.col(note).alias("t"))))
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n"), F.bool_and("s.strict").alias("strict")).orderBy("pattern").collect()
    good = []
    if any(not r.strict for r in counted):
        names, counts = [r.pattern for r in counted], np.array([r.n for r in counted], dtype=float)
        p = classifier(names, counts, reliabilities(names, counts)[0])
        good = [x for x, q, r in zip(names, p, counted, strict=True) if not r.strict and q >= threshold]
    inside = F.array(*[F.lit(x) for x in good]) if good else F.array().cast("array<string>")
    kept = F.filter("spans", lambda s: s["strict"] | F.array_contains(inside, s["pattern"]))
    plain = F.transform(F.array_sort(kept), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["strict"].alias("strict")))
    return found.select(F.col("k").alias(key), plain.alias("spans"))
