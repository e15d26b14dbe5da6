"""Personal data by a semi-Markov conditional random field over whole candidate spans.

Fixed patterns give the base spans, which always stay. Around digits, at-signs and their spellings the text is
cut into zones; what the base leaves of a zone is cut into atoms (numbers, words, single signs). A segmentation
of the atoms is scored by features of whole spans (how many digits, in which groups, with which signs, check
digit, octets, domain, what stands left and right) and the best one is found by dynamic programming that bounds an
entity's atoms, so boundaries and types are chosen together. Weights are trained by structured passes over a
bounded sample of zones, labelled by the base patterns, and over examples of other usual spellings.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm import spans
from ensspark.llm.common import Smallest, prepared, table
from ensspark.llm.spans import Span

# Fixed values of the contract.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TRAIN_ZONES = 400  # labelled zones of the corpus that the weights are trained on
EPOCHS = 4
MOST_ATOMS = 17  # bound of an entity, in atoms; a spelt-out sign with its blanks and brackets is one
SEED = re.compile(r"[0-9@]|[\[(](?:[aA][tT]|[dD][oO][tT])[\])]")
ATOM = re.compile(r" ?[\[(](?:[aA][tT]|[dD][oO][tT])[\])] ?|[0-9]+|[^\W\d_]+|.", re.S)
BREAK = re.compile(r"[\t-\r]")
AT = re.compile(r"\s?[\[(]at[\])]\s?|@", re.I)
DOT = re.compile(r"\.|[\[(]dot[\])]", re.I)
MAIL = re.compile(r"[\w.%+-]+(?:\s?[\[(]at[\])]\s?|@)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]+)*", re.I | re.A)
ZONE_CHARS = 120  # length up to which white space joins chunks to a zone that weights are trained on


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, leftmost and non-overlapping by kind, failing matches dropped.

    Linear in the text: an address is searched from its at-sign, so that long runs of letters cost nothing.
    """
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        rest = DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            found.append((start, rest.end(), "email"))
            free = rest.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


def zones(text: str, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of white-space-free chunks that hold a seed; chunks one blank apart make one zone, up to a length if given."""
    start = end = -1
    for m in SEED.finditer(text):
        if m.start() < end:
            continue
        a = max(text.rfind(" ", max(end, 0), m.start()) + 1, max(end, 0))
        for b in BREAK.finditer(text, a, m.start()):
            a = b.end()
        stop = text.find(" ", m.end())
        stop = len(text) if stop < 0 else stop
        if m.end() - m.start() > 1:  # a spelt-out sign may stand alone between blanks: take its neighbours
            a = max(text.rfind(" ", max(end, 0), max(a - 1, 0)) + 1, max(end, 0))
            for b in BREAK.finditer(text, a, m.start()):
                a = b.end()
            stop = text.find(" ", min(stop + 1, len(text)))
            stop = len(text) if stop < 0 else stop
        if cut := BREAK.search(text, m.end(), stop):
            stop = cut.start()
        if start >= 0 and a - end <= 1 and text[end:a] in ("", " ") and (most is None or stop - start <= most):
            end = stop
            continue
        if start >= 0:
            yield start, end
        start, end = a, stop
    if start >= 0:
        yield start, end


def gaps(zone: tuple[int, int], base: Sequence[Span]) -> Iterator[tuple[int, int]]:
    """What sorted base spans leave of a zone."""
    at = zone[0]
    for s, e, _ in base:
        if e <= at or s >= zone[1]:
            continue
        if s > at:
            yield at, s
        at = max(at, e)
    if at < zone[1]:
        yield at, zone[1]


def _feasible(kind: str, s: str, digits: int) -> bool:
    if kind == "email":
        at = AT.search(s)
        return at is not None and DOT.search(s, at.end()) is not None
    if any(c.isalpha() for c in s):
        return False
    return s.count(".") == 3 if kind == "ip" else 7 <= digits <= 19


def features(kind: str, s: str, left: str, right: str) -> list[str]:
    """Whole-span features of a candidate."""
    out = ["bias", "cut left" if left.isalnum() or left in "_@+" and left else "left", "cut right" if right.isalnum() or right == "@" else "right"]
    if kind == "email":
        m = MAIL.fullmatch(s)
        end = re.split(r"\.|dot[\])]\s?", s, flags=re.I)[-1]
        out += ["mail" if m else "no mail", "ends in letters" if end.isalpha() and 2 <= len(end) <= 12 else "odd end", "one" if len(AT.findall(s)) == 1 else "many"]
    else:
        groups = re.findall(r"[0-9]+", s)
        signs = "".join(sorted({c for c in s if not c.isdigit()}))
        digits = "".join(groups)
        out += [f"digits {min(len(digits), 20)}", f"groups {'-'.join(str(len(g)) for g in groups[:6])}", f"signs {signs}", "ends well" if s[-1].isdigit() else "ends badly", f"first {'0' if s[0].isdigit() else s[0]}"]
        if kind == "card":
            out.append("luhn" if luhn(digits) else "no luhn")
        if kind == "ip":
            out.append("octets" if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups) else "no octets")
    return [f"{kind} {f}" for f in out]


class Field:
    """Weights of features and the search for the best segmentation."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = Counter(weights or {})

    def score(self, names: Sequence[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def candidates(self, text: str, cuts: Sequence[int]) -> Iterator[tuple[int, int, str, list[str]]]:
        """Every feasible entity of bounded length, by atom numbers."""
        n = len(cuts) - 1
        for i in range(n):
            c = text[cuts[i]]
            if not (c.isalnum() or c in "+("):
                continue
            for j in range(i + 1, min(n, i + MOST_ATOMS) + 1):
                if not text[cuts[j] - 1].isalnum():
                    continue
                s = text[cuts[i] : cuts[j]]
                digits = sum("0" <= x <= "9" for x in s)
                if digits < 4 and not AT.search(s):
                    continue
                left, right = text[cuts[i] - 1 : cuts[i]] if cuts[i] else "", text[cuts[j] : cuts[j] + 1]
                for kind in KINDS:
                    if _feasible(kind, s, digits):
                        yield i, j, kind, features(kind, s, left, right)

    def best(self, text: str, start: int, end: int) -> list[Span]:
        """The entities of the best segmentation; other atoms are segments of their own and score nothing."""
        cuts = [start, *(m.end() for m in ATOM.finditer(text, start, end))]
        ending: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind, names in self.candidates(text, cuts):
            if (score := self.score(names)) > 0:
                ending.setdefault(j, []).append((i, kind, score))
        if not ending:
            return []
        best, back = [(0.0, 0)] * len(cuts), [None] * len(cuts)  # of equal scores the one that covers more
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            for i, kind, score in ending.get(j, ()):
                whole = best[i][0] + score, best[i][1] + cuts[j] - cuts[i]
                if whole > best[j]:
                    best[j], back[j] = whole, (i, kind)
        found, j = [], len(cuts) - 1
        while j > 0:
            if back[j]:
                found.append((cuts[back[j][0]], cuts[j], back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return found[::-1]

    def train(self, labelled: Sequence[tuple[str, Sequence[Span]]], epochs: int = EPOCHS) -> Field:
        """Averaged structured updates: raise the labelled spans' features, lower those wrongly found."""
        total: Counter = Counter()
        for _ in range(epochs):
            for text, gold in labelled:
                guess, gold = set(self.best(text, 0, len(text))), set(gold)
                for sign, own in ((1.0, gold - guess), (-1.0, guess - gold)):
                    for s, e, kind in own:
                        for name in features(kind, text[s:e], text[s - 1 : s] if s else "", text[e : e + 1]):
                            self.weights[name] += sign
                for name, w in self.weights.items():
                    total[name] += w
        n = max(1, epochs * len(labelled))
        return Field({k: v / n for k, v in total.items()})


def examples(n: int = 40) -> list[tuple[str, list[Span]]]:
    """Labelled examples of usual spellings and of numbers that are nobody's data, from a fixed seed."""
    rng = random.Random(7)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    found = []
    for _ in range(n):
        number, area = f"{digits(3)}-{digits(4)}", digits(3)
        for s in (f"({area}) {number}", f"{area}-{number}", f"+{rng.randint(1, 9)} ({area}) {number}"):
            found.append((f"{name()} {s} {name()}", s, "phone"))
        who, where = f"{name()}.{digits(2)}", f"{name()}.{rng.choice(['com', 'org', 'net', 'de', 'example.com'])}"
        for s in (f"{who}@{where}", f"{who} [at] {where}", f"{who}(at){where}", f"{name()} [at] {name()} [dot] com"):
            found.append((f"{name()} {s}, {name()}", s, "email"))
        c = card()
        for s in (c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"):
            found.append((f"{name()} {s}. {name()}", s, "card"))
        s = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        found.append((f"{name()} {s}, {name()}", s, "ip"))
        for s in (f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", digits(rng.randint(4, 20)), f"{digits(2)},{digits(3)},{digits(3)}.{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(3)}.{digits(4)}",
                  f"{digits(4)}-{digits(4)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(5)} {digits(5)} {digits(5)}", f"978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", f"{digits(8)}/{digits(8)}", f"@{name()}", f"{name()}@{name()}", f"{name()}@{digits(2)}", f"{digits(2)}@{digits(3)}", f"{name()} (at) {name()}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}9"):
            found.append((f"{name()} {s} {name()}", s, None))
    return [(t, [(t.index(s), t.index(s) + len(s), kind)] if kind else []) for t, s, kind in found]


def labelled_zones(docs: DataFrame, text: str, n: int = TRAIN_ZONES) -> list[tuple[str, list[Span]]]:
    """A bounded sample of the corpus' zones (those with the smallest hashes) with their base spans as labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Smallest(n)
        for batch in batches:
            for body in batch[0]:
                t = body.as_py()
                for a, b in zones(t, ZONE_CHARS):
                    if b - a <= 2 * ZONE_CHARS:
                        found.add(t[max(0, a - 1) : b + 1])
        rows = found.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["zone", "h"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(run, "zone string, h long")
    sample = rows.distinct().orderBy("h", "zone").limit(n).collect()
    return [(r[0], spans.ordered(base_spans(r[0]), KINDS)) for r in sample]


def fitted(docs: DataFrame, text: str = "text") -> Field:
    """Weights from the corpus' labelled zones and the examples."""
    labelled = labelled_zones(docs, text) + examples()
    random.Random(11).shuffle(labelled)
    return Field().train(labelled)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and those the field adds."""
    base = spans.ordered(base_spans(text), KINDS)
    if not SEED.search(text):
        return base, []
    more = [s for zone in zones(text) for a, b in gaps(zone, base) for s in field.best(text, a, b)]
    return base, more


def detected(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """Every row as ``row`` with its ``spans`` (kind, start, end in code points, whether of the base).

    A null or empty text has none. Repeated rows get the same spans; columns of the input stay inside ``row``,
    so no name can clash; an empty table gives an empty result. Time is linear in the text, whatever its length.
    """
    weights = dict((field or fitted(docs, text)).weights)

    def start():
        own = Field(weights)
        return lambda body: find(body, own)

    return spans.with_spans(docs, text, start, KINDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return spans.digest(detected(table(prepared(spark), sf_dir, "documents", "doc_id", "text")), KINDS)
