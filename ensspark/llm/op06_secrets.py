"""Secrets by two character Markov models: random strings against ordinary identifiers.

Fixed patterns give the base spans, which always stay. Every other long token is scored by the logarithm of how
much likelier the model of random strings makes it than the model of ordinary identifiers; it is a secret if the
ratio passes a threshold as a whole and per character. Both models are trained from labelled samples: values of
base spans and words of the corpus, both bounded, with generated keys and joined words beside them.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm import spans
from ensspark.llm.common import Smallest, landed, prepared, table
from ensspark.llm.spans import Span

# Fixed values of the contract.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

ADDED = "random"
TRAIN_WORDS = 4000  # labelled samples of each class
LEAST_CHARS = 20
RATIO = 10.0  # natural logarithm, for the whole token
PER_CHAR = 0.6
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
INDEX = {c: i for i, c in enumerate(ALPHABET)}
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, leftmost and non-overlapping by kind, failing matches dropped.

    Runs of hex digits are found as whole runs of 24 or more, which is the same and linear.
    """
    found: list[Span] = []
    small = text.lower()
    if any(k in small for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Markov:
    """Probabilities of a character after the two before it, smoothed by those after one and none."""

    def __init__(self, samples: Sequence[str]):
        n = len(ALPHABET)
        one, two, three = np.full(n, 0.5), np.zeros((n + 1, n)), {}
        for s in samples:
            a = b = n
            for c in s:
                if (k := INDEX.get(c)) is None:
                    a = b = n
                    continue
                one[k] += 1
                two[b, k] += 1
                three[(a, b, k)] = three.get((a, b, k), 0) + 1
                a, b = b, k
        self.one = one / one.sum()
        self.two = (two + 4 * self.one) / (two.sum(axis=1, keepdims=True) + 4)
        self.three, self.seen = three, {}
        for (a, b, _), c in three.items():
            self.seen[(a, b)] = self.seen.get((a, b), 0) + c

    def score(self, token: str) -> float:
        a = b = len(ALPHABET)
        total = 0.0
        for c in token:
            k = INDEX[c]
            total += math.log((self.three.get((a, b, k), 0) + 8 * self.two[b, k]) / (self.seen.get((a, b), 0) + 8))
            a, b = b, k
        return total


def generated(n: int) -> list[str]:
    """Keys as generators make them, from a fixed seed."""
    rng = random.Random(13)
    sets = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 48))) for i in range(n)]


def joined_words(words: Sequence[str], n: int) -> list[str]:
    """Identifiers made of the corpus' words: with signs, in capitals, in camel case, with a number."""
    rng = random.Random(17)
    found = []
    for i in range(n if words else 0):
        own = rng.choices(words, k=rng.randint(2, 5))
        form = i % 7
        if form < 4:
            found.append("_-/="[form].join(own))
        elif form == 4:
            found.append("".join(w.capitalize() for w in own))
        elif form == 5:
            found.append("_".join(own).upper())
        else:
            found.append(f"{'-'.join(own)}-{rng.randint(0, 2024)}")
    return found


def labelled_samples(docs: DataFrame, text: str, n: int = TRAIN_WORDS) -> tuple[list[str], list[str]]:
    """Bounded samples (smallest hashes): values that the base finds, and words outside of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, plain = Smallest(n), Smallest(n)
        for batch in batches:
            for body in batch[0]:
                t = body.as_py()
                base = base_spans(t)
                for s, e, kind in base:
                    secret.add((ASSIGN.fullmatch(t[s:e])[2] if kind == "assign" else t[s:e])[:64])
                words = t.split() if not base else []
                for w in words[:: 1 + len(words) // 50]:
                    if len(w := w.strip(".,;:!?\"'()")[:40]) >= 4:
                        plain.add(w)
        rows = [(*r, True) for r in secret.rows()] + [(*r, False) for r in plain.rows()]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "h", "secret"])

    words = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(run, "word string, h long, secret boolean")
    words = landed(words, "secret-samples").distinct()
    best = lambda secret: [r[0] for r in words.where(F.col("secret") == secret).orderBy("h", "word").limit(n).collect()]
    return best(True), best(False)


class Ratio:
    """The two models and their decision."""

    def __init__(self, secret: Sequence[str], plain: Sequence[str]):
        keys = list(secret) + generated(TRAIN_WORDS)
        self.random, self.ordinary = Markov(keys), Markov([*plain, *(w.lower() for w in plain), *joined_words(plain, TRAIN_WORDS)])

    def of(self, token: str) -> float:
        return self.random.score(token) - self.ordinary.score(token)

    def secret(self, token: str) -> bool:
        ratio = self.of(token)
        return ratio > RATIO and ratio > PER_CHAR * len(token)


def fitted(docs: DataFrame, text: str = "text") -> Ratio:
    return Ratio(*labelled_samples(docs, text))


def find(text: str, ratio: Ratio) -> tuple[list[Span], list[Span]]:
    """Base spans and random tokens beside them."""
    base = base_spans(text)
    more = [(m.start(), m.end(), ADDED) for m in TOKEN.finditer(text)]
    return base, [s for s in spans.apart(more, base) if ratio.secret(text[s[0] : s[1]])]


def detected(docs: DataFrame, text: str = "text", ratio: Ratio | None = None) -> DataFrame:
    """Every row as ``row`` with its ``spans`` (kind, start, end in code points, whether of the base).

    A null or empty text has none. Repeated rows get the same spans; columns of the input stay inside ``row``,
    so no name can clash; an empty table gives an empty result. Time is linear in the text, whatever its length.
    """
    model = ratio or fitted(docs, text)
    return spans.with_spans(docs, text, lambda: lambda body: find(body, model), [*KINDS, ADDED])


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", ratio: Ratio | None = None) -> DataFrame:
    """The rows with every secret replaced by a mask; other columns and clean texts stay as they are."""
    rows = detected(docs, text, ratio)
    inner = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"])))
    body = F.col(f"row.{text}")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc, span):
        fresh = F.concat(acc["out"], F.substr(body, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mask))
        return F.when(span["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))).otherwise(
            F.struct(fresh.alias("out"), span["end"].alias("at"))
        )

    clean = F.aggregate(inner, state, add, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))))
    return rows.select(F.col("row").withField(text, F.when(F.size("spans") == 0, body).otherwise(clean)).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return spans.digest(detected(table(prepared(spark), sf_dir, "documents", "doc_id", "text")), KINDS)
