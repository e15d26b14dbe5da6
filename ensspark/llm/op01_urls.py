"""URL filter: all glob rules run at once over each canonical URL, as one bit-parallel automaton.

A rule is a glob over ``host + path``. ``*`` stands for any characters, ``+`` for any characters but ``/``
(it stays within the host), ``?`` for one character; anything else for itself. Rules match the whole
canonical URL. Every rule takes one bit for each of its characters and one for its start; the bits of all
rules lie side by side in 64-bit words (Shift-And masks). A URL is read once: a step shifts all words by
one bit with carry, masks them by the character's reach mask and keeps the bits that loop on a wildcard.
NumPy takes the step for all URLs of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import prepared, table

LOOPS = {"*": None, "+": "/"}  # wildcard -> the character it does not pass
CARRY = np.uint64(63)
ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """A glob, its verdict and a name; the rule with the longest name wins, then the smaller name."""

    glob: str
    verdict: str
    name: str
    reported: bool = True


def host_rules(rules: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules ``host/path`` that fit a host, its subdomains and every path that starts like the rule's."""
    found = []
    for name, verdict in rules:
        found += [Rule(f"{name}*", verdict, name), Rule(f"+.{name}*", verdict, name)]
    return found


class Automaton:
    """Masks of a list of globs. Characters that no glob names share one class."""

    def __init__(self, globs: Sequence[str]):
        names = sorted({c for g in globs for c in g if c not in "*+?"} | {"/"})
        self.codes = np.array([ord(c) for c in names], dtype=np.uint32)
        reach: list[set[int]] = [set() for _ in range(len(names) + 1)]
        loop: list[set[int]] = [set() for _ in range(len(names) + 1)]
        start, accept, bit = set(), [], 0

        def loops(at: int, passed_by: str | None) -> None:
            for k in range(len(names) + 1):
                if k == len(names) or names[k] != passed_by:
                    loop[k].add(at)

        for glob in globs:
            start.add(bit)
            for c in glob:
                if c in LOOPS:
                    loops(bit, LOOPS[c])
                    continue
                bit += 1
                for k in range(len(names) + 1):
                    if c == "?" or (k < len(names) and names[k] == c):
                        reach[k].add(bit)
            accept.append(bit)
            bit += 1
        self.words = (bit + 63) // 64
        self.reach = np.stack([self._mask(x) for x in reach])
        self.loop = np.stack([self._mask(x) for x in loop])
        self.start = self._mask(start)
        self.accept = np.array(accept, dtype=np.int64)

    def _mask(self, bits: set[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            mask[b // 64] |= ONE << np.uint64(b % 64)
        return mask

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """For each text and glob, whether the glob fits the whole text."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.concatenate(([0], np.cumsum(size)))[order]
        at = np.searchsorted(self.codes, codes)
        kinds = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == codes, at, len(self.codes))
        size = size[order]
        state = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for step in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size, -step, side="left"))  # the URLs longer than step
            now = state[:live]
            kind = kinds[first[:live] + step]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> CARRY
            state[:live] = (moved & self.reach[kind]) | (now & self.loop[kind])
        hit = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & ONE
        out = np.empty(hit.shape, dtype=bool)
        out[order] = hit.astype(bool)
        return out


def canonical(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of every URL: the key, host, path, rule (name of the reported winner), verdict, glob.

    Reported rules come before others, then the longest name wins. A null or malformed URL has empty host
    and path and gets what the rules say of the empty text, usually the default. Repeated rows are judged
    one by one; further columns of the input are ignored; an empty table gives an empty result.
    """
    rules = sorted(rules, key=lambda r: (not r.reported, -len(r.name), r.name))
    host, path = canonical(url)
    rows = urls.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    schema = f"page_id {dict(urls.dtypes)[key]}, host string, path string, rule string, verdict string, glob string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in rules])
        for batch in batches:
            texts = [h + p for h, p in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True)]
            fits = automaton.matches(texts)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            won = [rules[i] if i >= 0 else None for i in best]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([r.name if r and r.reported else None for r in won], pa.string()),
                    pa.array([r.verdict if r else default for r in won], pa.string()),
                    pa.array([r.glob if r else None for r in won], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "glob"],
            )

    return rows.mapInArrow(run, schema)


# Fixed values of the query's contract.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# The method's own verdict where no host rule fits: unwanted kinds of sites, by name.
SITE_GLOBS = ["*cheap-pills*", "*spam-farm*", "*casino*", "+xxx+/*", "*viagra*"]
RULES = host_rules(HOST_RULES) + [Rule(g, "block", g, reported=False) for g in SITE_GLOBS]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the url of every page."""
    return judge(table(prepared(spark), sf_dir, "pages", "page_id", "url"), RULES)


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(name, verdict, rhost, rpath) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
globs("glob", pattern) AS (
  VALUES ('*cheap-pills*', '.*cheap-pills.*'), ('*spam-farm*', '.*spam-farm.*'), ('*casino*', '.*casino.*'),
         ('+xxx+/*', '[^/]*xxx[^/]*/.*'), ('*viagra*', '.*viagra.*')),
fit AS (
  SELECT s.page_id, r.name, r.verdict, s.host = r.rhost AS same,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.name) DESC, r.name) AS rn
  FROM split s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)),
site AS (
  SELECT s.page_id, g."glob", row_number() OVER (PARTITION BY s.page_id ORDER BY length(g."glob") DESC, g."glob") AS rn
  FROM split s JOIN globs g ON regexp_full_match(s.host || s.path, g.pattern))
SELECT s.page_id, s.host, s.path, f.name AS rule,
       coalesce(f.verdict, CASE WHEN g."glob" IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.name IS NOT NULL THEN CASE WHEN f.same THEN '' ELSE '+.' END || f.name || '*' ELSE g."glob" END AS "glob"
FROM split s LEFT JOIN fit f ON f.page_id = s.page_id AND f.rn = 1
             LEFT JOIN site g ON g.page_id = s.page_id AND g.rn = 1
"""
