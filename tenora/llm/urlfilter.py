"""URL filtering by glob rules that a bit-parallel automaton matches all at once.

Every rule is a glob over the canonical URL ``.host`` NUL ``path``, where ``*`` stands for any run of bytes and ``?`` for
one. A glob with m items becomes m + 1 states; the states of all globs are packed into 64-bit words. One character moves
all states of all URLs of a batch with a shift and a mask (Shift-And), and states before or after a ``*`` also stay.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path prefix); a rule covers the host and all its subdomains.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
#: Ends the host in a canonical URL; a NUL inside a host or path is written as %00.
END = "\0"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_glob(host: str, prefix: str) -> str:
    return f"*.{host}{END}{prefix}*"


class ShiftAnd:
    """Matches every glob against whole byte strings."""

    def __init__(self, globs: Iterable[str]):
        self.globs = list(globs)
        states = sum(len(g.replace("*", "").encode()) + 1 for g in self.globs)
        self.words = max(1, -(-states // 64))
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        self.stay, self.start = np.zeros(self.words, dtype=np.uint64), np.zeros(self.words, dtype=np.uint64)
        self.accept = np.zeros((len(self.globs), 2), dtype=np.int64)
        at = 0
        for i, glob in enumerate(self.globs):
            self._set(self.start, at)
            for byte in glob.encode():
                if byte == ord("*"):
                    self._set(self.stay, at)
                    continue
                at += 1
                for b in range(256) if byte == ord("?") else [byte]:
                    self._set(self.step[b], at)
            self.accept[i] = at // 64, at % 64
            at += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A boolean row per text with a column per glob.

        Texts run side by side, longest first, so a long one costs only its own steps; memory is the batch's bytes.
        """
        n, one, top = len(texts), np.uint64(1), np.uint64(63)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[order]
        data, running = np.frombuffer(b"".join(texts), dtype=np.uint8), lengths[order]
        state = np.tile(self.start, (n, 1))
        alive = n
        for i in range(int(running[0]) if n else 0):
            while running[alive - 1] <= i:
                alive -= 1
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.step[data[starts[:alive] + i]]) | (now & self.stay)
        found = np.empty((n, len(self.globs)), dtype=bool)
        bits = (state[:, self.accept[:, 0]] >> self.accept[:, 1].astype(np.uint64)) & one
        found[order] = bits.astype(bool)
        return found


def judge(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES, default: str = DEFAULT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. Nothing is shuffled.

    Of the rules that fit, the longest (host and path) decides, the earlier one of equals. No fitting rule gives a null
    rule and the default verdict; so do null URLs and URLs without a host. Rows that repeat a URL get the same verdict.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names, verdicts = [*[r[1] + r[2] for r in ranked], None], [*[r[0] for r in ranked], default]  # the last if none fits
    globs = [host_glob(r[1], r[2]) for r in ranked]
    machine: list[ShiftAnd] = []

    @F.pandas_udf(T.IntegerType())
    def fitting(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        if not machine:
            machine.append(ShiftAnd(globs))
        texts = [
            f".{h.replace(END, '%00')}{END}{p.replace(END, '%00')}".encode("utf-8", "surrogatepass")
            for h, p in zip(hosts, paths)
        ]
        found = machine[0].match(texts)
        return pd.Series(np.where(found.any(axis=1), found.argmax(axis=1), len(globs)), dtype="int32")

    split = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return split.withColumn("at_", fitting("host", "path")).select(
        "page_id", "host", "path", F.get(F.array(*map(F.lit, names)), F.col("at_")).alias("rule"),
        F.get(F.array(*map(F.lit, verdicts)), F.col("at_")).alias("verdict"),
    )


#: ``judge`` with the rules above in SQL.
SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, prefix) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.prefix AS rule, r.verdict FROM p LEFT JOIN r
    ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.prefix))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), '{DEFAULT}') AS verdict
FROM m GROUP BY page_id, host, path
"""
