"""Tokens of the keyword arm: runs of Hangul with their bigrams, runs of Latin letters and digits."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Saturation, length normalisation and the constant average length.
K1, B, AVG_LEN = 1.2, 0.75, 256.0

RUNS = "([가-힣]+|[a-z0-9]+)"


def tokens(text: Column) -> Column:
    """All tokens in order: each run, and after a Hangul run its bigrams (so a run of two counts twice); null gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    hangul = lambda r: (r >= F.lit("가")) & (F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: F.when(hangul(r), F.concat(F.array(r), pairs(r))).otherwise(F.array(r))))


def query_terms(text: str | None) -> list[str]:
    """The distinct tokens of a query, in order; on the driver, since a query is a literal."""
    out: dict[str, None] = {}
    for run in re.findall(RUNS, (text or "").lower()):
        out[run] = None
        if run >= "가":
            out |= dict.fromkeys(a + b for a, b in zip(run, run[1:]))
    return list(out)


def token_counts(text: str | None) -> tuple[Counter[str], int]:
    """(how often each token occurs, number of tokens) of one text; equals counting tokens()."""
    counts = Counter(re.findall(RUNS, (text or "").lower()))
    for run, n in [x for x in counts.items() if x[0] >= "가"]:
        for a, b in zip(run, run[1:]):
            counts[a + b] += n
    return counts, counts.total()


def token_id(token: Column) -> Column:
    """The first four bytes of the MD5, little-endian, as a LONG."""
    h = F.md5(token)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def tf_weight(tf: Column, length: Column, k1: float = K1, b: float = B, avg_len: float = AVG_LEN) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1)."""
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
