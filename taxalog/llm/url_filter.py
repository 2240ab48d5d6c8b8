"""URL filter (operator 1): rules on host and path, else a logistic regression.

The model reads hashed character n-grams of host and path and is trained on a
small labelled table of URLs that any caller can replace.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
ORDERS = (3, 4, 5)
ROUNDS, RATE, L2 = 400, 1.0, 1e-3
THRESHOLD = 0.5

#: (verdict, host, path); the longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The labelled table: words and shapes of hosts and paths that crawls commonly block or keep.
_BLOCKED = ("casino", "casino-win", "poker", "slots", "jackpot", "free-bets", "betting", "cheap-pills", "pharmacy-sale",
            "viagra", "adult-cams", "xxx", "porn-tube", "escort", "payday-loan", "win-prize", "crack-keygen", "warez")
_KEPT = ("news", "library", "museum", "university", "cooking", "garden", "travel", "science", "weather", "history",
         "music", "recipes", "sports", "health", "school", "city", "books", "forum", "docs", "blog", "wiki")
_SHAPES = ("{}.example.com/en/12", "www.{}.example.net/", "blog.{}.example.org/fr/34.html", "m.{}.site.com/de/page")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): every word of the two lists in some usual shapes."""
    return [("http://" + shape.format(word), label) for words, label in ((_BLOCKED, 1), (_KEPT, 0))
            for word in words for shape in _SHAPES]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if found else ""
    path = re.match(r"[^?#]*", rest[len(host):])[0] if found else ""
    return host.translate(_LOWER), path


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, which do not share buckets by name."""
    found = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        found.update(f"{part}{text[k:k + n]}" for n in ORDERS for k in range(len(text) - n + 1))
    return np.unique([zlib.crc32(g.encode("utf-8", "replace")) & ((1 << bits) - 1) for g in found] or [0])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        at = grams(host, path)
        z = self.weights[at].sum() / np.sqrt(len(at)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(urls: Sequence[tuple[str, int]] | None = None) -> UrlModel:
    """Gradient descent on the log loss with L2; the table is small and fits the driver."""
    rows = [(grams(*split_url(url)), label) for url, label in urls or labelled_urls()]
    used = np.unique(np.concatenate([at for at, _ in rows]))
    x = np.zeros((len(rows), len(used)))
    for k, (at, _) in enumerate(rows):
        x[k, np.searchsorted(used, at)] = 1 / np.sqrt(len(at))
    y, w, b = np.array([label for _, label in rows], float), np.zeros(len(used)), 0.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= RATE * (x.T @ error / len(rows) * 10 + L2 * w)
        b -= RATE * error.mean()
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return UrlModel(weights, float(b))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) columns, null where no rule fits; longer rules are asked first, of equal ones the earlier."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``; one narrow stage.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and gets what the model says of them. Repeated rows are judged alike; columns
    of these names are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([model.score(h.as_py(), p.as_py()) for h, p in zip(hosts, paths)], pa.float64())

    rows = (pages.select(*names, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
            .withColumn("score", score("host", "path")))
    model_says = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return rows.select(*names, "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, model_says).alias("verdict"))


def kept(pages: DataFrame, model: UrlModel) -> DataFrame:
    """The rows of ``pages`` that are allowed."""
    return judge(pages, model).where("verdict = 'allow'").select(*pages.columns)
