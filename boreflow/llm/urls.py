"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import fold_az, narrow

# (action, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
STRICT = ("porn", "xxx", "sex", "hentai", "milf", "nsfw", "camgirls", "escort", "jackpot", "warez", "keygen")
SOFT = ("adult", "casino", "bet", "poker", "slots", "dating", "hot", "nude", "torrent", "crack", "pills", "viagra", "win", "free", "loan")
SOFT_LIMIT = 2  # so many distinct soft terms reject


@functools.cache
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            a.add_word(t, (kind, t))
    if len(a):
        a.make_automaton()
    return a


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int, int]:
    """Strict places, soft places and distinct soft terms; a term counts only between boundaries.

    A boundary is the end of the url or a character other than a-z.
    """
    a = automaton(strict, soft)
    n_strict = n_soft = 0
    distinct = set()
    if not len(a):
        return 0, 0, 0
    for end, (kind, term) in a.iter(url):
        start = end - len(term) + 1
        if (start > 0 and "a" <= url[start - 1] <= "z") or (end + 1 < len(url) and "a" <= url[end + 1] <= "z"):
            continue
        if kind == "strict":
            n_strict += 1
        else:
            n_soft += 1
            distinct.add(term)
    return n_strict, n_soft, len(distinct)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z folded. Path: from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    has = F.coalesce(at, F.lit(0)) > 0
    return F.when(has, fold_az(host)).otherwise(""), F.when(has, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action, both null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES,
    strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft, n_soft_distinct.

    A fitting rule decides; without one the vocabulary does: one strict hit or ``soft_limit``
    distinct soft hits anywhere in the url block the page. Defined cases: a null url or one
    without ``://`` has empty host and path, no rule and is judged by the vocabulary alone (a null
    url has no hits and is allowed); repeated rows are judged one by one; an empty table gives no
    rows; urls of any length are read whole.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict long, n_soft long, n_soft_distinct long")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in urls:
            rows = [term_hits(u or "", strict, soft) for u in s]
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "n_soft_distinct"])

    p = narrow(pages, page_id=id_col, url=url_col)
    host, path = host_path(F.col("url"))
    p = p.withColumn("host", host).withColumn("path", path)
    p = p.withColumn("hit", hits(fold_az(F.coalesce("url", F.lit("")))))
    name, action = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("hit.n_strict") >= 1) | (F.col("hit.n_soft_distinct") >= soft_limit), "block").otherwise("allow")
    return p.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(action, own).alias("verdict"),
        "hit.n_strict", "hit.n_soft", "hit.n_soft_distinct",
    )
