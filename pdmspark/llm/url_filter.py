"""URL filter: a weighted vocabulary matched with Aho-Corasick, under rules for hosts and paths."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed

#: One of these in a url rejects it.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "escorts", "viagra", "cialis", "onlinecasino", "warez", "hardcore")
#: ``MIN_SOFT`` different ones of these do.
SOFT_TERMS = ("adult", "sex", "sexy", "nude", "dating", "casino", "poker", "betting", "jackpot", "slots", "loan", "loans", "crack", "keygen", "torrent", "pills", "escort", "cam", "webcam", "hot")
MIN_SOFT = 2
#: (what, rule): a host, a slash and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z in lower case; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. For up to some hundreds of rules."""
    out = F.lit(None)
    for what, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("verdict"))).otherwise(out)
    return out


@functools.lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        out.add_word(term, (len(term), term, term in strict))
    out.make_automaton()
    return out


def term_hits(url: Column, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS) -> Column:
    """(strict, soft): how many different strict and soft terms the url has, in any case, as words.

    A term counts where no ASCII letter or digit stands before or after it. A null url has none.
    """
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = automaton(strict, soft)
        alnum = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        to_lower = str.maketrans(UPPER, LOWER)
        for urls in batches:
            rows = []
            for url in urls:
                text = url.translate(to_lower) if url else ""
                found: set[tuple[str, bool]] = set()
                for last, (length, term, is_strict) in words.iter(text):
                    if text[last + 1 : last + 2] not in alnum and (last < length or text[last - length] not in alnum):
                        found.add((term, is_strict))
                n = sum(is_strict for _, is_strict in found)
                rows.append((n, len(found) - n))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return F.pandas_udf(count, "strict int, soft int")(url)


def judge_urls(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, min_soft: int = MIN_SOFT) -> DataFrame:
    """Every row of ``df`` with host, path, strict_hits, soft_hits, rule and verdict (allow or block).

    The longest fitting rule decides; without one, a url is blocked for one strict or ``min_soft``
    different soft terms. A null url has empty host and path and is allowed. Columns of df with these
    names are replaced.
    """
    url = F.col(url_col)
    out = boxed(df, host_of(url).alias("host"), path_of(url).alias("path"), term_hits(url, strict, soft).alias("hits"))
    out = out.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= min_soft)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow"))
    added = {"host": F.col("host"), "path": F.col("path"), "strict_hits": F.col("hits.strict"), "soft_hits": F.col("hits.soft"), "rule": F.col("fit.rule"), "verdict": verdict}
    return unboxed(out, list(added), *[c.alias(n) for n, c in added.items()])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def _sql() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    hits = lambda terms: f"len(list_filter({list(terms)!r}, lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::INT"
    fits, ordered = [], sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    for what, rule in ordered:
        own, _, rest = rule.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')", rule, what))
    rule = " ".join(f"WHEN {a} THEN '{b}'" for a, b, _ in fits)
    verdict = " ".join(f"WHEN {a} THEN '{c}'" for a, _, c in fits)
    return f"""
WITH u AS (
  SELECT page_id, url, {low} AS low, instr(url, '://') AS pos, substr(url, instr(url, '://') + 3) AS rest FROM pages
), p AS (
  SELECT page_id, low,
         CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), h AS (SELECT *, {hits(STRICT_TERMS)} AS strict_hits, {hits(SOFT_TERMS)} AS soft_hits FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits >= 1 OR soft_hits >= {MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits
FROM h
"""


SQL = _sql()
