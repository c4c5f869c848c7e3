"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import ascii_lower, whole_row

#: verdict, rule (host/path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Fixed vocabulary, a parameter of url_filter. One of these rejects a url: sexual content, malware and fraud, piracy,
#: medicine spam, in English, Spanish, French and German.
STRICT = tuple(
    "adult-x adultchat adultsex beastiality bestiality blowjob bukkake camgirls camsex cumshot deepthroat ebony-porn escort-service "
    "escortgirls freeporn fuck gangbang hardcore hentai hookups incest livesex milf nudes onlyfans-leak orgy porn porn-tube porno "
    "pornhub pornos pornstars putas sexcam sexchat sexo sexshop sexvideos sexcams shemale upskirt xhamster xnxx xvideos xxx "
    "child-porn malware phishing ransomware spam-farm spyware trojan keylogger warez torrents-free serial-keys cracked-software "
    "cheap-pills cheap-viagra buy-viagra cialis-online levitra tramadol viagra xanax".split()
)
#: So many different ones of these reject it.
SOFT = tuple(
    "18plus adult adulte adultos adulto amateur babes bet bets betting bingo blackjack bonus brides busty cams casino casinos cash "
    "cheap chicas cialis clickbank coupon crack cracks credit dating debt desnuda drugs earn erotic erotica erotik escort escorts "
    "farm fetish forex free freebies gambling generic girls gratis gratuit hack hacks hot jackpot kamagra keygen kostenlos lesbian "
    "lingerie loan loans lottery lotto mature money naked nackt nude nudist nue payday pharmacy pharma pills poker prescription "
    "prizes promo replica replicas roulette rx seduction serial sex sexe sexy slot slots spam spins sportsbook strip teen teens "
    "tits torrent torrents unlimited vip voyeur wager webcam wetten win winner".split()
)
SOFT_LIMIT = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, else null; of equally long ones the last in text order."""
    chosen = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, at = rule.split("/", 1)
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{at}")
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` with ``host, path, rule, n_strict, n_soft, verdict``.

    The verdict is the longest fitting rule's; where none fits, ``block`` if the url holds at least one strict term or
    ``soft_limit`` different soft terms, else ``allow``. A term counts where no ASCII letter or digit touches it, A-Z
    lower-cased, anywhere in the url. A null or empty url has empty host and path, no terms, and is allowed. Columns
    of ``pages`` with the names of new ones are replaced; repeated rows are judged alike. The automaton is built from
    the vocabulary once a task; the terms are a parameter and don't grow with the data.
    """
    new = ("host", "path", "rule", "verdict", "n_strict", "n_soft")
    kept = [c for c in pages.columns if c not in new or c == url]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule = rule_of(host, path, rules)
    counted = pages.select(whole_row(pages, kept), host.alias("host"), path.alias("path"), rule.alias("rule"), _terms(strict, soft)(ascii_lower(F.col(url))).alias("terms"))
    by_rule = F.create_map(*(F.lit(x) for verdict, r in rules for x in (r, verdict))) if rules else F.create_map().cast("map<string,string>")
    found = F.when((F.col("terms.n_strict") > 0) | (F.col("terms.n_soft") >= soft_limit), "block").otherwise("allow")
    return counted.select(*(F.col("row")[c].alias(c) for c in kept if c not in new), "host", "path", "rule", F.col("terms.n_strict").alias("n_strict"), F.col("terms.n_soft").alias("n_soft"), F.coalesce(by_rule[F.col("rule")], found).alias("verdict"))


def _terms(strict, soft):
    @F.pandas_udf("n_strict bigint, n_soft bigint")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        search = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):  # a term in both lists is strict
            for x in terms:
                search.add_word(x, (x, weight))
        search.make_automaton()
        for batch in urls:
            yield pd.DataFrame([_count(search, u) for u in batch], columns=["n_strict", "n_soft"])

    return count


def _count(search: ahocorasick.Automaton, url: str | None) -> tuple[int, int]:
    found = {}
    if url and len(search):
        for end, (term, weight) in search.iter(url):
            start = end - len(term) + 1
            if not (start and _letter(url[start - 1])) and not (end + 1 < len(url) and _letter(url[end + 1])):
                found[term] = weight
    n_strict = sum(w == 2 for w in found.values())
    return n_strict, len(found) - n_strict


def _letter(c: str) -> bool:
    return c.isascii() and c.isalnum()
