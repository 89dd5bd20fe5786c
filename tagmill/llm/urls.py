"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary, term by term: a weight of 1 or more is strict and rejects alone; soft terms add up. A deployment reads its own.
STRICT = ("adult-x", "casino", "cheap-pills", "escort", "free-bets", "hentai", "malware", "phishing", "porn", "spam-farm", "torrent", "viagra", "warez", "xxx")
SOFT = {
    "ads": 0.5, "adult": 0.6, "bet": 0.6, "bets": 0.6, "betting": 0.7, "bonus": 0.4, "cheap": 0.5, "click": 0.4, "coupon": 0.3, "crack": 0.5, "deal": 0.3, "download": 0.2, "farm": 0.5, "free": 0.5, "gambling": 0.8, "jackpot": 0.7,
    "keygen": 0.8, "loan": 0.5, "loans": 0.5, "nude": 0.8, "payday": 0.6, "pills": 0.6, "poker": 0.7, "sex": 0.8, "slots": 0.7, "spam": 0.6, "track": 0.5, "win": 0.5,
}

#: Fixed values of the query's contract: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

def read_vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[str], dict[str, float]]:
    """(strict terms, soft terms with weights) of a CSV file with the columns term and weight; a weight of 1 or more, or none, is strict.

    The terms go to the driver and into every task's automaton, so a file of more than `most` distinct terms is refused.
    A term that is listed more than once has its highest weight.
    """
    rows = spark.read.csv(path, header=True, schema="term string, weight double").where("trim(term) <> ''")
    found = rows.groupBy(F.lower(F.trim("term")).alias("term")).agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a vocabulary has at most {most} terms")
    return sorted(r.term for r in found if r.weight >= 1), {r.term: r.weight for r in sorted(found) if 0 < r.weight < 1}


_ROW = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"


def split_url(url: str = "url"):
    """(host, path): between the first :// and / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    low = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _judge(rules: Sequence[tuple[str, str, str]], strict: Sequence[str], soft: Mapping[str, float], reject_at: float):
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict:
            automaton.add_word(term.lower(), (term.lower(), 1.0, True))
        for term, weight in soft.items():
            if term.lower() not in automaton:
                automaton.add_word(term.lower(), (term.lower(), weight, False))
        automaton.make_automaton()
        by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            by_host.setdefault(host.lower(), []).append((path, action))

        def ruled(host: str, path: str) -> tuple[str | None, str | None]:
            best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
            labels = host.split(".") if host else []
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for start, action in by_host.get(suffix, ()):
                    if path.startswith(start) and (len(suffix) + len(start), len(suffix)) > best[:2]:
                        best = (len(suffix) + len(start), len(suffix), suffix + start, action)
            return best[2], best[3]

        def hits(url: str) -> tuple[set[str], dict[str, float]]:
            low, hard, mild = url.lower(), set(), {}
            for end, (term, weight, is_strict) in automaton.iter(low):
                start = end - len(term) + 1
                if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                    continue
                if is_strict:
                    hard.add(term)
                else:
                    mild[term] = weight
            return hard, mild

        for urls, hosts, paths in batches:
            out = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                rule, action = ruled(host, path)
                hard, mild = hits(url) if url else (set(), {})
                weight = round(sum(mild.values()), 6)
                verdict = action or ("block" if hard or (len(mild) > 1 and weight > reject_at - 1e-9) else "allow")
                out.append((host, path, rule, verdict, len(hard), len(mild), weight))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])

    return judge


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, reject_at: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of every row of pages.

    The longest rule whose host is the url's or a parent domain of it, and whose path starts the url's path, decides; of two as
    long as each other the one with the longer host, of one rule given twice the first.
    Elsewhere the vocabulary does: one automaton pass finds all terms of the lower-cased url; a hit counts only if no
    letter or digit adjoins it; one strict term, or two or more distinct soft terms weighing reject_at together, block.
    The work is one narrow pass that reads two columns: no shuffle, whatever host dominates.

    Null page_ids are judged like others and urls read whole, however long. Null urls and urls without :// have empty host and path, fit no rule, and a null or empty url is allowed. A term
    repeated in a url counts once; repeated rows are judged alike. Other columns are ignored; an empty table gives no rows.
    """
    host, path = split_url()
    judge = F.pandas_udf(_judge(rules, strict, soft, reject_at), _ROW)
    return pages.select("page_id", judge(F.col("url"), host, path).alias("j")).select("page_id", "j.*")
