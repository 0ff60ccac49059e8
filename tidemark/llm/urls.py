"""URL filter: rules by host and path first, then a weighted vocabulary that Aho-Corasick counts over whole batches of urls."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict): a rule fits its host and all subdomains, where the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Terms that tell by themselves, and terms that tell when several distinct ones come together; a url is rejected from weight LIMIT on.
STRICT = ("casino", "cialis", "escorts", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "dating", "drugs", "farm", "free", "jackpot", "keygen", "loan", "nude", "pharmacy", "pills", "poker", "replica", "sex", "slots", "torrent", "win")
LIMIT = 2
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, 1)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Letters and digits: a term next to one of them is part of a longer word.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True


class Vocabulary:
    """Distinct terms of each url, found in one walk of the automaton over all urls of a batch."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.terms = sorted(weights)
        if any(not t or t != t.lower() or not t.isascii() or "\n" in t for t in self.terms):
            raise ValueError("terms are lower-case ASCII, without line breaks")
        self.weights = np.array([weights[t] for t in self.terms], np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            self.automaton.add_word(term, (k, len(term)))
        self.automaton.make_automaton()

    def hits(self, urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of each distinct term that a url has as a word of its own, in their order; null has none."""
        # One byte for a character keeps places the same in bytes and characters; no term reaches over a line break.
        clean = pc.fill_null(pc.replace_substring_regex(pc.ascii_lower(urls), r"[^\x01-\x7F]|\n", " "), "")
        text = "\n".join(["", *clean.to_pylist(), ""])
        found = list(self.automaton.iter(text)) if self.terms else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(text.encode("ascii"), np.uint8)
        last = np.array([e for e, _ in found], np.int64)
        term, size = np.array([x for _, x in found], np.int64).T
        own = ~(_WORD[data[last - size]] | _WORD[data[last + 1]])
        row = np.searchsorted(np.flatnonzero(data == 10), last[own]) - 1
        pairs = np.unique(row * len(self.terms) + term[own])
        return pairs // len(self.terms), pairs % len(self.terms)


def best_rule(hosts: list[str], paths: list[str], rules: tuple[tuple[str, str, str], ...]) -> list[int]:
    """The place in ``rules`` of each url's longest fitting rule, -1 for none: one lookup for each suffix of the host, whatever the number of rules."""
    by_host: dict[str, list[int]] = {}
    for k in sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k)):
        by_host.setdefault(rules[k][0], []).append(k)
    deepest = max([h.count(".") + 1 for h in by_host], default=0)
    out = []
    for host, path in zip(hosts, paths, strict=True):
        labels, found = host.rsplit(".", deepest) if deepest else [], []
        for i in range(1, min(deepest, len(labels)) + 1):
            found += [k for k in by_host.get(".".join(labels[-i:]), ()) if path.startswith(rules[k][1])][:1]
        out.append(max(found, key=lambda k: (len(rules[k][0]) + len(rules[k][1]), -k), default=-1))
    return out


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, weights: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), weight and terms (distinct ones, joined by commas) of each url.

    The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes from
    there to ``?``, ``#`` or the end. Null urls and those without ``://`` have empty ones, which no rule fits. Of several
    fitting rules the longest wins (equally long: the first given); a url without a rule is blocked if the weights of its
    distinct terms reach ``limit``. A term counts where neither neighbour is an ASCII letter or digit, in either case. Rows
    are judged alone, so that repeats and long urls change nothing; no rows give no rows. Columns of pages that bear the
    name of a new one are replaced by it.
    """
    new = {"host": "string", "path": "string", "rule": "string", "verdict": "string", "weight": "long", "terms": "string"}
    kept = [c for c in pages.columns if c.lower() not in new]
    places = [f"c{k}" for k in range(len(kept))]  # mapInArrow takes no names with dots

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(weights)
        names = [h + p for h, p, _ in rules]
        for batch in batches:
            of, host, path = batch.columns[-3:]
            row, term = words.hits(of)
            weight = np.bincount(row, words.weights[term], len(of)).astype(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(of) + 1)), pa.int32()), pa.array([words.terms[k] for k in term], pa.string()))
            best = best_rule(host.to_pylist(), path.to_pylist(), rules)
            rule = pa.array([names[k] if k >= 0 else None for k in best], pa.string())
            verdict = pa.array([rules[k][2] if k >= 0 else "block" if w >= limit else "allow" for k, w in zip(best, weight, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], host, path, rule, verdict, pa.array(weight), pc.binary_join(listed, ",")], [*places, *new])

    def part(k: int) -> Column:
        return F.coalesce(F.regexp_extract(pages[f"`{url}`"], _URL, k), F.lit(""))

    host = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(*[pages[f"`{c}`"].alias(k) for c, k in zip(kept, places, strict=True)], pages[f"`{url}`"].alias("of"), host.alias("host"), part(2).alias("path"))
    schema = rows.drop("of", "host", "path").schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(judge, schema).toDF(*kept, *new)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "weight", "terms")


def _oracle() -> str:
    lists = ", ".join(f"('{t}', {w})" for t, w in sorted(VOCABULARY.items()))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rules (host, path, verdict) AS (VALUES {rules}), words (term, w) AS (VALUES {lists}),
u AS (SELECT row_number() OVER () AS id, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
      translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
r AS (SELECT u.id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.id),
h AS (SELECT u.id, sum(w) AS weight, string_agg(term, ',' ORDER BY term) AS terms FROM u JOIN words ON regexp_matches(u.lowered, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY u.id)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, CASE WHEN h.weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(h.weight, 0)::BIGINT AS weight, coalesce(h.terms, '') AS terms
FROM u LEFT JOIN r USING (id) LEFT JOIN h USING (id)
"""


OP11_SQL = _oracle()
