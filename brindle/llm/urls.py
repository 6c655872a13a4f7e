"""URL filters: a weighted vocabulary found by Aho-Corasick, and host rules.

A term counts where no ASCII letter or digit stands beside it.  One strict term rejects a url, and so do
`soft_limit` different soft terms.  Rules come first: a rule fits its host and all subdomains where the path
starts with the rule's; the longest that fits wins and gives the verdict.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
A url that is null or has no `://` has both empty, no rule, and only the vocabulary judges it (null: allow).
Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# A vocabulary of words for what training text should not come from, after no table in particular.  Larger lists
# are files for read_vocabulary.  Strict terms say it alone, soft ones together.
STRICT = tuple(
    """adultchat adultdating adultfilm adultporn bdsm blackjack bukkake camgirl camgirls camsex casino casinos cialis cracked-software creampie cumshot deepfakes
    dildo escort escorts ecstasy-shop fakeid fetish gangbang gore hardcoresex hentai hookup-sites incest keygen keygens kamagra lolicon malware milf nudes onlinecasino
    pharma-online phish phishing porn porno pornhub pornstar pornstars pornvideo roulette-online sexcam sexcams sexchat sexshop sexvideo slots-online spyware steroids-shop
    stripclub stripper swingers torrentz tramadol trojan upskirt viagra voyeur warez webcamsex xanax-online xxx xxxvideo""".split()
)
SOFT = tuple(
    """18plus adult ads adware affiliate affiliates babes baccarat bet bets betting bingo binary-options bonus bonuses booty bride brides cams cash cheap clickbait coupon coupons
    crack cracks credit crypto dating deal deals discount discounts drugs earn easy-money erotic essay-writing farm fast-loans forex free freebie freespins gamble gambling
    get-rich girls giveaway hack hacks hot hotgirls install-now jackpot kinky loan loans lottery lucky meds miracle money nude offer offers payday pill pills poker popunder popups
    pharmacy promo promos prize prizes pyramid replica rich roulette sale sales seo sexy singles slot slots spam spins stream-free streams sweepstakes torrent torrents track
    tracker traffic unlimited vape watches weed weight-loss win winner winners""".split()
)

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

_PARTS = regex.compile(r"://([^/?#]*)([^?#]*)", regex.DOTALL)
_LOWER = {i: i + 32 for i in range(65, 91)}
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    if url is None or (m := _PARTS.search(url)) is None:
        return "", ""
    return m[1].translate(_LOWER), m[2]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str, str] | None:
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), default=None)


def read_vocabulary(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a text file of `weight<TAB>term` lines, read on the driver: weight 2 or more is strict, 1 soft; empty lines and those after # don't count."""
    strict, soft = [], []
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                weight, term = line.rstrip("\n").split("\t", 1)
                (strict if float(weight) >= 2 else soft).append(term.strip().translate(_LOWER))
    return tuple(strict), tuple(soft)


class Vocabulary:
    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]):
        self.strict = frozenset(strict)
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Different strict and soft terms of a url."""
        low, strict, soft = url.translate(_LOWER), set(), set()
        for end, term in self.automaton.iter(low):
            start = end + 1 - len(term)
            if (start and low[start - 1] in _BESIDE) or (end + 1 < len(low) and low[end + 1] in _BESIDE):
                continue
            (strict if term in self.strict else soft).add(term)
        return strict, soft


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """Key, host, path, rule, verdict, and the numbers of different strict and soft terms.  Only the two columns are read."""
    names = [key, "host", "path", "rule", "verdict", "n_strict", "n_soft"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tuple(strict), tuple(soft))
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for u in batch.column(1).to_pylist():
                host, path = parts(u)
                rule = rule_for(host, path, rules) if host or path else None
                hard, mild = vocabulary.hits(u or "")
                verdict = rule[2] if rule else "block" if hard or len(mild) >= soft_limit else "allow"
                for column, x in zip(out, (host, path, rule and rule[0] + rule[1], verdict, len(hard), len(mild)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in out[:4]), *(pa.array(x, pa.int32()) for x in out[4:])], names=names)

    return pages.select(key, url).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, n_strict int, n_soft int")


def judge_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> str:
    """The same judgement as DuckDB SQL over pages."""
    # Terms of letters and digits alone are whole words; the others are looked for between boundaries.
    plain = lambda t: t.isalnum()
    term = lambda t: f"list_contains(words, '{t}')" if plain(t) else f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', ['host', 'path']) AS part FROM pages),
p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
      string_split_regex(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS words,
      translate(part.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, part.path AS path FROM u),
r(h, s, v) AS (VALUES {listed}),
best AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
         FROM p JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, best.rule AS rule,
  CAST({" + ".join(f"CAST({term(t)} AS INT)" for t in strict)} AS INT) AS n_strict,
  CAST({" + ".join(f"CAST({term(t)} AS INT)" for t in soft)} AS INT) AS n_soft,
  coalesce(best.verdict, CASE WHEN {" OR ".join(term(t) for t in strict)} OR ({" + ".join(f"CAST({term(t)} AS INT)" for t in soft)}) >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)"""
