"""URL filters: pattern rules, filed under their rarest literal token.

A rule is a site (host and path prefix, subdomains included) or a pattern (text with `*` for any run of
characters, `|` at its start or end for the start or end of the address). Both become regular expressions
over the address: the lower-cased host, then the rest of the url as it is. The tokens of an address are its
runs of ASCII letters and digits. A run in a rule is a token of it if the rule itself fixes the characters
on both sides (or the address ends there): then every address that fits holds that token as a whole.

Spark counts how many addresses hold each token of the rules, and each rule is filed under the token that
fewest have. An address looks up its own tokens and runs the regular expressions of what it finds, and of
rules without any token. Rules are few next to addresses (RULES at most, else an error): they and their
counts are sent to every task. No row is shuffled but the counts.

Cases: a null url, or one without `://`, has an empty host and path, fits nothing and is allowed; hosts keep
ports and user names; repeated urls and ids are judged each; very long urls are one row; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, load

#: Rules that one filter may hold: what is sent to each task grows with them.
RULES = 1_000_000
BLOCK, ALLOW = "block", "allow"
_TOKEN = re.compile("[0-9A-Za-z]+")


@dataclasses.dataclass(frozen=True)
class Rule:
    """name: what the result shows. length: of rules that fit, sites go before patterns, then the longest wins,
    then the one that allows, then the smallest name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool
    length: int

    def rank(self):
        return (not self.site, -self.length, self.verdict != ALLOW, self.name)


def _tokens(text: str, left: bool, right: bool) -> list[str]:
    """Runs of letters and digits of a literal text; left, right: whether its edges are fixed."""
    return [m[0] for m in _TOKEN.finditer(text) if (left or m.start() > 0) and (right or m.end() < len(text))]


def site(verdict: str, host: str, path: str = "/") -> Rule:
    """A host with all its subdomains, and the paths that start with `path`."""
    host = host.translate({c: c + 32 for c in range(65, 91)})
    if path and path[0] != "/":
        raise ValueError(f"a path starts with /: {path!r}")
    tokens = _tokens(host, True, True) + _tokens(path, True, False)
    regex = r"\A(?:[^/?#]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?=[/?#]|\Z)")
    return Rule(host + path, verdict, regex, tuple(dict.fromkeys(tokens)), True, len(host) + len(path))


def pattern(verdict: str, text: str) -> Rule:
    """Addresses that contain the text; see the module's head for `*` and `|`."""
    first, last = text.startswith("|"), text.endswith("|")
    parts = text[first : len(text) - last].split("*")
    if not any(parts):
        raise ValueError("a pattern needs some text")
    tokens = []
    for i, part in enumerate(parts):
        tokens += _tokens(part, first and i == 0, last and i == len(parts) - 1)
    regex = (r"\A" if first else "") + ".*".join(map(re.escape, parts)) + (r"\Z" if last else "")
    return Rule(text, verdict, regex, tuple(dict.fromkeys(tokens)), False, len(text))


#: The sites and, for the rest, the patterns of the registered query.
SITES = (site(BLOCK, "net"), site(ALLOW, "example.net", "/en/"), site(BLOCK, "example.com", "/de/"), site(ALLOW, "org", "/fr/"))
PATTERNS = (
    pattern(BLOCK, "cheap-pills."), pattern(BLOCK, "casino-win."), pattern(BLOCK, "?page=*&ref="), pattern(BLOCK, "/login/"),
    pattern(BLOCK, ".exe|"), pattern(BLOCK, ".zip|"), pattern(ALLOW, "/en/*.html|"), pattern(ALLOW, "|www."),
)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the whole address (host and all that comes after it)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    host = ascii_lower(host)
    return host, F.regexp_extract(after, "^[^?#]*", 0), F.concat(host, after)


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many addresses hold each token of the rules."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules, of {RULES} at most")
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    own = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")  # bounded by RULES
    address = parts(F.col("url"))[2]
    every = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(address, F.lit("([0-9A-Za-z]+)"), F.lit(1)))).alias("token"))
    found = every.join(F.broadcast(own), "token").groupBy("token").agg(F.count("*").alias("n"))
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in found.collect()}


class Index:
    """Rules by their rarest token; `loose` are those without one. Expressions are compiled when first run."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.filed: dict[str, list[Rule]] = {}
        self.loose: list[Rule] = []
        self.compiled: dict[str, re.Pattern] = {}
        for rule in rules:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.loose if rarest is None else self.filed.setdefault(rarest, [])).append(rule)

    def candidates(self, address: str) -> list[Rule]:
        return [r for token in {*_TOKEN.findall(address)} for r in self.filed.get(token, ())] + self.loose

    def _fits(self, rule: Rule, address: str) -> bool:
        found = self.compiled.get(rule.regex)
        if found is None:
            found = self.compiled[rule.regex] = re.compile(rule.regex, re.DOTALL)
        return found.search(address) is not None

    def judge(self, address: str) -> tuple[Rule | None, int]:
        """The rule that wins, and how many regular expressions ran."""
        tried = self.candidates(address)
        return min((r for r in tried if self._fits(r, address)), key=Rule.rank, default=None), len(tried)


def judged(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """page_id, host, path, rule (the site's name), pattern (if no site fits: the pattern's text), verdict,
    n_tried (regular expressions run)."""
    rules = tuple(rules)
    counts = token_counts(pages, rules)
    host, path, address = parts(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"), address.alias("address"))
    kind = d.schema["page_id"].dataType.simpleString()

    def run(batches):
        index = Index(rules, counts)
        for batch in batches:
            names, texts, verdicts, tries = [], [], [], []
            for address in batch.column(3).to_pylist():
                rule, tried = index.judge(address)
                names.append(rule.name if rule and rule.site else None)
                texts.append(rule.name if rule and not rule.site else None)
                verdicts.append(rule.verdict if rule else ALLOW)
                tries.append(tried)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, pa.string()) for c in (names, texts, verdicts)), pa.array(tries, pa.int64())],
                names=["page_id", "host", "path", "rule", "pattern", "verdict", "n_tried"])

    return d.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, pattern string, verdict string, n_tried long")


def allowed(pages: DataFrame, rules: Iterable[Rule] = SITES + PATTERNS) -> DataFrame:
    """The pages, with all their columns, whose url isn't blocked."""
    rules = tuple(rules)
    counts = token_counts(pages, rules)
    d = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), parts(F.col("url"))[2].alias("address"))

    def run(batches):
        index = Index(rules, counts)
        for batch in batches:
            found = (index.judge(a)[0] for a in batch.column(1).to_pylist())
            yield batch.filter(pa.array([rule is None or rule.verdict == ALLOW for rule in found], pa.bool_())).select([0])

    return d.mapInArrow(run, T.StructType([d.schema["row"]])).select("row.*")


def op12_url_rules(spark, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "pages"), SITES + PATTERNS).drop("n_tried")


OP12_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS after FROM b),
d AS (SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path, host || after AS address FROM c),
e AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM d),
f AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(address, '(?s)\?page=.*&ref=') THEN '?page=*&ref='
    WHEN contains(address, 'cheap-pills.') THEN 'cheap-pills.'
    WHEN regexp_matches(address, '(?s)/en/.*\.html$') THEN '/en/*.html|'
    WHEN contains(address, 'casino-win.') THEN 'casino-win.'
    WHEN contains(address, '/login/') THEN '/login/'
    WHEN starts_with(address, 'www.') THEN '|www.'
    WHEN ends_with(address, '.exe') THEN '.exe|'
    WHEN ends_with(address, '.zip') THEN '.zip|' END AS pattern FROM e)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') OR (rule IS NULL AND (pattern IS NULL OR pattern IN ('/en/*.html|', '|www.'))) THEN 'allow' ELSE 'block' END AS verdict
FROM f
"""
