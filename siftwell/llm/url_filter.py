"""URL filters: many rules, few regular expressions run by URL.

A rule is a regular expression and the literal tokens (runs of A-Z, a-z, 0-9) that every URL it fits holds whole. The
index keeps each rule under its rarest token, the one that fewest rules share; the tokens of a URL fetch the candidate
rules, and only those run their expression, which is compiled when it is first needed. Rules without a token are tried on
every URL. The rule list travels with the task's closure: its size is that of the list, not of the data.

Rules come as hosts and paths (`example.net/en/`), as words of hosts, or as lines of the common filter-list syntax:

    ||example.com^      a host and its subdomains        |http://x.org/    the URL's start        .swf|    its end
    /banner/*/big.      `*`: anything                    ^                 a separator (neither letter, digit nor _-.%) or the end
    @@||example.com/    an exception (allow)             /p[0-9]+/         a regular expression
    ...$important       before every exception           ...$match-case    otherwise case doesn't count (A-Z)

Comments (`!`, `[`) are skipped. Rules that hide page elements, rules with other options (they speak of what a page loads,
not of pages) and expressions that don't compile are returned beside the rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm._common import table

TOKEN = re.compile(r"[A-Za-z0-9]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
URL_SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string"


@dataclass(frozen=True)
class Rule:
    """verdict for what regex matches from the start of host + path; weight: the greatest wins, the first on ties.

    subject: "url" or "lower" if regex is sought in the whole URL, or in the URL with A-Z lower-cased.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int
    is_host_rule: bool = True
    subject: str = "parts"


def host_rule(text: str, verdict: str) -> Rule:
    """A rule like `example.net/en/`: the host and its subdomains, paths that start alike. The longest wins."""
    host, slash, rest = text.partition("/")
    found = [m for m in TOKEN.finditer(text)]
    whole = tuple(m[0] for m in found if m.end() < len(text))  # a token at the end may go on in the URL
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}", whole, len(text))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule that fits hosts of which a label has the word between hyphens or ends."""
    return Rule(word, verdict, rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|\Z)", (word,), len(word), False)


_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"
_KINDS = {"block": 1 << 40, "allow": 2 << 40, "important": 3 << 40}  # before word rules, and in this order
_OPTIONS = re.compile(r"\$([a-z0-9~_-]+(?:=[^,]*)?(?:,[a-z0-9~_-]+(?:=[^,]*)?)*)\Z")


def filter_rule(line: str) -> Rule | str | None:
    """The rule of a line of a filter list; None for a comment; a reason if the line can't be a rule for pages."""
    name = line.strip()
    if not name or name[0] in "![":
        return None
    if re.search(r"#[@?$]*#", name):
        return "hides page elements"
    verdict, text = ("allow", name[2:]) if name.startswith("@@") else ("block", name)
    options: list[str] = []
    is_regex = len(text) > 2 and text[0] == text[-1] == "/"
    if not is_regex and (m := _OPTIONS.search(text)):
        text, options = text[: m.start()], m[1].split(",")
        is_regex = len(text) > 2 and text[0] == text[-1] == "/"
    if others := set(options) - {"important", "match-case", "document", "doc", "all"}:
        return f"option {min(others)}"
    weight = _KINDS["important" if verdict == "block" and "important" in options else verdict] + len(text)
    subject = "url" if "match-case" in options else "lower"
    if is_regex:
        try:
            re.compile(text[1:-1], re.ASCII if subject == "url" else re.ASCII | re.IGNORECASE)
        except re.error as e:
            return f"not an expression: {e}"
        return Rule(name, verdict, text[1:-1] if subject == "url" else f"(?i:{text[1:-1]})", (), weight, False, subject)
    body = text if subject == "url" else text.translate(_UPPER)
    host, body = body.startswith("||"), body.removeprefix("||")
    start, body = not host and body.startswith("|"), body.removeprefix("|") if not host else body
    end, body = body.endswith("|"), body.removesuffix("|")
    pieces = re.split(r"\*+", body)
    regex = ".*".join("".join(_SEPARATOR if c == "^" else re.escape(c) for c in p) for p in pieces)
    tokens = []
    for k, p in enumerate(pieces):
        for m in TOKEN.finditer(p):
            whole_left = m.start() > 0 or (k == 0 and (host or start))
            whole_right = m.end() < len(p) or (k == len(pieces) - 1 and end)
            if whole_left and whole_right:
                tokens.append(m[0])
    before = r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?" if host else r"\A" if start else ""
    return Rule(name, verdict, before + regex + (r"\Z" if end else ""), tuple(tokens), weight, False, subject)


def parse_list(lines: Iterable[str]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of a filter list, and the lines that are none, with their reasons. Repeated lines are repeated rules."""
    rules, out = [], []
    for line in lines:
        found = filter_rule(line)
        if isinstance(found, Rule):
            rules.append(found)
        elif found:
            out.append((line.strip(), found))
    return rules, out


def load_list(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[Rule], list[tuple[str, str]]]:
    """parse_list() of text files. More lines than `most` are an error: rules travel with every task."""
    lines = [r[0] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} lines in {path}")
    return parse_list(lines)


#: The production rules by host and path.
HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: Host words that the method blocks where no rule by host and path fits.
WORD_RULES = tuple(word_rule(w) for w in ("casino", "bet", "bets", "poker", "pills", "viagra", "porn", "xxx", "adult", "escort", "torrent", "warez"))


@dataclass
class Index:
    """fits that were tried are counted in `tried`."""

    rules: Sequence[Rule]
    default: str = "allow"
    by_token: dict[str, list[int]] = field(default_factory=dict)
    always: list[int] = field(default_factory=list)
    compiled: dict[int, re.Pattern] = field(default_factory=dict)
    tried: int = 0

    def __post_init__(self) -> None:
        shared = Counter(t for r in self.rules for t in set(r.tokens))
        for k, r in enumerate(self.rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (shared[t], -len(t), t)), []).append(k)
            else:
                self.always.append(k)

    def candidates(self, *texts: str) -> set[int]:
        out = set(self.always)
        for t in {t for x in texts for t in TOKEN.findall(x)}:
            out.update(self.by_token.get(t, ()))
        return out

    def fits(self, k: int, host: str, path: str, url: str | None, lower: str | None = None) -> bool:
        r = self.rules[k]
        if r.subject != "parts" and url is None:
            return False
        self.tried += 1
        if k not in self.compiled:
            self.compiled[k] = re.compile(r.regex, re.DOTALL | (re.ASCII if r.subject != "parts" else 0))
        if r.subject == "parts":
            return self.compiled[k].match(host + path) is not None
        if r.subject == "lower":
            url = url.translate(_UPPER) if lower is None else lower
        return self.compiled[k].search(url) is not None

    def judge(self, host: str, path: str, url: str | None = None) -> tuple[str | None, str, str | None]:
        """rule (by host and path, or None), verdict, the pattern that decided in its absence (or None).

        Without the whole URL, rules of filter lists fit nothing.
        """
        lower = url.translate(_UPPER) if url is not None else ""
        fits = [k for k in self.candidates(host + path, url or "", lower) if self.fits(k, host, path, url, lower)]
        for own in (True, False):
            if best := min(((-self.rules[k].weight, k) for k in fits if self.rules[k].is_host_rule == own), default=None):
                r = self.rules[best[1]]
                return (r.name, r.verdict, None) if own else (None, r.verdict, r.name)
        return None, self.default, None


_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as they stand: ports and user names belong to the host; no `://`: both empty."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of (page_id, url).

    A null URL, or one without `://`, has empty parts and, unless a rule of a filter list fits it, the default verdict. Repeated rows are judged each. Other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, default)
        for b in batches:
            urls = b.column(1).to_pylist()
            split = [parts(u) for u in urls]
            said = [index.judge(*x, u) for x, u in zip(split, urls, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array([x[k] for x in split], pa.string()) for k in (0, 1)), *(pa.array([x[k] for x in said], pa.string()) for k in (0, 1, 2))],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return pages.select("page_id", "url").mapInArrow(run, URL_SCHEMA)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the production rules."""
    return judge_urls(table(spark, sf_dir, "pages"), (*HOST_RULES, *WORD_RULES))


_WORDS_SQL = "|".join(r.name for r in WORD_RULES)
OP2_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
w AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
  list_filter(regexp_split_to_array(host, '[.-]'), lambda x: regexp_full_match(x, '{_WORDS_SQL}')) AS hit FROM v)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN len(hit) > 0 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL AND len(hit) > 0 THEN list_sort(list_transform(hit, lambda x: lpad((1000 - length(x))::VARCHAR, 4, '0') || x))[1][5:] END AS pattern
FROM w
"""
