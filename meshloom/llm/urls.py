"""10. URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules: host and path (``example.com/en/``: the host and its subdomains, paths that start so) and patterns
(``/banner/``, ``||ads.example.org^``; ``*`` any text, ``^`` a separator or the end, ``||`` the start of a host label,
``|`` the start or end). Every rule becomes a regular expression and has literal tokens, letter and digit runs that
a fitting url must have as whole tokens. Spark counts the urls in which each of these tokens occurs; a rule is filed
under its rarest one. For a url its tokens fetch the rules filed there and only those run their expression, which a task
compiles when it is first fetched. Rules without a whole token are tried on every url.

Rules are given as tuples or as a table (kind, verdict, text). They are broadcast in blocks of BLOCK_RULES; the blocks judge
the urls one after the other in the same pass, each handing on the best rule so far; the counts of tokens take a scan of the urls for each block before.

The host and path rule with the longest text wins (of equals the first given). Where none fits, any fitting pattern rule
decides in the same way, and where none does the verdict is ``allow``.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no host rule and is allowed; a rule's
path does not fit an empty path; repeated rows are judged each; an empty table gives an empty result, and an empty rule
table allows all; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Pages that hold no prose, by the words of their address.
PATTERN_RULES = (
    ("block", "/login^"),
    ("block", "/signin^"),
    ("block", "/cart^"),
    ("block", "/checkout^"),
    ("block", "/banner/"),
    ("block", "||ads."),
    ("block", ".exe|"),
    ("block", ".zip|"),
    ("allow", "/cart/help^"),
)
#: Rules of one broadcast index (a few hundred bytes each).
BLOCK_RULES = 100_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WHOLE = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    on_host: bool


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def host_rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    whole = [m for m in _WHOLE.finditer(path.translate(_LOWER)) if m.end() < len(path)]  # the last may go on in the url
    tokens = (*_WHOLE.findall(host.translate(_LOWER)), *(m[0] for m in whole))
    return Rule(text, verdict, rf"\A(?:[^\0]*\.)?{re.escape(host.translate(_LOWER))}\0/{re.escape(path)}", tokens, True)


def pattern_rule(verdict: str, text: str) -> Rule:
    body, head, tail = text.translate(_LOWER), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"\A[^/?#]*?://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], r"\A"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    regex = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in body)
    # a token is whole if a literal that is no letter or digit stands on both sides, or the pattern's anchor
    marked = ("/" if head else "*") + body + ("/" if tail else "*")
    tokens = tuple(m[0] for m in _WHOLE.finditer(marked) if marked[m.start() - 1] != "*" and marked[m.end()] != "*")
    return Rule(text, verdict, head + regex + tail, tokens, False)


def rules_of(host_rules, pattern_rules) -> Iterator[Rule]:
    yield from (host_rule(*r) for r in host_rules)
    yield from (pattern_rule(*r) for r in pattern_rules)


def rules_of_table(table: DataFrame) -> Iterator[Rule]:
    """Rules of a table (kind: host or pattern, verdict, text), read partition by partition, in the order of their texts."""
    for r in table.select("kind", "verdict", "text").distinct().orderBy("kind", "text", "verdict").toLocalIterator():
        yield (host_rule if r["kind"] == "host" else pattern_rule)(r["verdict"], r["text"])


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each of the rules' tokens occurs (at most a row for each such token)."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    wanted = pages.sparkSession.createDataFrame(pd.DataFrame({"token": known}))
    lowered = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = pages.select(F.explode(F.array_distinct(F.split(lowered, "[^a-z0-9]+"))).alias("token"))
    counts = tokens.groupBy("token").count().join(wanted, "token").toPandas()  # a row for each token of a block of rules
    return dict(zip(counts["token"], counts["count"].tolist(), strict=True))


def filed(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """The rules under each token, and those without one."""
    index: dict[str, list[int]] = {}
    rest = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            rest.append(k)
    return index, rest


_BEST = "page_id long, url string, host string, path string, rule string, rule_verdict string, pattern string, pattern_verdict string"


def _judged(rows: DataFrame, rules: list[Rule], index: dict[str, list[int]], rest: list[int]) -> DataFrame:
    """``rows`` (columns of _BEST) with the best rules so far and of this block; of equals the earlier stays."""
    shared = rows.sparkSession.sparkContext.broadcast((rules, index, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, index, rest = shared.value
        regexes: dict[int, re.Pattern] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("rule", "rule_verdict", "pattern", "pattern_verdict")}
            for n, (url, host, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True)):
                lowered = (url or "").translate(_LOWER)
                place = f"{host}\0{path}"
                for k in sorted({k for t in set(_WHOLE.findall(lowered)) for k in index.get(t, ())}.union(rest)):
                    rule = rules[k]
                    if k not in regexes:
                        regexes[k] = re.compile(rule.regex, re.S)
                    if regexes[k].search(place if rule.on_host else lowered):
                        text, verdict = ("rule", "rule_verdict") if rule.on_host else ("pattern", "pattern_verdict")
                        if columns[text][n] is None or len(rule.text) > len(columns[text][n]):
                            columns[text][n], columns[verdict][n] = rule.text, rule.verdict
            kept = [batch.column(c) for c in ("page_id", "url", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.string()) for v in columns.values())], names=["page_id", "url", "host", "path", *columns])

    return rows.mapInArrow(run, _BEST)


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        none = pa.nulls(batch.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array([p[k] for p in parts], pa.string()) for k in range(2)), none, none, none, none], names=[c.split()[0] for c in _BEST.split(", ")])


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (of the host rules), verdict and pattern (the pattern rule that decided) of each row. ``rules`` is a table in place of the tuples."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    given = rules_of(host_rules, pattern_rules) if rules is None else rules_of_table(rules)
    rows = urls.mapInArrow(_split_batches, _BEST)
    while block := list(islice(given, BLOCK_RULES)):
        rows = _judged(rows, block, *filed(block, token_counts(urls, block)))
    pattern = F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"), pattern)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filter": op10_url_filter}


def _oracle() -> str:
    parts = [(verdict, text, *text.partition("/")[::2]) for verdict, text in sorted(HOST_RULES, key=lambda r: -len(r[1]))]
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", text, verdict) for verdict, text, h, p in parts]
    patterns = sorted((pattern_rule(*r) for r in PATTERN_RULES), key=lambda r: -len(r.text))
    quoted = lambda r: r.regex.replace(r"\Z", r"\z").replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
             translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM u)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {c} THEN '{text}'" for c, text, _ in fits)} END AS rule,
       CASE {' '.join(f"WHEN {c} THEN '{verdict}'" for c, _, verdict in fits)}
            {' '.join(f"WHEN regexp_matches(lowered, '{quoted(r)}', 's') THEN '{r.verdict}'" for r in patterns)} ELSE 'allow' END AS verdict
FROM p"""


ORACLES = {"op10_url_filter": _oracle()}
