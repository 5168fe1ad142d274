"""URL filters: rules indexed by the rarest of their literal tokens.

A rule is tried on a URL only if the URL has the token under which the rule is filed: of the tokens that every URL it fits must have,
the one that the fewest URLs have. Rules come in two kinds. A place rule names a host, which stands for its subdomains too, and the
beginning of a path. A pattern rule is a text with `*` (anything), `^` (the end, or a character that is neither a letter or digit nor one
of `_-.%`), `|` (begin or end) and `||` (begin of the host or of one of its labels). Of the place rules that fit, the longest decides;
where there is none, a pattern that allows, else a pattern that blocks, else the default.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, others, quoted

#: Bytes of rules that each task gets with its code; more rules are joined by their tokens.
TASK_BYTES = 8 << 20
#: Letters, digits and all that isn't ASCII make tokens.
TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. text names the rule; pattern is tried from the begin of host and rest; place: tells the kinds apart."""

    verdict: str
    text: str
    pattern: str
    tokens: tuple[str, ...]
    place: bool

    def rank(self) -> tuple:
        """The fitting rule that ranks highest decides; of equals, blocking goes before allowing among places, and then the text decides."""
        first = (2, len(self.text), self.verdict == "block") if self.place else (1, self.verdict == "allow", len(self.text))
        return (*first, self.text)


def place_rule(verdict: str, host: str, path: str = "") -> Rule:
    """Fits the host and its subdomains, if the path begins with the given one, case counting; no host: all hosts."""
    if re.search("[?#]", host + path) or "/" in host or path[:1] not in ("", "/"):
        raise ValueError(f"a host and a path that begins with /, without ? and #: {host!r}, {path!r}")
    host = host.translate(LOWER)
    name = rf"(?:[^/?#]*\.)?{re.escape(host)}" if host else "[^/?#]*"
    tokens = TOKEN.findall(host) + TOKEN.findall(path)
    if path and TOKEN.fullmatch(path[-1]):  # the last token may go on in the URL
        tokens.pop()
    return Rule(verdict, host + path, name + (re.escape(path) or "(?=[/?#]|$)"), tuple(tokens), True)


def pattern_rule(text: str) -> Rule:
    """A pattern as above, case counting; one that begins with @@ allows what it fits, any other blocks it."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    host, body = body.startswith("||"), body.removeprefix("||")
    begin, end = not host and body.startswith("|"), body.endswith("|")
    inner = body[begin : len(body) - end]
    made = "".join({"*": ".*", "^": r"(?:[^0-9A-Za-z_\-.%\u0080-\U0010FFFF]|$)"}.get(c) or re.escape(c) for c in inner)
    front = r"(?:[^/?#]*\.)?" if host else "" if begin else ".*"
    tokens = []
    for m in TOKEN.finditer(inner):
        left = inner[m.start() - 1] != "*" if m.start() else host or begin
        right = inner[m.end()] != "*" if m.end() < len(inner) else end
        if left and right:
            tokens.append(m[0])
    return Rule(verdict, text, f"(?s:{front}{made}{'$' if end else ''})", tuple(tokens), False)


#: Pages that say little or repeat others: what sessions, carts, logins, searches, feeds' links and referrers make of a page's address.
PATTERNS = tuple(map(pattern_rule, [
    "^utm_source=", "^utm_campaign=", "^ref=", "^sessionid=", "^phpsessid=", "^replytocom=", "^add-to-cart=", "/cgi-bin/", "/wp-admin/", "/wp-login.php", "/login^", "/logout^", "/signup^",
    "/cart^", "/checkout^", "||ads.*^", "||doubleclick.net^", "@@||web.archive.org^", "@@^page=1^",
]))


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path, and all that follows the host. The host stands between the first :// and the next of / ? #, ASCII letters in lower case;
    the path goes on to the next of ? #. No URL, or none with ://: all empty."""
    _, mark, tail = (url or "").partition("://")
    if not mark:
        return "", "", ""
    m = re.search("[/?#]", tail)
    host, rest = (tail[: m.start()], tail[m.start() :]) if m else (tail, "")
    return host.translate(LOWER), re.split("[?#]", rest, maxsplit=1)[0], rest


def token_counts(urls: DataFrame, url_col: str, wanted: Iterable[str]) -> dict[str, int]:
    """How many URLs have each of the wanted tokens; a task hands on a count for each of those it met."""
    names = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                host, _, rest = split_url(url)
                met.update(names.intersection(TOKEN.findall(f"{host}{rest}")))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["token", "n"])

    counted = urls.select(F.col(quoted(url_col)).cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in names} | {r.token: r.n for r in counted}


def filed(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """The rules by their rarest token, of equally rare ones the first; those without a token under the empty text: they fit anywhere."""
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        out.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return out


class Tries:
    """The index, and the rules' regular expressions, compiled when a rule is tried for the first time."""

    def __init__(self, index: dict[str, list[Rule]]):
        self.index, self.made, self.tried = index, {}, 0

    def best(self, host: str, rest: str) -> Rule | None:
        subject, best = f"{host}{rest}", None
        for token in {*TOKEN.findall(subject), ""} & self.index.keys():
            for rule in self.index[token]:
                if (best is None or rule.rank() > best.rank()) and self.fits(rule, subject):
                    best = rule
        return best

    def fits(self, rule: Rule, subject: str) -> bool:
        if rule.pattern not in self.made:
            self.made[rule.pattern] = re.compile(rule.pattern)
        self.tried += 1
        return self.made[rule.pattern].match(subject) is not None


RESULTS = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "pattern", "verdict")]


def url_verdicts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow", task_bytes: int = TASK_BYTES) -> DataFrame:
    """urls with host, path, rule (the place rule that decides, else null), pattern (the pattern rule that decides, else null) and verdict.

    A null URL, or one without ://, has empty host and path and gets the default. Repeated rows are judged alike. Columns of urls that
    bear a result's name, in any case, are replaced. No rules: the default for all. Nothing is shuffled for rules of at most task_bytes
    in all; more of them are joined by token with the tokens of distinct URLs, and then only the fitting rules come together by URL.
    """
    counts = token_counts(urls, url_col, {t for r in rules for t in r.tokens})
    index = filed(rules, counts)
    if sum(2 * len(r.pattern) + len(r.text) + 300 for r in rules) > task_bytes:
        return _joined(urls, index, url_col, default)
    new = [f.name for f in RESULTS]
    passed = others(urls.columns, new)
    source = urls.select(F.col(quoted(url_col)).cast("string").alias("__url"), *[F.col(quoted(c)) for c in passed])
    schema = T.StructType([*source.schema.fields[1:], *RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries(index)
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                host, path, rest = split_url(url)
                best = tries.best(host, rest) if host or rest else None
                rows.append((host, path, best.text if best and best.place else None, best.text if best and not best.place else None, best.verdict if best else default))
            made = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(new))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*passed, *new])

    return source.mapInArrow(run, schema)


def _joined(urls: DataFrame, index: dict[str, list[Rule]], url_col: str, default: str) -> DataFrame:
    """The same by a join of tokens and rules. A token that many URLs and several rules share is split by Spark's skew join;
    the many rows of one URL are one row there."""
    spark = urls.sparkSession
    new = [f.name for f in RESULTS]
    rows = [(t, r.verdict, r.text, r.pattern, r.place) for t, rules in index.items() for r in rules]
    table = materialize(spark.createDataFrame(rows, "token string, verdict string, text string, pattern string, place boolean"), "rules")
    tokens = T.StructType([T.StructField(n, T.StringType()) for n in ("__url", "host", "path", "subject")] + [T.StructField("tokens", T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(u, *split_url(u)) for u in batch.column(0).to_pylist()]
            made = [(u, host, path, f"{host}{rest}", sorted({*TOKEN.findall(f"{host}{rest}"), ""}) if host or rest else []) for u, host, path, rest in parts]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f) for k, f in enumerate([pa.string()] * 4 + [pa.list_(pa.string())])], names=tokens.fieldNames())

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries({})
        for batch in batches:
            fits = [tries.fits(Rule("", "", p, (), False), s) for p, s in zip(batch.column("pattern").to_pylist(), batch.column("subject").to_pylist(), strict=True)]
            kept = batch.filter(pa.array(fits, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("__url", "verdict", "text", "place")], names=["__url", "verdict", "text", "place"])

    cut_urls = materialize(urls.select(F.col(quoted(url_col)).cast("string").alias("__url")).where("__url is not null").distinct().mapInArrow(cut, tokens), "urls")
    met = cut_urls.select("__url", "subject", F.explode("tokens").alias("token")).join(table, "token")
    fitting = met.mapInArrow(tried, "__url string, verdict string, text string, place boolean")
    # the rank as a structure: kind, then length or allowing, as Rule.rank has it
    rank = F.when(F.col("place"), F.struct(F.lit(2).alias("kind"), F.length("text").alias("a"), (F.col("verdict") == "block").cast("int").alias("b"))).otherwise(F.struct(F.lit(1).alias("kind"), (F.col("verdict") == "allow").cast("int").alias("a"), F.length("text").alias("b")))
    best = fitting.groupBy("__url").agg(F.max(F.struct(rank.alias("rank"), "text", "verdict", "place")).alias("best"))
    judged = cut_urls.drop("subject", "tokens").join(best, "__url", "left").select(
        "__url", F.col("host").alias("__host"), F.col("path").alias("__path"), F.when(F.col("best.place"), F.col("best.text")).alias("__rule"),
        F.when(~F.col("best.place"), F.col("best.text")).alias("__pattern"), F.coalesce("best.verdict", F.lit(default)).alias("__verdict"),
    )
    passed = others(urls.columns, new)
    source = urls.select(F.col(quoted(url_col)).cast("string").alias("__url"), *[F.col(quoted(c)) for c in passed]).join(judged, "__url", "left")
    missing = {"host": "", "path": "", "verdict": default}
    return source.select(*[F.col(quoted(c)) for c in passed], *[(F.coalesce(f"__{n}", F.lit(missing[n])) if n in missing else F.col(f"__{n}")).alias(n) for n in new])
