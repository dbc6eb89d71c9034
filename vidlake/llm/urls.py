"""Verdicts on addresses by host rules and pattern rules, fetched by their rarest token."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import LOWER, UPPER, without

#: Rules in one lookup map. More rules make more maps, each passed over the same rows.
BLOCK = 256

CANDIDATE = "array<struct<length:int,name:string,verdict:string,pattern:string>>"


@dataclass(frozen=True)
class Rule:
    """`pattern` is a regular expression on host and path; `tokens` are names that stand whole,
    between dots, slashes or the ends, in every address it matches. `name` may be any text."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    length: int = 0


def host_rule(verdict: str, place: str) -> Rule:
    """A rule for `host/path-prefix`, its host's subdomains included. Its last part is a prefix
    and no whole token."""
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", place)
    tokens = tuple(t for t in re.split(r"[./]", place)[:-1] if t)
    return Rule(place, verdict, rf"^(?:[^/]*\.)?{quoted}", tokens, len(place))


#: Hosts that serve advertising or link spam; used where no host rule fits.
PATTERNS = (
    Rule("ads-track", "block", r"^(?:[^/]*\.)?ads-track\.", ("ads-track",), 9),
    Rule("spam-farm", "block", r"^(?:[^/]*\.)?spam-farm\.", ("spam-farm",), 9),
)
DEFAULT = "allow"


def judged(pages: DataFrame, rules: list[Rule], patterns: tuple[Rule, ...] = PATTERNS,
           default: str = DEFAULT) -> DataFrame:
    """`pages` with `host`, `path`, `rule` and `verdict`.

    Of the `rules` that match, the longest one wins (of equally long ones, the greatest name)
    and is named in `rule`. Where none does, `rule` is null and the longest matching pattern
    decides, else `default`.

    Each rule is indexed by that one of its tokens which the fewest addresses hold, counted over
    all pages. The tokens of an address fetch its candidates from the index, and only their
    regular expressions run. Rules without a token are tried on every address. Nothing is
    shuffled but the counts of the rules' own tokens.

    The host stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower
    case; the path goes on to `?`, `#` or the end. A null address, or one without `://`, has
    empty host and path and is matched like any other. Input columns called like a result are
    replaced; repeated rows are judged alike; no rows give no rows.
    """
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    rows = without(pages, "host", "path", "rule", "verdict").withColumn(
        "_rest", F.coalesce(rest, F.lit("")))
    rows = rows.withColumns({
        "host": F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)})
    rows = rows.withColumn("_at", F.concat("host", "path")).withColumn(
        "_tokens", F.array_distinct(F.split("_at", "[./]")))
    counts = _counts(rows, sorted({t for r in (*rules, *patterns) for t in r.tokens}))
    rows = rows.withColumns({"_rule": _best(list(rules), counts),
                             "_pattern": _best(list(patterns), counts)})
    rows = rows.withColumns({
        "rule": F.col("_rule.name"),
        "verdict": F.coalesce("_rule.verdict", "_pattern.verdict", F.lit(default))})
    return rows.drop("_rest", "_at", "_tokens", "_rule", "_pattern")


def _counts(rows: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many addresses hold each of the rules' tokens: no more rows than there are tokens."""
    if not tokens:
        return {}
    own = F.array_intersect("_tokens", F.lit(tokens))
    found = rows.select(F.explode(own).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def _best(rules: list[Rule], counts: dict[str, int]) -> Column:
    """The longest rule that matches `_at`, as a struct, or null."""
    best = [_best_of(rules[i:i + BLOCK], counts) for i in range(0, len(rules), BLOCK)]
    none = F.lit(None).cast("struct<length:int,name:string,verdict:string>")
    return F.greatest(*best, none) if best else none


def _best_of(rules: list[Rule], counts: dict[str, int]) -> Column:
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(rarest, []).append(r)

    def listed(some: list[Rule]) -> Column:
        return F.array(*[F.struct(F.lit(r.length).alias("length"), F.lit(r.name).alias("name"),
                                  F.lit(r.verdict).alias("verdict"),
                                  F.lit(r.pattern).alias("pattern")) for r in some])

    always = listed(index.pop(None)) if None in index else F.array().cast(CANDIDATE)
    found = always
    if index:
        entries = F.create_map(*[c for t, some in index.items() for c in (F.lit(t), listed(some))])
        fetched = F.transform("_tokens", lambda t: F.coalesce(
            F.element_at(entries, t), F.array().cast(CANDIDATE)))
        found = F.concat(always, F.flatten(fetched))
    fits = F.filter(found, lambda c: F.regexp_like("_at", c["pattern"]))
    return F.array_max(F.transform(fits, lambda c: F.struct(c["length"], c["name"], c["verdict"])))
