"""Operator 1 - URL filter: allow and block rules, then gradient-boosted trees on lexical features.

A rule is host and path prefix (``example.com/en/``); it fits its host and all
subdomains if the url's path starts with its path; the longest rule wins, of
equal ones the first.  Rules are expressions on the scan, in parts of
``RULES_AT_ONCE``.  Other urls are judged by trees that are trained here from
labelled urls, a table (url, blocked 0/1): length, depth, digit ratio, entropy,
parameter counts, hyphens, and statistics of suffixes (zone, last two labels,
file) and of the path's first part, each the smoothed log odds of being blocked
among the labelled urls that have it.

Where no table is given the rules label the urls: 1 where a rule blocks, else 0,
as what no rule names passes today.  The trees then find urls that look like
those that the rules block, and no names are known to them beforehand.

Hosts fall in ``FOLDS`` parts, and each part is judged by trees that were trained
on the others, so no url is judged by labels of its own host and what the trees
say of labelled urls is a held-out figure (``Judges.report``).  The statistics
that a tree is trained with are also those of other hosts.  A url is blocked
above the odds at which ``LOST`` of the labelled urls to allow would be, held
out, and above one half.  Training runs on the driver on a bounded sample of the
labelled urls, each different one once: ``SAMPLE_ROWS`` chosen by hash, and
of these at most ``PER_HOST`` of a host, so that no host outweighs the others.
Judging is one pass without a shuffle.

Cases: a null url or one without ``://`` has empty host and path, no rule, and
nothing to judge by: it is allowed, with odds 0; labels that are null or neither
0 nor 1 are not used; without labels of both kinds all that no rule names is
allowed, with odds 0; a url that is labelled both ways counts as both; rows that
repeat a page_id are each judged; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_extract import host_of

#: The query's rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
RULES_AT_ONCE = 500
SAMPLE_ROWS, PER_HOST = 50_000, 64
LOST = 0.005
ROUNDS, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 8
FOLDS = 3


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    found: list[Column] = []
    for part in range(0, len(order), RULES_AT_ONCE):
        own = None
        for i in order[part : part + RULES_AT_ONCE][::-1]:
            verdict, rule = rules[i]
            name, slash, prefix = rule.partition("/")
            fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
            value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
            own = F.when(fits, value).otherwise(own) if own is not None else F.when(fits, value)
        found.append(own)
    best = F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    return best["rule"], best["verdict"]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


NAMES = (
    "length host_length path_length depth digit_ratio host_digits host_entropy path_entropy parameters hyphens dots longest_label upper_ratio"
    " zone_odds domain_odds file_odds part_odds"
).split()


def suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    """What statistics are kept of: zone, last two labels, file suffix, first part of the path."""
    labels = host.split(":")[0].split(".")
    last = path.rsplit("/", 1)[-1]
    return labels[-1], ".".join(labels[-2:]), last.rsplit(".", 1)[1] if "." in last else "", path.split("/")[1] if path.count("/") > 1 else ""


Odds = list[dict[str, float]]


def odds_of(urls: list[str], bad: np.ndarray, least: int = 3) -> Odds:
    """For each kind of suffix the smoothed log odds of being blocked, against those of all urls."""
    seen, hit = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for u, b in zip(urls, bad, strict=True):
        for k, x in enumerate(suffixes(*split_url(u))):
            seen[k][x] += 1
            hit[k][x] += int(b)
    usual = (bad.sum() + 1) / (len(bad) + 2)
    log = lambda p: math.log(p / (1 - p))
    return [{x: log((hit[k][x] + usual) / (n + 1)) - log(usual) for x, n in seen[k].items() if n >= least} for k in range(4)]


def features(urls: list[str | None], odds: Odds) -> np.ndarray:
    rows = np.zeros((len(urls), len(NAMES)))
    for i, u in enumerate(urls):
        u = u or ""
        host, path = split_url(u)
        query = u.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in u)
        rows[i] = (
            len(u), len(host), len(path), sum(bool(x) for x in path.split("/")), digits / max(len(u), 1), sum(c.isdigit() for c in host), _entropy(host), _entropy(path),
            query.count("=") + query.count("&"), host.count("-"), host.count("."), max(map(len, host.split("."))), sum(c.isupper() for c in u) / max(len(u), 1),
            *(table.get(x, 0.0) for table, x in zip(odds, suffixes(host, path), strict=True)),
        )
    return rows


@dataclass
class Trees:
    """Boosted trees as full binary arrays: feature and split of inner nodes, values of leaves."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    base: float
    odds: Odds | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, s, v in zip(self.feature, self.split, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > s[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, Newton steps, splits between quantiles."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    margin = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features_, splits, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, split = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, 0, None)
            if len(rows) >= 2 * LEAST:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    bins = binned[rows, f]
                    size = len(e) + 1
                    gl = np.cumsum(np.bincount(bins, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(bins, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(bins, minlength=size))[:-1]
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[2] is not None:
                feature[at], split[at] = best[1], edges[best[1]][best[2]]
                right = binned[rows, best[1]] > best[2]
            else:
                right = np.zeros(len(rows), bool)
            node[rows] = 2 * at + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        features_.append(feature)
        splits.append(split)
        values.append(value)
    return Trees(np.array(features_), np.array(splits), np.array(values), base)


def fold_of(url: str | None, folds: int = FOLDS) -> int:
    """The part that the url's host falls in."""
    return zlib.crc32(split_url(url)[0].encode("utf-8", "surrogatepass")) % folds


def train(rows: list[tuple[str, int]]) -> Trees | None:
    """From (url, 1 if blocked); the statistics that a half of the hosts is trained with are those of the other.  None without both kinds."""
    urls, y = [u for u, _ in rows], np.array([b for _, b in rows], float)
    if len(set(y)) < 2:
        return None
    side = np.array([fold_of(u, 2 * FOLDS + 1) % 2 for u in urls])
    x = np.zeros((len(urls), len(NAMES)))
    for own in (0, 1):
        at, other = np.flatnonzero(side == own), np.flatnonzero(side != own)
        x[at] = features([urls[i] for i in at], odds_of([urls[i] for i in other], y[other]))
    trees = boost(x, y)
    trees.odds = odds_of(urls, y)
    return trees


@dataclass
class Judges:
    """For each part of the hosts the trees of the others; and how they fare on labelled urls of hosts that they have not seen."""

    trees: list[Trees | None]
    threshold: float
    report: dict[str, float]

    def odds(self, urls: list[str | None]) -> np.ndarray:
        """The probability that each url is to be blocked."""
        out, fold = np.zeros(len(urls)), np.array([fold_of(u, len(self.trees)) if split_url(u)[0] else -1 for u in urls], np.int64)
        for f, trees in enumerate(self.trees):
            at = np.flatnonzero(fold == f)
            if trees is not None and len(at):
                out[at] = 1 / (1 + np.exp(-trees.margin(features([urls[i] for i in at], trees.odds))))
        return out


def train_judges(rows: list[tuple[str, int]], folds: int = FOLDS, lost: float = LOST) -> Judges:
    fold = np.array([fold_of(u, folds) for u, _ in rows], np.int64)
    judges = Judges([train([rows[i] for i in np.flatnonzero(fold != f)]) for f in range(folds)], 0.5, {})
    y, odds = np.array([b for _, b in rows], bool), judges.odds([u for u, _ in rows])
    if not y.all():
        allowed = np.sort(odds[~y])
        judges.threshold = max(0.5, float(allowed[len(allowed) - 1 - int(lost * len(allowed))]))
    got = odds > judges.threshold
    share = lambda x: float(x.mean()) if len(x) else math.nan
    judges.report = {"labelled": len(rows), "hosts": len({split_url(u)[0] for u, _ in rows}), "accuracy": share(got == y), "blocked_caught": share(got[y]), "allowed_blocked": share(got[~y])}
    return judges


def label_by_rules(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(url, blocked): 1 where a rule blocks the url, else 0."""
    url = F.col("url").cast("string")
    rows = pages.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).where("host <> ''")
    verdict = rule_of(F.col("host"), F.col("path"), rules)[1]
    return rows.select("url", F.coalesce((verdict == "block").cast("int"), F.lit(0)).alias("blocked"))


def train_labelled(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, per_host: int = PER_HOST) -> Judges:
    """From a table (url, blocked 0/1): the ``sample_rows`` different rows of least hash, and of these at most ``per_host`` of a host."""
    rows = labelled.where("url is not null and blocked in (0, 1)").select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("int").alias("blocked"))
    # some times the sample by another hash first, so that no task sends the driver more than a share of that
    parts = max(1, rows.count() // (4 * sample_rows))
    rows = rows.where(F.pmod(F.hash("url"), F.lit(parts)) == 0).distinct()
    seen: Counter[str] = Counter()
    sample = []
    for url, blocked in rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample_rows).collect():
        host = split_url(url)[0]
        seen[host] += 1
        if seen[host] <= per_host:
            sample.append((url, blocked))
    return train_judges(sample)


def _judged(judges: Judges):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("page_id", "host", "path", "rule", "verdict")), pa.array(judges.odds(own.column("url").to_pylist()))], names=["page_id", "host", "path", "rule", "verdict", "odds"])

    return run


def url_filter(pages: DataFrame, *, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, judges: Judges | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, odds (the trees' probability that the url is to be blocked).

    ``labelled`` is a table (url, blocked 0/1) to train from, by default that of ``label_by_rules``; ``judges`` are trained already.
    """
    judges = judges or train_labelled(label_by_rules(pages, rules) if labelled is None else labelled, sample_rows)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    kind = dict(rows.dtypes)["page_id"]
    judged = rows.mapInArrow(_judged(judges), f"page_id {kind}, host string, path string, rule string, verdict string, odds double")
    own = F.when(F.col("odds") > judges.threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "odds")
