"""URL filters: suffix rules first, association rules for the rest.

A url's tokens (scheme, host labels, path words, query keys, extension, fragment) and the label of its document make a
transaction; Spark's FP-growth mines frequent combinations.  The document of a page is the one that the first number in
its path names; a page without such a number, or whose document has no label, teaches nothing.

Rules whose consequence is a label are pruned by support, by confidence and lift over the label's share (a url is
blocked if that is likelier than not), by a lower confidence bound that must lie above that share, and by simpler rules
that are as sure.  An inverted index from a rule's first token finds the rules that may match a url; the surest
match decides, and a url without one is allowed.

Support, lift and bound are tested by Spark; what comes to the driver is rules that passed all three.

Results: a null url, or one without ``://``, has an empty host and path and no tokens.  Repeated rows get equal results;
an empty table gives no rows.  Without labelled urls no rule is mined.  Urls of any length are read whole.  Extra columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "label=allow", "label=block"
#: Rules of the query: (host, path, verdict).
SUFFIX_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between ``://`` and the first of / ? # (A-Z lower-cased), and what follows up to ? or #."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(""), F.when(has, path).otherwise("")


def suffix_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = SUFFIX_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a url, sorted; numbers are one token each place, whatever their value."""
    if not url or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    host, path, query, fragment = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest).groups()
    labels = host.translate(LOWER).split(".")
    out = {f"scheme={scheme.translate(LOWER)}", f"tld={labels[-1]}", f"domain={'.'.join(labels[-2:])}", f"first={labels[0]}"}
    out |= {f"path={w}" for w in re.findall(r"[^\W\d_]+", path)}
    out |= {"path=number"} if re.search(r"\d", path) else set()
    out |= {f"end={path[path.rindex('.') + 1 :]}"} if "." in path.rsplit("/", 1)[-1] else set()
    out |= {"end=slash"} if path.endswith("/") else set()
    out |= {f"query={p.split('=', 1)[0]}" for p in (query or "").split("&") if p}
    out |= {"fragment"} if fragment else set()
    return sorted(out)


def document_number(url: Column) -> Column:
    """The number in a page's path that names the document which its label belongs to."""
    return F.regexp_extract(url, "://[^/?#]*/(?:[^?#]*?/)?([0-9]{1,18})", 1).try_cast("long")


@dataclass(frozen=True)
class Rule:
    """``gain``: how much of the way from the label's share to certainty the lower confidence bound lies."""

    tokens: tuple[str, ...]
    label: str
    confidence: float
    support: float
    gain: float

    def sureness(self) -> tuple:
        return (-self.gain, -self.support, len(self.tokens), self.tokens, self.label)


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items array<string>) of labelled urls: their tokens and a label, block if the document is of low quality or toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [[*tokens(u), BLOCK if bad else ALLOW] for u, bad in zip(b.column("url").to_pylist(), b.column("bad").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    bad = F.max(((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(bad.alias("bad"))
    known = pages.filter("url IS NOT NULL").select("url", document_number(F.col("url")).alias("doc_id")).filter("doc_id IS NOT NULL").join(marks, "doc_id")
    return known.select("url", (F.col("bad") == 1).alias("bad")).mapInArrow(run, "items array<string>")


def lower_bound(confidence: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share that was observed in n cases."""
    mid = confidence + z * z / (2 * n)
    return (mid - z * F.sqrt(confidence * (1 - confidence) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5, min_lift: float = 1.5, z: float = 2.58, most_tokens: int = 4) -> list[Rule]:
    """Pruned rules from labelled urls, surest first.

    ``min_confidence`` and ``min_lift`` are asked of rules that block, as allowing is the default.
    """
    items = transactions(pages, labels)
    n, blocked = items.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    if not n:
        return []
    share = blocked / n
    # No rule that passes below has a smaller confidence.
    least = min(max(share * min_lift, min_confidence), 1 - share)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=least).fit(items)
    rules = model.associationRules.filter(F.array_contains("consequent", ALLOW) | F.array_contains("consequent", BLOCK))
    rules = rules.filter((F.size("antecedent") <= most_tokens) & ~F.array_contains("antecedent", ALLOW) & ~F.array_contains("antecedent", BLOCK))
    blocks = F.array_contains("consequent", BLOCK)
    own = F.when(blocks, share).otherwise(1 - share)
    bound = lower_bound(F.col("confidence"), F.lit(float(n)) * F.col("support") / F.col("confidence"), z)
    rules = rules.withColumn("bound", bound).withColumn("share", own).filter((F.col("bound") > F.col("share")) & (~blocks | (F.col("confidence") >= F.greatest(min_lift * F.col("share"), F.lit(min_confidence)))))
    rules = rules.withColumn("gain", F.round((F.col("bound") - F.col("share")) / (1 - F.col("share")), 9))
    found = [Rule(tuple(sorted(r["antecedent"])), r["consequent"][0], r["confidence"], r["support"], r["gain"]) for r in rules.collect()]
    best: dict[tuple[str, str], float] = {}
    kept: list[Rule] = []
    for r in sorted(found, key=lambda r: (len(r.tokens), r.sureness())):
        # Rules have few tokens, so their proper subsets are few, too.
        smaller = [s for k in range(len(r.tokens)) for s in combinations(r.tokens, k)]
        if not any(best.get((s, r.label), -1.0) >= r.gain for s in smaller):
            best[r.tokens, r.label] = r.gain
            kept.append(r)
    return sorted(kept, key=Rule.sureness)


def matcher(rules: list[Rule]):
    """url -> the surest rule whose tokens it has, or None."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(r.tokens[0] if r.tokens else "", []).append(r)

    def match(url: str | None) -> Rule | None:
        own = tokens(url)
        have = set(own)
        hits = [r for t in ["", *own] for r in index.get(t, ()) if have.issuperset(r.tokens)] if own else []
        return min(hits, key=Rule.sureness, default=None)

    return match


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = SUFFIX_RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, learned_rule (tokens joined by blanks) and its confidence, a row for each page."""
    mined = mine(pages, labels, **mining)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(mined)
        for b in batches:
            hits = [match(u) for u in b.column("url").to_pylist()]
            own = [pa.array([h and h.label.split("=")[1] for h in hits], pa.string()), pa.array([h and " ".join(h.tokens) for h in hits], pa.string()), pa.array([h and h.confidence for h in hits], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *own], ["page_id", "url", "own", "learned_rule", "confidence"])

    seen = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url").mapInArrow(run, "page_id long, url string, own string, learned_rule string, confidence double")
    host, path = host_and_path(F.col("url"))
    parts = seen.select("page_id", host.alias("host"), path.alias("path"), "own", "learned_rule", "confidence")
    rule, verdict = suffix_rule(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("own"), F.lit("allow")).alias("verdict"), "learned_rule", "confidence")
