"""Operator 7: URL filters, by host and path rules and by path-template trees learned from what the rules decide.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's path; the
longest rule that fits decides. Other urls are judged by their template. Within each host, paths become trees of
segments:

1. *Generalise*: digits in a segment become ``#``; a segment with a long run of hexadecimal or mixed characters becomes
   ``*``. Where a node still has more than ``MAX_CHILDREN`` different children, most of them rare, its children become ``*``.
2. *Merge*: sibling branches with the same shape below them and statistically like labels (unlabelled, or within two
   standard errors of their parent's share of blocked pages, or significantly above or below) become one branch.
3. *Reject*: a template is blocked if the share of blocked pages among its labelled ones, smoothed by ``PRIOR`` pages
   of which half are blocked, is above ``LIMIT``. Labels are the rules' verdicts. A template without labelled pages stays
   at one half, which doesn't reject it: rejecting needs evidence.

Trees are built level by level over counts for (host, template so far, next segment), which Spark aggregates before
shuffling; hosts of any size are spread by their templates. Paths deeper than ``DEPTH`` keep their rest in one segment.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and forms a template of its
own; rows are judged one by one, so repeated rows give repeated results; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: The rules of the registered query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_CHILDREN, RARE, DEPTH = 32, 0.5, 4
PRIOR, LIMIT, ERRORS = 4.0, 0.5, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    part = lambda k: F.when(has, F.regexp_extract(url, pattern, k)).otherwise(F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first in code-point order among equally long ones; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments with digits and opaque runs generalised, at most ``DEPTH`` of them."""
    plain = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}|[A-Za-z0-9_-]{40,}", "*"), r"[0-9]+", "#")
    return F.split(F.regexp_replace(plain, r"^/", ""), "/", DEPTH)


def templates(pages: DataFrame) -> DataFrame:
    """``host, segments, template, blocked`` for each combination of host and segments in ``pages`` (host, segments, verdict)."""
    count = lambda c: F.sum(c.cast("long"))
    shapes = pages.groupBy("host", "segments").agg(F.count("*").alias("n"), count(F.coalesce(F.col("verdict").isNotNull(), F.lit(False))).alias("labelled"), count(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("bad"))
    tree = written = materialize(shapes.withColumn("at", F.lit("")), "shapes")
    for level in range(DEPTH):
        segment = F.try_element_at("segments", F.lit(level + 1))
        below = F.transform(F.slice("segments", level + 2, DEPTH), lambda s: F.regexp_replace(s, r"[^#*.]+", "a"))
        node = tree.withColumn("segment", segment).withColumn("below", F.when(segment.isNotNull(), F.concat_ws("/", below)))
        children = node.where("segment is not null").groupBy("host", "at", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("below").alias("first"), F.max("below").alias("last"))
        parents = children.groupBy("host", "at").agg(F.count("*").alias("children"), F.sum("n").alias("pages"), F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"), F.count_if(F.col("n") <= 2).alias("rare"))
        share = (F.col("all_bad") + F.lit(PRIOR / 2)) / (F.col("all") + PRIOR)
        error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
        off = (F.col("bad") / F.greatest("labelled", F.lit(1)) - share) / F.greatest(error, F.lit(1e-9))
        kind = F.when(F.col("labelled") == 0, "unlabelled").when(off > ERRORS, "above").when(off < -ERRORS, "below").otherwise("like")
        variable = (F.col("children") > MAX_CHILDREN) & (F.col("rare") >= RARE * F.col("children"))
        alike = F.concat_ws("|", "kind", "first", "last")
        named = children.join(parents, ["host", "at"]).withColumn("kind", kind).withColumn("class", F.when(variable, F.concat(F.lit("*"), "kind")).otherwise(alike))
        several = named.groupBy("host", "at", "class").agg(F.count("*").alias("like")).where("like > 1")  # a count and a join: a node may have any number of children
        merged = F.concat(F.lit("{"), "class", F.lit("}"))
        named = named.join(several, ["host", "at", "class"], "left").select("host", "at", "segment", F.when(F.col("like").isNull(), F.col("segment")).otherwise(merged).alias("branch"))
        tree = node.join(named, ["host", "at", "segment"], "left").withColumn("at", F.when(F.col("branch").isNull(), F.col("at")).otherwise(F.concat("at", F.lit("/"), "branch"))).drop("segment", "below", "branch")
        tree = materialize(tree, f"tree{level}")
        discard(written)
        written = tree
    purity = tree.groupBy("host", "at").agg(((F.sum("bad") + F.lit(PRIOR / 2)) / (F.sum("labelled") + PRIOR)).alias("purity"))
    return tree.join(purity, ["host", "at"]).select("host", "segments", F.col("at").alias("template"), (F.col("purity") > LIMIT).alias("blocked"))


def judge(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` for each row."""
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "segments": shape(F.col("path"))})
    found = templates(rows.select("host", "segments", F.col("by_rule").alias("verdict")))
    by_template = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.join(found, ["host", "segments"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template")
