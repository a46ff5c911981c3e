"""URL filters: rules first, then a tree of path templates for each host, in DataFrame operations only.

*Rules* (``Rule(host, path, verdict)``) fit their host and its subdomains if the url's path
starts with theirs; the longest wins. Their verdicts are the labels that the tree learns from.

*Tree.* Level by level, the distinct paths of a host are put under templates. Each child of a node is
judged by its own urls, however many siblings it has: its segment is variable if it has a digit or fewer than ``FEW``
urls (first segments that as many hosts have are fixed words). Variable children of a node become one wildcard. Of
the others, those with labels that go on in the same way (end here or go on) and whose share of blocked urls is alike,
tested against their parent's share at two standard errors, are merged into one branch; without labels a child
stays on its own. The loop ends when all paths do. Below the first segment, a node of one path, or of fewer than ``FEW`` urls,
cannot branch any more and is finished at once, so only paths that several urls share segment by segment take long.

*Purity.* A template's share of blocked labels is smoothed with the share of the same template on
all hosts, and that with one half, as so many (``WEIGHT``) more labels. Templates
of at least ``least`` are rejected: their urls without a rule are blocked; all others are allowed.

Counts come before every join, so a host with a third of all urls is summed up where it is read.

Defined results: a missing url, or one without ``://``, has an empty host and path, which no rule
fits; such urls are one template. A path without segments is a template of its own. Repeated urls
count as often as they occur. Ties between rules of one length go to the first in the alphabet.
Other columns pass through; result names that are taken raise an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.frames import sent_if_small
from tableops.plans.scratch import written

#: A segment with fewer urls than this is variable.
FEW = 3
WEIGHT = 4.0
ANY = "*"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in small letters."""
    found = F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)) for r in ordered]
    none = F.lit(None).cast("string")
    if not ordered:
        return none, none
    return F.coalesce(*[F.when(f, F.lit(r.name)) for f, r in zip(fits, ordered, strict=True)]), F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, ordered, strict=True)])


def _branch(child: Column) -> Column:
    """The name of merged children, of the same length for any number of them; equal sets have equal names."""
    ends = F.concat_ws("|", F.min(child), F.when(F.count("*") > 1, F.max(child)))
    more = F.concat(F.lit("|+"), F.count("*") - 2, F.lit("#"), F.hex(F.bit_xor(F.xxhash64(child))))
    return F.concat(ends, F.when(F.count("*") > 2, more).otherwise(F.lit("")))


def templates(paths: DataFrame) -> DataFrame:
    """The template of each distinct (host, path): host, path, template, n, labelled, blocked.

    ``paths`` holds host, path, and counts n, labelled, blocked.
    """
    marks = ["n", "labelled", "blocked"]
    out = ["host", "path", "template", *marks]
    now = paths.withColumn("parts", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", r"\A/", ""), "/")))
    now = written(now.withColumn("template", F.lit("")), "templates")
    ended = []
    level = 0
    while True:
        ended.append(now.where(F.size("parts") <= level).select(*out))
        here = now.where(F.size("parts") > level)
        if here.isEmpty():
            return reduce(DataFrame.unionAll, ended)
        child = F.get("parts", F.lit(level))
        counts = here.groupBy("host", "template", child.alias("child"))
        counts = counts.agg(F.max(F.size("parts") > level + 1).alias("on"), F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in marks])
        counts = written(counts, "children")
        nodes = counts.groupBy("host", "template").agg(F.sum("paths").alias("all_paths"), *[F.sum(c).alias(f"all_{c}") for c in marks])
        own = counts.join(sent_if_small(written(nodes, "nodes")), ["host", "template"])
        few = F.col("n") < FEW
        if level == 0:
            hosts = written(counts.groupBy("child").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= FEW), "words")
            own = own.join(sent_if_small(hosts), "child", "left")
            few = few & F.col("hosts").isNull()
        last = (F.lit(level > 0)) & ((F.col("all_paths") == 1) | (F.col("all_n") < FEW))
        share = F.col("all_blocked") / F.greatest("all_labelled", F.lit(1))
        spread = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
        off = F.col("blocked") / F.greatest("labelled", F.lit(1)) - share
        like = F.when(F.col("labelled") == 0, F.concat(F.lit("?"), "child")).when(off > 2 * spread, "+").when(off < -2 * spread, "-").otherwise("=")
        varies = few | F.rlike("child", F.lit("[0-9]"))
        own = own.select("host", "template", "child", varies.alias("varies"), last.alias("last"), F.concat(like, F.col("on").cast("string")).alias("kind"))
        own = written(own, "judged")
        names = own.where(~F.col("varies")).groupBy("host", "template", "kind").agg(_branch(F.col("child")).alias("branch"))
        own = own.join(sent_if_small(written(names, "branches")), ["host", "template", "kind"], "left")
        own = written(own.select("host", "template", "child", "last", F.when(F.col("varies"), ANY).otherwise(F.col("branch")).alias("branch")), "steps")
        found = here.withColumn("child", child).join(sent_if_small(own), ["host", "template", "child"])
        rest = F.slice("parts", level + 2, F.size("parts"))
        rest = F.transform(rest, lambda x: F.when((F.col("n") < FEW) | F.rlike(x, F.lit("[0-9]")), ANY).otherwise(x))
        step = F.concat("template", F.lit("/"), "branch")
        step = F.when(F.col("last"), F.array_join(F.concat(F.array(step), rest), "/")).otherwise(step)
        found = written(found.select("host", "path", step.alias("template"), *marks, "parts", "last"), "templates")
        ended.append(found.where("last").select(*out))
        now = found.where(~F.col("last")).drop("last")
        level += 1


def rejected(found: DataFrame, least: float = 0.8) -> DataFrame:
    """Smoothed purity of each host's templates: host, template, purity, rejected."""
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    own = written(found.groupBy("host", "template").agg(*sums), "own")
    everywhere = own.groupBy("template").agg(F.sum("labelled").alias("labelled_everywhere"), F.sum("blocked").alias("blocked_everywhere"))
    wide = (F.col("blocked_everywhere") + WEIGHT / 2) / (F.col("labelled_everywhere") + WEIGHT)
    joined = own.join(sent_if_small(written(everywhere, "everywhere")), "template")
    purity = (F.col("blocked") + WEIGHT * wide) / (F.col("labelled") + WEIGHT)
    return joined.select("host", "template", purity.alias("purity"), (purity >= least).alias("rejected"))


def judged(urls: DataFrame, rules: Sequence[Rule], least: float = 0.8, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, template, purity and verdict (``allow`` or ``block``)."""
    taken = {"host", "path", "rule", "template", "purity", "verdict"} & {c.lower() for c in urls.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are already there")
    rows = urls.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    marks = [F.count("*").alias("n"), F.count("_verdict").alias("labelled"), F.count_if(F.col("_verdict") == "block").alias("blocked")]
    found = written(templates(rows.groupBy("host", "path").agg(*marks)), "found")
    purity = rejected(found, least)
    known = found.select("host", "path", "template").join(sent_if_small(written(purity, "purity")), ["host", "template"])
    out = rows.join(sent_if_small(written(known, "known")), ["host", "path"])
    verdict = F.coalesce("_verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(*urls.columns, "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
