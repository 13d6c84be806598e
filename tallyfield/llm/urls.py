"""URL filters by a path-template tree, in DataFrame functions only.

A path is cut into segments; segments that look variable (numbers, long hexadecimal strings, segments with several
digits, very long ones) become wildcards at once, which leaves few distinct paths per host, each with its number of
pages and of labelled ones. The tree is then built from the root over those: under a node with more than FANOUT children
the rare ones fold into a wildcard, and the others are taken in the order of their smoothed share of bad labels and
merged with the branch before, all its members pooled, unless a two-proportion test tells them apart. Segments that all
paths under a node have in common are passed at once, so there are as many rounds as branchings on a path, not segments.
What paths become is their template; a template is rejected if its share of bad labels, smoothed towards the share over
all pages, reaches REJECT.

Explicit rules come before templates; the longest that fits wins.

Defined results: a null url and one without "://" have an empty host and path, no rule, and the template of the empty
host's root; pages without a label count for the tree only; rows that repeat a page_id are judged each; paths of any
length and depth are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import cut

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FANOUT, FREQUENT, LONG = 20, 0.05, 32
MIN_LABELS, MOST_Z = 5, 1.96
STRENGTH, REJECT = 4.0, 0.5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, those that look variable as wildcards; a short extension stays."""
    cut_off = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        stem, ending = F.regexp_extract(s, "^(.*?)(\\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, "^(.*?)(\\.[A-Za-z]{1,5})?$", 2)
        variable = stem.rlike("^[0-9]+$|^[0-9a-fA-F-]{8,}$|[0-9].*[0-9].*[0-9]") | (F.length(stem) > LONG) | (stem == WILD)
        return F.when(variable, F.concat(F.lit(WILD), ending)).otherwise(s)

    return F.transform(cut_off, general)


def _named(segment: Column) -> Column:
    return F.when(F.startswith(segment, F.lit(WILD)), WILD).otherwise(segment)


def _branches(tested: DataFrame) -> DataFrame:
    """host, prefix, segment, name: the branch of each child with labels enough. At most max(FANOUT, 1 / FREQUENT) children
    of a node are compared."""
    child = F.struct("rate", "segment", F.col("labelled").alias("m"), F.col("bad").alias("b"))
    nodes = tested.groupBy("host", "prefix").agg(F.sort_array(F.collect_list(child)).alias("children"))
    empty = F.array().cast("array<struct<m:bigint,b:bigint,names:array<string>>>")

    def add(groups: Column, x: Column) -> Column:
        g = F.element_at(groups, -1)
        share = (g["b"] + x["b"]) / (g["m"] + x["m"])
        apart = F.abs(x["b"] / x["m"] - g["b"] / g["m"]) > MOST_Z * F.sqrt(share * (1 - share) * (1 / x["m"] + 1 / g["m"]))
        alone = F.struct(x["m"].alias("m"), x["b"].alias("b"), F.array(x["segment"]).alias("names"))
        pooled = F.struct((g["m"] + x["m"]).alias("m"), (g["b"] + x["b"]).alias("b"), F.array_append(g["names"], x["segment"]).alias("names"))
        return F.when((F.size(groups) == 0) | apart, F.array_append(groups, alone)).otherwise(F.array_append(F.slice(groups, F.lit(1), F.size(groups) - 1), pooled))

    grouped = nodes.select("host", "prefix", F.explode(F.aggregate("children", empty, add)).alias("g"))
    return grouped.select("host", "prefix", F.explode("g.names").alias("segment"), F.array_join(F.sort_array("g.names"), "|").alias("name"))


def _level(nodes: DataFrame, prior: float) -> DataFrame:
    """host, prefix, segment and the branch that the segment belongs to."""
    parents = nodes.groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("pages").alias("all_pages"))
    known = nodes.join(parents.select(F.col("host").alias("h"), F.col("prefix").alias("x"), "children", "all_pages"), (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("x"))).drop("h", "x")
    wild = (F.col("segment").startswith(WILD)) | ((F.col("children") > FANOUT) & (F.col("pages") < FREQUENT * F.col("all_pages")))
    known = known.withColumn("wild", wild).withColumn("rate", (F.col("bad") + STRENGTH * prior) / (F.col("labelled") + STRENGTH))
    literal = known.where(~F.col("wild"))
    tested = _branches(literal.where(F.col("labelled") >= MIN_LABELS))
    columns = ["host", "prefix", "segment", "name"]
    return (
        tested.select(*columns)
        .unionByName(literal.where(F.col("labelled") < MIN_LABELS).withColumn("name", F.col("segment")).select(*columns))
        .unionByName(known.where("wild").withColumn("name", F.lit(WILD)).select(*columns))
    )


def _in_common(rows: DataFrame) -> DataFrame:
    """`rows` with the segments that all of a node's paths have in common passed on to the prefix: those that the least and
    the greatest of them share."""
    ends = rows.groupBy(F.col("host").alias("h"), F.col("prefix").alias("x")).agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
    apart = F.array_position(F.transform("least", lambda s, i: (s != F.get("most", i)) | F.get("most", i).isNull()), F.lit(True))
    ends = ends.select("h", "x", F.when(apart > 0, apart.cast("int") - 1).otherwise(F.size("least")).alias("passed"))
    joined = rows.join(ends, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("x")))
    passed = F.transform(F.slice("rest", F.lit(1), F.col("passed")), _named)
    prefix = F.when(F.col("passed") > 0, F.concat("prefix", F.lit("/"), F.array_join(passed, "/"))).otherwise(F.col("prefix"))
    rest = F.slice("rest", F.col("passed") + 1, F.size("rest"))
    return joined.select("host", "route", "pages", "labelled", "bad", prefix.alias("prefix"), rest.alias("rest"))


def templates(pages: DataFrame) -> DataFrame:
    """host, route, template of every distinct route; `pages` has host, route (segments joined), parts (segments),
    labelled and bad (0 or 1). One branching at a time, each cut from its lineage; the rows are distinct routes only."""
    routes = cut(
        pages.groupBy("host", "route").agg(F.first("parts").alias("rest"), F.count("*").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    )
    whole = routes.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = whole[1] / max(whole[0], 1)
    columns = ["host", "route", "labelled", "bad", "prefix"]
    rows = routes.withColumn("prefix", F.lit(""))
    done, open_rows = rows.where(F.size("rest") == 0).select(*columns), rows.where(F.size("rest") > 0)
    while not open_rows.isEmpty():
        rows = cut(_in_common(open_rows))
        there = rows.where(F.size("rest") > 0).withColumn("segment", F.element_at("rest", 1))
        nodes = there.groupBy("host", "prefix", "segment").agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        names = _level(cut(nodes), prior).select(F.col("host").alias("h"), F.col("prefix").alias("x"), F.col("segment").alias("s"), "name")
        joined = there.join(names, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("x")) & (F.col("segment") == F.col("s")))
        longer = joined.withColumn("prefix", F.concat("prefix", F.lit("/"), "name")).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).drop("h", "x", "s", "name", "segment")
        longer = cut(longer)
        done = done.unionByName(rows.where(F.size("rest") == 0).select(*columns)).unionByName(longer.where(F.size("rest") == 0).select(*columns))
        open_rows = longer.where(F.size("rest") > 0)
    rows = done
    found = rows.withColumnRenamed("prefix", "template")
    sums = found.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    purity = ((F.col("b") + STRENGTH * prior) / (F.col("m") + STRENGTH)).alias("bad_share")
    sums = sums.select("h", "t", purity)
    return found.join(sums, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).select("host", "route", "template", "bad_share")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of `pages` (page_id, url). `labels` (page_id, bad) has
    the labelled pages, one row each."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", segments(F.col("path")).alias("parts")).select("*", F.array_join("parts", "/").alias("route"))
    marks = labels.select(F.col("page_id").cast("long").alias("marked_id"), F.col("bad").cast("boolean").cast("long").alias("bad"))
    marked = rows.join(marks, F.col("page_id") == F.col("marked_id"), "left")
    marked = marked.select("host", "route", "parts", F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    known = cut(templates(marked)).select(F.col("host").alias("h"), F.col("route").alias("r"), "template", "bad_share")
    judged = rows.join(known, (F.col("host") == F.col("h")) & (F.col("route") == F.col("r")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "template")
