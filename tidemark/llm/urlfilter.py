"""URL filters by a sort-merge range join.

A host read from its last label on (``org.example.www.``) turns "this host and
its subdomains" into a prefix, and a prefix is an interval of sorted keys.  The
rules sorted by key are nested intervals; each task sorts its urls by the same
key and sweeps both lists once, with a stack of the rules whose interval the
sweep is in.  The longest rule of the stack whose path the url's path starts
with decides; without one the verdict is ``default``.

The rules reach the tasks as a broadcast only while they number at most
``max_broadcast``; beyond it an equi-join on each host suffix replaces the sweep
(same results, tested).

Results for unusual input: a null url, or one without ``://``, has an empty host
and path and gets the default verdict; equal rules: block wins; repeated rows
are judged row by row; an empty table or rule set works.  Extra columns with any
name stay as they are in ``judge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of the production query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"
MAX_BROADCAST = 200_000


def host_of(url: F.Column) -> F.Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    """Labels from the last on, each followed by a dot below every other character."""
    return "".join(label + "\0" for label in reversed(host.split("."))) if host else ""


def _sweep(batches, rules: list[tuple[str, str, str]], default: str):
    """rules: (verdict, host, path).  One pass over the sorted urls of each batch."""
    by_place = {}
    for v, h, p in rules:  # of equal rules block wins
        place = (reversed_key(h), h, p)
        if by_place.get(place, ("",))[0] != "block":
            by_place[place] = (v, h, p)
    nested = sorted(by_place.items())
    for b in batches:
        hosts, paths = b["host"].tolist(), b["path"].tolist()
        keys = [reversed_key(h) for h in hosts]
        verdicts, texts = [default] * len(b), [None] * len(b)
        stack: list[tuple[str, tuple]] = []
        following = 0
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            key = keys[i]
            while following < len(nested) and nested[following][0][0] <= key:
                start, rule = nested[following][0][0], nested[following][1]
                while stack and not start.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((start, rule))
                following += 1
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = None
            for _, (v, h, p) in stack:  # all of them hold the host
                if paths[i].startswith(p):
                    rank = (len(h) + len(p), len(h), v == "block")
                    if best is None or rank > best[0]:
                        best = (rank, v, h + p)
            if best:
                verdicts[i], texts[i] = best[1], best[2]
        b["rule"], b["verdict"] = texts, verdicts
        yield b


def _by_suffix(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts from an equi-join of every host suffix with the rules' hosts."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").distinct()
    hit = each.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    rule = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block")
    best = hit.groupBy("host", "path").agg(F.max_by(rule, rank).alias("b"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``rules`` is a list, or a DataFrame (verdict, host, path) of any size.  The
    sweep needs no shuffle: each task sorts the urls it has read, so a hot host
    is spread as its rows are.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(max_broadcast + 1).collect()
        listed = [tuple(r) for r in few] if len(few) <= max_broadcast else None
    else:
        listed = list(rules) if len(rules) <= max_broadcast else None
        rules = None if listed is not None else spark.createDataFrame(rules, "verdict string, host string, path string")
    if listed is None:
        named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        return _by_suffix(urls, named, default)
    shared = spark.sparkContext.broadcast(listed)
    return urls.mapInPandas(
        lambda batches: _sweep(batches, shared.value, default), "page_id long, host string, path string, rule string, verdict string"
    )


def oracle() -> str:
    """DuckDB SQL for the production rules."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with u as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(v, h, p) as (values {rules}),
m as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
  from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
  group by page_id)
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, '{DEFAULT}') as verdict
from u left join m on u.page_id = m.page_id"""
