"""From sources and search words to requests, and what may be fetched when."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.text import form_encode, text_or_empty, url_host
from alertloom.operators.numbering import position_in_group, running_offset

# What a source means by leaving a field out.
DEFAULT_KIND, DEFAULT_LOCATION = "generic", "Morocco"


def request_plan(
    sources: DataFrame,
    queries: Iterable[str],
    only_sources: Iterable[str] | None = None,
    limit_queries: int | None = None,
) -> DataFrame:
    """One row per enabled source and query; a static page gives exactly one row.

    ``sources`` has ``source_pos`` (0, 1, 2, ...) and the fields of a source.  ``id``
    numbers the requests in order of source and query.
    """
    kept = sources.where(F.coalesce("enabled", F.lit(True)))
    chosen = [s for s in only_sources or [] if s]
    if chosen:
        kept = kept.where(F.col("name").isin(*chosen))
    search, static = text_or_empty(F.col("search_url")), text_or_empty(F.col("url"))
    common = F.array(*[F.lit(q) for q in queries]).cast("array<string>")
    own = F.when(F.coalesce(F.size("queries"), F.lit(0)) > 0, F.col("queries")).otherwise(common)
    if limit_queries:
        own = F.slice(own, 1, limit_queries)
    asked = F.when(F.contains(search, F.lit("{query}")), own).otherwise(F.array(F.lit("")))
    rows = kept.where((search != "") | (static != "")).select(
        "source_pos",
        F.col("name").alias("source"),
        F.coalesce("kind", F.lit(DEFAULT_KIND)).alias("kind"),
        F.when(search != "", search).otherwise(static).alias("template"),
        F.coalesce("default_location", F.lit(DEFAULT_LOCATION)).alias("default_location"),
        F.coalesce("company", F.lit("")).alias("company"),
        asked.alias("asked"),
    )
    numbered = running_offset(rows, "source_pos", F.size("asked"), "first_id")
    exploded = numbered.select("*", F.posexplode("asked").alias("pos", "query"))
    return exploded.select(
        (F.col("first_id") + F.col("pos")).alias("id"),
        "source",
        "kind",
        F.replace("template", F.lit("{query}"), form_encode(F.col("query"))).alias("url"),
        "query",
        "default_location",
        "company",
    )


def lane_plan(requests: DataFrame, delay_seconds: float, max_lanes: int) -> DataFrame:
    """Place requests in lanes: one host after another row by row, hosts side by side.

    ``slot`` is the place inside a host, ``earliest_offset_s`` the first moment a request
    may start, ``lanes`` how many hosts run at once.
    """
    hosted = requests.withColumn("host", url_host(F.col("url")))
    lanes = hosted.agg(
        F.greatest(F.lit(1), F.least(F.lit(max_lanes), F.count_distinct("host"))).alias("lanes")
    )
    placed = position_in_group(hosted, "host", "id", "slot")
    return placed.withColumn("earliest_offset_s", (F.col("slot") - 1) * F.lit(float(delay_seconds))).withColumn(
        "lanes", lanes.scalar()
    )


FEW_RULES = 200


def url_policy(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed`` to rows with a unique ``id`` and a ``url``.

    ``rules`` has ``host, rule_pos, prefix, allow``.  The first rule of the host whose
    prefix starts the path decides; no rule allows, no host refuses.  The rules of a host
    with at most ``FEW_RULES`` of them are a list that is looked through in the row, after
    one join with a row per host.  Only addresses on hosts with more rules are compared by
    equality with the prefix lengths that their host uses.
    """
    root = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
    path = F.regexp_replace(F.regexp_replace("url", root, ""), "#.*$", "")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    located = urls.withColumn("host", url_host(F.col("url"))).withColumn("_path", path)
    unique = rules.groupBy("host", "prefix").agg(
        F.min("rule_pos").alias("rule_pos"), F.min_by("allow", "rule_pos").alias("allow")
    )
    sizes = unique.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
    # at most FEW_RULES rules to a list
    lists = (
        unique.join(sizes.where(F.col("_n") <= FEW_RULES), "host").groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("rule_pos", "prefix", "allow"))).alias("_rules"))
    )
    many = sizes.where(F.col("_n") > FEW_RULES).select("host")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r.prefix)), F.lit(0))
    few_decided = located.join(many, "host", "left_anti").join(lists, "host", "left").withColumn(
        "_allow", first["allow"]).drop("_rules")

    rest = located.join(many, "host", "left_semi")
    # at most as many lengths per host as an address has characters
    lengths = unique.join(many, "host", "left_semi").groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    tried = (
        rest.select("id", "host", "_path")
        .join(lengths, "host")
        .select("id", "host", F.explode(F.transform(
            F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.left(F.col("_path"), n)
        )).alias("prefix"))
    )
    verdicts = (
        tried.join(unique, ["host", "prefix"])
        .groupBy("id")
        .agg(F.min_by("allow", "rule_pos").alias("_allow"))
    )
    every = few_decided.unionByName(rest.join(verdicts, "id", "left"))
    decided = F.when(F.col("host") == "", False).otherwise(F.coalesce("_allow", F.lit(True)))
    return every.withColumn("allowed", decided).select(*urls.columns, "host", "allowed")


PLAN_COLUMNS = ("source", "kind", "url", "default_location", "company")


def fetched_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the page that answered them; failed and missing ones fall away.

    ``pages`` has ``id, ok, final_url, html``.  Pages that also carry the request's own
    columns (``PLAN_COLUMNS``, as a crawler that keeps the plan beside its answers writes
    them) need no join, so ``html`` is never moved.
    """
    good = pages.where("ok")
    if set(PLAN_COLUMNS) <= set(pages.columns):
        answered = good.select("id", *PLAN_COLUMNS, "final_url", "html")
    else:
        answered = requests.join(good.select("id", "final_url", "html"), "id")
    return answered.select(
        F.col("id").alias("task_id"),
        "source",
        "kind",
        F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("page_url"),
        "default_location",
        F.col("company").alias("company_hint"),
        "html",
    )
