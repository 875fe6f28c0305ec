"""Inputs for the registered queries, derived by Spark from the driver's tables.

The tables hold prose, addresses and events rather than job pages.  What a query needs
beyond them is computed from every row of a table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.config import Rules, Settings
from alertloom.functions.text import strip

AS_OF_TEXT = "2024-02-01 00:00:00"
RULES = Rules(
    locations=("en", "fr", "de"),
    terms=("the", "une", "für", "está", "of the"),
    skills=("and", "que", "est", "sich", "with", "à", "ing", "c++"),
    excluded=("of", "le", "in"),
    title_boosts=((("the", "une"), 8), (("ing", "en"), 7)),
)
SETTINGS = Settings(max_age_days=10)
# The same words for plain article pages.
PAGE_RULES = Rules(
    locations=("en", "fr", "de"), terms=("the", "une", "für"),
    skills=("and", "que", "est", "sich", "with", "à"), excluded=("of",), title_boosts=(),
)


def as_of() -> Column:
    """``AS_OF_TEXT`` in UTC, whatever the zone of the machine."""
    return F.timestamp_seconds(F.lit(1_706_745_600))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, searched: bool = False) -> DataFrame:
    """Spread a small input over all cores before costly work on its rows.

    Inputs of many files are split by the scan already and stay as they are.  Catalyst
    moves filters below a repartitioning, which for costly ones would undo it; with
    ``searched`` the rows pass through a generator, and filters stay above that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    wide = df.repartition(cores)
    return wide.select(F.inline(F.array(F.struct(*df.columns)))) if searched else wide


def posted(id_col: str) -> Column:
    hours = F.col(id_col) * 7 % 400
    moment = F.timestamp_micros(F.unix_micros(as_of()) - hours * 3_600_000_000)
    return F.when(F.col(id_col) % 5 != 0, moment)


def stamp_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def document_listings(spark: SparkSession, sf_dir: str, searched: bool = False) -> DataFrame:
    """Documents as listings: the first line is the title, the whole text the summary."""
    return spread(table(spark, sf_dir, "documents"), searched).select(
        "source",
        strip(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.upper("lang").alias("company"),
        F.col("lang").alias("location"),
        F.concat(F.lit("https://"), "lang", F.lit(".example/job/"), F.expr("n_chars div 20")).alias("url"),
        posted("doc_id").alias("posted_at"),
        F.col("text").alias("summary"),
        F.col("doc_id").alias("seq"),
    )


def escaped(col: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(raw), F.lit(name))
    return col


def _age_days() -> Column:
    return (F.col("doc_id") * 7 % 30 + 1).cast("string")


def document_pages(spark: SparkSession, sf_dir: str, kind: str, html: Column, hint: str = "") -> DataFrame:
    """One page of a kind per document.  ``html`` may use the columns made here."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", "text",
        strip(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        _age_days().alias("days"),
        F.date_format(posted("doc_id"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("stamp"),
    )
    return docs.select(
        F.col("doc_id").alias("task_id"), "source", F.lit(kind).alias("kind"),
        F.concat(F.lit("https://"), "source", F.lit(".example/list/all?page=1")).alias("page_url"),
        F.col("lang").alias("default_location"), F.lit(hint).alias("company_hint"), html.alias("html"),
    )


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page_html(kind: str) -> Column:
    """HTML of one page of a kind, from the columns ``document_pages`` offers."""
    title, body, number = escaped(F.col("title")), escaped(F.col("text")), F.col("doc_id").cast("string")
    days, stamp = F.col("days"), F.coalesce("stamp", F.lit(""))
    if kind == "json_ld":
        posting = F.struct(
            F.lit("JobPosting").alias("@type"), F.col("title").alias("title"),
            F.struct(F.col("source").alias("name")).alias("hiringOrganization"),
            F.struct(F.struct(F.col("lang").alias("addressLocality"), F.lit("X").alias("addressCountry"))
                     .alias("address")).alias("jobLocation"),
            _cat("/offre/", number).alias("url"), stamp.alias("datePosted"), F.lit("2030-01-01").alias("validThrough"),
            _cat("<p>", body, "</p>").alias("description"),
        )
        graph = F.to_json(F.struct(F.array(posting).alias("@graph")))
        script = F.replace(graph, F.lit("<"), F.lit("\\u003c"))
        return _cat('<html><head><script type="application/ld+json">', script, "</script></head></html>")
    if kind == "cards":
        return _cat(
            '<ul><li data-job-id="', number, '"><h2> ', title, ' </h2><a href="../offre?id=', number,
            '">open</a><b class="brand">', F.col("source"), '</b><i class="city">', F.col("lang"),
            '</i><time datetime="', stamp, '"></time><p>', body, "</p></li></ul>")
    if kind == "wordpress":
        return _cat(
            '<article class="post"><h2><a href="/offre/', number, '">', title, '</a></h2><time datetime="', stamp,
            '">soon</time><div class="entry-summary">', body, "</div></article>")
    if kind == "rekrute":
        return _cat(
            '<ul><li><a href="/offre-emploi-x-recrutement-', F.col("source"), "-group-", F.col("lang"), "-", number,
            '.html?r=1">', F.replace(title, F.lit("|"), F.lit("/")), " | ", F.col("lang"), " (Maroc)</a><p>", body,
            "</p></li></ul>")
    if kind == "marocannonces":
        return _cat(
            "<article><div>posted ", days, ' days ago.</div><a href="cat/annonce/', number, '/x.html">', title,
            " Niveau d'études: Bac+5</a><p>", body, "</p></article>")
    if kind == "talent":
        return _cat(
            '<article data-testid="job-card-unified"><div>posted ', days, " days ago.</div><h2>", title,
            '</h2><a href="/view?id=', number, '">view</a><p>', body, "</p></article>")
    if kind == "successfactors":
        return _cat(
            "<div><p>posted ", days, ' days ago.</p><a href="/JobDetail/', number, '">', title,
            '</a><a href="/JobDetail/', number, '">again again</a><p>', body, "</p></div>")
    if kind == "rss":
        return _cat(
            '<?xml version="1.0"?><rss version="2.0"><channel><item><title>', title, "</title><link>https://f.example/",
            number, "</link><author>", F.col("source"), "</author><pubDate>", stamp, "</pubDate><description>",
            escaped(_cat("<p>", body, "</p>")), "</description></item></channel></rss>")
    if kind == "detail":
        ld = _cat('<script type="application/ld+json">{"@type": "JobPosting", "datePosted": "', stamp, '"}</script><p>', body,
                  "</p>")
        turn = F.col("doc_id") % 4
        return (
            F.when(turn == 0, ld)
            .when(turn == 1, _cat("<div>Publiée il y a ", days, " jours.</div><p>", body, "</p>"))
            .when(turn == 2, _cat("<p>Le 2024-01-15.</p><p>", body, "</p>"))
            .otherwise(_cat("<h1>", title, "</h1><p>", body, "</p>"))
        )
    raise KeyError(kind)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources: some switched off, some static, some with words of their own."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source_pos"),
        F.col("p_brand").alias("name"),
        F.expr("CASE p_size % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END").alias("enabled"),
        F.expr("CASE WHEN p_type <> 'SMALL' THEN lower(p_type) END").alias("kind"),
        F.expr("CASE p_size % 4 WHEN 0 THEN concat('https://', p_partkey, '.example/?q={query}') "
               "WHEN 1 THEN 'https://x.example/all' END").alias("search_url"),
        F.expr("CASE p_size % 4 WHEN 0 THEN 'https://unused.example' WHEN 2 THEN "
               "concat('https://static.example/', p_partkey) WHEN 3 THEN '' END").alias("url"),
        F.expr("CASE WHEN p_size % 3 > 0 THEN p_type END").alias("default_location"),
        F.expr("CASE WHEN p_size % 2 > 0 THEN p_brand END").alias("company"),
        F.expr("CASE p_size % 5 WHEN 0 THEN split(p_name, ' ') WHEN 1 THEN array() END")
        .cast("array<string>").alias("queries"),
    )


QUERIES = ("stage informatique", "pré embauche", "c++ & c#")


def path_rules(pages: DataFrame) -> DataFrame:
    """Two path rules per page: one for its language folder, one for its own path."""
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    return pages.select(host.alias("host"), F.explode(F.array(
        F.struct((F.col("page_id") * 2).alias("rule_pos"), path.alias("prefix"), (F.col("page_id") % 3 == 0).alias("allow")),
        F.struct((F.col("page_id") * 2 + 1).alias("rule_pos"), F.regexp_extract(path, "^/[a-z]+", 0).alias("prefix"),
                 (F.col("page_id") % 2 == 0).alias("allow")),
    )).alias("r")).select("host", "r.*")


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and event types as alerted keys, with the time of their last event."""
    from alertloom.sources.seen import iso_text

    latest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return latest.select(
        "user_id", "event_type",
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("dedupe_key"),
        iso_text(F.col("ts").cast("timestamp")).alias("first_seen"),
    )
