"""The registered queries.  Each takes a session and a folder of tables."""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import dates, text
from alertloom.operators import dedupe, digest, extract, matching, rule_table, stats, verify
from alertloom.operators.requests import fetched_pages, lane_plan, request_plan, url_policy
from alertloom.plans.alert_run import alert_run, finish, rank_listings
from alertloom.plans.articles import article_listings, top_listings as ranked_articles
from alertloom.session import new_path, written
from alertloom.sources import seen as state
from alertloom.sources.bucketed import read_bucketed, write_bucketed
from alertloom.sources.dom import elements, with_dom
from alertloom.sources.seen_log import SeenLog
from alertloom.sources.feeds import read_feed_files
from alertloom.sources.sinks import dump_raw, write_digest
from alertloom.streaming import incremental
from checks import inputs as I

QUERIES = {}


def query(fn):
    """Register a query under its name; dates are read and shown in UTC."""

    @wraps(fn)
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = in_utc
    return fn


def _pages(spark, sf_dir) -> DataFrame:
    return I.spread(I.table(spark, sf_dir, "pages"))


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _joined(name: str, col: str | None = None):
    return F.array_join(col or name, ",").alias(name)


# --- text and addresses -------------------------------------------------------

@query
def norm_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.normalize_url(F.col("url")).alias("norm_url"),
                        text.detail_url(F.col("url")).alias("detail_url"), text.url_host(F.col("url")).alias("host"))


@query
def norm_text_dups(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    key = F.sha2(text.normalize_text(F.col("text")), 256)
    groups = docs.groupBy(key.alias("text_key")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return groups.where("copies > 1")


@query
def dedupe_key(spark, sf_dir):
    key = text.dedupe_key(F.col("url"), F.col("company"), F.col("title"))
    return I.document_listings(spark, sf_dir).select("seq", key.alias("dedupe_key"))


@query
def form_encode(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.form_encode(F.col("text")), 256).alias("encoded_sha"))


@query
def truncate(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate(F.col("text"), 256).alias("short"), F.left("text", F.lit(800)).alias("head"))


@query
def url_join(spark, sf_dir):
    anchors = elements(with_dom(_pages(spark, sf_dir)), "page_id", "url").where("tag = 'a'")
    word = F.substring(F.col("attrs")["href"], 2, 2_000_000_000)
    refs = F.array(*[F.concat(F.lit(p), word) for p in ("/", "", "?q=", "#", "//o.example/", "../", "x/../y/./")])
    return anchors.select("page_id", "pos", "url", F.posexplode(refs).alias("form", "ref")).select(
        "page_id", _long("pos"), _long("form"), text.url_join(F.col("url"), F.col("ref")).alias("joined"))


@query
def page_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.strip_html(F.col("html")).alias("visible"))


# --- dates ----------------------------------------------------------------------

@query
def age_text(spark, sf_dir):
    rows = I.document_listings(spark, sf_dir)
    return rows.select("seq", dates.age_text(F.col("posted_at"), I.as_of()).alias("age"),
                       matching.freshness_rank(I.as_of(), I.SETTINGS).cast("long").alias("freshness_rank"))


@query
def parse_date(spark, sf_dir):
    """Order dates written in ten ways, read back."""
    orders = I.spread(I.table(spark, sf_dir, "orders"))
    day = F.col("o_orderdate")
    months = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
    month = F.get(F.array(*[F.lit(m) for m in months]), F.month(day) - 1)
    forms = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss.SSS'+02:00'"),
        F.date_format(day, "'Mon, 'd MMM yyyy HH:mm:ss' +0100'"), F.date_format(day, "MMMM d, yyyy"),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string")),
        F.date_format(day, "'Date de publication : 'MM/dd/yyyy"),
        F.concat(F.lit("il y a "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" jours")),
        F.concat((F.col("o_orderkey") % 50 + 2).cast("string"), F.lit(" weeks ago")),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.date_format(day, "yyyy-MM-dd")),
    ]
    said = F.get(F.array(*forms), (F.col("o_orderkey") % 10).cast("int"))
    read = dates.parse_date(said, I.as_of())
    return orders.select("o_orderkey", I.stamp_text(read).alias("read"))


@query
def infer_date(spark, sf_dir):
    """Dates inside running text around every order."""
    orders = I.spread(I.table(spark, sf_dir, "orders"))
    n = (F.col("o_orderkey") % 20 + 1).cast("string")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    forms = [
        F.concat(F.lit("Status "), "o_orderstatus", F.lit(" published "), n, F.lit(" days ago apply now")),
        F.concat(F.lit("date de publication : "), day), F.concat(F.lit("Offre "), day, F.lit(" Casablanca")),
        F.concat(F.lit("Publiée il y a "), n, F.lit(" jours Stagiaire")),
        F.concat(F.lit("since "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", prio "), F.col("o_orderpriority")),
        F.concat(F.lit("no dates in here "), F.col("o_orderpriority")),
    ]
    said = F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int"))
    return orders.select("o_orderkey", I.stamp_text(dates.infer_date(said, I.as_of())).alias("read"))


@query
def iso_parse(spark, sf_dir):
    events = I.spread(I.table(spark, sf_dir, "events"))
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("props"))).otherwise(
        state.iso_text(F.col("ts").cast("timestamp")))
    return events.select("event_id", F.unix_micros(dates.iso_parse(said)).cast("string").alias("micros"))


# --- matching -------------------------------------------------------------------

@query
def term_matches(spark, sf_dir):
    rows = I.document_listings(spark, sf_dir).withColumn("hits", matching.hits(I.RULES))
    return rows.select("seq", _joined("locations", "hits.locations"), _joined("terms", "hits.terms"),
                       _joined("skills", "hits.skills"))


@query
def relevance(spark, sf_dir):
    return I.document_listings(spark, sf_dir, searched=True).where(matching.relevant(I.RULES)).select("seq")


@query
def default_rules(spark, sf_dir):
    """The full default keyword lists over whole texts."""
    rows = I.document_listings(spark, sf_dir).withColumn("hits", matching.hits(matching.Rules()))
    return rows.select("seq", _joined("terms", "hits.terms"), _joined("skills", "hits.skills"))


@query
def match_rule_table(spark, sf_dir):
    """Terms from tables: the opening words of all documents, names, words and signs of parts."""
    parts = I.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"))
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text", I.strip(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    opening = F.array_join(F.slice(F.split("title", " "), 1, 2), " ")
    lists = {
        "openings": docs.select(F.lower(opening).alias("term"), F.col("doc_id").alias("pos")),
        "names": parts.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("pos")),
        "words": parts.select(F.posexplode("words").alias("i", "term"), "p_partkey").select("term", (F.col("p_partkey") * 2 + F.col("i")).alias("pos")),
        "signs": parts.select(F.concat(F.element_at("words", -1), F.lit("+")).alias("term"), F.col("p_partkey").alias("pos")),
    }
    rules = None
    for name, terms in lists.items():
        # a term once, at its first place
        rows = terms.groupBy("term").agg(F.min("pos").alias("pos")).select(F.lit(name).alias("list"), "pos", "term", F.lit(False).alias("exact"))
        rules = rows if rules is None else rules.unionByName(rows)
    said = docs.join(parts, F.col("doc_id") == F.col("p_partkey"), "left").select("doc_id", F.concat(
        "text", F.coalesce(F.concat(F.lit(" "), F.upper("p_name"), F.lit("+")), F.lit(""))).alias("text"))
    return rule_table.match_table(said, rules, "doc_id").select("doc_id", "list", _joined("hits").alias("hits"))


@query
def term_matches_table(spark, sf_dir):
    """The configured rules as a table."""
    rows = I.document_listings(spark, sf_dir).select("seq", matching.haystack().alias("hay"))
    kinds = ["locations", "terms", "skills"]
    hits = rule_table.match_table(rows, rule_table.rules_frame(spark, I.RULES), text="hay").where(F.col("list").isin(kinds))
    wide = hits.groupBy("seq").pivot("list", kinds).agg(F.first(F.array_join("hits", ",")))
    return rows.select("seq").join(wide, "seq", "left").na.fill("", kinds)


@query
def relevance_table(spark, sf_dir):
    rules = rule_table.rules_frame(spark, I.RULES)
    return rule_table.match_listings_by_table(I.document_listings(spark, sf_dir), rules).select("seq")


@query
def age_filter(spark, sf_dir):
    rows = I.document_listings(spark, sf_dir)
    return rows.where(matching.valid() & matching.young_enough(I.as_of(), I.SETTINGS)).select("seq", "title")


def _scored(spark, sf_dir) -> DataFrame:
    found = matching.match_listings(I.document_listings(spark, sf_dir, searched=True), I.RULES)
    return matching.score_listings(matching.with_keys(found), I.as_of(), I.RULES, I.SETTINGS)


@query
def score(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", _long("match_score"), _long("freshness_rank"),
                                         _joined("matched_skills"))


@query
def match_reason(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "match_reason")


# --- duplicates, ranking, messages -------------------------------------------------

def _event_scores(spark, sf_dir) -> DataFrame:
    """Events as scored rows: many per key, many ties."""
    return I.table(spark, sf_dir, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type",
                    F.get_json_object("props", "$.k")).alias("dedupe_key"),
        F.col("user_id").cast("string").alias("norm_url"), F.col("event_type").alias("norm_company"),
        F.col("value").cast("int").alias("match_score"), (F.col("event_id") % 3).cast("int").alias("freshness_rank"),
        F.when(F.col("event_id") % 3 != 2, F.col("ts").cast("timestamp")).alias("posted_at"),
        F.col("event_id").alias("seq"))


@query
def best_per_key(spark, sf_dir):
    return dedupe.best_per_key(_event_scores(spark, sf_dir)).select(
        "dedupe_key", "seq", _long("match_score"), "key_slot")


@query
def collapse_url_company(spark, sf_dir):
    best = dedupe.best_per_key(_event_scores(spark, sf_dir))
    return dedupe.collapse_offers(best).select("norm_url", "norm_company", "seq", _long("match_score"), "slot")


@query
def rank_topn(spark, sf_dir):
    return dedupe.rank_new(_event_scores(spark, sf_dir), None, 40).select(_long("place"), "seq", "dedupe_key")


@query
def anti_seen(spark, sf_dir):
    best = dedupe.best_per_key(_event_scores(spark, sf_dir))
    kept = I.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.lit("view"), F.get_json_object("props", "$.k")).alias("dedupe_key"))
    return dedupe.drop_seen(best, kept).select("dedupe_key", "seq")


@query
def anti_seen_log(spark, sf_dir):
    """The same keys from a log of runs, one of them merged and bucketed."""
    best = dedupe.best_per_key(_event_scores(spark, sf_dir))
    kept = I.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        "user_id", state.iso_text(F.col("ts").cast("timestamp")).alias("first_seen"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.lit("view"), F.get_json_object("props", "$.k")).alias("dedupe_key"))
    log = SeenLog(spark, new_path(spark, "state-log"), buckets=8, bucket_rows=1, fan=3)
    for n in range(4):
        log.append(kept.where(F.col("user_id") % 4 == n))
        log.compact()
    return dedupe.drop_seen(best, log.current()).select("dedupe_key", "seq")


def _ranked(spark, sf_dir) -> DataFrame:
    return rank_listings(I.document_listings(spark, sf_dir, searched=True), I.as_of(), I.RULES, I.SETTINGS)


@query
def rank_documents(spark, sf_dir):
    return _ranked(spark, sf_dir).select(_long("place"), "seq", _long("match_score"), _long("freshness_rank"), "match_reason")


@query
def digest_chunks(spark, sf_dir):
    rows = digest.digest_rows(_ranked(spark, sf_dir), I.as_of())
    return rows.withColumns({"place": F.col("place").cast("long"), "color": F.col("color").cast("long")})


@query
def digest_messages(spark, sf_dir):
    return digest.digest_messages(digest.digest_rows(_ranked(spark, sf_dir), I.as_of()))


@query
def digest_files(spark, sf_dir):
    """The messages as they are written to files."""
    path = new_path(spark, "digest")
    write_digest(digest.digest_messages(digest.digest_rows(_ranked(spark, sf_dir), I.as_of())), path)
    return spark.read.text(path).select(F.col("value").alias("message"))


# --- pages ------------------------------------------------------------------------

@query
def page_elements(spark, sf_dir):
    """Elements per page and tag, from the tree job."""
    rows = elements(with_dom(_pages(spark, sf_dir)), "page_id")
    return rows.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _site_pages(spark, sf_dir, kind: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        F.col("page_id").alias("task_id"), F.lit("site").alias("source"), F.lit(kind).alias("kind"),
        F.col("url").alias("page_url"), F.lit("Morocco").alias("default_location"), F.lit("").alias("company_hint"), "html")


@query
def page_anchors(spark, sf_dir):
    """All links of a page with their place and text."""
    rows = elements(with_dom(_pages(spark, sf_dir)), "page_id").where("tag = 'a'")
    return rows.select("page_id", F.col("attrs")["href"].alias("href"), "text").groupBy("page_id", "href", "text").agg(
        F.count(F.lit(1)).alias("n"))


@query
def pipe_anchor_listings(spark, sf_dir):
    """First link per address on every page, read as a ``title | city`` listing."""
    chosen = {"rekrute": partial(extract.pipe_titles, part="/")}
    rows = extract.extract_listings(_site_pages(spark, sf_dir, "rekrute"), I.as_of(), chosen)
    return rows.select("task_id", "seq", "title", "company", "location", "url", "summary")


@query
def boxed_anchor_listings(spark, sf_dir):
    """First long link per address on every page, with the text of the box around it."""
    chosen = {"successfactors": partial(extract.boxed_anchors, part="/")}
    rows = extract.extract_listings(_site_pages(spark, sf_dir, "successfactors"), I.as_of(), chosen)
    return rows.select("task_id", "seq", "title", "company", "location", "url", "summary")


@query
def page_articles(spark, sf_dir):
    rows = article_listings(_pages(spark, sf_dir), I.posted("page_id"))
    return rows.select("seq", "title", "company", "location", "url", "summary", I.stamp_text(F.col("posted_at")).alias("posted"))


@query
def top_listings(spark, sf_dir):
    rows = ranked_articles(_pages(spark, sf_dir), I.posted("page_id"), I.as_of(), I.PAGE_RULES, I.SETTINGS)
    return rows.select(_long("place"), "seq", "title", "company", "location", "url", _long("match_score"),
                       _long("freshness_rank"), I.stamp_text(F.col("posted_at")).alias("posted"), "match_reason")


def _extracted(name: str, kind: str, hint: str = ""):
    def run(spark, sf_dir):
        pages = I.document_pages(spark, sf_dir, kind, I.page_html(name), hint)
        rows = extract.extract_listings(pages, I.as_of(), {kind: extract.EXTRACTORS[kind]})
        return rows.select("seq", "source", "title", "company", "location", "url",
                           I.stamp_text(F.col("posted_at")).alias("posted"), "summary")

    run.__name__ = f"extract_{name}"
    return query(run)


_extracted("json_ld", "generic")
_extracted("cards", "generic")
_extracted("wordpress", "wordpress")
_extracted("rekrute", "rekrute")
_extracted("marocannonces", "marocannonces")
_extracted("talent", "talent", "Talent Co")
_extracted("successfactors", "successfactors")
_extracted("rss", "rss")


@query
def extract_all_kinds(spark, sf_dir):
    """All kinds in one scan, an unknown one among them; rows counted per kind."""
    kinds = ("wordpress", "rekrute", "marocannonces", "talent", "successfactors", "rss", "other")
    pages = None
    html = F.lit("")
    for i, kind in enumerate(kinds):
        html = F.when(F.col("doc_id") % 7 == i, I.page_html("cards" if kind == "other" else kind)).otherwise(html)
    pages = I.document_pages(spark, sf_dir, "x", html)
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("task_id") % 7).cast("int"))
    rows = extract.extract_listings(pages.withColumn("kind", kind), I.as_of())
    return rows.select("seq", "title", "url")


@query
def page_errors(spark, sf_dir):
    """Feeds, every third of them broken in one of two ways; the readable ones give no row."""
    whole = I.page_html("rss")
    html = F.when(F.col("doc_id") % 3 == 1, F.replace(whole, F.lit("</item>"), F.lit("</itm>"))).when(
        F.col("doc_id") % 3 == 2, F.lit("<p>moved</p>")).otherwise(whole)
    return extract.page_errors(I.document_pages(spark, sf_dir, "rss", html)).select("task_id", "source", "error")


@query
def extract_many_cards(spark, sf_dir):
    """Pages of 150 cards, one card per document."""
    docs = I.table(spark, sf_dir, "documents")
    card = F.concat(F.lit('<li data-job-id="1"><h2>Offer '), F.col("doc_id").cast("string"), F.lit('</h2><a href="/o/'),
                    F.col("doc_id").cast("string"), F.lit('">open</a></li>'))
    # at most 150 cards to a page, whatever the table holds
    pages = docs.groupBy(F.expr("doc_id div 150").alias("task_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", card.alias("card")))), lambda c: c["card"]), "").alias("html"))
    rows = extract.extract_listings(pages.select(
        "task_id", F.lit("site").alias("source"), F.lit(None).cast("string").alias("kind"), F.lit("https://site.example/").alias("page_url"),
        F.lit("Morocco").alias("default_location"), F.lit("").alias("company_hint"), "html"), I.as_of())
    return rows.select("task_id", "title", "url")


@query
def extract_late_words(spark, sf_dir):
    """Cards whose whole text stands before a date and an address at the end."""
    html = F.concat(F.lit('<article><a href="cat/annonce/'), F.col("doc_id").cast("string"), F.lit('/x.html">Offer at the end</a><p>'),
                    I.escaped(F.col("text")), F.lit("</p><b>posted "), F.col("days"), F.lit("\u00a0days ago</b></article>"))
    rows = extract.extract_listings(I.document_pages(spark, sf_dir, "marocannonces", html), I.as_of())
    return rows.select("task_id", F.sha2("summary", 256).alias("summary_sha"))


@query
def extract_loose_feeds(spark, sf_dir):
    """Feeds as they are met: blanks in front, names of HTML, bare ampersands, CDATA, links only as identifiers."""
    number = F.col("doc_id").cast("string")
    guid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<guid>https://f.example/"), number, F.lit("</guid>"))).otherwise(
        F.concat(F.lit('<guid isPermaLink="false">'), number, F.lit("</guid>")))
    html = F.concat(F.lit('\n  <?xml version="1.0"?><rss version="2.0"><channel><item><title>R&D&nbsp;caf&eacute; '), number,
                    F.lit("</title>"), guid, F.lit("<description><![CDATA[<p>a &amp; b & c</p>]]></description></item></channel></rss>"))
    rows = extract.extract_listings(I.document_pages(spark, sf_dir, "rss", html), I.as_of())
    return rows.select("task_id", "title", "url", "summary")


@query
def extract_atom(spark, sf_dir):
    """Atom feeds with one entry per document."""
    number = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry '), number,
        F.lit('</title><link rel="self" href="/self"/><link href="https://f.example/'), number, F.lit('"/><author><name>'), F.col("source"),
        F.lit("</name></author><updated>"), F.coalesce("stamp", F.lit("")), F.lit('</updated><summary type="text">'), I.escaped(F.col("lang")),
        F.lit("</summary></entry></feed>"))
    rows = extract.extract_listings(I.document_pages(spark, sf_dir, "rss", html), I.as_of())
    return rows.select("task_id", "title", "company", "url", I.stamp_text(F.col("posted_at")).alias("posted"), "summary")


@query
def feed_files(spark, sf_dir):
    """Files of 50 documents each, RSS and Atom in turn, read back entry by entry."""
    docs, path = I.documents(spark, sf_dir), new_path(spark, "feeds")
    number, body, is_rss = F.col("doc_id").cast("string"), I.escaped(F.col("text")), F.expr("doc_id div 50 % 2 = 0")
    item = F.concat(F.lit("<item><title>Item "), number, F.lit("</title><guid>https://f.example/"), number,
                    F.lit("</guid><author>"), F.col("source"), F.lit("</author><description>"), body, F.lit("</description></item>"))
    entry = F.concat(F.lit('<entry><title type="text">Entry '), number, F.lit('</title><link rel="self" href="/s"/><link href="https://f.example/'),
                     number, F.lit('"/><author><name>'), F.col("source"), F.lit("</name></author><summary>"), body, F.lit("</summary></entry>"))
    # at most 50 documents to a feed, whatever the table holds
    feeds = docs.groupBy(F.expr("doc_id div 50").alias("feed")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.when(is_rss, item).otherwise(entry).alias("x")))), lambda d: d["x"]), ""
                     ).alias("entries"))
    whole = F.when(F.col("feed") % 2 == 0, F.concat(F.lit("<rss><channel>"), "entries", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")))
    feeds.select("feed", whole.alias("value")).write.partitionBy("feed").text(path)
    return read_feed_files(spark, f"{path}/feed=*").select(
        "title", "link", "author", F.sha2(text.normalize_text(F.col("summary")), 256).alias("summary_sha"), _long("place"))


@query
def detail_dates(spark, sf_dir):
    pages = I.document_pages(spark, sf_dir, "detail", I.page_html("detail")).select("task_id", "html")
    return extract.detail_dates(pages, I.as_of()).select("task_id", I.stamp_text(F.col("found_at")).alias("found"))


@query
def infer_company(spark, sf_dir):
    """Companies named in headlines made of every customer."""
    people = I.spread(I.table(spark, sf_dir, "customer"))
    name = F.initcap(F.lower("c_mktsegment"))
    forms = [
        (F.concat(F.lit("Stage chez "), name, F.lit(" Group à Fes")), F.lit("")),
        (F.concat(name, F.lit(" "), name, F.lit(" recrute des stagiaires")), F.lit("")),
        (F.lit("stage web"), F.concat(F.lit("Un poste chez la "), name, F.lit(", Casa"))),
        (F.concat(F.lit("un stage "), name), F.lit("rien")),
    ]
    titles, notes = (F.get(F.array(*[f[i] for f in forms]), (F.col("c_custkey") % 4).cast("int")) for i in (0, 1))
    return people.select("c_custkey", extract.undouble(extract.infer_company(titles, notes)).alias("company"))


# --- requests -----------------------------------------------------------------------

@query
def request_plan_all(spark, sf_dir):
    return request_plan(I.sources(spark, sf_dir), I.QUERIES)


@query
def request_plan_chosen(spark, sf_dir):
    return request_plan(I.sources(spark, sf_dir), I.QUERIES, only_sources=["Brand#2", "Brand#17"], limit_queries=1)


@query
def lane_plan_pages(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return lane_plan(pages, 0.5, 8).select("id", "host", _long("slot"), "earliest_offset_s", _long("lanes"))


@query
def url_policy_pages(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    return url_policy(pages.select(F.col("page_id").alias("id"), "url"), I.path_rules(pages)).select("id", "host", "allowed")


@query
def page_scan_planned(spark, sf_dir):
    """Pages that carry their request's columns."""
    pages = I.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("s").alias("source"), F.lit("generic").alias("kind"), "url", F.lit("Morocco").alias("default_location"),
        F.lit("").alias("company"), (F.col("page_id") % 4 != 0).alias("ok"), "html",
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat("url", F.lit("/moved"))).alias("final_url"))
    return fetched_pages(pages, pages).select("task_id", "page_url", F.sha2("html", 256).alias("html_sha"))


@query
def page_scan(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    requests = pages.select(F.col("page_id").alias("id"), F.lit("s").alias("source"), F.lit("generic").alias("kind"), "url",
                            F.lit("Morocco").alias("default_location"), F.lit("").alias("company"))
    results = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 4 != 0).alias("ok"), "html",
                           F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat("url", F.lit("/moved"))).alias("final_url"))
    return fetched_pages(requests, results).select("task_id", "page_url", F.sha2("html", 256).alias("html_sha"))


@query
def page_scan_bucketed(spark, sf_dir):
    """Pages that lie in buckets of their number; only the plan is dealt out for the join."""
    pages, path = I.table(spark, sf_dir, "pages"), new_path(spark, "pages")
    write_bucketed(pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 4 != 0).alias("ok"), "html", F.when(
        F.col("page_id") % 3 == 0, "").otherwise(F.concat("url", F.lit("/moved"))).alias("final_url")), path, "id", 16)
    requests = pages.select(F.col("page_id").alias("id"), F.lit("s").alias("source"), F.lit("generic").alias("kind"), "url",
                            F.lit("Morocco").alias("default_location"), F.lit("").alias("company"))
    return fetched_pages(requests, read_bucketed(spark, path)).select("task_id", "page_url", F.sha2("html", 256).alias("html_sha"))


# --- counts --------------------------------------------------------------------------

@query
def source_breakdown(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    requests = docs.select(F.col("doc_id").alias("id"), "source")
    status = F.expr("CASE doc_id % 12 WHEN 0 THEN 'robots' WHEN 4 THEN '403' WHEN 8 THEN '429' ELSE '200' END")
    results = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 != 0).alias("ok"), status.alias("status"))
    rows = matching.mark_listings(I.document_listings(spark, sf_dir), I.RULES)
    return stats.source_breakdown(requests, results, rows).withColumn("notes", stats.notes_text(F.col("notes")))


@query
def funnel(spark, sf_dir):
    raw = I.document_listings(spark, sf_dir, searched=True)
    young = raw.where(matching.young_enough(I.as_of(), I.SETTINGS))
    found = matching.match_listings(young, I.RULES)
    scored = written(matching.score_listings(matching.with_keys(found), I.as_of(), I.RULES, I.SETTINGS), "scored")
    collapsed = written(dedupe.collapse_offers(dedupe.best_per_key(scored)), "collapsed")
    rows = stats.funnel(raw, scored, collapsed, dedupe.rank_top(collapsed, I.SETTINGS.max_results))
    return rows.select("step", "rows")


@query
def undated_groups(spark, sf_dir):
    found = matching.with_keys(I.document_listings(spark, sf_dir))
    return verify.undated_groups(found).select("detail_url", "rows", "first_seq")


def _date_check(spark, sf_dir, limit: int | None) -> DataFrame:
    found = matching.with_keys(I.document_listings(spark, sf_dir)).select(
        "seq", "dedupe_key", "detail_url", "posted_at")
    places = I.table(spark, sf_dir, "documents").select("lang", F.expr("n_chars div 20").alias("n")).distinct()
    html = F.when(F.col("n") % 4 == 1, "<p>nothing to see</p>").otherwise(
        F.concat(F.lit("<p>posted "), (F.col("n") % 30 + 1).cast("string"), F.lit(" days ago</p>")))
    pages = places.select(F.concat(F.lit("https://"), "lang", F.lit(".example/job/"), F.col("n").cast("string")).alias("url"),
                          (F.col("n") % 3 != 0).alias("ok"), html.alias("html"))
    seen = found.where("seq % 10 = 0").select("dedupe_key")
    pairs = verify.unseen_undated(found, seen)
    checked = verify.check_dates(verify.date_check_candidates(pairs, limit), pages, I.as_of(), limit=limit)
    return verify.apply_dates(found, pairs, written(checked, "checked")).select(
        "seq", I.stamp_text(F.col("posted_at")).alias("posted"))


@query
def date_check(spark, sf_dir):
    """Undated documents look at the page behind their address."""
    return _date_check(spark, sf_dir, None)


@query
def date_check_limited(spark, sf_dir):
    """Only the first 20 addresses are looked at, as a run with a limit does."""
    return _date_check(spark, sf_dir, 20)


# --- state, sinks, streams --------------------------------------------------------------

@query
def seen_prune(spark, sf_dir):
    keys = I.event_keys(spark, sf_dir).select("dedupe_key", F.when(F.col("user_id") % 9 == 0, "unknown").otherwise(
        F.col("first_seen")).alias("first_seen"))
    return state.prune(keys, I.as_of(), 3)


@query
def seen_merge(spark, sf_dir):
    keys = I.event_keys(spark, sf_dir)
    seen = keys.where("event_type <> 'purchase'").select("dedupe_key", "first_seen")
    return state.merge(seen, keys.where("event_type in ('purchase', 'click')"), I.as_of())


@query
def seen_json(spark, sf_dir):
    """State documents of both formats and broken ones, one per user."""
    keys = I.event_keys(spark, sf_dir)
    # one entry per event type, so a document is small whatever a user did
    docs = keys.groupBy("user_id").agg(
        F.to_json(F.struct(F.lit(2).alias("version"), F.map_from_entries(
            F.collect_list(F.struct("dedupe_key", "first_seen"))).alias("seen"))).alias("v2"),
        F.to_json(F.struct(F.collect_list("dedupe_key").alias("seen"))).alias("v1"))
    value = F.when(F.col("user_id") % 5 == 0, F.col("v1")).when(F.col("user_id") % 7 == 0, "NOT JSON").otherwise(F.col("v2"))
    return state.parse_seen(docs.select(value.alias("value")), I.as_of())


@query
def seen_json_files(spark, sf_dir):
    """State written as JSON documents and read back, beside a path where nothing is."""
    keys, path = I.event_keys(spark, sf_dir).select("dedupe_key", "first_seen"), new_path(spark, "seen-json")
    state.write_seen_json(keys, path, I.as_of())
    return state.read_seen_json(spark, path, I.as_of()).unionByName(state.read_seen_json(spark, new_path(spark, "nothing"), I.as_of()))


@query
def seen_versions(spark, sf_dir):
    """State written and read back through the versioned store."""
    store = state.SeenStore(spark, new_path(spark, "state"))
    store.write(I.event_keys(spark, sf_dir).select("dedupe_key", "first_seen"))
    store.write(state.prune(store.read(), I.as_of(), 3))
    return store.read()


@query
def seen_log(spark, sf_dir):
    """Small writes to a log, some keys twice, then forgetting; runs are merged on the way."""
    log = SeenLog(spark, new_path(spark, "state-log"), buckets=8, bucket_rows=1, fan=3)
    keys = I.event_keys(spark, sf_dir)
    for n in range(7):
        log.append(keys.where(F.col("user_id") % 7 == n).select("dedupe_key", "first_seen"))
        log.compact()
    log.append(keys.where("event_type = 'purchase'").select("dedupe_key", state.iso_text(I.as_of()).alias("first_seen")))
    log.prune(I.as_of(), 3)
    log.compact()
    return log.read()


@query
def raw_dump(spark, sf_dir):
    path = new_path(spark, "raw")
    dump_raw(I.document_listings(spark, sf_dir), path)
    rows = spark.read.schema("source string, title string, company string, location string, url string, "
                             "posted_at string, summary string").json(path)
    return rows.select("source", "title", "company", "location", "url", "posted_at", F.sha2("summary", 256).alias("summary_sha"))


def _alert_pages(spark, sf_dir) -> DataFrame:
    return I.document_pages(spark, sf_dir, "wordpress", I.page_html("wordpress"))


def _digest_out(rows: DataFrame, *more) -> DataFrame:
    return rows.select(*more, _long("place"), _long("chunk"), "title", "url", "description", _long("color"), "company", "posted",
                       "score", "skills", "source")


@query
def alert_run_batch(spark, sf_dir):
    """Pages to digest, with a state that already holds some of the keys."""
    pages = _alert_pages(spark, sf_dir)
    store = state.SeenStore(spark, new_path(spark, "state"))
    first = alert_run(pages, store.read(), I.as_of(), I.RULES, I.SETTINGS)
    finish(first, store, lambda messages: True)
    second = alert_run(pages, store.read(), I.as_of(), I.RULES, I.SETTINGS)
    return _digest_out(second.digest)


@query
def run_funnel(spark, sf_dir):
    """Rows after each step of a run, counted as they passed."""
    done = alert_run(_alert_pages(spark, sf_dir), state.empty_seen(spark), I.as_of(), I.RULES, I.SETTINGS)
    return done.funnel().select("step", "rows")


@query
def incremental_alerts(spark, sf_dir):
    """Every page in three micro-batches, on a store that a batch run has filled before.

    The first batch repeats the pages of the run, so it alerts what comes after its top; the
    others carry on from there.
    """
    out, log = new_path(spark, "alerts"), new_path(spark, "alerts-log")
    pages, path = _alert_pages(spark, sf_dir), new_path(spark, "pages")
    store = SeenLog(spark, new_path(spark, "state-log"))
    finish(alert_run(pages, store.read(), I.as_of(), I.RULES, I.SETTINGS), store, lambda messages: True)
    for _ in range(3):
        pages.write.mode("append").parquet(path)
        incremental.incremental_alerts(
            incremental.page_stream(spark, path), store, out, lambda _: I.as_of(), log, I.RULES, I.SETTINGS).awaitTermination()
    return _digest_out(spark.read.parquet(out), _long("batch"))


@query
def ttl_dedupe(spark, sf_dir):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keys = incremental.first_alert_per_key(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")
    return incremental.drain(keys, "ttl").select("user_id", "event_type")


@query
def ttl_dedupe_again(spark, sf_dir):
    """Users and types alerted again once they are forgotten: arrivals of six days at a time, kept for five."""
    path, out, log = new_path(spark, "arrivals"), new_path(spark, "ttl-again"), new_path(spark, "ttl-again-log")
    period = F.least(F.lit(4), F.expr("(dayofmonth(ts) - 1) div 6")).cast("int")
    events = I.table(spark, sf_dir, "events").select("user_id", "event_type", period.alias("period")).withColumn(
        "ts", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(6 * period)"))
    schema = events.schema
    for n in range(5):
        events.where(F.col("period") == n).write.mode("append").parquet(path)
        arrivals = spark.readStream.schema(schema).parquet(path)
        incremental.first_alert_per_key(arrivals, ["user_id", "event_type"], "ts", "5 days").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).select("user_id", "event_type", _long("period"))
