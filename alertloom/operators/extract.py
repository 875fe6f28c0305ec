"""Pages to listing rows.

One scan and one tree-building step serve every page kind.  Per kind there is an
expression from a page to an array of draft rows; Spark picks it by ``kind``, explodes
the drafts once and then resolves links and dates.  Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import dom as D
from alertloom.functions.dates import date_places, first_date, parse_date
from alertloom.functions.text import SPACE_CLASS, collapse, let, strip, strip_html, url_join
from alertloom.sources.dom import with_dom
from alertloom.sources.feeds import feed_entries, feed_error, parsed_feed

# --- Fixed values: draft fields, selectors and patterns ----------------
DRAFT = "struct<title:string,company:string,location:string,href:string,date_text:string,infer_text:string,summary:string>"
UNKNOWN_COMPANY = "Unknown Company"
MIN_TITLE = 6
MIN_CARD_TITLE = 4
CARD_CLASSES = ("job_seen_beacon", "jobsearch-SerpJobCard", "job-card", "job", "offer", "annonce")
_S = f"[{SPACE_CLASS}]"
_NAME = r"[\p{L}\p{N}_&'’\-]*"
CHEZ = (
    rf"(?<![\p{{L}}\p{{N}}_])chez{_S}+(?:la|le|les|l’|l')?{_S}*"
    rf"([A-ZÀ-Þ]{_NAME}(?:{_S}+[A-ZÀ-Þ]{_NAME}){{0,3}})"
)
HEADLINE = (
    rf"^([A-ZÀ-Þ0-9]{_NAME}(?:{_S}+[A-ZÀ-Þ0-9]{_NAME}){{0,3}}){_S}+"
    r"(?:recrute|lance|ouvre|propose|recherche|publie)"
)
SLUG = r"recrutement-(.+?)-\d+\.html?$"
LEVEL_TAIL = rf"{_S}*Niveau d[’'][\s\S]*$"
# --- end of fixed values ------------------------------------------------------

LISTING_COLUMNS = ("source", "title", "company", "location", "url", "posted_at", "summary", "seq")


@dataclass(frozen=True)
class Page:
    """The columns an extractor may use."""

    els: Column
    texts: Column
    postings: Column
    entries: Column
    source: Column
    default_location: Column
    company: Column

    @classmethod
    def columns(cls) -> "Page":
        names = ("els", "texts", "postings", "entries", "source", "default_location", "company_hint")
        return cls(*[F.col(n) for n in names])


def draft(title, company, location, href, summary, date_text=None, infer_text=None) -> Column:
    nothing = F.lit("")
    values = (title, company, location, href,
              nothing if date_text is None else date_text,
              nothing if infer_text is None else infer_text, summary)
    names = ("title", "company", "location", "href", "date_text", "infer_text", "summary")
    return F.struct(*[F.coalesce(v, nothing).alias(n) for v, n in zip(values, names)])


def _or(value: Column, other) -> Column:
    return F.when(value == "", other).otherwise(value)


def _keep(drafts: Column) -> Column:
    return F.filter(drafts, lambda d: d.isNotNull())


# --- JSON-LD ------------------------------------------------------------------

def _json_text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _json_kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def json_ld(page: Page) -> Column:
    """Every job posting in the page's JSON-LD scripts."""

    def place(v: Column, path: str) -> Column:
        parts = [strip(_json_text(v, f"{path}.{key}"))
                 for key in ("addressLocality", "addressRegion", "addressCountry")]
        return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])

    def address(v: Column, path: str) -> Column:
        kind = _json_kind(v, f"{path}.address")
        return F.when(F.startswith(kind, F.lit("OBJECT")), place(v, f"{path}.address")).when(
            kind == "STRING", strip(_json_text(v, f"{path}.address"))
        ).otherwise("")

    def row(v: Column) -> Column:
        employer = F.when(
            F.startswith(_json_kind(v, "$.hiringOrganization"), F.lit("OBJECT")),
            _json_text(v, "$.hiringOrganization.name"),
        ).otherwise(_json_text(v, "$.hiringOrganization"))
        many = F.startswith(_json_kind(v, "$.jobLocation"), F.lit("ARRAY"))
        spot = F.when(many, address(v, "$.jobLocation[0]")).otherwise(address(v, "$.jobLocation"))
        remote = F.lower(_json_text(v, "$.jobLocationType")) == "telecommute"
        located = let(spot, lambda s: F.when(s != "", s).when(remote, "Remote").otherwise(page.default_location))
        return draft(
            title=strip(_json_text(v, "$.title")),
            company=strip(employer),
            location=located,
            href=_json_text(v, "$.url"),
            date_text=_json_text(v, "$.datePosted"),
            summary=strip_html(_json_text(v, "$.description")),
        )

    return F.transform(page.postings, lambda p: let(F.try_parse_json(p), row))


# --- card heuristics ----------------------------------------------------------

def _cards(page: Page, test: D.Test, row: Callable[[Column, Column, Column], Column]) -> Column:
    """``row(card, inner, text)`` for all elements that pass ``test``."""
    return F.transform(
        F.filter(page.els, test),
        lambda c: let(
            F.struct(D.inside(page.els, c).alias("inner"), D.text_of(page.texts, c).alias("text")),
            lambda v: row(c, v.inner, v.text),
        ),
    )


def generic_cards(page: Page) -> Column:
    """Elements that look like a job card."""
    both = lambda name: [D.holds("class", name), D.holds("data-testid", name)]
    titles = [D.tag("h1"), D.tag("h2"), D.tag("h3"), *both("title"), D.link()]
    companies = [*both("company"), D.css_class("brand"), D.css_class("recruiter")]
    places = [*both("location"), D.css_class("city"), D.css_class("region")]
    dates = [D.tag("time"), lambda e: D.has(e, "datetime"), D.holds("class", "date"),
             D.holds("class", "time"), D.holds("class", "posted")]

    def is_card(around: Column) -> D.Test:
        def in_list(number: int, item_class: str) -> D.Test:
            return lambda e: D.css_class(item_class)(e) & D.is_under(e, F.get(around, F.lit(number)))

        return D.any_of(
            lambda e: D.has(e, "data-job-id"),
            D.holds("data-testid", "job"),
            *[D.css_class(name) for name in CARD_CLASSES],
            lambda e: (e.tag == "div") & (D.holds("class", "job-card")(e) | D.holds("class", "offer-card")(e)),
            in_list(0, "item"),
            in_list(1, "job-item"),
        )

    def row(card: Column, inner: Column, text: Column) -> Column:
        anchor = D.first(inner, D.link())
        full = draft(
            title=D.pick(page.texts, inner, titles),
            company=_or(D.pick(page.texts, inner, companies), UNKNOWN_COMPANY),
            location=_or(D.pick(page.texts, inner, places), page.default_location),
            href=D.attr(anchor, "href"),
            date_text=D.pick(page.texts, inner, dates),
            infer_text=text,
            summary=text,
        )
        kept = let(full, lambda d: F.when(F.length(d.title) >= MIN_CARD_TITLE, d))
        return F.when(F.exists(inner, D.link()), kept)

    lists = F.array(*[D.enclosing(page.els, D.css_class(name)) for name in ("list-jobs", "jobs-list")])
    return let(lists, lambda around: _keep(_cards(page, is_card(around), row)))


def generic(page: Page) -> Column:
    """JSON-LD rows followed by card rows; the source's company fills unknown ones."""

    def fill(d: Column) -> Column:
        vague = d.company.isin("", UNKNOWN_COMPANY) & (page.company != "")
        return d.withField("company", F.when(vague, page.company).otherwise(d.company))

    return F.transform(F.concat(json_ld(page), generic_cards(page)), fill)


# --- page kinds with a known shape --------------------------------------------

def infer_company(title: Column, summary: Column) -> Column:
    """Company named in the words around an offer, '' when none is."""
    words = F.concat(title, F.lit(" "), summary)

    return let(
        strip(F.regexp_extract(words, CHEZ, 1)),
        lambda n: F.when(n != "", n).otherwise(strip(F.regexp_extract(title, HEADLINE, 1))),
    )


def undouble(name: Column) -> Column:
    """``A B A B`` said once."""
    half = F.floor(F.length(name) / 2).cast("int")
    left, right = strip(F.left(name, half)), strip(F.substring(name, half + 1, F.length(name)))
    return F.when((half > 0) & (left == right), left).otherwise(name)


def wordpress(page: Page) -> Column:
    """Articles with a linked heading."""
    heading = D.any_of(D.tag("h1", "h2", "h3"), D.css_class("entry-title"))
    excerpt = D.any_of(D.css_class("entry-summary"), D.css_class("jeg_post_excerpt"), D.tag("p"))

    def row(around: Column) -> Callable:
        def build(card: Column, inner: Column, text: Column) -> Column:
            def read(v: Column) -> Column:
                title, summary = D.text_of(page.texts, v.link), D.text_of(page.texts, v.excerpt)
                stamp = F.coalesce(
                    F.nullif(D.attr(v.time, "datetime"), F.lit("")), D.text_of(page.texts, v.time)
                )
                company = let(
                    F.struct(title.alias("t"), F.coalesce(summary, F.lit("")).alias("s")),
                    lambda w: F.when(page.company != "", page.company).otherwise(infer_company(w.t, w.s)),
                )
                return F.when(
                    F.length(title) >= MIN_TITLE,
                    draft(
                        title=title,
                        company=_or(let(company, undouble), UNKNOWN_COMPANY),
                        location=page.default_location,
                        href=D.attr(v.link, "href"),
                        date_text=stamp,
                        infer_text=text,
                        summary=F.coalesce(summary, F.lit("")),
                    ),
                )

            return let(
                F.struct(
                    D.first(inner, lambda e: D.link()(e) & D.is_under(e, around)).alias("link"),
                    D.first(inner, excerpt).alias("excerpt"),
                    D.first(inner, D.tag("time")).alias("time"),
                ),
                read,
            )

        return build

    return let(
        D.enclosing(page.els, heading),
        lambda around: _keep(_cards(page, D.tag("article"), row(around))),
    )


def _anchors(page: Page, part: str) -> Column:
    """All links whose address holds ``part``, with their text."""
    return F.transform(
        F.filter(page.els, D.link(part)),
        lambda e: F.struct(
            D.attr(e, "href").alias("href"), D.text_of(page.texts, e).alias("text"), e.pos.alias("pos")
        ),
    )


def pipe_titles(page: Page, part: str = "/offre-emploi-") -> Column:
    """Links titled ``Title | City (Country)``; the company comes from the address."""

    def row(a: Column) -> Column:
        cut = F.locate("|", a.text)
        title = F.when(cut > 0, F.left(a.text, cut - 1)).otherwise(a.text)
        tail = F.when(cut > 0, F.substring(a.text, cut + 1, F.length(a.text))).otherwise("")
        place = strip(F.replace(F.replace(tail, F.lit("(Maroc)"), F.lit("")), F.lit("(Morocco)"), F.lit("")))
        bare = F.rtrim(F.split_part(a.href, F.lit("?"), F.lit(1)), F.lit("/"))
        slug = F.regexp_extract(bare, SLUG, 1)
        company = let(
            F.split(slug, "-"),
            lambda s: strip(F.array_join(F.slice(s, 1, F.size(s) - 1), " ")),
        )
        return draft(
            title=_or(strip(title), a.text),
            company=_or(company, UNKNOWN_COMPANY),
            location=_or(place, page.default_location),
            href=a.href,
            summary=a.text,
        )

    unique = let(_anchors(page, part), lambda rows: D.first_per(rows, lambda a: a.href))
    return F.transform(F.filter(unique, lambda a: F.length(a.text) >= MIN_TITLE), row)


def rekrute(page: Page) -> Column:
    return pipe_titles(page)


def marocannonces(page: Page) -> Column:
    """Articles with a link to an announcement."""

    def row(card: Column, inner: Column, text: Column) -> Column:
        def read(title: Column) -> Column:
            short = strip(F.regexp_replace(title, LEVEL_TAIL, ""))
            return F.when(
                F.length(title) >= MIN_TITLE,
                draft(
                    title=_or(short, title),
                    company=F.lit(UNKNOWN_COMPANY),
                    location=page.default_location,
                    href=D.attr(D.first(inner, D.link("/annonce/")), "href"),
                    infer_text=text,
                    summary=text,
                ),
            )

        return let(D.text_of(page.texts, D.first(inner, D.link("/annonce/"))), read)

    return _keep(_cards(page, D.tag("article"), row))


def talent(page: Page) -> Column:
    """Cards marked as job cards, one per link."""

    def is_card(e: Column) -> Column:
        marked = (D.attr(e, "data-testid") == "job-card-unified") | D.holds("class", "JobCard_card")(e)
        return (e.tag == "article") & marked

    title_node = D.any_of(D.tag("h2", "h3"), D.holds("class", "JobCard_title"))

    def row(card: Column, inner: Column, text: Column) -> Column:
        title = collapse(D.text_of(page.texts, D.first(inner, title_node)))
        return F.when(
            F.exists(inner, D.link()) & (F.length(title) >= MIN_TITLE),
            draft(
                title=title,
                company=_or(page.company, UNKNOWN_COMPANY),
                location=page.default_location,
                href=D.attr(D.first(inner, D.link()), "href"),
                infer_text=text,
                summary=text,
            ),
        )

    rows = _keep(_cards(page, is_card, row))
    return let(rows, lambda r: D.first_per(r, lambda d: d.href))


def boxed_anchors(page: Page, part: str = "JobDetail") -> Column:
    """Links to a detail page; the box around a link tells the rest."""

    def row(around: Column) -> Callable:
        def build(a: Column) -> Column:
            text = F.coalesce(let(D.nearest(page.els, a, around), lambda b: D.text_of(page.texts, b)), F.lit(""))
            return let(
                text,
                lambda t: draft(
                    title=a.text,
                    company=_or(page.company, UNKNOWN_COMPANY),
                    location=page.default_location,
                    href=a.href,
                    infer_text=t,
                    summary=t,
                ),
            )

        return build

    long_enough = F.filter(_anchors(page, part), lambda a: F.length(a.text) >= MIN_TITLE)
    unique = let(long_enough, lambda rows: D.first_per(rows, lambda a: a.href))
    boxes = D.enclosing(page.els, D.tag("li", "div", "tr", "article"))
    return let(boxes, lambda around: F.transform(unique, row(around)))


def successfactors(page: Page) -> Column:
    return boxed_anchors(page)


def rss(page: Page) -> Column:
    """Feed entries."""

    def row(e: Column) -> Column:
        return draft(
            title=e.title,
            company=_or(F.coalesce(e.author, F.lit("")), page.source),
            location=page.default_location,
            href=e.link,
            date_text=F.coalesce(F.nullif(e.published, F.lit("")), e.updated),
            summary=strip_html(e.summary),
        )

    return F.transform(F.filter(page.entries, lambda e: F.length(e.title) >= MIN_CARD_TITLE), row)


EXTRACTORS: dict[str, Callable[[Page], Column]] = {
    "generic": generic,
    "wordpress": wordpress,
    "rekrute": rekrute,
    "marocannonces": marocannonces,
    "talent": talent,
    "successfactors": successfactors,
    "rss": rss,
}


# --- the job ------------------------------------------------------------------

def page_trees(pages: DataFrame) -> DataFrame:
    """Pages with their element tree and, for feeds, their entries.

    A page without a kind is ``generic``.  ``error`` says why a page or feed could not be read.
    """
    known = pages.withColumn("kind", F.coalesce("kind", F.lit("generic")))
    is_feed = F.col("kind") == "rss"
    tagged = known.withColumn("feed", F.when(is_feed, F.col("html"))).withColumn(
        "html", F.when(~is_feed, F.col("html"))
    )
    trees = with_dom(tagged).withColumn("parsed", parsed_feed(F.col("feed")))
    return trees.withColumn("error", F.coalesce("error", feed_error(F.col("feed"), F.col("parsed")))).withColumn(
        "entries", feed_entries(F.col("parsed"))).drop("feed", "parsed")


@lru_cache(maxsize=32)
def _drafts_of(_context_id: str, extractors: tuple) -> Column:
    page = Page.columns()
    nothing = F.array().cast(f"array<{DRAFT}>")
    known = dict(extractors)
    rest = known.pop("generic")(page) if "generic" in known else nothing
    out = None
    for kind, extractor in known.items():
        test, rows = F.col("kind") == kind, extractor(page).cast(f"array<{DRAFT}>")
        out = F.when(test, rows) if out is None else out.when(test, rows)
    rest = rest.cast(f"array<{DRAFT}>")
    return rest if out is None else out.otherwise(rest)


def drafts_of(spark: SparkSession, extractors: dict[str, Callable[[Page], Column]]) -> Column:
    """Draft rows of a page, by its kind; a kind nobody knows is read as ``generic``.

    The expression is large but names columns only, so it is built once per session.
    """
    return _drafts_of(spark.sparkContext.applicationId, tuple(extractors.items()))


def extract_listings(
    pages: DataFrame,
    as_of: Column,
    extractors: dict[str, Callable[[Page], Column]] | None = None,
    day_first: bool = False,
) -> DataFrame:
    """Listing rows of all pages.

    ``pages`` has ``task_id, source, kind, page_url, default_location, company_hint,
    html``.  ``seq`` orders rows by task, then by place in the document, whatever the
    partitioning: it is the arrival order that settles ties later on.
    """
    trees = page_trees(pages).where(F.col("error").isNull())
    rows = trees.select(
        "task_id", "source", "kind", "page_url", F.posexplode(drafts_of(pages.sparkSession, extractors or EXTRACTORS)).alias("pos", "d")
    )
    # the running text is only looked through where no date is stated
    posted = F.coalesce(parse_date(F.col("d.date_text"), as_of, day_first), first_date(date_places(F.col("d.infer_text")), as_of, day_first))
    # an entry of a feed without an address is not found at the feed's own
    unaddressed = (F.col("kind") == "rss") & (F.col("d.href") == "")
    return rows.select(
        F.col("task_id"),
        F.col("source"),
        F.col("d.title").alias("title"),
        F.col("d.company").alias("company"),
        F.col("d.location").alias("location"),
        F.when(unaddressed, "").otherwise(url_join(F.col("page_url"), F.col("d.href"))).alias("url"),
        posted.alias("posted_at"),
        F.col("d.summary").alias("summary"),
        (F.shiftleft(F.col("task_id").cast("long"), 31) + F.col("pos")).alias("seq"),
    )


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages and feeds that could not be read, with the reason."""
    return page_trees(pages).where(F.col("error").isNotNull()).select("task_id", "source", "page_url", "error")


def detail_dates(pages: DataFrame, as_of: Column, day_first: bool = False) -> DataFrame:
    """Publication date of detail pages: JSON-LD first, then the visible text.

    ``pages`` has ``html`` and key columns, which are kept.
    """
    keys = [c for c in pages.columns if c != "html"]
    stated = F.transform(
        F.col("postings"),
        lambda p: F.coalesce(F.try_variant_get(F.try_parse_json(p), "$.datePosted", "string"), F.lit("")),
    )
    text = F.array_join(F.col("texts"), " ")
    found = first_date(F.concat(stated, date_places(text)), as_of, day_first)
    return with_dom(pages).select(*keys, found.alias("found_at"))
