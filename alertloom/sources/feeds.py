"""Feeds: RSS and Atom documents to entries, through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertloom.functions.text import decode_entities, let

ENTRY = "struct<title:string,link:string,author:string,published:string,updated:string,summary:string>"

_TEXT = "struct<_VALUE:string,_type:string>"
_ITEM = (
    "struct<title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,author:string,creator:string,"
    "pubDate:string,date:string,description:string,encoded:string>"
)
_ATOM = (
    f"struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,author:struct<name:string>,"
    f"published:string,issued:string,updated:string,summary:{_TEXT},content:{_TEXT}>"
)
FEED_SCHEMA = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ATOM}>, broken string"
CDATA_START, CDATA_END = "<![CDATA[", "]]>"


def _entry(**fields: Column) -> Column:
    names = ("title", "link", "author", "published", "updated", "summary")
    return F.struct(*[F.coalesce(fields[n], F.lit("")).alias(n) for n in names])


def _first(*cols: Column) -> Column:
    """First text that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def _permanent(guid: Column) -> Column:
    """The identifier of an item where it is an address."""
    return F.when(F.lower(F.coalesce(guid["_isPermaLink"], F.lit("true"))) != "false", guid["_VALUE"])


def _well_formed(part: Column) -> Column:
    """Text outside CDATA with names that XML lacks decoded and bare ampersands escaped."""
    tokens = F.regexp_extract_all(
        part, F.lit(r"(&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&)"), F.lit(1))

    def mended(token: Column) -> Column:
        decoded = let(decode_entities(token), lambda d: F.when(F.startswith(d, F.lit("&")), F.concat(F.lit("&amp;"), F.substring(d, 2, 1000))).otherwise(d))
        return (
            F.when(token == "&", "&amp;")
            .when(token.rlike("^&(#|(amp|lt|gt|quot|apos);$)"), token)
            .when(F.startswith(token, F.lit("&")), decoded)
            .otherwise(token)
        )

    return F.when(F.contains(part, F.lit("&")), F.array_join(F.transform(tokens, mended), "")).otherwise(part)


def mended_feed(body: Column) -> Column:
    """A feed document without what XML forbids but feeds hold: blanks in front, names of HTML, bare ampersands."""
    parts = F.split(F.regexp_replace(body, r"^[\s\uFEFF]+", ""), r"<!\[CDATA\[")

    def after_cdata(part: Column) -> Column:
        end = F.locate(CDATA_END, part)
        return F.when(end == 0, part).otherwise(
            F.concat(F.left(part, end + 2), _well_formed(F.substring(part, end + 3, F.length(part)))))

    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, _well_formed(p)).otherwise(after_cdata(p))), CDATA_START)


def parsed_feed(body: Column) -> Column:
    """A feed document as one struct; ``broken`` holds a document that cannot be read."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return F.when(body.isNotNull(), F.from_xml(mended_feed(body), FEED_SCHEMA, options))


def feed_error(body: Column, parsed: Column) -> Column:
    """Why a feed document has no entries; null if it has, or may have none."""
    unknown = parsed["channel"].isNull() & parsed["item"].isNull() & parsed["entry"].isNull()
    return F.when(body.isNotNull() & parsed["broken"].isNotNull(), "not well-formed XML").when(
        body.isNotNull() & F.coalesce(unknown, F.lit(True)) & ~F.coalesce(body.rlike("(?i)<(rss|rdf|feed|channel)"), F.lit(False)), "not a feed")


def _rss_entry(i: Column) -> Column:
    return _entry(
        title=_first(i["title"]), link=_first(i["link"], _permanent(i["guid"])), author=_first(i["author"], i["creator"]),
        published=_first(i["pubDate"]), updated=_first(i["date"]), summary=_first(i["description"], i["encoded"]),
    )


def _atom_entry(e: Column) -> Column:
    links = F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return _entry(
        title=_first(e["title"]["_VALUE"]), link=_first(F.get(links, F.lit(0))["_href"]), author=_first(e["author"]["name"]),
        published=_first(e["published"], e["issued"]), updated=_first(e["updated"]),
        summary=_first(e["summary"]["_VALUE"], e["content"]["_VALUE"]),
    )


def feed_entries(parsed: Column) -> Column:
    """Entries of a parsed feed, in order; an unreadable document has none."""
    items = F.coalesce(parsed["channel"]["item"], parsed["item"])
    nothing = F.array().cast(f"array<{ENTRY}>")
    return F.coalesce(F.transform(items, _rss_entry), F.transform(parsed["entry"], _atom_entry), nothing)


def read_feed_files(spark, path: str) -> DataFrame:
    """Items and Atom entries of feed files, with their place: file, block of the file, place in the block.

    Large files are split by item, so a file of any size is read by many tasks.  Sorting by the
    place gives the order of the files and of the entries in them.  An element that cannot be
    read is left out; for whole documents with their errors see ``parsed_feed``.
    """
    def elements(tag: str, kind: str) -> DataFrame:
        rows = (
            spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("mode", "DROPMALFORMED")
            .schema(StructType.fromDDL(f"e {kind}")["e"].dataType).load(path)
        )
        fields = [F.col(name) for name in rows.columns]
        return rows.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"), F.struct(*fields).alias("e"))

    def read(tag: str, kind: str, entry) -> DataFrame:
        # a block is bounded by the split size, and so is the window
        place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))
        return elements(tag, kind).select("file", "block", place.alias("place"), entry(F.col("e")).alias("entry"))

    both = read("item", _ITEM, _rss_entry).unionByName(read("entry", _ATOM, _atom_entry))
    return both.select("entry.*", "file", "block", "place")
