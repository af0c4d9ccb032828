"""Listings from feeds, JSON payloads, crawl results and model replies.

Each reader takes a table with one text column per fetched payload, so parsing
is spread over the payloads. A payload that does not parse yields no listing and
can be counted with ``unreadable``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingflow import vocabulary as V
from listingflow.functions import classify, ids, money, replies
from listingflow.functions import text as tx
from listingflow.session import stored

_FEED_ITEM = "title string, description string, link string"
_BROKEN = "_corrupt_record"
#: An item: text, CDATA, and tags other than its end.
_ITEM = r"(?s)<item(?:\s[^>]*)?>(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/item\s*>))*+</item\s*>"


#: Lengths that texts are cut to, by column; an empty mapping cuts none.
Lengths = Mapping[str, int]


def read_feed(payloads: DataFrame, *keep: str, text: str = "xml", lengths: Lengths = V.CLIP_LENGTHS) -> DataFrame:
    """RSS items as listings, at any depth of the feed; a feed that is not XML has none. Texts are cut to ``lengths``.

    Items are cut out as text first, since a schema would name every level above them. An end tag in CDATA is text.
    """
    sound = F.from_xml(text, f"{_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(plain, F.lit(_ITEM), F.lit(0))
    items = (payloads.filter(sound.isNotNull() & sound[_BROKEN].isNull())
             .select(*keep, F.posexplode(found).alias("pos", "item"))
             .select(*keep, "pos", F.from_xml("item", _FEED_ITEM).alias("item")))
    return _feed_listings(items, [*keep, "pos"], lengths)


def read_feed_files(spark: SparkSession, path: str, lengths: Lengths = V.CLIP_LENGTHS) -> DataFrame:
    """RSS items of feed files as listings, read by the XML source, which takes items at any depth.

    A file is read as a stream of items, so a feed may be larger than a task's memory, and text in CDATA is text.
    An item that is not XML is not a listing; ``broken_feed_items`` gives those.
    """
    items = _feed_items(spark, path).where(f"{_BROKEN} is null")
    return _feed_listings(items.select(F.struct("title", "description", "link").alias("item")), [], lengths)


def broken_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of the items in feed files that are not XML."""
    # Spark reads broken records alone only from rows that are stored.
    return stored(_feed_items(spark, path), "feed-items").where(f"{_BROKEN} is not null").select(F.col(_BROKEN).alias("text"))


def _feed_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").option("columnNameOfCorruptRecord", _BROKEN) \
        .schema(f"{_FEED_ITEM}, {_BROKEN} string").load(path)


def _feed_listings(items: DataFrame, keep: list[str], lengths: Lengths) -> DataFrame:
    name = F.coalesce("item.title", F.lit(V.UNKNOWN_TITLE))
    about = F.col("item.description")
    org = replies.organization_from_text(F.coalesce(F.nullif(about, F.lit("")), name))
    return items.select(
        *keep, name.alias("title"), about.alias("about"), org.alias("organization"),
        F.col("item.link").alias("url"),
    ).select(
        *keep, ids.content_id(F.col("title"), F.col("organization"), length=16, lower=True)
        .alias("listing_id"),
        tx.clip(F.col("title"), lengths.get("name")).alias("name"),
        tx.clip(F.nullif("about", F.lit("")), lengths.get("description")).alias("description"),
        "organization", "url")


def api_items(payloads: DataFrame, *keep: str, text: str = "json") -> DataFrame:
    """One variant per item of a list, {scholarships}, {results} or single object.

    A key that is there decides, even if it holds no list: then there is no item.
    """
    v = F.col("payload")
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    whole = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    items = F.when(replies.variant_array(v).isNotNull(), replies.variant_array(v)) \
        .when(has("scholarships"), replies.variant_array(v, "$.scholarships")) \
        .when(has("results"), replies.variant_array(v, "$.results")).otherwise(whole)
    return (payloads.select(*keep, replies.parse_json(F.col(text)).alias("payload"))
            .select(*keep, F.posexplode(items).alias("pos", "item")))


def read_api(payloads: DataFrame, *keep: str, text: str = "json", lengths: Lengths = V.CLIP_LENGTHS) -> DataFrame:
    """API items as listings; an amount is a number or {min, max}, both read from the first alias set.

    Texts are cut to ``lengths``.
    """
    v = F.col("item")
    fields = {c: replies.first_value(v, names) for c, names in V.API_ALIASES.items()
              if c != "amount"}
    limits = {}
    for end in ("min", "max"):
        chosen = F.lit(None).cast("double")
        for alias in reversed(V.API_ALIASES["amount"]):
            plain = replies.first_value(v, [alias])
            kind = F.schema_of_variant(F.try_variant_get(v, f"$.{alias}", "variant"))
            is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
            value = F.when(is_object, F.try_variant_get(v, f"$.{alias}.{end}", "double")) \
                .otherwise(plain.try_cast("double"))
            is_set = F.when(is_object, kind != "OBJECT<>").otherwise(plain.isNotNull())
            chosen = F.when(is_set, value).otherwise(chosen)
        limits[end] = chosen
    return api_items(payloads, *keep, text=text).select(
        *keep, "pos", F.coalesce(fields["name"], F.lit(V.UNKNOWN_TITLE)).alias("title"),
        fields["description"].alias("about"), fields["url"].alias("url"),
        fields["organization"].alias("organization"),
        limits["min"].alias("min_award"), limits["max"].alias("max_award"),
    ).select(
        *keep, "pos", ids.short_id(F.col("title"), F.col("organization")).alias("listing_id"),
        tx.clip(F.col("title"), lengths.get("name")).alias("name"),
        tx.clip(F.col("about"), lengths.get("description")).alias("description"),
        "organization", "url", "min_award", "max_award")


def read_replies(payloads: DataFrame, *keep: str, text: str = "reply", max_chars: int | None = V.MAX_TEXT_LENGTH) -> DataFrame:
    """Listings in replies that hold a JSON array. Other replies give none. Prose is cut to ``max_chars`` (None: not)."""
    listed = replies.reply_json(F.col(text), as_type="array<variant>")
    items = payloads.select(*keep, F.posexplode(listed).alias("pos", "item"))
    v, texts = F.col("item"), F.col("texts")
    known = [*(n for names in V.REPLY_ALIASES.values() for n in names), "title", "description", *V.REPLY_LEVEL_FIELDS]

    def value(names, default=""):
        return replies.first_value(v, names, default, texts)

    # Columns that several others read are computed in a step of their own, so that no expression is repeated.
    raw = items.withColumn("texts", replies.field_texts(v, known)).select(*keep, "pos", *[
        value(names, V.REPLY_FALLBACKS.get(c, "")).alias(f"r_{c}") for c, names in V.REPLY_ALIASES.items()
    ], *[value([c]).alias(f"t_{c}") for c in ("title", "description")],
        F.concat_ws(" ", *[value([c]) for c in V.REPLY_LEVEL_FIELDS]).alias("t_levels"))

    def clean(c):
        t = F.col(f"r_{c}")     # never null
        quoted = t.contains("'") | t.contains('"')
        return F.when(quoted, tx.clean_text(t, quotes=True)).otherwise(tx.trim(t))

    audience = F.concat_ws(" ", "t_title", "t_description", "r_eligibility")
    prepared = raw.withColumns({
        "audience": F.lower(audience), "audience_levels": F.lower(F.concat_ws(" ", audience, "t_levels")),
        "needs": clean("eligibility"), "about": clean("description"), "flag": clean("renewable"),
    })
    for step in tx.strip_steps():
        prepared = prepared.withColumns({c: step(F.col(c)) for c in ("needs", "about")})
    prepared = prepared.withColumns({
        "levels": classify.academic_levels(F.col("audience_levels"), lowered=True),
        "needs": tx.truncate(F.col("needs"), max_chars), "about": tx.truncate(F.col("about"), max_chars)})
    with_level = F.concat(
        "needs", F.when(F.col("needs") != "", " | ").otherwise(""), "levels")
    return prepared.select(
        *keep, "pos", clean("name").alias("name"), clean("deadline").alias("deadline"),
        F.col("r_url").alias("url"), F.col("about").alias("description"),
        F.when(F.col("levels") != "", with_level).otherwise(F.col("needs")).alias("eligibility"),
        clean("organization").alias("organization"),
        tx.clean_level(F.col("levels")).alias("academic_level"),
        clean("geographic_restrictions").alias("geographic_restrictions"),
        classify.target_type(F.col("audience"), lowered=True).alias("target_type"),
        tx.non_empty(classify.ethnicities(F.col("audience"), lowered=True)).alias("ethnicity"),
        tx.non_empty(classify.gender(F.col("audience"), lowered=True)).alias("gender"),
        money.award(F.col("r_min_amount")).alias("min_award"),
        money.award(F.col("r_max_amount")).alias("max_award"),
        classify.is_renewable(F.col("flag"), "reply").alias("renewable"),
        tx.non_empty(clean("country"), "US").alias("country"),
        clean("apply_url").alias("apply_url"))


def unreadable(payloads: DataFrame, *keep: str, text: str = "reply") -> DataFrame:
    """Replies without JSON that parses, with the text as it came."""
    return payloads.filter(replies.reply_json(F.col(text)).isNull()).select(*keep, text)


def read_crawl_replies(payloads: DataFrame, *keep: str, text: str = "reply",
                       url: str = "url", max_chars: int | None = V.MAX_TEXT_LENGTH) -> DataFrame:
    """One listing per reply that holds a JSON object about the page at ``url``. Prose is cut to ``max_chars`` (None: not)."""
    v = F.col("payload")
    found = (payloads.select(*keep, url, replies.reply_json(F.col(text), objects_only=True)
                             .alias("payload")).filter(v.isNotNull()))

    def value(*names, default=""):
        return replies.first_value(v, names, default)

    def clean(*names):
        return tx.clean_text(value(*names), quotes=True)

    return found.select(
        *keep, clean("title").alias("name"), clean("deadline").alias("deadline"),
        F.col(url).alias("url"), tx.truncate(clean("description"), max_chars).alias("description"),
        tx.truncate(clean("eligibility"), max_chars).alias("eligibility"),
        clean("organization").alias("organization"),
        F.coalesce(tx.clean_level(value("academic_level", "academicLevel")), F.lit(""))
        .alias("academic_level"),
        clean("geographic_restrictions", "geographicRestrictions")
        .alias("geographic_restrictions"),
        F.lower(value("target_type", "targetType", default="both")).alias("target_type"),
        tx.non_empty(value("ethnicity")).alias("ethnicity"),
        tx.non_empty(value("gender")).alias("gender"),
        money.award(value("min_award", "minAward", default="0")).alias("min_award"),
        money.award(value("max_award", "maxAward", default="0")).alias("max_award"),
        (value("renewable") != "").alias("renewable"),
        value("country", default="US").alias("country"))


def crawl_items(crawls: DataFrame, *keep: str, results: str = "results") -> DataFrame:
    """One row per crawled page of a crawl job's nested results."""
    return (crawls.select(*keep, F.posexplode(results).alias("pos", "page"))
            .select(*keep, "pos", "page.*"))
