"""JSON-LD items: types, required and recommended fields, formats, warnings, scores, rich results and page roll-ups.

JVM expressions over the items' JSON text. Defined results: a field counts as present where it isn't null, '', [], {}, false
or 0; an item that isn't JSON has type Unknown, the format error json and score 0; a null item is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Required and recommended fields by type. Fixed values.
REQUIRED = {
    "Article": ("headline", "image", "author", "datePublished", "publisher"),
    "NewsArticle": ("headline", "image", "author", "datePublished", "publisher"),
    "BlogPosting": ("headline", "image", "author", "datePublished"),
    "Product": ("name", "image", "offers"),
    "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",),
    "Recipe": ("name", "image", "recipeIngredient", "recipeInstructions"),
    "Event": ("name", "startDate", "location"),
    "LocalBusiness": ("name", "address"),
    "Person": ("name",),
    "Organization": ("name", "url"),
    "WebPage": ("name",),
    "HowTo": ("name", "step"),
    "Review": ("itemReviewed", "reviewRating", "author"),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate"),
    "WebSite": ("name", "url"),
}
RECOMMENDED = {
    "Article": ("dateModified", "mainEntityOfPage", "description", "inLanguage"),
    "NewsArticle": ("dateModified", "mainEntityOfPage", "description", "inLanguage"),
    "BlogPosting": ("publisher", "dateModified", "mainEntityOfPage", "inLanguage"),
    "Product": ("description", "brand", "sku", "aggregateRating", "review"),
    "FAQPage": ("name", "description"),
    "BreadcrumbList": (),
    "Recipe": ("cookTime", "prepTime", "nutrition", "author", "aggregateRating"),
    "Event": ("endDate", "image", "description", "offers", "organizer"),
    "LocalBusiness": ("telephone", "openingHours", "image", "url", "geo"),
    "Person": ("url", "image", "jobTitle", "sameAs"),
    "Organization": ("logo", "sameAs", "contactPoint"),
    "WebPage": ("description", "url", "datePublished", "inLanguage"),
    "HowTo": ("image", "totalTime", "supply", "tool"),
    "Review": ("datePublished", "reviewBody"),
    "VideoObject": ("contentUrl", "embedUrl", "duration"),
    "WebSite": ("potentialAction",),
}
RICH = (
    "Article", "NewsArticle", "BlogPosting", "Product", "FAQPage", "BreadcrumbList", "Recipe", "Event", "LocalBusiness", "HowTo", "Review", "VideoObject",
)
URL_FIELDS = ("url", "image", "logo", "thumbnailUrl", "contentUrl", "embedUrl", "mainEntityOfPage", "sameAs")
DATE_FIELDS = ("datePublished", "dateModified", "dateCreated", "startDate", "endDate", "uploadDate")
DURATION_FIELDS = ("duration", "cookTime", "prepTime", "totalTime")
OBJECT_FIELDS = ("author", "publisher", "organizer", "performer")
LANGUAGE_TYPES = ("Article", "NewsArticle", "BlogPosting", "WebPage")
SCHEMA = "schema.org"

STRINGS = "array<string>"


def field(item: Column, name: str) -> Column:
    return F.get_json_object(item, f"$.{name}")


def present(v: Column) -> Column:
    return v.isNotNull() & ~v.isin("", "[]", "{}", "null", "false", "0", "0.0")


def is_object(v: Column) -> Column:
    return v.startswith("{") & v.endswith("}")


def listed(item: Column, name: str) -> Column:
    """The elements of a field as texts: those of a list, or the single value; none where it is null."""
    v = field(item, name)
    return F.when(v.isNull(), F.array().cast(STRINGS)).when(v.startswith("["), F.filter(F.coalesce(F.from_json(v, STRINGS), F.array(v)), lambda x: x.isNotNull())).otherwise(F.array(v))


def types_of(item: Column) -> Column:
    """The types of an item as a list; Unknown where it has none."""
    t = F.get_json_object(item, "$['@type']")
    return F.when(t.isNull(), F.array(F.lit("Unknown"))).when(t.startswith("["), F.from_json(t, STRINGS)).otherwise(F.array(t))


def _some(xs: list[Column]) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def _of_types(table: dict[str, tuple[str, ...]], item: Column) -> Column:
    """The fields of the item's types that it lacks, each once."""
    return F.array_distinct(_some([F.when(F.array_contains("types", t) & ~present(field(item, f)), F.lit(f)) for t, fields in table.items() for f in fields]))


def format_errors(item: Column, context: bool) -> Column:
    """The fields whose values have a wrong form: addresses, dates, durations, the context."""
    filled = lambda f: field(item, f).isNotNull() & ~field(item, f).isin("", "[]")
    address = lambda x: is_object(x) | x.rlike("^https?://")
    bad = [F.when(filled(f) & ~F.forall(listed(item, f), address), F.lit(f)) for f in URL_FIELDS]
    bad += [F.when(filled(f) & ~field(item, f).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(f)) for f in DATE_FIELDS]
    bad += [F.when(filled(f) & ~field(item, f).rlike(r"(?i)^P(?:T?\d+[HMSD])+$"), F.lit(f)) for f in DURATION_FIELDS]
    if context:
        bad.append(F.when(~names_schema(item, "https") & ~names_schema(item, "http"), F.lit("@context")))
    return _some(bad)


def names_schema(item: Column, scheme: str) -> Column:
    """Whether the context is, or has in its list or vocabulary, the address of the schema under a scheme."""
    c = F.get_json_object(item, "$['@context']")
    each = F.when(c.startswith("["), F.from_json(c, STRINGS)).otherwise(F.array(c))
    word = lambda x: F.rtrim(F.when(is_object(x), F.get_json_object(x, "$['@vocab']")).otherwise(x), F.lit("/")) == f"{scheme}://{SCHEMA}"
    return F.coalesce(F.exists(each, word), F.lit(False))


def warnings(item: Column, context: bool) -> Column:
    """One code for each flaw of the structure: field or field.flaw, as often as it occurs."""
    none = F.array().cast(STRINGS)
    parts = []

    def hits(f: str, code: str, flaw: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(listed(item, f), lambda x: F.coalesce(flaw(x), F.lit(False))), lambda x: F.lit(code))

    def each(f: str, flaws: list[tuple[str, Callable[[Column], Column]]]) -> None:
        parts.extend(hits(f, code, flaw) for code, flaw in flaws)

    got = lambda x, k: present(F.get_json_object(x, f"$.{k}"))
    kind = lambda x, t: F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")).rlike(rf'(^|"){t}("|$)')
    for f in OBJECT_FIELDS:
        each(f, [(f, lambda x: ~is_object(x)), (f"{f}.name", lambda x: is_object(x) & ~got(x, "name")), (f"{f}.logo", lambda x: is_object(x) & kind(x, "Organization") & ~got(x, "logo"))])
    each("offers", [
        ("offers.price", lambda x: is_object(x) & ~got(x, "price") & ~got(x, "lowPrice")), ("offers.priceCurrency", lambda x: is_object(x) & ~got(x, "priceCurrency")),
        ("offers.priceCurrency", lambda x: is_object(x) & got(x, "priceCurrency") & ~F.get_json_object(x, "$.priceCurrency").rlike("^[A-Z]{3}$")),
    ])
    faq = [("mainEntity", lambda x: ~is_object(x)), ("mainEntity.acceptedAnswer", lambda x: is_object(x) & ~got(x, "acceptedAnswer"))]
    for code, flaw in faq:
        parts.append(F.when(F.array_contains("types", "FAQPage"), hits("mainEntity", code, flaw)).otherwise(none))
    rating, review = field(item, "aggregateRating"), field(item, "reviewRating")
    number = lambda k, default: F.coalesce(F.get_json_object(rating, f"$.{k}").try_cast("double"), F.lit(default).cast("double"))
    value = F.get_json_object(rating, "$.ratingValue")
    single = [
        F.when(is_object(review) & ~got(review, "ratingValue"), F.lit("reviewRating")),
        F.when(is_object(rating) & value.isNull(), F.lit("aggregateRating.ratingValue")),
        F.when(is_object(rating) & ((number("ratingValue", None) < number("worstRating", 1)) | (number("ratingValue", None) > number("bestRating", 5))), F.lit("aggregateRating.range")),
        F.when(is_object(rating) & ~got(rating, "reviewCount") & ~got(rating, "ratingCount"), F.lit("aggregateRating.count")),
    ]
    if context:
        single.append(F.when(names_schema(item, "http") & ~names_schema(item, "https"), F.lit("@context")))
    return F.concat(*parts, _some(single))


def validate(items: DataFrame, id_col: str, item_col: str = "item", context: bool = True) -> DataFrame:
    """The items with types, missing_required, missing_recommended, format_errors, warnings and score.

    score = max(0, 100 - 20 required - 5 recommended - 10 format - 5 warnings); an item that isn't a JSON object has 0.
    """
    j = F.col(item_col)
    ok = F.try_parse_json(j).isNotNull() & F.trim(j).startswith("{")
    d = items.filter(j.isNotNull()).withColumn("types", F.when(ok, types_of(j)).otherwise(F.array(F.lit("Unknown"))))
    none = F.array().cast(STRINGS)
    when = lambda x: F.when(ok, x).otherwise(none)
    required = _of_types(REQUIRED, j)
    d = d.withColumns(
        {
            "missing_required": when(required), "missing_recommended": when(F.array_except(_of_types(RECOMMENDED, j), _all_required())),
            "format_errors": F.when(ok, format_errors(j, context)).otherwise(F.array(F.lit("json"))), "warnings": when(warnings(j, context)),
        }
    )
    score = F.greatest(F.lit(0), 100 - 20 * F.size("missing_required") - 5 * F.size("missing_recommended") - 10 * F.size("format_errors") - 5 * F.size("warnings"))
    return d.withColumn("score", F.when(ok, score).otherwise(0).cast("bigint"))


def _all_required() -> Column:
    """All required fields of the item's types, which aren't recommended as well."""
    return _some([F.when(F.array_contains("types", t), F.lit(f)) for t, fields in REQUIRED.items() for f in fields])


def rich_results(valid: DataFrame, item_col: str = "item") -> DataFrame:
    """The items with eligible (the types for which a rich result is possible) and lacking (what the others miss)."""
    j = F.col(item_col)
    offer = F.exists(listed(j, "offers"), lambda x: is_object(x) & (present(F.get_json_object(x, "$.price")) | present(F.get_json_object(x, "$.lowPrice"))))
    more = {
        "Product": F.when(~offer & ~present(field(j, "aggregateRating")) & present(field(j, "offers")), F.lit("price or rating")),
        "BreadcrumbList": F.when(field(j, "itemListElement").startswith("[") & (F.size(listed(j, "itemListElement")) < 2) | field(j, "itemListElement").isNull(), F.lit("two items")),
        "VideoObject": F.when(~present(field(j, "contentUrl")) & ~present(field(j, "embedUrl")), F.lit("contentUrl or embedUrl")),
    }
    lacks = {t: _some([F.when(~present(field(j, f)), F.lit(f)) for f in REQUIRED[t]] + ([more[t]] if t in more else [])) for t in RICH}
    eligible = _some([F.when(F.array_contains("types", t) & (F.size(x) == 0), F.lit(t)) for t, x in lacks.items()])
    lacking = F.array_distinct(F.flatten(F.array(*(F.when(F.array_contains("types", t), x).otherwise(F.array().cast(STRINGS)) for t, x in lacks.items()))))
    return valid.withColumns({"eligible": eligible, "lacking": lacking})


def bare_image(item: Column) -> Column:
    """Whether an image is a plain address and none is an image object with its size."""
    each = listed(item, "image")
    sized = F.exists(each, lambda x: is_object(x) & F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")).contains("ImageObject") & present(F.get_json_object(x, "$.width")) & present(F.get_json_object(x, "$.height")))
    return F.exists(each, lambda x: ~is_object(x)) & ~sized


def duplicate_types(valid: DataFrame, id_col: str, item_col: str = "item") -> DataFrame:
    """(id, type): types that several items of a page have, unless each of them has an @id of its own."""
    t = valid.select(id_col, F.explode("types").alias("type"), F.nullif(F.get_json_object(item_col, "$['@id']"), F.lit("")).alias("_id"))
    return t.groupBy(id_col, "type").agg(F.count("*").alias("n"), F.count("_id").alias("k"), F.count_distinct("_id").alias("u")).filter("n > 1 and not (k = n and u = n)").select(id_col, "type")


def recommendations(valid: DataFrame, id_col: str, item_col: str = "item") -> DataFrame:
    """(id, priority, type, message): what to add or mend, each once for a page: high, medium, low."""
    j, kind = F.col(item_col), F.get("types", F.lit(0))
    rows = lambda priority, what, xs: F.transform(xs, lambda x: F.struct(F.lit(priority).alias("priority"), kind.alias("type"), F.concat(F.lit(what), x).alias("message")))
    hints = F.concat(F.when(bare_image(j), F.array(F.lit("image size"))).otherwise(F.array().cast(STRINGS)), F.when(F.arrays_overlap("types", F.array(*map(F.lit, LANGUAGE_TYPES))) & ~present(field(j, "inLanguage")), F.array(F.lit("inLanguage"))).otherwise(F.array().cast(STRINGS)))
    each = F.concat(rows("high", "add ", F.col("missing_required")), rows("high", "form of ", F.col("format_errors")), rows("medium", "structure of ", F.col("warnings")), rows("low", "add ", F.col("missing_recommended")), rows("low", "hint ", hints))
    item = valid.select(id_col, F.explode(each).alias("x")).select(id_col, "x.*")
    page = duplicate_types(valid, id_col, item_col).select(id_col, F.lit("medium").alias("priority"), "type", F.lit("duplicate without @id").alias("message"))
    return item.unionByName(page).unionByName(without_search(valid, id_col, item_col).select(id_col, F.lit("low").alias("priority"), F.lit("WebSite").alias("type"), F.lit("add a search action").alias("message"))).distinct()


def without_search(valid: DataFrame, id_col: str, item_col: str = "item") -> DataFrame:
    """(id) of the pages with a WebSite item of which none has a search action."""
    site = F.array_contains("types", "WebSite")
    found = F.exists(listed(F.col(item_col), "potentialAction"), lambda x: F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")).contains("SearchAction"))
    return valid.filter(site).groupBy(id_col).agg(F.max(found).alias("s")).filter("not s").select(id_col)


def page_rollup(valid: DataFrame, id_col: str, item_col: str = "item") -> DataFrame:
    """(id, n_items, n_valid, mean_score, types, eligible, duplicate_types, website_without_search); the mean is rounded half to even."""
    rich = rich_results(valid, item_col)
    sets = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    g = rich.groupBy(id_col).agg(
        F.count("*").alias("n_items"),
        F.count_if(~F.array_contains("format_errors", "json")).alias("n_valid"),
        F.bround(F.avg("score"), 0).cast("bigint").alias("mean_score"),
        sets("types").alias("types"),
        sets("eligible").alias("eligible"),
    )
    again = duplicate_types(valid, id_col, item_col).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("duplicate_types"))
    lone = without_search(valid, id_col, item_col).withColumn("website_without_search", F.lit(True))
    return g.join(again, id_col, "left").join(lone, id_col, "left").na.fill("", ["duplicate_types"]).na.fill(False, ["website_without_search"])
