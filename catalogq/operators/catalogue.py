"""Catalogue queries: section feeds, similar items, search, id shards, lookup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import WHITESPACE, null_if_empty
from catalogq.operators.rankdir import Ranked, ranked
from catalogq.operators.rowindex import with_position
from catalogq.operators.topk import first_n, top_per_group
from catalogq.session import materialize

# Item columns, sections (id, title, description), list lengths and page limits.
ITEM_COLUMNS = (
    "gtin", "name", "brand", "price_eur", "currency", "category_path", "rating_value", "rating_count",
)
SECTIONS = (
    ("top-rated", "Top Rated Picks", "Strong ratings with enough review volume to be meaningful."),
    ("most-reviewed", "Most Reviewed", "Products with the highest number of ratings."),
    ("budget-finds", "Budget Finds", "Low-price items with good customer feedback."),
    ("pharmacy-picks", "Pharmacy Picks", "A selection from pharmacy-tagged products."),
    ("featured-badges", "Featured & Highlighted", "Products with eyecatchers or pill labels."),
)
SECTION_ITEMS = 12
SIMILAR_ITEMS = 8
SEARCH_FIELDS = ("name", "brand", "category_path")
MIN_QUERY_LENGTH = 3
PAGE_SIZE = 10
# Rows from the start up to which a page is cut out of one pass; and the pieces that a query of many probes with.
NEAR_ROWS = 10_000
PROBES = 2
# Catalogue rows of one task in a search for many queries.
SEARCH_ROWS = 20_000
SHARD_SIZE = 10_000
MAX_SHARD_SIZE = 50_000


def item_columns(df: DataFrame, identifier: str = "gtin") -> list[Column]:
    """The item projection: missing text is '', a missing number 0."""
    numbers = {"price_eur": "double", "rating_value": "double", "rating_count": "bigint"}
    return [
        F.coalesce(F.col(c).cast(numbers[c]), F.lit(0).cast(numbers[c])).alias(c)
        if c in numbers
        else F.coalesce(F.col(identifier if c == "gtin" else c).cast("string"), F.lit("")).alias(c)
        for c in ITEM_COLUMNS
    ]


# --- section feeds -------------------------------------------------------------------------


def _section_rules() -> dict[str, tuple[Column, str]]:
    """Section id → (which rows belong, which figure leads the order)."""
    price, rated = F.col("price_eur"), F.col("rating_count")
    priced = price.isNotNull()
    badges = F.col("has_eyecatchers").cast("boolean") | F.col("has_pills").cast("boolean")
    return {
        "top-rated": (priced & (rated >= 20), "rating_value"),
        "most-reviewed": (priced & (rated >= 1), "rating_count"),
        "budget-finds": (priced & (price <= 5) & (rated >= 5), "rating_value"),
        "pharmacy-picks": (priced & F.col("product_is_pharmacy").cast("boolean"), "rating_value"),
        "featured-badges": (priced & badges, "rating_count"),
    }


def section_feeds(catalogue: DataFrame, identifier: str = "gtin", size: int = SECTION_ITEMS) -> DataFrame:
    """(section_position, section_id, title, description, rank, item columns, paths): the best items per section.

    One pass over the catalogue serves all sections, and each task keeps at most
    `size` rows per section before the shuffle. An empty section yields no row.
    """
    rules = _section_rules()
    tags = []
    for position, (section, _, _) in enumerate(SECTIONS):
        condition, lead = rules[section]
        first, second = ("rating_value", "rating_count") if lead == "rating_value" else ("rating_count", "rating_value")
        tags.append(
            F.when(
                condition,
                F.struct(
                    F.lit(position).alias("section_position"),
                    F.col(first).cast("double").alias("_first"),
                    F.col(second).cast("double").alias("_second"),
                ),
            )
        )
    needed = [c for c in ITEM_COLUMNS if c != "gtin"]
    tagged = catalogue.select(
        F.col(identifier).alias("_id"), *needed, F.explode(F.array_compact(F.array(*tags))).alias("_tag")
    ).select("_id", *needed, "_tag.*")
    order = [F.col("_first").desc_nulls_last(), F.col("_second").desc_nulls_last(), F.col("price_eur"), F.col("_id")]
    best = top_per_group(tagged, ["section_position"], order, size, "rank")
    text_id = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    texts = [F.get(F.array(*[F.lit(s[i]) for s in SECTIONS]), F.col("section_position")) for i in range(3)]
    return best.select(
        "section_position",
        *[text.alias(name) for text, name in zip(texts, ("section_id", "title", "description"))],
        "rank",
        *item_columns(best, "_id"),
        F.concat(F.lit("/product/"), text_id).alias("product_path"),
        F.concat(F.lit("/api/product/"), text_id).alias("api_path"),
    )


def home_payload(feeds: DataFrame) -> DataFrame:
    """One row per non-empty section with its items as an array (at most a page of items each)."""
    items = F.struct("rank", *ITEM_COLUMNS, "product_path", "api_path")
    return feeds.groupBy("section_position", "section_id", "title", "description").agg(
        F.sort_array(F.collect_list(items)).alias("items"), F.count("*").alias("item_count")
    )


# --- similar items -------------------------------------------------------------------------


def similar_lists(catalogue: DataFrame, identifier: str = "gtin", k: int = SIMILAR_ITEMS) -> DataFrame:
    """Catalogue rows with `similar`: the k best items of the same category or brand, as an array.

    Items of the category come first, then by rating value and rating count, then id.
    Ids must be unique. No pairs are formed inside a group: the k + 1 best items of a
    category and of a brand, in order, serve all their members, as one of them may be
    the item itself. If the category's list has k others, they are the answer. If not,
    the list is the whole category, and the answer goes on with the brand's list
    without the items already met.

    The lists are written first, so that their size is known when the joins are planned;
    rows of a hot brand or category are split by the adaptive skew join.
    """

    def best_of(column: str) -> DataFrame:
        pool = catalogue.select(
            F.col(identifier).alias("_id"), *[c for c in ITEM_COLUMNS if c != "gtin"]
        ).where(F.col("_id").isNotNull() & (F.btrim(F.col(column), F.lit(WHITESPACE)) != ""))
        order = [F.col("rating_value").desc_nulls_last(), F.col("rating_count").desc_nulls_last(), F.col("_id")]
        best = top_per_group(pool, [column], order, k + 1, "_rank")
        entry = F.struct("_rank", F.struct(*item_columns(best, "_id")).alias("item"))
        lists = best.groupBy(F.col(column).alias(f"_{column}")).agg(F.sort_array(F.collect_list(entry)).alias("list"))
        return lists.select(f"_{column}", F.transform("list", lambda e: e["item"]).alias(f"_by_{column}"))

    def own(column: str) -> Column:
        return null_if_empty(F.btrim(F.col(column), F.lit(WHITESPACE))).alias(f"_{column}")

    rows = catalogue.select("*", F.col(identifier).cast("string").alias("_id"), own("category_path"), own("brand"))
    lookups = {c: materialize(best_of(c), "best") for c in ("category_path", "brand")}
    lookups["category_path"] = lookups["category_path"].withColumn(
        "_ids", F.transform("_by_category_path", lambda x: x["gtin"])
    )
    for column, lists in lookups.items():
        rows = rows.join(lists, f"_{column}", "left")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType))

    same_category = F.filter(listed("_by_category_path"), lambda x: x["gtin"] != F.col("_id"))
    met = F.coalesce(F.col("_ids"), F.array().cast("array<string>"))
    same_brand = F.filter(
        listed("_by_brand"), lambda x: (x["gtin"] != F.col("_id")) & ~F.array_contains(met, x["gtin"])
    )
    return rows.withColumn("similar", F.slice(F.concat(same_category, same_brand), 1, k)).drop(
        "_id", "_category_path", "_brand", "_by_category_path", "_by_brand", "_ids"
    )


def similar_items(catalogue: DataFrame, identifier: str = "gtin", k: int = SIMILAR_ITEMS) -> DataFrame:
    """(id, rank, item columns): the similar items of every catalogue row, one row each."""
    lists = similar_lists(catalogue.where(F.col(identifier).isNotNull()), identifier, k)
    return lists.select(
        F.col(identifier).alias("id"), F.posexplode("similar").alias("_pos", "_item")
    ).select("id", (F.col("_pos") + 1).cast("bigint").alias("rank"), "_item.*")


# --- search --------------------------------------------------------------------------------


def ascii_lower(value: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_fields(df: DataFrame) -> list[str]:
    fields = [f for f in SEARCH_FIELDS if f in df.columns]
    if not fields:
        raise ValueError("no searchable columns available")
    return fields


def checked_query(query: str) -> str:
    query = query.strip(WHITESPACE)
    if len(query) < MIN_QUERY_LENGTH:
        raise ValueError(f"query must be at least {MIN_QUERY_LENGTH} characters")
    return query


def checked_offset(page: int, page_size: int) -> int:
    if page < 1 or page_size < 1:
        raise ValueError("page and page size start at 1")
    return (page - 1) * page_size


def _matches(fields: Sequence[str], needle: Column) -> Column:
    found = [F.coalesce(ascii_lower(F.col(f)).contains(needle), F.lit(False)) for f in fields]
    condition = found[0]
    for more in found[1:]:
        condition = condition | more
    return condition


def _search_keys(fields: Sequence[str], needle: Column, identifier: str) -> list[tuple[Column, bool]]:
    """(key, descending): prefix hits field by field, then popularity, rating, name; the id settles ties."""
    prefix = [
        F.when(F.coalesce(ascii_lower(F.col(f)).startswith(needle), F.lit(False)), 0).otherwise(1) for f in fields
    ]
    return [
        *[(p, False) for p in prefix],
        (F.col("rating_count"), True),
        (F.col("rating_value"), True),
        (F.col("name"), False),
        (F.col(identifier), False),
    ]


def _search_order(fields: Sequence[str], needle: Column, identifier: str) -> list[Column]:
    keys = _search_keys(fields, needle, identifier)
    return [key.desc_nulls_last() if down else key.asc_nulls_first() for key, down in keys]


def _search_items(rows: DataFrame, identifier: str) -> list[Column]:
    shown = "gtin" if "gtin" in rows.columns else identifier
    ident = F.coalesce(F.col(shown).cast("string"), F.lit(""))
    rest = [c for c in item_columns(rows, shown)[1:]]
    return [ident.alias("id"), *rest, F.concat(F.lit("/product/"), ident).alias("product_path")]


@dataclass(frozen=True)
class SearchPage:
    query: str
    page: int
    per_page: int
    offset: int
    total: int
    total_pages: int
    search_fields: list[str]
    items: DataFrame

    min_page: int = 1
    min_query_length: int = MIN_QUERY_LENGTH

    @property
    def max_page(self) -> int:
        return self.total_pages

    @property
    def has_prev(self) -> bool:
        return self.page > self.min_page

    @property
    def has_next(self) -> bool:
        return 0 < self.total_pages and self.page < self.total_pages

    @property
    def prev_page(self) -> int:
        return self.page - 1 if self.has_prev else 1

    @property
    def next_page(self) -> int:
        return self.page + 1 if self.has_next else 1


def search_matches(catalogue: DataFrame, query: str) -> DataFrame:
    """Rows whose name, brand or category contains the query, ignoring ASCII case."""
    needle = ascii_lower(F.lit(checked_query(query)))
    return catalogue.where(_matches(search_fields(catalogue), needle))


def ranked_matches(catalogue: DataFrame, query: str, identifier: str = "gtin") -> Ranked:
    """All matches put in order once, for any number of pages however deep."""
    hits = search_matches(catalogue, query)
    needle = ascii_lower(F.lit(checked_query(query)))
    needed = list(dict.fromkeys([identifier, *[c for c in ITEM_COLUMNS if c in hits.columns]]))
    return ranked(hits.select(*needed), _search_keys(search_fields(catalogue), needle, identifier), "matches")


def ranked_page(matches: Ranked, page: int = 1, page_size: int = PAGE_SIZE, identifier: str = "gtin") -> DataFrame:
    """One page of the ordered matches: reads the ranges that hold it."""
    rows = matches.page(checked_offset(page, page_size), page_size)
    return rows.select(*_search_items(rows, identifier))


def search_items(
    catalogue: DataFrame, query: str, page: int = 1, page_size: int = PAGE_SIZE, identifier: str = "gtin"
) -> DataFrame:
    """One page of ranked matches.

    Up to NEAR_ROWS rows from the start each task keeps the rows that can be on the page, in one
    pass and two levels. Further on, all matches are put in order once, and the page is read from there.
    """
    offset = checked_offset(page, page_size)
    if offset + page_size > NEAR_ROWS:
        return ranked_page(ranked_matches(catalogue, query, identifier), page, page_size, identifier)
    needle = ascii_lower(F.lit(checked_query(query)))
    hits = search_matches(catalogue, query)
    order = _search_order(search_fields(catalogue), needle, identifier)
    return first_n(hits, order, offset + page_size).offset(offset).limit(page_size).select(*_search_items(hits, identifier))


def search(
    catalogue: DataFrame, query: str, page: int = 1, page_size: int = PAGE_SIZE, identifier: str = "gtin"
) -> SearchPage:
    """The page with its totals."""
    query = checked_query(query)
    offset = checked_offset(page, page_size)
    if offset + page_size > NEAR_ROWS:
        matches = ranked_matches(catalogue, query, identifier)
        total, items = matches.total, ranked_page(matches, page, page_size, identifier)
    else:
        total, items = search_matches(catalogue, query).count(), search_items(catalogue, query, page, page_size, identifier)
    return SearchPage(
        query, page, page_size, offset, total, -(-total // page_size), search_fields(catalogue), items
    )


def _trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a text; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(
        F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))
    ).otherwise(F.array().cast("array<string>"))


def _row_pieces(catalogue: DataFrame, fields: Sequence[str], identifier: str) -> DataFrame:
    """(_id, _piece): the distinct pieces of each row; nothing else of the row travels with them."""
    pieces = F.array_distinct(
        F.flatten(F.array(*[_trigrams(F.coalesce(ascii_lower(F.col(f)), F.lit(""))) for f in fields]))
    )
    return catalogue.select(F.col(identifier).alias("_id"), F.explode(pieces).alias("_piece"))


def _rarest_pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, _needle, _piece, _parts): the PROBES pieces of each query that the fewest rows hold.

    A query with a piece that no row holds has no hits and is left out. Frequencies are counted
    before the shuffle, for the pieces of queries only.
    """
    asked = materialize(wanted.select("query", "_needle", F.explode(_trigrams(F.col("_needle"))).alias("_piece")), "pieces")
    held = rows.join(asked.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("n"))
    counted = asked.join(held, "_piece", "left").select(
        "query", "_needle", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_piece").alias("piece")
    )
    # A query has as many pieces as characters.
    rarest = counted.groupBy("query", "_needle").agg(F.slice(F.array_sort(F.collect_list("piece")), 1, PROBES).alias("rare"))
    found = rarest.where(F.col("rare")[0]["n"] > 0)
    return found.select("query", "_needle", F.size("rare").alias("_parts"), F.explode(F.col("rare")["_piece"]).alias("_piece"))


def _search_tasks(catalogue: DataFrame) -> int:
    """Tasks of a search for many queries: the rows of one are bounded, whatever the size of the catalogue.

    Pieces and hits of a row are many times its bytes, by which adaptive execution would join tasks.
    """
    least = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-catalogue.count() // SEARCH_ROWS))


def candidate_pairs(catalogue: DataFrame, queries: DataFrame, identifier: str = "gtin") -> DataFrame:
    """(_id, query, _needle): rows that hold the rarest pieces of a query, written; every hit is among them.

    Rows and queries meet in an equi-join on three-character pieces. Each query probes with its
    rarest pieces and a row must hold all of them, so a piece that stands in every name brings
    rows only to queries that have no rarer one.
    """
    wanted = (
        queries.select(F.btrim(F.col("query"), F.lit(WHITESPACE)).alias("query"))
        .where(F.length("query") >= MIN_QUERY_LENGTH)
        .distinct()
        .withColumn("_needle", ascii_lower(F.col("query")))
    )
    parts = _search_tasks(catalogue)
    needed = list(dict.fromkeys([identifier, *search_fields(catalogue)]))
    rows = _row_pieces(catalogue.select(*needed).repartition(parts, identifier), search_fields(catalogue), identifier)
    probes = materialize(_rarest_pieces(rows, wanted), "probes")
    met = rows.join(probes, "_piece").repartition(parts, "_id").groupBy("_id", "query", "_needle").agg(
        F.count_distinct("_piece").alias("n"), F.max("_parts").alias("_parts")
    )
    return materialize(met.where("n = _parts").select("_id", "query", "_needle"), "candidates")


def query_hits(catalogue: DataFrame, queries: DataFrame, identifier: str = "gtin") -> DataFrame:
    """Catalogue rows with each query (column `query`) they match.

    Only ids and pieces go through the piece join; the rows themselves are fetched for the
    pairs that are left, by a join that adaptive execution chooses by size, and checked in full.
    """
    fields = search_fields(catalogue)
    needed = list(dict.fromkeys([identifier, *[c for c in ITEM_COLUMNS if c in catalogue.columns]]))
    parts = _search_tasks(catalogue)
    rows = catalogue.select(*needed, F.xxhash64(identifier).alias("_place")).repartition(parts, "_place")
    pairs = candidate_pairs(catalogue, queries, identifier).withColumn("_place", F.xxhash64("_id")).repartition(parts, "_place")
    # Rows without id meet each other too. Not an equality to the planner, so the join stays on the hash, and with it the tasks.
    same = F.coalesce(F.col(identifier) == F.col("_id"), F.col(identifier).isNull() & F.col("_id").isNull())
    hits = rows.join(pairs, "_place").where(same).drop("_id", "_place")
    return hits.where(_matches(fields, F.col("_needle")))


def search_many(
    catalogue: DataFrame, queries: DataFrame, page: int = 1, page_size: int = PAGE_SIZE, identifier: str = "gtin"
) -> DataFrame:
    """(query, total, total_pages, rank, item columns): the same page of every query.

    Every query of the input is there: one without hits, too short to be searched or without
    rows on this page has one row with its total and no rank. The matches are written once
    for totals and pages. Totals are counted before the shuffle, and each task keeps only
    the rows that can be on the page, so a query that matches most of the catalogue is no
    hot spot.
    """
    offset = checked_offset(page, page_size)
    asked = queries.select(F.btrim(F.col("query"), F.lit(WHITESPACE)).alias("query")).where("query is not null").distinct()
    hits = materialize(query_hits(catalogue, queries, identifier), "hits")
    totals = hits.groupBy("query").agg(F.count("*").alias("total"))
    order = _search_order(search_fields(catalogue), F.col("_needle"), identifier)
    ranked = top_per_group(hits, ["query"], order, offset + page_size, "rank").where(F.col("rank") > offset)
    shown = ranked.select("query", "rank", *_search_items(ranked, identifier))
    counted = asked.join(totals, "query", "left").select("query", F.coalesce("total", F.lit(0)).alias("total"))
    pages = F.ceil(F.col("total") / F.lit(page_size)).cast("bigint")
    return counted.join(shown, "query", "left").select(
        "query", "total", pages.alias("total_pages"), "rank", *[c for c in shown.columns if c not in ("query", "rank")]
    )


# --- ids -----------------------------------------------------------------------------------


def non_empty_ids(catalogue: DataFrame, identifier: str = "gtin") -> DataFrame:
    return catalogue.where(F.col(identifier).isNotNull() & (F.trim(F.col(identifier).cast("string")) != ""))


def shard_size(chunk: int) -> int:
    """The ids per shard: SHARD_SIZE if none is given, and never more than MAX_SHARD_SIZE."""
    return min(chunk if chunk > 0 else SHARD_SIZE, MAX_SHARD_SIZE)


def id_shards(
    catalogue: DataFrame, base_url: str, identifier: str = "gtin", chunk: int = SHARD_SIZE
) -> DataFrame:
    """(shard, id, loc): ids in order, cut into shards of equal size."""
    ids = non_empty_ids(catalogue, identifier).select(F.col(identifier).alias("id"))
    placed = with_position(ids, ["id"], "_position")
    text = F.btrim(F.col("id").cast("string"), F.lit(WHITESPACE))
    shard = F.floor(F.col("_position") / F.lit(shard_size(chunk))) + 1
    return placed.select(
        shard.alias("shard"), text.alias("id"), F.concat(F.lit(f"{base_url}/product/"), text).alias("loc")
    )


def shard_index(
    catalogue: DataFrame, base_url: str, identifier: str = "gtin", chunk: int = SHARD_SIZE, lastmod: str | None = None
) -> DataFrame:
    """(shard, loc, lastmod): the list of shards; it names one even when there are no ids."""
    pages = max(1, -(-non_empty_ids(catalogue, identifier).count() // shard_size(chunk)))
    day = F.lit(lastmod) if lastmod else F.date_format(F.current_date(), "yyyy-MM-dd")
    return catalogue.sparkSession.range(1, pages + 1).select(F.col("id").alias("shard")).select(
        "shard", F.format_string(f"{base_url}/sitemaps/products-%d.xml", F.col("shard")).alias("loc"), day.alias("lastmod")
    )


def find_by_id(table: DataFrame, identifier: str, value) -> DataFrame:
    """The row with this id (at most one); the filter reaches the scan."""
    return rows_with(table, identifier, value).limit(1)


def rows_with(table: DataFrame, column: str, value) -> DataFrame:
    """All rows with this value; the filter reaches the scan, which skips files and row groups by it."""
    return table.where(F.col(column) == F.lit(value).try_cast(table.schema[column].dataType))


def find_by_ids(table: DataFrame, identifier: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is in the table `wanted` (column of the same name)."""
    return table.join(wanted.select(identifier).distinct(), identifier, "left_semi")
