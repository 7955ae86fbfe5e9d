"""Change rows and page summaries as message blocks.

A block row is ``(url, block_no, block_type, text)``.  Block numbers order a message and leave
gaps between its sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions.text import escape_markup, let, relative_age

MAX_ITEMS = 3
MAX_DEALS = 4
DEFAULT_NAME = "Watched page"

# The order of the sections and their wording.
SECTIONS = (
    ("added", "🆕 New", "new"),
    ("changed", "🔄 Updated", "updated"),
    ("removed", "❌ Removed", "removed"),
)
MARKS = {"title": "", "perk": "", "price": "💰 ", "dates": "📅 "}
ITEM_FIELDS = ("title", "perk", "price", "dates")
SUMMARY_HEADER, SUMMARY_FOOTER = "Page summary", "End of the summary"
MAX_DESCRIPTION = 100


def section_rank(change_type: Column) -> Column:
    out = F.lit(len(SECTIONS))
    for rank, (kind, _, _) in reversed(list(enumerate(SECTIONS))):
        out = F.when(change_type == kind, rank).otherwise(out)
    return out


def top_items(changes: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Per url the first items: added, then changed, then removed, each in page order."""
    ranked = changes.withColumn("section", section_rank(F.col("change_type")))
    window = Window.partitionBy("url").orderBy("section", "pos", "id")
    return ranked.withColumn("item_no", F.row_number().over(window)).where(
        F.col("item_no") <= max_items
    )


def _filled(col: Column) -> Column:
    return F.nullif(F.coalesce(col, F.lit("")), F.lit(""))


def _safe(text: Column, limit: int | None) -> Column:
    """Escaped, and cut to what a message field may hold (None: whole)."""
    return escape_markup(text, limit)


def _escaped(promo: Column, limit: int | None) -> Column:
    """The four fields escaped, '' for missing ones, in item order."""
    return F.transform(F.array(*[promo[f] for f in ITEM_FIELDS]), lambda t: _safe(t, limit))


def _lines(texts: Column, old: Column | None = None) -> Column:
    lines = []
    for i, f in enumerate(ITEM_FIELDS):
        bold = "*" if f == "title" else ""
        lines.append(F.when(texts[i] != "", F.concat(F.lit(MARKS[f] + bold), texts[i], F.lit(bold))))
        if old is not None:
            struck = F.concat(F.lit(MARKS[f] + "~"), old[i], F.lit("~"))
            lines.append(F.when(old[i] != "", struck))
    return F.concat_ws("\n", *lines)


def record_text(promo: Column, limit: int | None = P.MESSAGE_TEXT_LIMIT) -> Column:
    """Bold title, perk, price and dates, one line each; missing fields are skipped."""
    return let(_escaped(promo, limit), lambda t: _lines(t))


def change_text(previous: Column, current: Column, limit: int | None = P.MESSAGE_TEXT_LIMIT) -> Column:
    """The new value of each field and, where it differs, the old one struck out."""
    differing = F.struct(
        *[F.when(~previous[f].eqNullSafe(current[f]), previous[f]).alias(f) for f in ITEM_FIELDS]
    )
    texts = F.struct(_escaped(current, limit).alias("new"), _escaped(differing, limit).alias("old"))
    return let(texts, lambda t: _lines(t["new"], t["old"]))


def item_text(limit: int | None = P.MESSAGE_TEXT_LIMIT) -> Column:
    previous, current = F.col("previous"), F.col("current")
    return (
        F.when(F.col("change_type") == "added", record_text(current, limit))
        .when(F.col("change_type") == "removed", record_text(previous, limit))
        .otherwise(change_text(previous, current, limit))
    )


def _block(number: Column | int, kind: str, text: Column | str | None) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    text = F.lit(text) if not isinstance(text, Column) else text
    return F.struct(
        number.cast("int").alias("block_no"),
        F.lit(kind).alias("block_type"),
        text.cast("string").alias("text"),
    )


def _explode_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    return rows.select("url", F.inline(F.filter(blocks, lambda b: b.isNotNull())))


def change_digest(
    sources: DataFrame,
    changes: DataFrame,
    as_of: Column,
    default_name: str = DEFAULT_NAME,
    max_items: int = MAX_ITEMS,
    text_limit: int | None = P.MESSAGE_TEXT_LIMIT,
) -> DataFrame:
    """Block rows, one message per url with changes.

    ``text_limit``: most characters of a field of a record (None: whole).

    ``sources``: url, name, detected_at (ISO text), the change counts and the summary.
    ``changes``: the change rows behind those counts.
    """
    changed = sources.where("has_changes")
    head = F.array(
        _block(0, "header", F.concat(
            F.lit("🎯 "), F.coalesce(_filled(F.col("name")), F.lit(default_name)))),
        _block(1, "context", F.concat(
            F.lit("<"), F.col("url"), F.lit("|View Page> • "),
            relative_age(F.col("detected_at"), as_of))),
        _block(2, "section", F.concat(F.lit("*Changes detected:* "), F.col("summary"))),
        _block(3, "divider", None),
    )
    # How many items each section shows follows from the counts alone.
    budget, frame = F.lit(max_items), []
    for rank, (kind, title, word) in enumerate(SECTIONS):
        total = F.col(f"n_{kind}")
        shown = F.least(total, budget)
        first = 10 * (rank + 1)
        heading = F.concat(F.lit(f"*{title} Promotions ("), total.cast("string"), F.lit("):*"))
        more = F.concat(
            F.lit("_... and "), (total - shown).cast("string"), F.lit(f" more {word} promotions_")
        )
        frame.append(F.when(shown > 0, _block(first, "section", heading)))
        frame.append(F.when((shown > 0) & (total > shown), _block(first + 9, "context", more)))
        budget = budget - shown
    frames = _explode_blocks(changed, F.concat(head, F.array(*frame)))
    items = top_items(changes, max_items).select(
        "url",
        (10 * (F.col("section") + 1) + F.col("item_no")).cast("int").alias("block_no"),
        F.lit("section").alias("block_type"),
        item_text(text_limit).alias("text"),
    )
    return frames.unionByName(items)


def messages(blocks: DataFrame) -> DataFrame:
    """One JSON message per url.  A message has at most a dozen blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "block_type", "text")))
    return blocks.groupBy("url").agg(F.to_json(ordered).alias("message"))


def deal_text(
    deal: Column, max_description: int | None = MAX_DESCRIPTION, limit: int | None = P.MESSAGE_TEXT_LIMIT
) -> Column:
    """Title, price and savings, place, dates and the start of the text."""
    money = F.concat_ws(
        " • ",
        F.concat(F.lit("💰 "), _filled(deal["price"])),
        F.concat(F.lit("💸 "), _filled(deal["savings"])),
    )
    description = _filled(deal["description"])
    short = description
    if max_description is not None:
        cut = F.concat(F.substring(description, 1, max_description), F.lit("..."))
        short = F.when(F.length(description) > max_description, cut).otherwise(description)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("*"), _safe(deal["title"], limit), F.lit("*")),
        F.nullif(money, F.lit("")),
        F.when(_filled(deal["location"]).isNotNull(),
               F.concat(F.lit("📍 "), _safe(deal["location"], limit))),
        F.when(_filled(deal["dates"]).isNotNull(),
               F.concat(F.lit("📅 "), _safe(deal["dates"], limit))),
        F.when(description.isNotNull() & (description != deal["title"]),
               F.concat(F.lit("_"), _safe(short, limit), F.lit("_"))),
    )


def summary_digest(
    summaries: DataFrame,
    as_of: Column,
    header: str = SUMMARY_HEADER,
    footer: str | None = SUMMARY_FOOTER,
    max_deals: int = MAX_DEALS,
    max_description: int | None = MAX_DESCRIPTION,
    text_limit: int | None = P.MESSAGE_TEXT_LIMIT,
) -> DataFrame:
    """Block rows of page-summary messages, one message per page row.

    ``text_limit``: most characters of a title, a place, a description and the like (None: whole).

    ``summaries``: the page summary columns with ``fetched_at`` (ISO text) and ``fetch_ms``.
    A message shows ``max_deals`` deals and says how many more there are.
    """
    deals, keys = F.col("deals"), F.col("key_elements")
    n_deals = F.size(deals)
    meta = F.col("meta_description")
    about = F.concat(
        F.lit("*Page Summary:*\n*Title:* "), _safe(F.col("title"), text_limit),
        F.lit("\n*Type:* "), F.col("kind"),
        F.lit("\n*Content:* "), F.floor(F.col("content_length") / 1024 + 0.5).cast("string"),
        F.lit("KB\n*Promotions:* "), F.col("n_promos").cast("string"), F.lit(" found"),
    )
    fixed = [
        _block(0, "header", header),
        _block(1, "context", F.concat(
            F.lit("<"), F.col("url"), F.lit("|View Page> • "),
            relative_age(F.col("fetched_at"), as_of),
            F.lit(" • Fetch: "), F.col("fetch_ms").cast("string"), F.lit("ms"))),
        _block(2, "section", about),
        F.when(_filled(meta).isNotNull(), _block(
            3, "section", F.concat(F.lit("*Description:* "), _safe(meta, text_limit)))),
        F.when(n_deals > 0, _block(4, "divider", None)),
        F.when(n_deals > 0, _block(5, "section", F.concat(
            F.lit("*🎯 Deals Found ("), n_deals.cast("string"), F.lit("):*")))),
    ]
    shown = F.transform(
        F.slice(deals, 1, max_deals),
        lambda deal, i: _block(6 + i, "section", deal_text(deal, max_description, text_limit)),
    )
    key_lines = F.transform(keys, lambda k: F.concat(F.lit("• "), _safe(k, text_limit)))
    only_keys = (n_deals == 0) & (F.size(keys) > 0)
    tail = [
        F.when(n_deals > max_deals, _block(6 + max_deals, "context", F.concat(
            F.lit("_... and "), (n_deals - max_deals).cast("string"),
            F.lit(" more deals found on the page_")))),
        F.when(only_keys, _block(7 + max_deals, "divider", None)),
        F.when(only_keys, _block(8 + max_deals, "section", F.concat(
            F.lit("*Key Elements Found:*\n"), F.array_join(key_lines, "\n")))),
    ]
    if footer is not None:
        tail.append(_block(9 + max_deals, "context", footer))
    return _explode_blocks(summaries, F.concat(F.array(*fixed), shown, F.array(*tail)))
