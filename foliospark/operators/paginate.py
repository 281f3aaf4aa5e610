"""Page closure: following links from page to page, all start pages side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written as _written
from .ordered import numbered


def closure(starts: DataFrame, links: DataFrame, max_pages: int = 50) -> DataFrame:
    """start, url, step: every page that each start reaches in at most max_pages steps, with the fewest steps.

    starts has url, links has url and next. Each round joins the last round's new pages to the links and
    drops what was seen; a cycle ends by itself. Rounds are written tables, so that the plan stays small.
    """
    links = links.select("url", "next").distinct()
    seen = _written(starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("step")).distinct())
    front = seen
    for step in range(1, max_pages + 1):
        new = front.join(links, "url").select("start", F.col("next").alias("url")).distinct()
        new = _written(new.join(seen, ["start", "url"], "left_anti").withColumn("step", F.lit(step)))
        if new.isEmpty():
            break
        seen, front = seen.union(new), new
        if step % 8 == 0:
            seen = _written(seen)
    return seen


def followed(pages: DataFrame, max_pages: int = 50, stop: DataFrame | None = None) -> DataFrame:
    """start, pages, items, stopped_by of chains of pages (start, url, next, items array) given as a table of all pages.

    A chain ends without a next page (end), at a page without items (zero-new), at one without new items
    (loop), at an address of another chapter (chapter-boundary, from stop (url)) or at the limit (cap).
    """
    rows = pages.select("start", "url", "next", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    if stop is not None:
        rows = rows.join(stop.select(F.col("url").alias("next"), F.lit(True).alias("other")).distinct(), "next", "left")
    else:
        rows = rows.withColumn("other", F.lit(False))
    rows = rows.select("start", "url", "next", "items", F.coalesce("other", F.lit(False)).alias("other"))
    none = F.array().cast("array<string>")
    state = rows.filter(F.col("start") == F.col("url")).select("start", F.col("url").alias("at"), none.alias("urls"), none.alias("items"), F.lit(0).alias("pages"), F.lit(None).cast("string").alias("stopped_by"))
    state = _written(state)
    for step in range(max_pages + 1):
        live = state.filter("stopped_by IS NULL")
        if live.isEmpty():
            break
        if step == max_pages:
            state = live.withColumn("stopped_by", F.lit("cap")).union(state.filter("stopped_by IS NOT NULL"))
            break
        s, p = live.alias("s"), rows.alias("p")
        met = s.join(p, (F.col("s.start") == F.col("p.start")) & (F.col("s.at") == F.col("p.url")), "left")
        new = F.array_except(F.coalesce("p.items", none), "s.items")
        urls = F.array_append("s.urls", F.col("s.at"))
        nxt = F.when(F.array_contains(urls, F.col("p.next")), None).otherwise(F.col("p.next"))
        why = F.when(F.size(F.coalesce("p.items", none)) == 0, "zero-new").when(F.size(new) == 0, "loop").when(F.col("p.other") & nxt.isNotNull(), "chapter-boundary").when(nxt.isNull(), "end")
        after = met.select("s.start", nxt.alias("at"), urls.alias("urls"), F.concat("s.items", new).alias("items"), (F.col("s.pages") + 1).alias("pages"), why.alias("stopped_by"))
        state = _written(after.union(state.filter("stopped_by IS NOT NULL")))
    return state.select("start", "pages", "items", "stopped_by")


def _steps(pages: DataFrame, max_pages: int) -> DataFrame:
    """pages with step: the number of the page on its start's chain (from 0), for those that it reaches in fewer than max_pages steps.

    By pointer doubling: a round joins every page's jump with itself, and what is reached so far with the jumps; log2(max_pages) rounds.
    """
    jumps = pages.filter("next IS NOT NULL").select("start", "url", F.col("next").alias("to"))
    reached = pages.filter(F.col("start") == F.col("url")).select("start", "url", F.lit(0).alias("step"))
    far = 1
    while far < max_pages:
        jumps = _written(jumps)
        more = reached.join(jumps, ["start", "url"]).select("start", F.col("to").alias("url"), (F.col("step") + far).alias("step"))
        # a page that was reached before (a cycle) keeps its first step
        reached = _written(reached.union(more.filter(F.col("step") < max_pages)).groupBy("start", "url").agg(F.min("step").alias("step")))
        after = jumps.select("start", F.col("url").alias("to"), F.col("to").alias("then"))
        jumps, far = jumps.join(after, ["start", "to"]).select("start", "url", F.col("then").alias("to")), far * 2
    return reached.join(pages, ["start", "url"])


def stopped(pages: DataFrame, max_pages: int = 50, stop: DataFrame | None = None, count_lost: bool = True) -> tuple[DataFrame, DataFrame]:
    """How each chain of pages (start, url, next, items array) ends: (start, pages, n_items, stopped_by), and its items (start, step, place, item).

    A chain ends at a page without items (zero-new), at one without new items (loop), before an address of stop (url) (chapter-boundary), without a
    next page that it hasn't read (end), or at the limit (cap); of several reasons at a page the first one counts. An item stands
    once, where it comes first. A next page that isn't there has no items, and is one of the chain's pages if count_lost; a start without its own page has no row. Null items are
    none. No chain is walked page by page.
    """
    none = F.array().cast("array<string>")
    rows = pages.select("start", "url", "next", F.coalesce("items", none).alias("items"))
    lost = rows.filter("next IS NOT NULL").select("start", F.col("next").alias("url")).distinct().join(rows.select("start", "url"), ["start", "url"], "left_anti")
    rows = rows.withColumn("lost", F.lit(0)).unionByName(lost.select("start", "url", F.lit(None).cast("string").alias("next"), none.alias("items"), F.lit(1).alias("lost")))
    rows = _written(rows)
    walked = _written(_steps(rows, max_pages))
    said = walked.select("start", "step", F.posexplode("items").alias("place", "item"))
    first = _written(said.groupBy("start", "item").agg(F.min(F.struct("step", "place")).alias("at")).select("start", F.col("at.step").alias("step"), F.col("at.place").alias("place"), "item"))
    new = first.groupBy("start", "step").agg(F.count("*").alias("n_new"))
    seen = walked.select("start", F.col("url").alias("next"), F.col("step").alias("next_step"))
    state = walked.join(new, ["start", "step"], "left").join(seen, ["start", "next"], "left")
    if stop is not None:
        state = state.join(stop.select(F.col("url").alias("next"), F.lit(True).alias("other")).distinct(), "next", "left")
    else:
        state = state.withColumn("other", F.lit(False))
    on = F.col("next").isNotNull() & F.coalesce(F.col("next_step") > F.col("step"), F.lit(True))
    why = F.when(F.size("items") == 0, "zero-new").when(F.col("n_new").isNull(), "loop").when(on & F.coalesce("other", F.lit(False)), "chapter-boundary").when(~on, "end").when(F.col("step") == max_pages - 1, "cap")
    ends = state.withColumn("why", why).filter("why IS NOT NULL").groupBy("start").agg(F.min(F.struct("step", "why", "lost")).alias("e"))
    read = F.col("e.step") + 1 - (0 if count_lost else F.col("e.lost"))
    ends = _written(ends.select("start", F.col("e.step").alias("last"), read.cast("long").alias("pages"), F.col("e.why").alias("stopped_by")))
    items = first.join(ends.select("start", "last"), "start").filter("step <= last").drop("last")
    counts = items.groupBy("start").agg(F.count("*").alias("n_items"))
    return ends.join(counts, "start", "left").select("start", "pages", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "stopped_by"), items


def visits(starts: DataFrame, links: DataFrame) -> DataFrame:
    """book, doc, step, place: everything that a book's starts (book, doc, rank) reach by links (book, doc, ord, to), in the order of a queue.

    The starts come first, by rank (reading order, then navigation); then, from the first document of the queue to the last, what
    each links to, in the order of its links, if nothing before did. A document of several labels keeps the least one. Places are from 0 and number all documents of a book.
    Rounds go by steps from the starts; each numbers its documents by the place of who found them first, over all partitions.
    """
    first = starts.groupBy("book", "doc").agg(F.min("rank").cast("long").alias("label"))
    front = _written(numbered(first.select("book", "doc", "label"), "book", "label", "doc"))
    seen = front = _written(front.select("book", "doc", F.lit(0).alias("step"), F.col("n").alias("place")))
    links = links.select("book", "doc", "ord", "to")
    step = 0
    while True:
        step += 1
        found = front.join(links, ["book", "doc"]).select("book", F.col("to").alias("doc"), F.struct(F.col("place").alias("by"), F.col("ord").cast("long").alias("ord")).alias("label"))
        new = found.groupBy("book", "doc").agg(F.min("label").alias("label")).join(seen.select("book", "doc"), ["book", "doc"], "left_anti")
        new = _written(new.select("book", "doc", "label"))
        if new.isEmpty():
            return seen
        before = seen.groupBy("book").agg(F.count("*").alias("before"))
        placed = numbered(new, "book", "label", "doc").join(before, "book")
        front = _written(placed.select("book", "doc", F.lit(step).alias("step"), (F.col("before") + F.col("n")).alias("place")))
        seen = seen.union(front)
        if step % 8 == 0:
            seen = _written(seen)
