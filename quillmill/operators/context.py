"""Text around a page or an item, within a budget of characters; no more of a page is gathered than its budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cut_to(text: Column, most: int) -> Column:
    """At most `most` characters; a longer text ends in dots, without white space before them."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def _joined(chunks: Column, most: int) -> Column:
    return cut_to(T.normalize(F.array_join(chunks, " ")), most)


def page_contexts(centers: DataFrame, items: DataFrame, most: int = 5000) -> DataFrame:
    """id, pages, text of centers(id, doc, page): texts of the items(doc, page, pos, text) on its page and the next, or the one before if the document has no next.

    Chunks are `[page p] text` in order of pos, until the budget is used. A page that the document does not have gives no pages of its own; centers without a page,
    or of unknown documents, have none and an empty text. Items without a page or a text are passed over. Ids are distinct.
    """
    own = items.where("doc IS NOT NULL AND page IS NOT NULL")
    there = own.select("doc", "page").distinct()
    clean = own.withColumn("text", T.normalize(F.col("text"))).where("text <> ''")
    # of each page no more than the budget, by the length of what comes before
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc", "page").orderBy("pos")) - F.length("text") - 1
    kept = clean.withColumn("_before", before).where(F.col("_before") < most)
    chunk = F.struct("pos", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("] "), F.substring("text", 1, most)).alias("t"))
    page_text = kept.groupBy("doc", "page").agg(F.collect_list(chunk).alias("chunks"))
    asked = centers.select("id", "doc", "page", F.explode_outer(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("p"))
    found = asked.join(there.withColumnRenamed("page", "p"), ["doc", "p"], "left_semi")
    following = F.max(F.col("p") > F.col("page")).over(Window.partitionBy("id"))
    found = found.withColumn("_next", following).where("p >= page OR NOT _next")
    both = found.join(page_text.withColumnRenamed("page", "p"), ["doc", "p"], "left").groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("pages"), F.array_sort(F.flatten(F.collect_list("chunks"))).alias("c"))
    text = _joined(F.transform("c", lambda x: x["t"]), most)
    none = F.array().cast(f"array<{dict(items.dtypes)['page']}>")
    done = both.select("id", "pages", text.alias("text"))
    return centers.select("id").join(done, "id", "left").select("id", F.coalesce("pages", none).alias("pages"), F.coalesce("text", F.lit("")).alias("text"))


def item_windows(centers: DataFrame, items: DataFrame, before: int = 8, after: int = 8, most: int = 2500) -> DataFrame:
    """id, n, text of centers(id, doc, pos): n items(doc, page, pos, text) with a text from `before` places before it to `after` behind it.

    Chunks are `[item i page p] text` (p empty if unknown) in order, cut to the budget. A center without a place has no items. Ids and the items' places in a document are distinct.
    """
    window = F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("pos")
    clean = items.withColumn("text", T.normalize(F.col("text"))).where("text <> ''")
    head = F.concat(F.lit("[item "), F.col("pos").cast("string"), F.lit(" page "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("] "))
    chunk = F.struct("pos", F.concat(head, F.substring("text", 1, most)).alias("t"))
    near = centers.where("pos IS NOT NULL").select("id", "doc", window).join(clean.select("doc", "pos", "page", "text"), ["doc", "pos"])
    found = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(chunk)).alias("c"))
    done = found.select("id", "n", _joined(F.transform("c", lambda x: x["t"]), most).alias("text"))
    return centers.select("id").join(done, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
