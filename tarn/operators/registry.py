"""Changes to the watched pages and the stored postings, as new versions of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import strip
from tarn.functions.url import label


def bulk_add(pages: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, counts). urls: pos, url. Blank ones are passed over, repeated ones count once, ones that are
    no address are invalid, and known ones are skipped. added: url, label; counts: added, skipped, invalid."""
    asked = urls.withColumn("url", strip(F.coalesce("url", F.lit("")))).filter("url != ''")
    first = Window.partitionBy("url").orderBy("pos")
    valid = F.col("url").rlike(r"(?i)^(https?://[^/?#\s]+|(?!https?:)[a-z][a-z0-9+.-]*:\S)")
    marked = asked.select("pos", "url", valid.alias("valid"), F.row_number().over(first).alias("rn"))
    known = pages.select("url", F.lit(True).alias("known")).distinct()
    rows = marked.filter("not valid or rn = 1").join(known, "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    added = rows.filter("valid and not known").select("url", label(F.col("url")).alias("label"))
    counts = rows.agg(F.count_if(F.expr("valid and not known")).alias("added"), F.count_if(F.expr("valid and known")).alias("skipped"), F.count_if(~F.col("valid")).alias("invalid"))
    return added, counts


def update_page(pages: DataFrame, page_id, active: bool | None = None, name: str | None = None) -> DataFrame:
    own = F.col("page_id") == page_id
    changes = {k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in (("active", active), ("label", name and name.strip())) if v is not None}
    return pages.withColumns(changes) if changes else pages


def delete_pages(pages: DataFrame, postings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, postings) without the pages of gone (page_id) and all that was found on them; what duplicated
    a posting that went duplicates nothing any more."""
    ids = gone.select("page_id").distinct()
    kept = postings.join(ids, "page_id", "left_anti")
    return pages.join(ids, "page_id", "left_anti"), without_dangling(kept, kept, "duplicate_of", "id")


def without_dangling(rows: DataFrame, others: DataFrame, column: str, key: str) -> DataFrame:
    """rows with column set to null where others has no such key."""
    known = others.select(F.col(key).alias("__known")).distinct()
    joined = rows.join(known, F.col(column) == F.col("__known"), "left")
    return joined.withColumn(column, F.col("__known")).select(*rows.columns)


def reset_crawls(pages: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, postings) to fetch everything anew: no postings, no hashes, errors or claims. First crawls stay
    done, so what is found next is screened."""
    nothing = {c: F.lit(None).cast(pages.schema[c].dataType) for c in ("last_content_hash", "last_error", "poll_claimed_at") if c in pages.columns}
    return pages.withColumns({**nothing, "failure_count": F.lit(0)}), postings.limit(0)


def company_facts(dossier: Column) -> Column:
    """The known facts of a dossier, in the order in which they are shown."""
    plain = [F.nullif(dossier[c], F.lit("")) for c in ("industry", "size_estimate", "stage", "funding")]
    return F.array_compact(F.array(*plain, F.when(F.coalesce(dossier["founded"], F.lit("")) != "", F.concat(F.lit("founded "), dossier["founded"]))))
