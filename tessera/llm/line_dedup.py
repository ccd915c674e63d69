"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line's ratio is the host's pages that hold it over all
pages of the host, and lines above ``max_ratio`` on at least ``min_pages`` pages go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Hosts' boilerplate lists are broadcast up to so many line keys, else joined by host.
BROADCAST_KEYS = 200_000
#: Parts into which each host's pages are dealt for the join by host.
SALTS = 32


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n_pages, n_host_pages): the lines above the ratio, by the hash of the trimmed line.

    Counts are summed before they are shuffled, so a host with a third of all pages, or a
    line on all of them, is a few rows from each task. A host has fewer than 1 / max_ratio
    times as many such lines as its pages have lines on average.
    """
    pages = docs.select(_named(docs, host).alias("host"), _named(docs, text).alias("text")).where("host is not null")
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_host_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    lines = pages.where("text is not null").select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return lines.join(total, "host").where(F.col("n_pages") / F.col("n_host_pages") > max_ratio)


def _named(docs: DataFrame, column: str) -> Column:
    return docs["`" + column.replace("`", "``") + "`"]


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus, with ``counts``, ``n_lines`` and ``n_dropped``.

    ``n_chars``, if there, is counted again. Every row stays: a null text stays null with
    no lines, a text of boilerplate alone becomes empty, a null host's pages stay as they
    are, blank lines stay, repeated rows count as pages each. Lines equal but for
    outer spaces are one. Columns of any name are kept as they are; only with ``counts``
    do the counts take the place of columns of their names.
    """
    names = docs.columns
    bad = written(boilerplate(docs, host, text, max_ratio, min_pages).groupBy("host").agg(F.collect_list("key").alias("bad")).select(F.col("host").alias("bad_host"), "bad"), "lines")
    size = bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0)).alias("n")).first()["n"]
    # Under names of our own, whatever theirs are.
    mine = docs.select(*(_named(docs, c).alias(f"c{k}") for k, c in enumerate(names)))
    at, body = f"c{names.index(host)}", F.col(f"c{names.index(text)}")
    if size <= BROADCAST_KEYS:
        joined = mine.join(F.broadcast(bad), F.col(at) == F.col("bad_host"), "left")
    else:
        # A host's pages are dealt by their place in the input, so equal texts are dealt too.
        salted = mine.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        wide = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(wide, (F.col(at) == F.col("bad_host")) & (F.col("salt") == F.col("part")), "left")
    split = F.split(body, "\n")
    kept = F.when(F.col("bad").isNull(), split).otherwise(F.filter(split, lambda x: ~((F.trim(x) != "") & F.array_contains(F.col("bad"), _key(x)))))
    out = joined.withColumn("kept", kept).withColumn("n_lines", F.when(body.isNull(), 0).otherwise(F.size(split)))
    out = out.withColumn("n_dropped", F.when(body.isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")))
    out = out.withColumn("new", F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(body))
    new = {text: F.col("new")} | ({"n_chars": F.length("new").cast("bigint")} if "n_chars" in names else {})
    ours = ["n_lines", "n_dropped"] if counts else []
    return out.select(*(new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(names) if c not in ours), *ours)


def query(docs: DataFrame) -> DataFrame:
    return drop_boilerplate(docs).select("doc_id", "source", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_dropped").cast("bigint").alias("n_dropped"), F.md5(F.col("text")).alias("text_md5"))


SQL = f"""
with l as (select source, doc_id, unnest(string_split(text, chr(10))) line from documents),
h as (select source, count(*) n from documents where source is not null group by 1),
bad as (
  select source, trim(line) line from l join h using (source) where trim(line) <> ''
  group by source, trim(line), n having count(distinct doc_id) >= {MIN_PAGES} and count(distinct doc_id) / n > {MAX_RATIO}
),
b as (select source, list(line) bad from bad group by 1),
k as (
  select doc_id, source, text, string_split(text, chr(10)) parts,
    list_filter(string_split(text, chr(10)), lambda x: not (trim(x) <> '' and list_contains(coalesce(bad, []), trim(x)))) kept
  from documents left join b using (source)
)
select doc_id, source, coalesce(len(parts), 0)::bigint n_lines, coalesce(len(parts) - len(kept), 0)::bigint n_dropped,
  md5(array_to_string(kept, chr(10))) text_md5 from k
"""
