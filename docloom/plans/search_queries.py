"""Search over the driver's documents, web pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plans.registry import query
from docloom.session import table

LITERAL = "the of"
_FORM = "lower(translate({0}, 'ĠġĢģ‟İI', 'iŞşş\"iı'))"
_PATTERN = r"the\s+of"


def _positions_sql(source: str) -> str:
    """(columns of ``source``, start, end) of the matches of the literal in ``t``; ``source`` has id columns and t."""
    return f"""
m AS (SELECT *, regexp_extract_all(f, '({_PATTERN})', 1) AS w, string_split_regex(f, '{_PATTERN}') AS s
  FROM (SELECT *, {_FORM.format("t")} AS f FROM {source})),
h AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
p AS (SELECT *, CAST(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i-1]]), 0) AS INTEGER) AS start FROM h)"""


@query(f"SELECT doc_id, CAST(coalesce(len(regexp_extract_all({_FORM.format('text')}, '{_PATTERN}')), 0) AS BIGINT) AS hits FROM documents")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a literal in each document."""
    return search.count_by_document(table(spark, sf_dir, "documents"), LITERAL)


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), {_positions_sql("d")}
SELECT doc_id, start, start + CAST(length(w[i]) AS INTEGER) AS "end" FROM p""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its place, in code points."""
    return search.search(table(spark, sf_dir, "documents"), LITERAL).select("doc_id", "start", "end")


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), {_positions_sql("d")}
SELECT doc_id, start, start + CAST(length(w[i]) AS INTEGER) AS "end" FROM p
WHERE NOT (start > 0 AND regexp_matches(substring(f, start, 1), '[\\p{{L}}\\p{{N}}]'))
  AND NOT regexp_matches(substring(f, start + length(w[i]) + 1, 1), '[\\p{{L}}\\p{{N}}]')""")
def search_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that no letter or digit touches."""
    return search.search(table(spark, sf_dir, "documents"), LITERAL, whole_word=True).select("doc_id", "start", "end")


@query(f"""WITH a AS (
  SELECT doc_id AS doc_order, 'text' AS kind, CAST(1 AS INTEGER) AS page_no, 0 AS r, text AS t FROM documents
  UNION ALL SELECT page_id, 'outline', CAST(NULL AS INTEGER), 1, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages
  UNION ALL SELECT conv_id, 'comment', CAST(turn AS INTEGER), 2, text || ' ' || role FROM conversations),
{_positions_sql("a")}
SELECT doc_order, kind, page_no, start, CAST(row_number() OVER (PARTITION BY doc_order
  ORDER BY r, CASE WHEN kind = 'text' THEN page_no END, CASE WHEN kind = 'text' THEN start END, coalesce(page_no, 0) * 1000000 + start) AS INTEGER) AS rank FROM p""")
def search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, titles and comments searched together, in the order of the list of results."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_order"), F.lit("text").alias("kind"), F.lit(1).alias("page_no"), "text")
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_order"), F.lit("outline").alias("kind"), F.lit(None).cast("int").alias("page_no"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_order"), F.lit("comment").alias("kind"), F.col("turn").cast("int").alias("page_no"), F.concat_ws(" ", "text", "role").alias("text"))
    hits = search.search(texts.unionByName(titles).unionByName(turns), LITERAL)
    hits = hits.withColumn("pos", F.coalesce("page_no", F.lit(0)).cast("long") * 1_000_000 + F.col("start"))
    return search.in_order(hits).select("doc_order", "kind", "page_no", "start", "rank")


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), {_positions_sql("d")} SELECT DISTINCT doc_id, start FROM p""")
def hit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of overlapping searches, each place once."""
    docs = table(spark, sf_dir, "documents")
    twice = search.search(docs, LITERAL).unionByName(search.search(docs, LITERAL.upper().replace("I", "İ")))
    return search.one_hit_each(twice.select("doc_id", "start"), "doc_id", "start")


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), {_positions_sql("d")},
n AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, start, CAST((i + 1) % n AS INTEGER) AS next, CAST((i - 1 + n) % n AS INTEGER) AS previous FROM n""")
def hit_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous hit of each, around the ends of its document."""
    from pyspark.sql import Window

    hits = search.search(table(spark, sf_dir, "documents"), LITERAL).select("doc_id", "start")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    n = F.count("*").over(Window.partitionBy("doc_id")).cast("int")
    return hits.select("doc_id", "start", search.neighbour(index, 1, n).alias("next"), search.neighbour(index, -1, n).alias("previous"))


@query(f"""WITH d AS (SELECT conv_id AS doc_id, turn AS page_no, text AS t FROM conversations), {_positions_sql("d")},
g AS (SELECT doc_id, min(CASE WHEN page_no >= 2 THEN page_no * 1000000 + start END) AS onward, min(page_no * 1000000 + start) AS first FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(onward, first) // 1000000 AS page_no, CAST(coalesce(onward, first) % 1000000 AS INTEGER) AS start FROM g""")
def hit_first_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit on or after page 2 of each conversation, its turns as pages."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return search.first_from(search.search(pages, LITERAL), 2)


@query("""SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id""")
def page_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of a page from its items in order, each ending its line."""
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("pos"), F.col("text").alias("str"), F.lit(True).alias("eol"), F.lit(False).alias("recognised"))
    return search.page_texts(items).select("doc_id", "text")
