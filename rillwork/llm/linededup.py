"""Line dedup: lines that occur in many documents are dropped from all of them.

Each document's distinct normalised lines are hashed, and distinct documents are counted by hash: pairs of hash and doc_id, 16
bytes each, are made distinct in one shuffle, which spreads even a line of all documents, and counted in a second one with partial
counts before it. The frequent hashes, a small table, meet the lines again; what travels then is positions. Texts are only shuffled
if the table of affected texts is too large to broadcast (its rows and positions are counted). All of it is JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, fresh, small, tidy

FREQUENT_ROWS, AFFECTED_ROWS, AFFECTED_POSITIONS = 500_000, 100_000, 2_000_000


@dataclass(frozen=True)
class LineConfig:
    """max_documents: a line stays if at most so many documents have it. min_chars: shorter normalised lines always stay.
    max_documents_long: None, or the limit for lines of more than ``long_words`` blank-separated words."""

    max_documents: int = 20
    min_chars: int = 1
    max_documents_long: int | None = None
    long_words: int = 50


#: Passages of over 50 words go as soon as two documents have them.
PASSAGES = LineConfig(max_documents_long=1)


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _hashes(config: LineConfig) -> Column:
    """Of each line the hash of its normal form (lower case, runs of blanks as one, none at the ends), null for lines that stay. Where
    long lines have a limit of their own, the last bit says whether the line is long."""

    def one(line: Column) -> Column:
        normal = F.lower(F.trim(F.regexp_replace(line, "[ \\t\\r]+", " ")))
        key = F.xxhash64(normal)
        if config.max_documents_long is not None:
            long = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) >= config.long_words
            key = key.bitwiseAND(F.lit(-2)).bitwiseOR(long.cast("long"))
        return F.when(F.length(normal) >= max(1, config.min_chars), key)

    return F.transform(_lines(), one)


def frequent_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(line_hash, documents) of the lines in more documents than their limit. A document is a distinct doc_id, whatever rows it has; rows
    with a null doc_id are documents of their own."""
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    hashes = docs.select("doc_id", own.alias("own"), F.explode(F.array_compact(F.array_distinct(_hashes(config)))).alias("line_hash")).distinct()
    limit = F.lit(config.max_documents)
    if config.max_documents_long is not None:
        limit = F.when(F.col("line_hash").bitwiseAND(F.lit(1)) == 1, config.max_documents_long).otherwise(limit)
    return hashes.groupBy("line_hash").agg(F.count("*").alias("documents")).where(F.col("documents") > limit)


def drop_frequent_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` without frequent lines, with the columns n_lines and n_dropped.

    docs needs doc_id and text. A document is a distinct doc_id: repeated rows count once, and all of them lose a frequent line; rows
    with a null doc_id are documents of their own. A line that occurs twice in a document counts once, and both go. Blank lines always stay. A null text stays null with 0 lines; an empty text is one blank line. A
    text all of whose lines go becomes empty. Other columns pass through (n_chars too, as it was), but existing columns n_lines
    and n_dropped are replaced. A document that loses nothing keeps its text byte for byte. Ties (exactly as many
    documents as the limit) stay.
    """
    docs = tidy(docs, ["doc_id", "text"])
    docs = docs.select([c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    frequent = cut(frequent_lines(docs, config)).select("line_hash")
    # A text's positions depend on nothing but the text: copies, null and repeated ids need no row number.
    k1, k2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    exploded = docs.where(F.col("text").isNotNull()).select(k1.alias("k1"), k2.alias("k2"), F.posexplode(_hashes(config)).alias("at", "line_hash")).where(F.col("line_hash").isNotNull())
    hits = exploded.join(small(frequent, FREQUENT_ROWS), "line_hash")
    affected = cut(hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")))
    names = {c: fresh(docs, f"__{c}") for c in ("k1", "k2", "gone", "lines")}
    base = docs.select("*", k1.alias(names["k1"]), k2.alias(names["k2"]), _lines().alias(names["lines"]))
    size = affected.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("positions")).first()
    affected = affected.withColumnsRenamed(names)
    if size["n"] <= AFFECTED_ROWS and size["positions"] <= AFFECTED_POSITIONS:
        affected = F.broadcast(affected)
    joined = base.join(affected, [names["k1"], names["k2"]], "left")
    lines, gone = F.col(names["lines"]), F.col(names["gone"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    counts = [F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped")]
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


def line_sql(config: LineConfig = LineConfig()) -> str:
    limit = f"{config.max_documents}"
    if config.max_documents_long is not None:
        limit = f"CASE WHEN len(string_split(norm, ' ')) > {config.long_words} THEN {config.max_documents_long} ELSE {limit} END"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), normal AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS norm FROM lines),
frequent AS (SELECT norm FROM normal WHERE length(norm) >= {max(1, config.min_chars)} GROUP BY norm HAVING count(DISTINCT doc_id) > {limit}),
marked AS (SELECT n.*, f.norm IS NOT NULL AS gone FROM normal n LEFT JOIN frequent f ON n.norm = f.norm)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
