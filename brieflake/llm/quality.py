"""Quality rules: measures of a text, and lines that too many documents of a host share. DataFrame functions only.

Words: `[^\\x20\\x09-\\x0D]+`. A line's normal form is its words joined by one space, in lower case, digits as 0; lines
without a word don't count. Within a host (a column, `source` by default; null is a host of its own), a line is above the limits if more than LINE_DOCS
documents hold it, and more than one in LINE_SHARE of the host's documents. Such lines are removed. A document is depleted if
fewer than MIN_WORDS words or less than LEFT percent of its words are left; a document without a removed line never is.

Documents are counted by (host, text): exact copies are one document, so copies don't make each other's lines frequent
(they are the business of near-dedup). Lines and texts are compared by two 64-bit hashes each.

Texts are scanned once, for their measures and their lines' hashes; all else works on those. Lines are pre-aggregated
before they are shuffled, and frequent keys are joined by broadcast (join_hot), so no line, host or text meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import join_hot, materialize

MIN_WORDS = 20
#: Words in repeated windows of WINDOW words: at most this percentage of all words.
REPEATED = 30
WINDOW = 8
LINE_DOCS = 10
LINE_SHARE = 100
LEFT = 50

#: White space that isn't one space or one line feed.
_ODD_SPACE = r"[\t\x0B-\r][\x20\t\x0B-\r]*+|\x20[\x20\t\x0B-\r]++"
ID = ["a", "b"]
LINE = ["k1", "k2"]


def _bound(value: Column, use) -> Column:
    """use(value), with value made once: as a lambda's variable it isn't computed again for each element."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of `window` words (a power of two) that comes twice or more, the first one included.

    A window's hash is made of those of its halves. Only where a hash repeats are they sorted, with their places. Each
    repeated window adds the words up to the next one, `window` at most.
    """

    def places(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        again = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, F.lit(window), lambda s, x: s + x)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _bound(_bound(ordered, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def doubling(half: int):
        def doubled(h: Column) -> Column:
            n = F.size(h) - half
            return F.zip_with(F.slice(h, 1, n), F.slice(h, half + 1, n), lambda x, y: F.xxhash64(x, y))

        return doubled

    hashes, half = F.transform(w, lambda x: F.xxhash64(x)), 1
    while half < window:
        hashes, half = _bound(hashes, doubling(half)), 2 * half
    return F.when(F.size(w) <= window, F.lit(0)).otherwise(_bound(hashes, counted)).cast("long")


def _line_struct(line: Column, host: Column) -> Column:
    """The two hashes of a normal line in its host, and its words."""
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.struct(F.xxhash64(host, line).alias("k1"), F.xxhash64(F.lit(1), host, line).alias("k2"), F.when(line == "", 0).otherwise(words).alias("words"))


def _identity(text: Column, host: Column) -> list[Column]:
    return [F.xxhash64(host, text).alias("a"), F.xxhash64(F.lit(1), host, text).alias("b")]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, a, b (which text of the host), the measures, base_failed, lines (array of k1, k2, words), written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t, h = F.col("text"), F.col("host")
    got = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), text.alias("text")).select("*", F.regexp_replace(t, _ODD_SPACE, " ").alias("spaced"))
    got = got.select(
        "doc_id", "host", *_identity(t, h), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(F.replace("spaced", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"),
        F.split(F.regexp_replace(F.lower("spaced"), "[1-9]", "0"), "\n").alias("normal"),
    )
    got = got.select(
        "doc_id", "host", *ID, F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"), "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
        F.transform("normal", lambda x: _bound(F.trim(x), lambda line: _line_struct(line, h))).alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return materialize(got.withColumn("base_failed", failed), "quality-measured")


def removed_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE) -> DataFrame:
    """a, b, copies, n_removed_lines, removed_words, places (line numbers from 0) of the texts that hold lines above the limits, written."""
    # once per text, however many documents have it
    lines = materialize(
        rows.select("host", *ID, F.posexplode("lines").alias("place", "l")).filter("l.words > 0")
        .groupBy(*ID, "place").agg(F.first("host").alias("host"), F.first("l").alias("l"), F.count("*").alias("copies"))
        .select("host", *ID, "place", "l.*", "copies"), "quality-lines",
    )
    texts = lines.groupBy("host", *LINE).agg(F.countDistinct(*ID).alias("docs"), F.count("*").alias("n")).filter(F.col("docs") > line_docs)
    hosts = materialize(rows.groupBy("host").agg(F.countDistinct(F.when(F.col("n_words") > 0, F.struct(*ID))).alias("of")).select(F.xxhash64("host").alias("h"), F.col("host").isNull().alias("none"), "of"), "quality-hosts")
    keyed = texts.select(F.xxhash64("host").alias("h"), F.col("host").isNull().alias("none"), *LINE, "docs", "n")
    above = materialize(join_hot(keyed, hosts, ["h", "none"], "of").filter(F.col("docs") * line_share > F.col("of")).select(*LINE, "n"), "quality-above")
    hit = join_hot(lines, above, LINE, "n")
    return materialize(hit.groupBy(*ID).agg(F.max("copies").alias("copies"), F.count("*").alias("n_removed_lines"), F.sum("words").cast("long").alias("removed_words"), F.collect_list("place").alias("places")), "quality-removed")


def rate(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE, left: int = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines, removed_words of every document.

    docs (doc_id, text, host). kept: not base_failed and not depleted. Null or empty text: no words, so base_failed. Very
    long texts: whole. Null doc_id: kept as null. Null host: a host of its own. Repeated rows: each rated, counted as one
    document. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = measured(docs, host)
    gone = removed_lines(rows, line_docs, line_share).drop("places")
    got = join_hot(rows.drop("lines", "host"), gone, ID, "copies", "left").fillna(0, ["n_removed_lines", "removed_words"])
    rest = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((rest < MIN_WORDS) | (100 * rest < left * F.col("n_words")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_removed_lines", "removed_words")


def clean(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE, left: int = LEFT) -> DataFrame:
    """The documents that are kept, all columns as they are, `text` without the lines above the limits.

    Cases as for rate(); lines that stay are as they were, joined by line feeds.
    """
    columns, name = docs.columns, "__quality"
    rows = measured(docs, host)
    gone = removed_lines(rows, line_docs, line_share)
    words_of = rows.groupBy(*ID).agg(F.first("n_words").alias("n_words"), F.first("base_failed").alias("base_failed"), F.count("*").alias("copies"))
    state = words_of.join(gone.drop("copies"), ID, "left").fillna(0, ["removed_words"])
    rest = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((rest < MIN_WORDS) | (100 * rest < left * F.col("n_words")))
    keep = materialize(state.filter(~F.col("base_failed") & ~depleted).select(*ID, "copies", "places"), "quality-kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias(name), *_identity(text, F.col(host).cast("string")), text.alias("t"))
    got = join_hot(whole, keep, ID, "copies")
    lines = F.split("t", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("places", F.array().cast("array<int>")))
    shorter = F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda x: F.array_join(F.transform(x["s"], lambda i: F.get(x["l"], i)), "\n"))[0]
    return got.select(*[(F.when(F.col("places").isNull(), F.col("t")).otherwise(shorter) if c == "text" else F.col(name)[c]).alias(c) for c in columns])


def oracle_sql(line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE, left: int = LEFT) -> str:
    """rate() as DuckDB SQL over `documents` (unique doc_id)."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, x, line, regexp_extract_all(line, {word}) AS lw FROM (SELECT doc_id, source, x, unnest(string_split(x, chr(10))) AS line FROM t)),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE len(lw) > 0 GROUP BY 1),
base AS (SELECT doc_id, source, x, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
nl AS (SELECT doc_id, source, x, len(lw) AS words, regexp_replace(lower(array_to_string(lw, ' ')), '[1-9]', '0', 'g') AS k FROM l WHERE len(lw) > 0),
ho AS (SELECT source, count(DISTINCT x) AS n FROM t WHERE len(w) > 0 GROUP BY 1),
fr AS (SELECT f.source, f.k FROM (SELECT source, k, count(DISTINCT x) AS docs FROM nl GROUP BY 1, 2) f JOIN ho ON ho.source IS NOT DISTINCT FROM f.source WHERE docs > {line_docs} AND docs * {line_share} > n),
gone AS (SELECT doc_id, count(*) AS n, sum(words) AS words FROM nl JOIN fr ON fr.source IS NOT DISTINCT FROM nl.source AND fr.k = nl.k GROUP BY 1),
r AS (SELECT base.*, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM base LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {MIN_WORDS} OR 100 * (n_words - removed_words) < {left} * n_words)) AS kept, n_removed_lines, removed_words FROM r"""
