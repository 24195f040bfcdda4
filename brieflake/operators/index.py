"""A persisted inverted index for BM25: built once, asked often, kept up to date without reading old texts.

An index is a folder: `segments/<name>` holds blocks, `manifest` one version after another of what counts, `statistics` what a version's vocabulary
says, counted when it is first asked for. Documents go, as they come, into slots of at most BLOCK documents (about so many after `compact`). A block is a term's postings in one slot, ordered by id,
with a header (how many, largest term frequency, smallest length), so no group grows with the corpus. The block without a term lists a slot's documents.
Blocks are made where the texts are read (operators.postings) and written without a shuffle, in pages: a row holds a slot's blocks of many terms. Documents
are taken out of pages row by row, without a shuffle either; only slots that become one in `compact` are shuffled, page by page.

A query reads headers first: a slot's bound is the sum, over the query's terms, of the impact of its header, which no document there can
exceed. The SEEDS best slots of each query are scored in full; their k-th score then rules out every slot whose bound is below it,
and only the blocks of the others are read. The result is exact.

A version is written last and names all its segments: a failed write leaves the version before it. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflake.operators import postings as PO
from brieflake.operators.ordered import running_sums
from brieflake.operators.retrieval import asked_terms, filled, idf_of, impact, small, top, weighed
from brieflake.sources.scratch import spread, written

#: Documents of a slot.
BLOCK = 512
#: Slots of a query that are scored before the others are ruled out.
SEEDS = 4

#: Bytes of a row group of pages: what a task holds of them at a time.
GROUP_BYTES = 16 << 20
#: Stored bytes up to which the ids that leave slots are a broadcast side, so that no page is shuffled for them.
GONE_BYTES = 64 << 20

_MANIFEST = "segment string, slots int, documents long, length long, n long, total_length long"
_STATISTICS = "vocabulary long, mean_idf double"


@dataclass
class State:
    """The current version: its segments, and the statistics of all documents."""

    spark: SparkSession
    path: str
    version: int
    segments: list[tuple[str, int]]
    n: int
    total_length: int

    @property
    def mean_idf(self) -> float:
        return statistics(self)[1]

    @property
    def mean_length(self) -> float:
        return self.total_length / self.n if self.n else 0.0


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return _stored(spark, f"{path}/manifest", f"{_MANIFEST}, version int")


def state(spark: SparkSession, path: str) -> State:
    """The newest version; an index without one is empty. A version without a segment has one row with a null name."""
    known = _versions(spark, path)
    last = known.agg(F.max("version")).first()[0] if known is not None else None
    if last is None:
        return State(spark, path, 0, [], 0, 0)
    rows = known.filter(F.col("version") == last).collect()
    return State(spark, path, last, [(r.segment, r.slots) for r in rows if r.segment], rows[0].n, rows[0].total_length)


def statistics(at: State) -> tuple[int, float]:
    """How many terms the version has, and their mean idf: counted from the headers once, then kept beside the manifest."""
    path = f"{at.path}/statistics/version={at.version}"
    known = _stored(at.spark, path, _STATISTICS)
    got = known.first() if known is not None else None
    if got is None:
        table = pages(at.spark, at)
        words = document_frequencies(headers(table)).agg(F.count("*").alias("v"), F.avg(idf_of(F.col("df"), at.n)).alias("mean")).first() if table is not None else None
        got = (words.v, words.mean or 0.0) if words else (0, 0.0)
        at.spark.createDataFrame([got], _STATISTICS).coalesce(1).write.mode("append").parquet(path)
    return got[0], got[1]


def pages(spark: SparkSession, at: State) -> DataFrame | None:
    """segment, bucket, and the columns of postings.PAGE, of all segments, in one scan; bucket -1 lists the documents."""
    if not at.segments:
        return None
    names = [name for name, _ in at.segments]
    return spark.read.option("basePath", f"{at.path}/segments").parquet(*[f"{at.path}/segments/segment={name}" for name in names])


def headers(table: DataFrame) -> DataFrame:
    """segment, slot, term, n, max_tf, min_len of the pages' blocks."""
    rows = table.filter("bucket = 0").select("segment", "slot", F.posexplode("term").alias("at", "term"), "n", "max_tf", "min_len")
    return rows.select("segment", "slot", "term", *[F.get(c, F.col("at")).alias(c) for c in ("n", "max_tf", "min_len")])


def blocks(table: DataFrame) -> DataFrame:
    """segment, slot, term, postings (array of id, tf, len) of the pages' blocks."""
    rows = table.filter("bucket = 0").select("segment", "slot", F.posexplode("term").alias("at", "term"), "n", "first", "id", "tf", "len")
    kind = table.schema["id"].dataType.elementType.simpleString()
    mine = F.arrays_zip(*[F.slice(c, F.get("first", F.col("at")) + 1, F.get("n", F.col("at"))) for c in ("id", "tf", "len")])
    return rows.select("segment", "slot", "term", mine.cast(f"array<struct<id:{kind},tf:int,len:int>>").alias("postings"))


def _write(table: DataFrame, path: str) -> str:
    """A segment of these pages; those that list documents lie apart."""
    name = uuid.uuid4().hex
    bucket = F.when(F.col("page") < 0, -1).otherwise(0).alias("bucket")
    spark, key = table.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    # both files of a task are open at once (from as many on as set, Spark sorts), so that pages aren't sorted to be written
    spark.conf.set(key, 3)
    try:
        table.select(bucket, *PO.PAGE).write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/segments/segment={name}")
    finally:
        spark.conf.set(key, before)
    return name


def document_frequencies(heads: DataFrame) -> DataFrame:
    """term, df: from the headers alone."""
    return heads.groupBy("term").agg(F.sum("n").alias("df"))


def _commit(spark: SparkSession, path: str, version: int, names: list[str]) -> State:
    """Sizes of the segments from their lists of documents, then the version that names them."""
    table = pages(spark, State(spark, path, version, [(name, 0) for name in names], 0, 0))
    sizes = {}
    if table is not None:
        sizes = {r.segment: (r.slots, r.documents, r.length) for r in table.filter("bucket = -1").groupBy("segment").agg(F.count("*").alias("slots"), F.sum(F.size("id")).alias("documents"), F.sum(F.aggregate("len", F.lit(0).cast("long"), lambda s, x: s + x)).alias("length")).collect()}
    n, total = sum(d for _, d, _ in sizes.values()), sum(x for _, _, x in sizes.values())
    rows = [(name, *sizes.get(name, (0, 0, 0)), n, total, version) for name in names] or [(None, 0, 0, 0, 0, 0, version)]
    spark.createDataFrame(rows, f"{_MANIFEST}, version int").coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")
    return State(spark, path, version, [(name, sizes.get(name, (0,))[0]) for name in names], n, total)


def _without(spark: SparkSession, at: State, ids: DataFrame) -> list[str]:
    """The segments without these documents (doc_id): a segment that holds some is written anew, from its pages."""
    table = pages(spark, at)
    if table is None:
        return []
    listed = table.filter("bucket = -1").select("segment", "slot", F.explode("id").alias("doc_id"))
    # at most a slot's documents in a row
    gone = written(listed.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("segment", "slot").agg(F.collect_list("doc_id").alias("gone")), "index-gone")
    hit = {r.segment for r in gone.select("segment").distinct().collect()}
    kept = [name for name, _ in at.segments if name not in hit]
    for name, _ in at.segments:
        if name in hit:
            mine, dying = table.filter(F.col("segment") == name), small(gone.filter(F.col("segment") == name).select("slot", "gone"), GONE_BYTES)
            kept.append(_write(PO.without(mine.join(dying, "slot", "left")), at.path))
    return kept


def upsert(docs: DataFrame, path: str) -> State:
    """Documents (doc_id, content; unique ids) into the index at path: ids that it holds are replaced, the others are added.

    The texts of `docs` are read once; of what is indexed, only pages of segments that hold replaced documents are
    written anew. An index that doesn't exist is made. Null content: a document without words.
    """
    spark = docs.sparkSession
    at = state(spark, path)
    kept = _without(spark, at, docs)
    documents = docs.count()
    if documents:
        kept.append(_write(PO.term_pages(spread(docs).select("doc_id", F.coalesce("content", F.lit("")).alias("content")), BLOCK), path))
    return _commit(spark, path, at.version + 1, kept)


def remove(ids: DataFrame, path: str) -> State:
    """The index without these documents (doc_id); ids that it doesn't hold are ignored."""
    spark = ids.sparkSession
    at = state(spark, path)
    return _commit(spark, path, at.version + 1, _without(spark, at, ids))


def compact(spark: SparkSession, path: str) -> State:
    """All segments as one, from their pages: no text is read. Slots in a row of under BLOCK documents in all become one; a
    slot that stays alone is taken over as it is."""
    at = state(spark, path)
    if len(at.segments) < 2:
        return at
    table = pages(spark, at)
    sums = running_sums(table.filter("bucket = -1").select("segment", "slot", F.size("id").cast("long").alias("n")), ["segment", "slot"], ["n"])
    placed = written(sums.select("segment", "slot", F.floor(F.col("n_before") / BLOCK).alias("into")), "index-places")
    alone = placed.groupBy("into").agg((F.count("*") == 1).alias("alone"))
    rows = table.join(small(placed.join(alone, "into")), ["segment", "slot"])
    stays = rows.filter("alone").withColumn("slot", F.col("into")).select(*PO.PAGE)
    return _commit(spark, path, at.version + 1, [_write(stays.unionByName(PO.merged(rows.filter("not alone"), "into")), path)])


def documents(spark: SparkSession, at: State) -> DataFrame:
    """doc_id, length of all documents."""
    table = pages(spark, at)
    if table is None:
        return spark.createDataFrame([], "doc_id long, length int")
    return table.filter("bucket = -1").select(F.posexplode("id").alias("at", "doc_id"), "len").select("doc_id", F.get("len", F.col("at")).alias("length"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term, df of all terms."""
    table = pages(spark, state(spark, path))
    return spark.createDataFrame([], "term string, df long") if table is None else document_frequencies(headers(table))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """segment, slots, documents, length, n, total_length, vocabulary, mean_idf, version of the current version's segments."""
    known = _versions(spark, path)
    if known is None:
        return spark.createDataFrame([], f"{_MANIFEST}, {_STATISTICS}, version int")
    at = state(spark, path)
    terms, mean = statistics(at)
    rows = known.filter(F.col("version") == at.version).filter("segment is not null")
    return rows.withColumns({"vocabulary": F.lit(terms).cast("long"), "mean_idf": F.lit(mean)}).select(*[c for c in known.columns if c != "version"], "vocabulary", "mean_idf", "version")


class Search:
    """The k best documents of each query (query_id, query) of a stored index; `read` and `postings` say how much of the
    queries' postings the search went through, of how many."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int = 10, digits: int = 9):
        self.at, self.queries, self.k, self.digits = state(spark, path), queries.select("query_id", "query"), k, digits
        self.spark, self.table = spark, pages(spark, self.at)
        if self.table is None:
            self.asked = self.bounds = None
            return
        asked = written(asked_terms(self.queries), "index-asked")
        mine = headers(self.table).select("term", "n").join(small(asked.select("term").distinct()), "term", "left_semi")
        dfs = mine.groupBy("term").agg(F.sum("n").alias("df"))
        self.asked = small(weighed(asked, dfs, self.at.n, self.at.mean_idf))
        self.asks = small(PO.asks(self.asked, self.asked.select("query_id").distinct().count()))
        # headers only
        heads = headers(self.table).join(self.asks, "term").drop("term")
        self.bounds = written(PO.bounds(heads, ["segment", "slot"], self._gain()), "index-bounds")

    def _gain(self):
        mean_length = self.at.mean_length
        return lambda tf, length: impact(tf, length, mean_length)

    def _scored(self, chosen: DataFrame) -> DataFrame:
        """query_id, doc_id, score of the k best hits in each of the chosen (query_id, segment, slot)."""
        who = self.asks.select("chunk", F.explode("asks.query_id").alias("query_id")).distinct()
        only = chosen.select("query_id", "segment", "slot").join(small(who), "query_id")
        rows = self.table.join(small(only.select("segment", "slot").distinct()), ["segment", "slot"], "left_semi")
        return PO.best(blocks(rows).join(self.asks, "term").drop("term"), ["segment", "slot"], self._gain(), self.k, self.digits, only).select("query_id", "doc_id", "score")

    def topk(self) -> DataFrame:
        """query_id, rank, doc_id, score; always min(k, N) rows a query: documents without a shared token score 0, by doc_id."""
        if self.table is None:
            return self.spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
        order = [F.desc("score"), F.col("doc_id")]
        seeds = written(top(self.bounds, SEEDS, [F.desc("bound"), F.col("segment"), F.col("slot")], ["query_id"]).select("query_id", "segment", "slot", "n"), "index-seeds")
        first = written(top(self._scored(seeds), self.k, order, ["query_id"]), "index-first")
        # the k-th score of the seeds: nothing below it is among the k best
        least = first.filter(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        others = self.bounds.join(seeds, ["query_id", "segment", "slot"], "left_anti").join(F.broadcast(least), "query_id", "left")
        slack = 10.0**-self.digits
        rest = written(others.filter(F.col("least").isNull() | (F.col("bound") * (1 + 1e-12) + slack >= F.col("least"))).select("query_id", "segment", "slot", "n"), "index-rest")
        best = top(first.drop("rank").unionByName(self._scored(rest)), self.k, order, ["query_id"])
        self.read = sum(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (seeds, rest))
        self.postings = self.bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        every = blocks(self.table).select("term", F.explode("postings.id").alias("doc_id")).join(self.asked, "term").select("query_id", "doc_id")
        return filled(best, every, documents(self.spark, self.at), self.queries, self.k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    return Search(spark, path, queries, k, digits).topk()
