"""Sources and sinks: tables, ground-truth CSV, prediction and experiment JSON, catalogs, HTML tables, text outputs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brieflake.functions import patterns as P
from brieflake.functions import text as X
from brieflake.operators.layout import pages_in_order
from brieflake.sources.scratch import written

VOTE = T.StructType().add("vote", "string").add("confidence", "double").add("reasoning", "string").add("is_final", "boolean")
PREDICTION = (
    T.StructType().add("docket", "string").add("llm_model", "string").add("mode", "string").add("replicate", "integer").add("has_transcripts", "boolean")
    .add("has_opinion_rag", "boolean").add("predict_term", "integer").add("justice_votes", T.MapType(T.StringType(), VOTE)).add("initial_votes", T.MapType(T.StringType(), VOTE))
    .add("petitioner_votes", "integer").add("respondent_votes", "integer").add("predicted_winner", "string").add("vote_split", "string").add("average_confidence", "double")
    .add("deliberation_rounds", "integer").add("total_vote_changes", "integer").add("votes_per_round", T.ArrayType(T.MapType(T.StringType(), VOTE)))
)
RECORD = T.StructType().add("term", "integer").add("docket", "string").add("case_name", "string").add("date", "string").add("author_initials", "string").add("author_name", "string").add("pdf_url", "string").add("pdf_filename", "string")
FILING_COLUMNS = ["date", "description", "link_text", "filename", "original_filename", "url"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Cells of a row of ground truth that are read; a row may have fewer.
TRUTH_WIDTH = 64


def _truth_width(spark: SparkSession, folder: str) -> int:
    """Cells of the widest header, or more: columns that no row has are dear to read. Told from the commas of each file's first line, unless a
    header may go on after it."""
    text = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter((F.col("_metadata.file_block_start") == 0) & (F.col("value") != ""))
    first = written(lines.groupBy("file").agg(F.min("line").alias("line")), "truth-lines")
    count = lambda x: F.length("value") - F.length(F.replace(F.col("value"), F.lit(x), F.lit("")))
    open_ended = (count('"') % 2 == 1) | F.col("value").contains("\\")
    width = lines.join(F.broadcast(first), ["file", "line"]).agg(F.max(F.when(open_ended, TRUTH_WIDTH).otherwise(count(",") + 1))).first()[0]
    return min(width or 1, TRUTH_WIDTH)


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder, in order of file name and place (`seq`); columns that a file lacks are null.

    Files may have any headers: cells are read by place, and each file's first row says which is which (a row a file, so the
    driver holds no more than its own list of files). Rows are then read once, and of them only the cells that some
    header names. A file is one task, as a quoted cell may hold line breaks.
    """
    wanted = {"Docket": "docket", "Term": "term", "CaseName": "case_name", "WinningParty": "winning_party", "Justice": "justice", "VoteDescription": "vote_description", "ActualVote": "actual_vote"}
    cells = [f"c{i}" for i in range(_truth_width(spark, folder))]
    read = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("multiLine", True).option("encoding", "UTF-8").option("pathGlobFilter", "*.csv").csv(folder)
    # within a task rows are numbered in order, so a file's smallest number is its header's
    place = [F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")]
    first = written(read.select(*place).groupBy("file").agg(F.min("line").alias("head")), "truth-first")
    # only rows that hold one of the names can say anything as a header, so that few are joined
    named = read.select(*place, F.array(*cells).alias("names")).filter(F.arrays_overlap("names", F.array(*[F.lit(k) for k in wanted])))
    named = named.join(F.broadcast(first), "file").filter("line = head").select("file", *[F.array_position("names", k).cast("int").alias(f"at_{v}") for k, v in wanted.items()])
    files = first.join(named, "file", "left").orderBy("file").collect()
    fields = [("number", pa.int64()), ("file", pa.string()), ("head", pa.int64()), *[(f"at_{v}", pa.int32()) for v in wanted.values()]]
    heads = spark.createDataFrame(pa.table([pa.array(column, type=kind) for column, (_, kind) in zip(zip(*[(n, *r) for n, r in enumerate(files)]), fields)] or [pa.array([], type=kind) for _, kind in fields], names=[n for n, _ in fields]))

    def cell(v: str) -> Column:
        got = F.lit(None).cast("string")
        for at in sorted({r[f"at_{v}"] for r in files if r[f"at_{v}"]}):
            got = F.when(F.col(f"at_{v}") == at, F.col(cells[at - 1])).otherwise(got)
        return got.alias(v)

    body = read.select(*cells, *place).join(F.broadcast(heads), "file").filter("line > head")
    # a task numbers its rows below 2 ** 33
    got = body.select(*[cell(v) for v in wanted.values()], (F.shiftleft("number", 33) + F.col("line") - F.col("head")).alias("seq"))
    return got.withColumn("term", F.coalesce(F.expr("try_cast(term as int)"), F.lit(0)))


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """docket, term, case_name, winner, justice, vote: a row for each vote that can be told from the rows of ground truth."""
    from brieflake.operators.evaluation import truth_by_vote

    return truth_by_vote(read_truth(spark, folder))


def read_predictions(spark: SparkSession, folder: str, recursive: bool = True, lines: bool = False) -> DataFrame:
    """JSON arrays of predictions; a missing mode is the name of the folder above.

    An array a file, however it is laid out, or with `lines` an array a line (as `write_predictions` writes it): such files
    are split among tasks.
    """
    read = spark.read.schema(PREDICTION).option("multiLine", not lines).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{json,txt}")
    return with_mode(read.json(folder))


def with_mode(raw: DataFrame) -> DataFrame:
    parent = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.withColumn("mode", F.coalesce("mode", parent))


def prediction_votes(pred: DataFrame) -> DataFrame:
    return pred.select("docket", "llm_model", "mode", "replicate", F.explode("justice_votes").alias("justice", "v")).select("docket", "llm_model", "mode", "replicate", "justice", "v.*")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object a file, files named *_cond*.json."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*_cond*.json").json(folder)


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects term -> list of records, as rows; the key is the term. A file is one object, or with `lines` (as
    `write_catalog` writes it) each line is one, and files are split among tasks."""
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(RECORD))).alias("m"))
    return raw.select(F.explode("m").alias("k", "records")).select(F.col("k").cast("int").alias("k"), F.explode("records").alias("r")).select(F.col("k").alias("term"), *[F.col(f"r.{f}").alias(f) for f in RECORD.names if f != "term"])


def upsert_terms(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Terms that come in replace the existing ones whole; others stay."""
    return existing.join(incoming.select("term").distinct(), "term", "left_anti").unionByName(incoming)


def dockets_of_files(files: DataFrame, column: str = "path", suffix: str = "_pdfs") -> DataFrame:
    """Distinct dockets from folders named <docket>_pdfs in file paths."""
    name = F.regexp_extract(column, rf"([^/]+){suffix}/[^/]*$", 1)
    return files.select(name.alias("docket")).filter("docket <> ''").distinct()


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every quoted link, built-ins only."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def absolute_url(href: Column, host: str, folder: str) -> Column:
    clean = F.substring_index(href, "#", 1)
    return F.when(clean.startswith("/"), F.concat(F.lit(host), clean)).when(clean.startswith("http"), clean).otherwise(F.concat(F.lit(folder), clean))


class _Tables(HTMLParser):
    """Tables as lists of rows of (text, link) cells, with the tables' classes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table":
            self.open.append({"class": (given.get("class") or "").split(), "id": given.get("id") or "", "rows": []})
            self.tables.append(self.open[-1])
        elif self.open:
            rows = self.open[-1]["rows"]
            if tag == "tr":
                rows.append([])
            elif tag in ("td", "th"):
                if not rows:
                    rows.append([])
                rows[-1].append({"text": [], "links": [], "head": tag == "th"})
            elif tag == "a" and given.get("href") and rows and rows[-1]:
                rows[-1][-1]["links"].append([given["href"], []])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["rows"] and self.open[-1]["rows"][-1]:
            cell = self.open[-1]["rows"][-1][-1]
            cell["text"].append(data)
            if cell["links"]:
                cell["links"][-1][1].append(data)


def html_tables(page: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.tables


def _text(cell: dict, joiner: str = " ") -> str:
    return " ".join(joiner.join(cell["text"]).split())


def filing_rows(pages: DataFrame, host: str = "https://example.org") -> DataFrame:
    """(page_id, date, description, link_text, original_filename, url) of the .pdf links in docket pages: tables classed
    ProceedingItem, else the table `proceedings`, where a link row's date and text come from the row before."""
    import re

    def of(page_id, page):
        tables = html_tables(page)
        items = [t for t in tables if "ProceedingItem" in t["class"]]
        for t in items or [t for t in tables if t["id"] == "proceedings"]:
            before = ("", "")
            whole = " ".join(_text(c) for r in t["rows"] for c in r)
            for row in t["rows"]:
                texts = [_text(c) for c in row if not c["head"]]
                for c in row:
                    for href, said in c["links"]:
                        if href.split("#")[0].lower().endswith(".pdf"):
                            m = re.match(P.DATE_PREFIX, whole)
                            date, text = (m[0] if m else "", whole) if items else before
                            text = " ".join(re.sub(P.BOILERPLATE_LABELS, "", text).split())[:200]
                            url = host + href if href.startswith("/") else href
                            yield page_id, date, text, " ".join("".join(said).split()), href.split("/")[-1], url
                before = (texts[0], texts[1]) if len(texts) >= 2 and re.match(P.DATE_PREFIX, texts[0]) else ("", "")

    columns = ["page_id", "date", "description", "link_text", "original_filename", "url"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for i, h in zip(pdf["page_id"], pdf["html"]) for r in of(i, h)], columns=columns)

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, date string, description string, link_text string, original_filename string, url string")
    return rows.withColumn("filename", X.file_name(F.col("original_filename")))


def opinion_records(pages: DataFrame, host: str = "https://example.org") -> DataFrame:
    """pages (term, html) -> catalog records: rows of five cells or more of tables classed table-bordered, else of tables of
    over two rows; the name cell must link to a .pdf (anchor dropped)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for term, page in zip(pdf["term"], pdf["html"]):
                tables = html_tables(page)
                bordered = [t for t in tables if "table-bordered" in t["class"]]
                for t in bordered or [t for t in tables if len(t["rows"]) > 2]:
                    for row in t["rows"]:
                        cells = [c for c in row if not c["head"]]
                        if len(cells) >= 5 and cells[3]["links"]:
                            out.append((term, _text(cells[1]), _text(cells[2]), _text(cells[3]), _text(cells[4]), cells[3]["links"][0][0]))
            yield pd.DataFrame(out, columns=["term", "date", "docket", "case_name", "author_initials", "href"])

    got = pages.select("term", "html").mapInPandas(run, "term int, date string, docket string, case_name string, author_initials string, href string")
    url = absolute_url(F.col("href"), host, f"{host}/opinions/")
    got = got.filter(F.lower(F.substring_index("href", "#", 1)).endswith(".pdf")).withColumn("pdf_url", url)
    return got.select("term", "docket", "case_name", "date", "author_initials", X.author_name(F.col("author_initials")).alias("author_name"), "pdf_url", F.element_at(F.split("pdf_url", "/"), -1).alias("pdf_filename"))


def box_texts(boxes: DataFrame, keys: list[str], normalize: bool = True) -> DataFrame:
    """boxes (keys, x0, y0, x1, y1, text) -> (keys, boxes, text): pages in reading order, white space and hyphens mended."""
    got = pages_in_order(boxes, keys)
    return got.withColumn("text", X.normalize_page(F.col("text"))) if normalize else got


def page_texts(files: DataFrame, extractor, normalize: bool = True) -> DataFrame:
    """files (path, content) -> (path, page, text) by a pluggable extractor(bytes) -> list of page texts; extractors that
    give boxes go through `box_texts`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(p, i + 1, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(extractor(bytes(c)))], columns=["path", "page", "text"])

    got = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    return got.withColumn("text", X.normalize_page(F.col("text"))) if normalize else got


def first_page(pages: Column, most: int = 1000) -> Column:
    return F.substring(F.try_element_at(pages, F.lit(1)), 1, most)


def present_segments(segments: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with their catalog record, and the records without a file."""
    files = segments.select("term", "pdf_filename").distinct()
    return segments.join(catalog, ["term", "pdf_filename"]), catalog.join(files, ["term", "pdf_filename"], "left_anti")


# ---------------------------------------------------------------- sinks


def write_filings(rows: DataFrame, path: str) -> None:
    """Filing rows in their fixed order of columns; quotes in cells are doubled, as in RFC 4180."""
    rows.select(*FILING_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """What `write_filings` wrote; its cells hold no line breaks, so files are split among tasks. CSV doesn't tell null
    from empty: both are read as empty."""
    got = spark.read.schema(", ".join(f"{c} string" for c in FILING_COLUMNS)).option("header", True).option("escape", '"').csv(path)
    return got.na.fill("")


#: Replicates of a docket that share an array of predictions.
ARRAY_REPLICATES = 1000


def write_predictions(pred: DataFrame, path: str, folders: bool = False) -> None:
    """One JSON array for each mode and docket, below `mode=<mode>/`: an array a line, or with `folders` a folder and a
    file a docket (for readers that want a file each; not for millions of dockets).

    Modes (with `folders`: dockets) that come in replace what is there, others stay, so that a run that is repeated doesn't
    double. Nothing is replaced before all tasks have finished: a write that fails leaves the old files whole. A docket of
    over ARRAY_REPLICATES replicates gets an array for each so many. A null mode or docket is a key of its own.
    """
    part = F.floor(F.coalesce(F.col("replicate") if "replicate" in pred.columns else F.lit(0), F.lit(0)) / ARRAY_REPLICATES)
    arrays = pred.groupBy("mode", "docket", part.alias("part")).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*pred.columns)))).alias("texts"))
    body = F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]"))  # sorted, so the rows alone decide the file
    keys = ["mode", "docket"] if folders else ["mode"]
    out = arrays.select(*keys, body.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    (out.option("maxRecordsPerFile", 1) if folders else out).text(path)


def write_catalog(records: DataFrame, path: str, most: int = 2000) -> None:
    """records (term, ...) as JSON objects term -> list of records, an object a line. A term is cut by a hash of the records
    into as many lists as all records need at `most` a list, so that a term of any size meets in no task."""
    pieces = 1 + records.count() // most
    fields = [c for c in records.columns if c != "term"]
    piece = F.pmod(F.xxhash64(*fields), F.lit(pieces))
    lists = records.groupBy("term", piece.alias("piece")).agg(F.collect_list(F.struct(*fields)).alias("records"))
    lists.select(F.to_json(F.create_map(F.col("term").cast("string"), "records")).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_sft_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select(F.format_string("### Instruction:\n%s\n\n### Response:\n%s", "instruction", "output").alias("text"))


def syllabus_columns(rows: DataFrame) -> DataFrame:
    """rows (model, text): word count, success, safe file stem."""
    return rows.select("model", X.word_count(F.col("text")).alias("words"), (~F.col("text").rlike("^(Error|Failed)")).alias("success"), F.translate("model", "/: ", "___").alias("stem"))


def write_index(chunks: DataFrame, path: str) -> None:
    """Vectors and metadata by voter; partition discovery reads one voter or all."""
    chunks.write.mode("overwrite").partitionBy("justice").parquet(path)


def read_index(spark: SparkSession, path: str, justice: str | None = None) -> DataFrame:
    got = spark.read.parquet(path)
    return got if justice is None else got.filter(F.col("justice") == justice)


def write_json_report(report: dict, path: str, spark: SparkSession) -> None:
    """A small driver-side report as one JSON text file, through Spark's writer (any file system)."""
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
