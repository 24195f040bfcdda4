"""Queries through files and pages: tables written in a source's format and read back by its reader; prompts' contexts.

Each has its SQL over the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brieflake.functions import paths
from brieflake.functions import patterns as P
from brieflake.functions import text as X
from brieflake.operators import classify as C
from brieflake.operators import datasets as D
from brieflake.operators import evaluation as E
from brieflake.operators import filters as FL
from brieflake.plans import pipelines as PL
from brieflake.plans import surrogates as V
from brieflake.plans.retrieval_queries import _SAID, SQL_OVERLAP, SQL_SANITIZE
from brieflake.plans.vote_queries import FILLERS, FORMATS, SQL_GT, SQL_PRED, preds
from brieflake.sources import readers as IO
from brieflake.sources.scratch import written


def folder(s, name: str) -> str:
    """A new folder beside the scratch tables."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- files


def truth_files(s, d):
    """Ground truth through CSV files, in order of file and line."""
    path, r = folder(s, "truth"), V.truth_rows(s, d)
    named = {"docket": "Docket", "term": "Term", "case_name": "CaseName", "winning_party": "WinningParty", "justice": "Justice", "vote_description": "VoteDescription", "actual_vote": "ActualVote"}
    r.orderBy("seq").select(*[F.col(k).alias(v) for k, v in named.items()]).write.option("header", True).csv(path)
    return IO.read_cases(s, path)


def prediction_files(s, d):
    """Predictions through files of JSON arrays, a folder for each mode, an array a docket."""
    path, p = folder(s, "predictions"), preds(s, d).withColumn("average_confidence", F.round("average_confidence", 6))
    mode = F.when(F.col("replicate") == 1, "agents").otherwise("single")
    IO.write_predictions(p.select(mode.alias("mode"), "docket", "llm_model", "replicate", "predicted_winner", "vote_split", "average_confidence"), path)
    return IO.read_predictions(s, path, lines=True).select("mode", "docket", "llm_model", "replicate", "predicted_winner", "vote_split", "average_confidence")


def filing_files(s, d):
    """Filing rows through their CSV files."""
    path = folder(s, "filings")
    IO.write_filings(docket_filings(s, d), path)
    return IO.read_filings(s, path)


def catalog_file(s, d):
    """An opinion catalog through its JSON files; suppliers as cases, nations as terms."""
    path = folder(s, "catalog")
    IO.write_catalog(IO.table(s, d, "supplier").select(F.col("s_nationkey").alias("term"), F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("docket"), F.col("s_name").alias("case_name")), path)
    return IO.read_catalog(s, path, lines=True).select("term", "docket", "case_name")


def sft_files(s, d):
    path = folder(s, "sft")
    IO.write_jsonl(D.exact_items(V.cases(s, d)).select("instruction", "output"), path)
    return IO.read_sft_text(s, path)


def index_files(s, d):
    """Vectors by voter, written and read as a whole and for one voter."""
    path = folder(s, "index")
    v = IO.table(s, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("Justice "), F.col("label").cast("string")).alias("name"))
    IO.write_index(v.withColumn("justice", paths.folder_of_name(F.col("name"))).drop("name"), path)
    every = IO.read_index(s, path).groupBy(paths.name_of_folder(F.col("justice")).alias("justice")).agg(F.count("*").alias("chunks"), F.sum("vec_id").alias("ids"))
    one = IO.read_index(s, path, "Justice_3").agg(F.count("*").alias("of_three"))
    return every.crossJoin(one)


def docket_folders(s, d):
    p = V.cases(s, d).select(F.concat(F.lit("/data/term_"), F.col("term").cast("string"), F.lit("/"), "docket", F.when(F.col("o_orderkey") % 3 == 0, "_pdfs/b.pdf").when(F.col("o_orderkey") % 3 == 1, "_pdfs/a.pdf").otherwise("/c.pdf")).alias("path"))
    return IO.dockets_of_files(p)


# ---------------------------------------------------------------- pages


def docket_filings(s, d):
    """Filing rows of docket pages in both layouts; a page a customer."""
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    new = F.concat(F.lit('<table class="a ProceedingItem"><tr><td>Jan 05 2022</td><td>Brief of '), name, F.lit(' filed. <a href="/docs/'), k, F.lit('.pdf">Main Document</a> <a href="/x.html">other</a></td></tr></table>'))
    old = F.concat(F.lit("<table id='proceedings'><tr><td>Feb 17 2021</td><td>Reply  of "), name, F.lit("</td></tr><tr><td></td><td><a href='https://files.example.org/p/"), k, F.lit(".pdf#page=2'>Proof</a></td></tr><tr><td>note</td><td>x</td></tr><tr><td><a href='late.pdf'>Late</a></td></tr></table>"))
    none = F.lit("<html><body><p>No docket</p><a href='a.pdf'>x</a></body></html>")
    html = F.when(F.col("c_custkey") % 3 == 0, new).when(F.col("c_custkey") % 3 == 1, old).otherwise(none)
    return IO.filing_rows(IO.table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), html.alias("html")))


SQL_FILING_ROWS = """SELECT c_custkey::BIGINT AS page_id, 'Jan 05 2022' AS date, 'Jan 05 2022 Brief of ' || c_name || ' filed. other' AS description, 'Main Document' AS link_text,
c_custkey || '.pdf' AS original_filename, 'https://example.org/docs/' || c_custkey || '.pdf' AS url, c_custkey || '.pdf' AS filename FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'Feb 17 2021', 'Reply of ' || c_name, 'Proof', c_custkey || '.pdf#page=2', 'https://files.example.org/p/' || c_custkey || '.pdf#page=2', c_custkey || '.pdf_page_2' FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, '', '', 'Late', 'late.pdf', 'late.pdf', 'late.pdf' FROM customer WHERE c_custkey % 3 = 1"""


def opinion_tables(s, d):
    """Catalog records of slip-opinion pages; a page a supplier."""
    k = F.col("s_suppkey").cast("string")
    href = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/opinions/pdf/"), k, F.lit(".pdf#x"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://files.example.org/"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("22pdf/"), k, F.lit(".pdf")))
    row = lambda link: F.concat(F.lit("<tr><td>R-1</td><td>6/30/23</td><td>22-"), k, F.lit("</td><td><a href='"), link, F.lit("'>"), F.col("s_name"), F.lit("</a></td><td> EK </td></tr>"))
    html = F.concat(F.lit("<table class='table table-bordered'><tr><th>R</th><th>Date</th><th>No</th><th>Name</th><th>J</th></tr>"), row(href), row(F.lit("none.html")), F.lit("<tr><td>short</td></tr></table>"))
    return IO.opinion_records(IO.table(s, d, "supplier").select((F.col("s_suppkey") % 10).cast("int").alias("term"), html.alias("html")))


SQL_OPINION_ROWS = """WITH u AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'https://example.org/opinions/pdf/' || s_suppkey || '.pdf' WHEN 1 THEN 'https://files.example.org/' || s_suppkey || '.pdf' ELSE 'https://example.org/opinions/22pdf/' || s_suppkey || '.pdf' END AS pdf_url FROM supplier)
SELECT CAST(s_suppkey % 10 AS INT) AS term, '22-' || s_suppkey AS docket, s_name AS case_name, '6/30/23' AS date, 'EK' AS author_initials, 'Elena Kagan' AS author_name, pdf_url, s_suppkey || '.pdf' AS pdf_filename FROM u"""


def date_prefixes(s, d):
    o = IO.table(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "MMM dd yyyy"), F.lit(" filed"))).otherwise(F.concat(F.lit("On "), F.date_format("o_orderdate", "MMM dd yyyy")))
    return o.select("o_orderkey", X.date_prefix(text).alias("date"))


#: Words a line, lines a column; a page is a heading across and two columns.
_WORDS, _LINES = 8, 20
_PAGE = _WORDS * (2 * _LINES + 1)


def _boxes(s, d):
    """Lines of the documents' words, set as pages: a heading across the page, then two columns."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    t = IO.table(s, d, "documents").select("doc_id", words.alias("w")).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / _WORDS).cast("int"))).alias("line")).filter("size(w) > 0")
    line, place = F.array_join(F.slice("w", F.col("line") * _WORDS + 1, _WORDS), " "), F.col("line") % (2 * _LINES + 1)
    t = t.select("doc_id", F.floor(F.col("line") / (2 * _LINES + 1)).cast("int").alias("page"), line.alias("text"), place.alias("p"))
    column, row = F.floor((F.col("p") - 1) / _LINES), (F.col("p") - 1) % _LINES
    head = F.col("p") == 0
    left, top = F.when(head, 0).otherwise(column * 160), F.when(head, 0).otherwise(20 + row * 12)
    return t.select("doc_id", "page", "text", left.alias("x0"), top.alias("y0"), F.when(head, 300).otherwise(left + 140).alias("x1"), (top + 10).alias("y1"))


def box_pages(s, d):
    """Page texts from text boxes: the columns are read one after the other, as the words were."""
    return IO.box_texts(_boxes(s, d), ["doc_id", "page"]).select("doc_id", "page", "boxes", F.md5(F.col("text").cast("binary")).alias("digest"))


def first_pages(s, d):
    """The first 1,000 characters of each document's first page."""
    got = IO.box_texts(_boxes(s, d).filter("page = 0"), ["doc_id", "page"])
    return got.select("doc_id", F.md5(IO.first_page(F.array("text")).cast("binary")).alias("digest"))


_SQL_PAGES = rf"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, CAST(unnest(range((len(w) + {_PAGE} - 1) // {_PAGE})) AS INT) AS page, w FROM w),
t AS (SELECT doc_id, page, w[page * {_PAGE} + 1:(page + 1) * {_PAGE}] AS w FROM p),
r AS (SELECT doc_id, page, CAST((len(w) + {_WORDS} - 1) // {_WORDS} AS INT) AS boxes, regexp_replace(regexp_replace(array_to_string(w, ' '), '\s+', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS text FROM t)"""


def fallback_types(s, d):
    """Types of pages: of the rules where one applies, else learned from the words of the pages that a rule names."""
    p = IO.table(s, d, "pages")
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), (F.col("page_id") % len(_EXTRA) + 1).cast("int"))
    t = p.select("page_id", FL.document_type(extra, F.lit("")).alias("label"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    names = [n for n, _ in P.DOCUMENT_TYPES]
    weights, totals = C.fit(t, names)
    rest = t.filter(F.col("label") == P.UNCATEGORIZED)
    learned = C.predict(rest, "page_id", written(weights, "type_weights"), totals, names, P.UNCATEGORIZED).select("page_id", F.col("label").alias("type"), F.round("probability", 6).alias("probability"), F.lit(True).alias("learned"))
    return t.filter(F.col("label") != P.UNCATEGORIZED).select("page_id", F.col("label").alias("type"), F.lit(1.0).alias("probability"), F.lit(False).alias("learned")).unionByName(learned)


_EXTRA = ("amicus", "joint appendix", "reply", "brief for petitioner", "", "oralarg")
_NAMES = [n for n, _ in P.DOCUMENT_TYPES]
_SQL_CASE = "CASE " + " ".join(f"WHEN regexp_matches(extra || ' ', '{p}') THEN '{n}'" for n, p in P.DOCUMENT_TYPES) + " END"
SQL_FALLBACK = f"""WITH e AS (SELECT page_id, [{', '.join(f"'{x}'" for x in _EXTRA)}][page_id % {len(_EXTRA)} + 1] AS extra, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages),
t AS (SELECT page_id, {_SQL_CASE} AS label, text FROM e),
k AS (SELECT page_id, label, ('0x' || substring(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))), 1, 4))::INT AS bucket FROM t),
n AS (SELECT label, bucket, count(*) AS n FROM k WHERE label IS NOT NULL GROUP BY ALL),
c AS (SELECT label, count(*) AS docs FROM t WHERE label IS NOT NULL GROUP BY 1), z AS (SELECT label, sum(n) AS size FROM n GROUP BY 1),
u AS (SELECT page_id, bucket, count(*) AS f FROM k WHERE label IS NULL GROUP BY ALL),
h AS (SELECT page_id, n.label, sum(f * ln(n + 1)) AS s FROM u JOIN n USING (bucket) GROUP BY ALL),
l AS (SELECT page_id, coalesce(sum(f), 0) AS size FROM (SELECT page_id FROM t WHERE label IS NULL) LEFT JOIN u USING (page_id) GROUP BY 1),
g AS (SELECT l.page_id, c.label, list_position([{', '.join(f"'{x}'" for x in _NAMES)}], c.label) AS place, ln(docs / (SELECT sum(docs) FROM c)) + coalesce(h.s, 0) - l.size * ln(coalesce(z.size, 0) + 65536) AS score FROM l CROSS JOIN c LEFT JOIN z ON z.label = c.label LEFT JOIN h ON h.page_id = l.page_id AND h.label = c.label),
b AS (SELECT *, max(score) OVER (PARTITION BY page_id) AS best FROM g)
SELECT page_id, label AS type, 1.0::DOUBLE AS probability, false AS learned FROM t WHERE label IS NOT NULL
UNION ALL SELECT page_id, arg_min(label, place) FILTER (score = best), round(1 / sum(exp(score - best)), 6), true FROM b GROUP BY page_id"""

# ---------------------------------------------------------------- state of runs


def available_models(s, d):
    """Nations as models; those of two regions are blocked until different times."""
    n = IO.table(s, d, "nation")
    block = n.filter("n_regionkey < 2").select(F.col("n_name").alias("model"), F.when(F.col("n_regionkey") == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("timestamp").alias("unblock_at"))
    return FL.available(n.select(F.col("n_name").alias("model")), block, F.lit("2024-01-01 12:00:00").cast("timestamp"))


def docket_resume(s, d):
    """Items behind the last number of their term; terms without an entry start over."""
    items = V.cases(s, d).select("term", F.col("o_orderkey").alias("number"))
    done = items.filter("term <> 1994 and number % 7 = 0 and number < 2000")
    return PL.resume_after(items, done)


def terms_to_do(s, d):
    terms = V.cases(s, d).select("term").distinct()
    return PL.terms_to_do(terms, terms.filter("term % 2 = 0"))


# ---------------------------------------------------------------- contexts


def _case_chunks(s, d):
    """Documents as chunks: their source is the docket, every third one is a transcript."""
    t = IO.table(s, d, "documents").filter("source is not null and text is not null")
    name = F.when(F.col("doc_id") % 3 == 0, "transcript").otherwise("brief")
    chunks = t.select(F.col("source").alias("docket"), name.alias("source"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("document_type"), (F.col("doc_id") % 50).alias("page"))
    return chunks, t.select(F.col("source").alias("docket")).distinct().withColumn("case_name", F.concat(F.lit("the of and die "), "docket"))


def _digest(df, *columns):
    return df.select("docket", *[F.md5(F.col(c).cast("binary")).alias(c) for c in columns])


def case_contexts(s, d):
    chunks, cases = _case_chunks(s, d)
    return _digest(PL.contexts(chunks, cases, PL.Config()), "context", "transcript_context")


def research_notes(s, d):
    chunks, cases = _case_chunks(s, d)
    return _digest(PL.research(chunks, cases, PL.Config(sanitize_research=False)), "research")


def syllabus_contexts(s, d):
    chunks, cases = _case_chunks(s, d)
    return _digest(PL.syllabus_context(chunks, cases, PL.Config()), "context")


def _overlap(a: str, b: str) -> str:
    return SQL_OVERLAP.replace("{a}", a).replace("{b}", b)


_SQL_CHUNKS = """k AS (SELECT source AS docket, CASE WHEN doc_id % 3 = 0 THEN 'transcript' ELSE 'brief' END AS source, doc_id, text, CASE WHEN doc_id % 5 <> 0 THEN lang END AS document_type, doc_id % 50 AS page FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
s AS (SELECT *, {o} AS score, bool_and(source = 'transcript') OVER (PARTITION BY docket) AS only_t FROM k)""".replace("{o}", _overlap("'the of and die ' || docket", "text"))
_SQL_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
SQL_CONTEXTS = f"""WITH {_SQL_CHUNKS},
c AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY score DESC, source, doc_id) AS r FROM s WHERE source <> 'transcript' OR only_t QUALIFY r <= 10),
t AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY score DESC, source, doc_id) AS r FROM s WHERE source = 'transcript' QUALIFY r <= 8),
a AS (SELECT docket, string_agg('[' || source || ']' || chr(10) || text, {_SQL_RULE} ORDER BY r) AS x FROM c GROUP BY 1),
b AS (SELECT docket, string_agg('[' || source || ']' || chr(10) || text, {_SQL_RULE} ORDER BY r) AS x FROM t GROUP BY 1)
SELECT docket, md5(a.x) AS context, md5(b.x) AS transcript_context FROM a LEFT JOIN b USING (docket)"""
SQL_RESEARCH = f"""WITH {_SQL_CHUNKS}, c AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY score DESC, source, doc_id) AS r FROM s QUALIFY r <= 5)
SELECT docket, md5(substring(string_agg(chr(10) || text, {_SQL_RULE} ORDER BY r), 1, 3000)) AS research FROM c GROUP BY 1"""

def spoiler_texts(s, d):
    got = D.spoiler_texts(_decided(s, d), FILLERS, FORMATS)
    return got.select("docket", "format", "watermark", "sentence", F.md5(F.col("text").cast("binary")).alias("digest"))


def _decided(s, d):
    """Cases, some with a split and some with an author."""
    k = F.col("o_orderkey")
    return V.cases(s, d).withColumn("vote_split", F.when(k % 2 == 0, F.concat((5 + k % 5).cast("string"), F.lit("-"), (4 - k % 5).cast("string")))).withColumn("author", F.when(k % 3 == 0, "Elena Kagan"))


def _sql_form(form: str) -> str:
    out = "'" + form.replace("'", "''") + "'"
    for name, value in {"case_name": "case_name", "winner_lower": "lower(winner)", "vote_split": "split", "outcome_verb": "verb", "outcome_past": "past"}.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_PICK = "('0x' || substring(md5('42|{p}|' || docket), 1, 7))::BIGINT"
SQL_SPOILER_TEXTS = f"""WITH {V.SQL_CASES}, c AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'by a vote of ' || (5 + o_orderkey % 5) || '-' || (4 - o_orderkey % 5) ELSE '' END AS split,
CASE WHEN winner = 'Petitioner' THEN 'reversing' ELSE 'affirming' END AS verb, CASE WHEN winner = 'Petitioner' THEN 'reversed' ELSE 'affirmed' END AS past, CAST(5 + {_PICK.format(p='fillers')} % 3 AS INT) AS n FROM cases),
t AS (SELECT docket, term, n, CAST(1 + {_PICK.format(p='place')} % (n - 1) AS INT) AS place, {_sql_list(FORMATS)}[{_PICK.format(p='format')} % {len(FORMATS)} + 1] AS format,
[{', '.join(_sql_form(f) for f in P.SPOILER_SENTENCES)}][{_PICK.format(p='form')} % {len(P.SPOILER_SENTENCES)} + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '{P.SPOILER_AUTHOR.replace(chr(123) + 'author' + chr(125), 'Elena Kagan')}' ELSE '' END AS sentence,
'WM-' || term || '-' || docket || '-' || substring(md5(term || '-' || docket), 1, 8) AS watermark,
list_transform(list_sort(list_transform({_sql_list(FILLERS)}, lambda f: {{'h': md5('42|' || docket || '|' || f), 'f': f}})), lambda x: x.f) AS o FROM c)
SELECT docket, format, watermark, sentence, md5('# ' || format || chr(10) || chr(10) || array_to_string(list_transform(o[1:n], lambda f, i: CASE WHEN i - 1 = place THEN f || ' ' || sentence ELSE f END), chr(10) || chr(10)) || chr(10) || chr(10) || 'Ref. ' || watermark) AS digest FROM t"""

def sanitized_documents(s, d):
    """Outcome sentences stand before the texts, as in sentence_sanitize; every fourth text is left with that sentence alone."""
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % 4 + 1).cast("int"))
    t = F.concat(said, F.when(F.col("doc_id") % 4 < 3, F.col("text")).otherwise(""))
    got = FL.sanitized_documents(IO.table(s, d, "documents").select("doc_id", t.alias("content")))
    return got.select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


SQL_SANITIZED = SQL_SANITIZE.replace("[doc_id % 4 + 1] || text AS text", "[doc_id % 4 + 1] || CASE WHEN doc_id % 4 < 3 THEN text ELSE '' END AS text").replace("SELECT doc_id, CAST(length(x) AS BIGINT) AS n_chars, md5(x) AS digest FROM r", "SELECT doc_id, md5(x) AS digest FROM r WHERE length(trim(x)) > 50")

QUERIES = {
    "truth_files": (truth_files, SQL_GT),
    "prediction_files": (prediction_files, SQL_PRED + " SELECT CASE replicate WHEN 1 THEN 'agents' ELSE 'single' END AS mode, docket, llm_model, replicate, predicted_winner, vote_split, round(average_confidence, 6) AS average_confidence FROM pred"),
    "catalog_file": (catalog_file, "SELECT CAST(s_nationkey AS INT) AS term, 'd' || s_suppkey AS docket, s_name AS case_name FROM supplier"),
    "sft_files": (sft_files, f"WITH {V.SQL_CASES}, i AS (SELECT 'How was ' || case_name || ' decided?' AS a, 'It was decided for the ' || lower(winner) || '.' AS b FROM cases UNION ALL SELECT 'Which side prevailed in docket ' || docket || '?', winner FROM cases) SELECT '### Instruction:' || chr(10) || a || chr(10) || chr(10) || '### Response:' || chr(10) || b AS text FROM i"),
    "index_files": (index_files, "SELECT 'Justice ' || label AS justice, count(*) AS chunks, CAST(sum(vec_id) AS BIGINT) AS ids, (SELECT count(*) FROM embeddings WHERE label = 3) AS of_three FROM embeddings GROUP BY 1"),
    "docket_folders": (docket_folders, f"WITH {V.SQL_CASES} SELECT DISTINCT docket FROM cases WHERE o_orderkey % 3 < 2"),
    "docket_filings": (docket_filings, SQL_FILING_ROWS),
    "opinion_tables": (opinion_tables, SQL_OPINION_ROWS),
    "filing_files": (filing_files, f"SELECT date, description, link_text, filename, original_filename, url FROM ({SQL_FILING_ROWS})"),
    "box_pages": (box_pages, f"WITH {_SQL_PAGES} SELECT doc_id, page, boxes, md5(text) AS digest FROM r"),
    "first_pages": (first_pages, f"WITH {_SQL_PAGES} SELECT doc_id, md5(substring(text, 1, 1000)) AS digest FROM r WHERE page = 0"),
    "fallback_types": (fallback_types, SQL_FALLBACK),
    "date_prefixes": (date_prefixes, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b %d %Y') ELSE '' END AS date FROM orders"),
    "available_models": (available_models, "SELECT n_name AS model FROM nation WHERE n_regionkey <> 0"),
    "docket_resume": (docket_resume, f"WITH {V.SQL_CASES}, m AS (SELECT term, max(o_orderkey) AS last FROM cases WHERE term <> 1994 AND o_orderkey % 7 = 0 AND o_orderkey < 2000 GROUP BY 1) SELECT c.term, o_orderkey AS number FROM cases c LEFT JOIN m USING (term) WHERE last IS NULL OR o_orderkey > last"),
    "terms_to_do": (terms_to_do, f"WITH {V.SQL_CASES} SELECT DISTINCT term FROM cases WHERE term % 2 = 1"),
    "case_contexts": (case_contexts, SQL_CONTEXTS),
    "research_notes": (research_notes, SQL_RESEARCH),
    "syllabus_contexts": (syllabus_contexts, None),
    "spoiler_texts": (spoiler_texts, SQL_SPOILER_TEXTS),
    "sanitized_documents": (sanitized_documents, SQL_SANITIZED),
}
