"""Registry of the library's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import cleaning, evaluate, features, kpi, models, quantiles, sampling, stats
from spindrift.operators.lemmas import Lemmatizer
from spindrift.plans.registry import Models, Runs, signature, signature_rows
from spindrift.sources import pages, scratch, tables
from spindrift.streaming import monthly

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, Callable[[], str]] = {}


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in _SQL.items()}


def query(sql: Callable[[], str] | None = None):
    """Registers a query, and what makes the SQL with its rows, which is asked only when the SQL is."""

    def add(f):
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# Inputs ------------------------------------------------------------------------------------------


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark, sf_dir, name) -> DataFrame:
    """A table whose texts are work: a small one is dealt to all cores."""
    return tables.spread(_read(spark, sf_dir, name))


def comments(spark, sf_dir) -> DataFrame:
    """doc_id, clean_comment, category: documents with a sentiment taken from their labels."""
    docs, labels = _texts(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    category = F.expr("CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END").cast("int")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("clean_comment"), category.alias("category"))


def scored(spark, sf_dir) -> DataFrame:
    s = F.expr("CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END")
    return _read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").alias("author"), s.alias("sentiment"))


def scored_orders(spark, sf_dir) -> DataFrame:
    s = F.expr("CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 0 ELSE 1 END")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").alias("author"), s.alias("sentiment"))


def dialogue(spark, sf_dir) -> DataFrame:
    """Turns with a sentiment by their number of words."""
    turns = _read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", "text", (F.pmod(T.word_count(F.col("text")), F.lit(3)) - 1).alias("sentiment"))


def predicted(spark, sf_dir) -> DataFrame:
    """Labelled comments with a made-up prediction that any engine can compute."""
    n = F.char_length("clean_comment")
    p = F.when(n % 4 == 0, -1).when(n % 7 == 0, 0).otherwise(F.col("category"))
    return comments(spark, sf_dir).where("category is not null").select("doc_id", F.col("category").alias("label"), p.alias("prediction"))


def vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


_COMMENTS = """comments AS (SELECT d.doc_id, d.text AS clean_comment, CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 0 END AS category
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_SCORED = "scored AS (SELECT event_id, ts AS timestamp, user_id AS author, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END AS sentiment FROM events)"
_PREDICTED = f"""{_COMMENTS}, predicted AS (SELECT doc_id, category AS label, CASE WHEN length(clean_comment) % 4 = 0 THEN -1 WHEN length(clean_comment) % 7 = 0 THEN 0 ELSE category END AS prediction
  FROM comments WHERE category IS NOT NULL)"""


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"


def _sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{T.SPACES}]+'), lambda t: t <> '')"


def _sql_whitelist(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z0-9!?.,{T.SPACES}]', '', 'g')"


def _sql_without(x: str, words) -> str:
    return f"list_filter({x}, lambda t: t NOT IN ({_listed(words)}))"


def _sql_clean(x: str) -> str:
    words = _sql_without(_sql_tokens(_sql_whitelist(f"replace({_sql_strip(f'lower({x})')}, chr(10), ' ')")), T.removed_stop_words())
    return f"array_to_string({words}, ' ')"


def _sql_analyzed(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _sql_ngrams(words: str, lo: int, hi: int) -> str:
    parts = [f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))" for n in range(lo, hi + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_CLEANED = f"{_COMMENTS}, cleaned AS (SELECT doc_id, category, {_sql_clean('clean_comment')} AS cleaned FROM comments)"


def cleaned(spark, sf_dir) -> DataFrame:
    return comments(spark, sf_dir).select("doc_id", "category", T.clean(F.col("clean_comment")).alias("cleaned"))


# Sources -----------------------------------------------------------------------------------------


_scratch = scratch.place


def _as_csv(spark, sf_dir, name: str) -> str:
    """The comments as CSV files, as the scans find them; their path."""
    path = _scratch(spark, name)
    tables.write_csv(comments(spark, sf_dir), path)
    return path


_SCANNED = "doc_id bigint, clean_comment string, category int"


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, CASE WHEN clean_comment NOT IN ({_listed(cleaning.NA_TOKENS)}) THEN clean_comment END AS clean_comment, category FROM comments")
def s01_csv_scan(spark, sf_dir):
    return tables.read_csv(spark, _as_csv(spark, sf_dir, "comments"), _SCANNED)


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, coalesce(clean_comment, '') AS clean_comment, category FROM comments")
def s02_scan_filled(spark, sf_dir):
    return tables.read_filled(spark, _as_csv(spark, sf_dir, "comments"), _SCANNED)


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments WHERE clean_comment IS NOT NULL AND category IS NOT NULL")
def s03_scan_preprocessed(spark, sf_dir):
    return tables.read_preprocessed(spark, _as_csv(spark, sf_dir, "comments"), ["clean_comment", "category"], _SCANNED)


@query(lambda: f"""WITH {_COMMENTS} SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42||' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY category) * 0.2) AS is_test
  FROM comments WHERE category IS NOT NULL""")
def s04_split_sink(spark, sf_dir):
    """Both parts of a split, written and read back."""
    path = _scratch(spark, "split")
    tables.write_split(*sampling.train_test(_labelled_comments(spark, sf_dir), "doc_id", stratify="category"), path)
    parts = [spark.read.parquet(f"{path}/{name}").select("doc_id", "category", F.lit(name == "test").alias("is_test")) for name in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query(lambda: f"WITH {_CLEANED} SELECT doc_id, nullif(cleaned, '') AS clean_comment, category FROM cleaned WHERE category IS NOT NULL AND cleaned NOT IN ({_listed(w for w in cleaning.NA_TOKENS if w)})")
def s05_processed_sink(spark, sf_dir):
    """Processed comments, written as CSV; read back, empty ones are null."""
    path = _scratch(spark, "interim")
    tables.write_csv(cleaned(spark, sf_dir).where("category is not null").select("doc_id", F.col("cleaned").alias("clean_comment"), "category"), path)
    return tables.read_csv(spark, path, _SCANNED)


@query(lambda: f"WITH {_COMMENTS} SELECT category, count(*) AS n FROM comments WHERE category IS NOT NULL GROUP BY 1")
def s06_single_csv(spark, sf_dir):
    path = _scratch(spark, "counts")
    tables.write_single_csv(stats.class_counts(_labelled_comments(spark, sf_dir)), path)
    return tables.read_csv(spark, path, "category int, n long")


@query(lambda: f"WITH {_sql_terms(1, 1, 1000)} SELECT doc_id, count(*) AS n_terms FROM terms JOIN vocab USING (term) GROUP BY 1")
def s09_saved_vectorizer(spark, sf_dir):
    """How many terms a vectorizer finds after it was saved and loaded."""
    df, path = comments(spark, sf_dir), _scratch(spark, "vectorizer")
    features.Vectorizer(1000, (1, 1)).fit(df, "clean_comment").save(path)
    found = features.Vectorizer(1000, (1, 1)).load(path).transform(df, "clean_comment")
    return found.select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x != 0)).cast("long").alias("n_terms")).where("n_terms > 0")


@query(lambda: "SELECT 'run-1' AS run_id, 'models/one' AS model_path")
def s10_run_pointer(spark, sf_dir):
    path = _scratch(spark, "pointer")
    tables.write_pointer(spark, "run-1", "models/one", path)
    return tables.read_pointer(spark, path)


def _bodies(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(texts.alias("comments"))).alias("body"))


@query(lambda: "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INT) AS position, text AS comment FROM conversations")
def s11_request_rows(spark, sf_dir):
    return tables.request_comments(_bodies(spark, sf_dir)).drop("body")


@query(lambda: "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS k FROM events")
def s12_objects_to_table(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query(lambda: """WITH t AS (SELECT conv_id AS number, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position, text, coalesce(nullif(role, ''), 'Unknown') AS authorId FROM conversations WHERE turn IS NOT NULL),
 n AS (SELECT number, count(*) AS n FROM t GROUP BY 1), b AS (SELECT number, coalesce(sum(n) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT number, CAST(position AS INT) AS position, text, '2024-01-01 00:00:00' AS published, authorId FROM t JOIN b USING (number) WHERE before < 500""")
def s13_comment_pages(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("turn is not null")
    leaf = F.struct(F.col("text").alias("textOriginal"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.struct(F.col("role").alias("value")).alias("authorChannelId"))
    item = F.struct("turn", "text", F.struct(F.struct(leaf.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    filled = turns.groupBy(F.col("conv_id").alias("number")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    # The first of the pages, more than will be taken, each naming the next one; written as a service would hand them out, a file for each.
    first = filled.orderBy("number").limit(501)
    linked = first.withColumn("nextPageToken", F.lead("number").over(Window.partitionBy(F.lit(1)).orderBy("number")).cast("string"))  # 501 rows at most
    path = _scratch(spark, "threads")
    linked.select(F.to_json(F.struct("items", "nextPageToken")).alias("page"), F.lit("one").alias("thread"), F.col("number").alias("token")).write.partitionBy("thread", "token").text(path)
    pages.register(spark)
    start = linked.agg(F.min("number")).first()[0]
    got = spark.read.format("comment_pages").option("path", path).option("first", str(start)).load()
    return got.select(F.col("token").cast("long").alias("number"), "position", "text", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("published"), "authorId")


@query(lambda: "SELECT conv_id, turn, coalesce(nullif(role, ''), 'Unknown') AS author FROM conversations")
def s14_nested_default(spark, sf_dir):
    nested = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.col("role").alias("value")).alias("authorChannelId"))
    return nested.select("conv_id", "turn", tables.author(F.col("authorChannelId.value")).alias("author"))


@query(lambda: f"""WITH a AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || left(md5(CAST(page_id AS VARCHAR)), 11) || '&t=1' WHEN 1 THEN 'https://youtube.com/watch?v=' || left(md5(CAST(page_id AS VARCHAR)), 9) || '-_' ELSE url END AS url FROM pages)
SELECT page_id, regexp_extract(url, '{tables.VIDEO_URL}', 1) AS video_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM a""")
def s15_url_extraction(spark, sf_dir):
    """Two thirds of the pages get a watch page's address, made from their ids, as no address of the table is one."""
    tail, k = F.md5(F.col("page_id").cast("string")), F.pmod("page_id", F.lit(3))
    watched = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.left(tail, F.lit(11)), F.lit("&t=1"))).when(k == 1, F.concat(F.lit("https://youtube.com/watch?v="), F.left(tail, F.lit(9)), F.lit("-_")))
    pages_ = _read(spark, sf_dir, "pages").withColumn("url", F.coalesce(watched, "url"))
    return pages_.select("page_id", tables.video_id(F.col("url")).alias("video_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, clean_comment, category FROM comments")
def s17_dataset_artifact(spark, sf_dir):
    """A run's dataset, as it is read back from its artifacts."""
    runs = Runs(spark, _scratch(spark, "runs"))
    return spark.read.parquet(runs.log_dataset("run", "comments", comments(spark, sf_dir)))


@query(lambda: f"""WITH {_sql_terms(1, 1, 50)}, {_IDF.format('comments')}, few AS (SELECT doc_id FROM comments ORDER BY doc_id LIMIT 5), w AS (SELECT doc_id, term, tf * idf AS w FROM few JOIN terms USING (doc_id) JOIN idf USING (term)),
 u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w), grid AS (SELECT few.doc_id, 'term_' || idf.term AS name, round(coalesce(u.w, 0), 6) AS weight FROM few CROSS JOIN idf LEFT JOIN u ON u.doc_id = few.doc_id AND u.term = idf.term)
SELECT * EXCLUDE (doc_id) FROM (PIVOT grid ON name USING first(weight) GROUP BY doc_id)""")
def s16_dense_sample(spark, sf_dir):
    df = comments(spark, sf_dir).orderBy("doc_id")
    held = features.dense_sample(features.Vectorizer(50, (1, 1)).fit(df, "clean_comment"), df, "clean_comment")
    return held.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) for c in held.columns])


# Row cleaning ------------------------------------------------------------------------------------


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments WHERE clean_comment IS NOT NULL AND category IS NOT NULL AND doc_id IS NOT NULL")
def f01_drop_any_null(spark, sf_dir):
    return cleaning.drop_null(comments(spark, sf_dir))


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments WHERE category IS NOT NULL")
def f02_drop_null_in_subset(spark, sf_dir):
    return cleaning.drop_null(comments(spark, sf_dir), ["category"])


@query(lambda: f"WITH {_COMMENTS} SELECT DISTINCT clean_comment, category FROM comments")
def f03_drop_duplicates(spark, sf_dir):
    return cleaning.drop_duplicates(comments(spark, sf_dir).select("clean_comment", "category"))


@query(lambda: f"SELECT stamp_id, source, raw FROM stamps WHERE {_sql_strip('raw')} <> ''")
def f04_drop_blank(spark, sf_dir):
    """On the table that has blank texts and nulls."""
    return cleaning.drop_blank(_read(spark, sf_dir, "stamps").select("stamp_id", "source", "raw"), "raw")


@query(lambda: f"SELECT stamp_id, source, raw FROM stamps WHERE {_sql_strip('raw')} = ''")
def f05_blank_rows(spark, sf_dir):
    return _read(spark, sf_dir, "stamps").select("stamp_id", "source", "raw").where(cleaning.is_blank(F.col("raw")))


@query(lambda: f"WITH {_COMMENTS} SELECT DISTINCT clean_comment, category FROM comments WHERE clean_comment IS NOT NULL AND category IS NOT NULL AND {_sql_strip('clean_comment')} <> ''")
def f06_ingest_clean(spark, sf_dir):
    return cleaning.ingest_clean(comments(spark, sf_dir), "clean_comment", ["clean_comment", "category"])


@query(lambda: f"WITH {_COMMENTS} SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(clean_comment) AS clean_comment, count(*) - count(category) AS category FROM comments")
def f07_null_counts(spark, sf_dir):
    return cleaning.null_counts(comments(spark, sf_dir))


@query(lambda: f"WITH {_COMMENTS} SELECT category, count(*) AS n FROM comments JOIN documents USING (doc_id) WHERE lang IS DISTINCT FROM 'en' OR text IS NULL GROUP BY 1")
def f08_null_text_labels(spark, sf_dir):
    """Labels beside null texts; texts in other languages than English stand for null ones, as the table has none."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("clean_comment"))
    held = docs.join(comments(spark, sf_dir).select("doc_id", "category"), "doc_id")
    return cleaning.null_label_counts(held, "clean_comment", "category")


@query(lambda: f"WITH {_COMMENTS} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM comments GROUP BY clean_comment, category)")
def f09_duplicate_count(spark, sf_dir):
    return cleaning.duplicate_count(comments(spark, sf_dir).select("clean_comment", "category"))


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, clean_comment, category FROM (SELECT *, row_number() OVER (PARTITION BY clean_comment, category ORDER BY doc_id) AS nth FROM comments) WHERE nth > 1")
def f10_duplicate_rows(spark, sf_dir):
    return cleaning.duplicate_rows(comments(spark, sf_dir), ["clean_comment", "category"], "doc_id")


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments WHERE category = 1")
def f11_label_filter(spark, sf_dir):
    return comments(spark, sf_dir).where("category = 1")


@query(lambda: f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '{cleaning.URL}')")
def f12_url_rows(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").rlike(cleaning.URL))


@query(lambda: "SELECT conv_id, turn, text FROM conversations WHERE contains(text, chr(10))")
def f13_newline_rows(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where(F.contains("text", F.lit("\n")))


@query(lambda: f"WITH {_COMMENTS} SELECT count(*) FILTER (WHERE starts_with(clean_comment, ' ') OR ends_with(clean_comment, ' ')) AS edged FROM comments")
def f14_edge_spaces(spark, sf_dir):
    return comments(spark, sf_dir).agg(F.count_if(cleaning.edge_space(F.col("clean_comment"))).alias("edged"))


@query(lambda: f"WITH {_COMMENTS} SELECT clean_comment FROM comments")
def f15_projection(spark, sf_dir):
    return comments(spark, sf_dir).select("clean_comment")


@query(lambda: f"WITH {_COMMENTS} SELECT count(*) AS n_rows, CAST(3 AS INT) AS n_columns FROM comments")
def f16_shape(spark, sf_dir):
    df = comments(spark, sf_dir)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments ORDER BY doc_id LIMIT 5")
def f16_head(spark, sf_dir):
    return cleaning.head(comments(spark, sf_dir), "doc_id")


@query(lambda: f"WITH {_COMMENTS} SELECT * FROM comments ORDER BY doc_id DESC LIMIT 50")
def f16_tail(spark, sf_dir):
    return cleaning.tail(comments(spark, sf_dir), "doc_id")


@query(lambda: f"WITH {_COMMENTS} SELECT clean_comment FROM comments ORDER BY md5('42|sample|' || doc_id), doc_id LIMIT 1")
def f16_sample(spark, sf_dir):
    return sampling.random_rows(comments(spark, sf_dir), 1, "doc_id").select("clean_comment")


@query(lambda: f"""WITH {_COMMENTS} SELECT CAST(0 AS INT) AS position, 'doc_id' AS name, 'bigint' AS type, count(doc_id) AS non_null FROM comments
  UNION ALL SELECT 1, 'clean_comment', 'string', count(clean_comment) FROM comments UNION ALL SELECT 2, 'category', 'int', count(category) FROM comments""")
def f16_info(spark, sf_dir):
    return cleaning.info(comments(spark, sf_dir))


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, CAST(len({_sql_tokens('clean_comment')}) AS INT) AS word_count, CAST(length(clean_comment) AS INT) AS num_chars FROM comments")
def f17_derived_columns(spark, sf_dir):
    return comments(spark, sf_dir).select("doc_id", T.word_count(F.col("clean_comment")).alias("word_count"), F.char_length("clean_comment").alias("num_chars"))


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, CASE category WHEN -1 THEN 2 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS label FROM comments WHERE category IN (-1, 0, 1)")
def f18_remap(spark, sf_dir):
    return comments(spark, sf_dir).select("doc_id", cleaning.remap(F.col("category"), models.TO_CLASS).alias("label")).where("label is not null")


@query(lambda: "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS INT) AS position FROM events ORDER BY event_id LIMIT 25")
def f20_head_in_order(spark, sf_dir):
    return cleaning.head_in_order(_read(spark, sf_dir, "events").select("event_id"), "event_id")


# Text --------------------------------------------------------------------------------------------


def _scalar(name: str, column: Callable, sql: str, kind: str = "") -> None:
    def run(spark, sf_dir):
        return comments(spark, sf_dir).select("doc_id", column(F.col("clean_comment")).alias("value"))

    run.__name__ = name
    query(lambda: f"WITH {_COMMENTS} SELECT doc_id, {f'CAST({sql} AS {kind})' if kind else sql} AS value FROM comments")(run)


_X = "clean_comment"
_scalar("t01_lower", F.lower, f"lower({_X})")
_scalar("t02_strip", T.strip, _sql_strip(_X))
_scalar("t03_newline_to_space", T.newline_to_space, f"replace({_X}, chr(10), ' ')")
_scalar("t04_whitelist", T.whitelist, _sql_whitelist(_X))
_scalar("t05_tokens", lambda c: F.array_join(T.tokens(c), "|"), f"array_to_string({_sql_tokens(_X)}, '|')")
_scalar("t06_stop_words", lambda c: T.joined(T.without(T.tokens(c), T.removed_stop_words())), f"array_to_string({_sql_without(_sql_tokens(_X), T.removed_stop_words())}, ' ')")
_scalar("t08_joined", lambda c: T.joined(T.tokens(c)), f"array_to_string({_sql_tokens(_X)}, ' ')")
_scalar("t10_clean_column", T.clean, _sql_clean(_X))
_scalar("t11_word_count", T.word_count, f"len({_sql_tokens(_X)})", "INT")
_scalar("t12_stop_word_count", T.stop_word_count, f"len(list_filter({_sql_tokens(_X)}, lambda t: t IN ({_listed(T.STOP_WORDS)})))", "INT")
_scalar("t13_char_count", F.char_length, f"length({_X})", "INT")
_scalar("t14_punctuation_count", T.punctuation_count, f"length(regexp_replace({_X}, '[^.,!?;:\"''()\\[\\]{{}}-]', '', 'g'))", "INT")
_scalar("t15_split_word_count", T.word_count, f"len({_sql_tokens(_X)})", "INT")
_scalar("t16_analyzed", lambda c: F.array_join(T.analyzed(c), "|"), f"array_to_string({_sql_analyzed(_X)}, '|')")


@query(lambda: f"WITH {_COMMENTS}, w AS (SELECT doc_id, {_sql_analyzed(_X)} AS t FROM comments) SELECT doc_id, array_to_string({_sql_ngrams('t', 1, 3)}, '|') AS value FROM w")
def t17_ngrams(spark, sf_dir):
    words = comments(spark, sf_dir).select("doc_id", T.analyzed(F.col("clean_comment")).alias("words"))
    return words.select("doc_id", F.array_join(T.ngrams(F.col("words"), 1, 3), "|").alias("value"))


_scalar("t18_vectorizer_stop_words", lambda c: T.joined(T.without(T.analyzed(c), T.VECTORIZER_STOP_WORDS)), f"array_to_string({_sql_without(_sql_analyzed(_X), T.VECTORIZER_STOP_WORDS)}, ' ')")
_scalar("t19_casts", lambda c: F.try_to_number(F.char_length(c).cast("string"), F.lit("999999999")).cast("int").cast("string"), f"CAST(length({_X}) AS VARCHAR)")
_scalar("t20_fixed", lambda c: T.fixed(F.char_length(c).cast("decimal(20,0)") / F.lit(8).cast("decimal(20,0)")).cast("double"), f"CAST(round(CAST(length({_X}) AS DECIMAL(18,3)) * 0.125, 2) AS DOUBLE)")
_scalar("t21_percent_label", lambda c: T.percent_label(F.char_length(c) / 4), f"printf('%.1f%%', length({_X}) / 4)")



def _sql_lemmas() -> str:
    """``lemmas`` (word, lemma) of the words of ``cleaned``: what the rules make of a word, if it is a word too; the shortest, then by rule."""
    rules = " UNION ALL ".join(f"SELECT word, {k} AS rank, left(word, length(word) - {len(old)}) || '{new}' AS c FROM lex WHERE ends_with(word, '{old}') AND length(word) > {len(old)}" for k, (old, new) in enumerate(T.NOUN_RULES))
    irregular = ", ".join(f"('{old}', '{new}')" for old, new in T.NOUN_EXCEPTIONS.items())
    return f"""lex AS (SELECT DISTINCT unnest({_sql_tokens('cleaned')}) AS word FROM cleaned), irregular AS (SELECT * FROM (VALUES {irregular}) AS t(word, lemma)), tried AS ({rules}),
 found AS (SELECT word, arg_min(c, struct_pack(n := length(c), r := rank)) AS lemma FROM tried WHERE c IN (SELECT word FROM lex) AND length(word) >= 4 AND NOT ends_with(word, 'ss')
   AND word NOT IN ({_listed(T.NO_PLURALS)}) GROUP BY 1),
 lemmas AS (SELECT word, coalesce(i.lemma, f.lemma, word) AS lemma FROM lex LEFT JOIN irregular i USING (word) LEFT JOIN found f USING (word))"""


def _lemmatizer(spark, df: DataFrame) -> Lemmatizer:
    return Lemmatizer(spark, _scratch(spark, "lexicon")).fit(df, "clean_comment")


@query(lambda: f"WITH {_CLEANED}, {_sql_lemmas()} SELECT word, lemma FROM lemmas")
def t07_lemmas(spark, sf_dir):
    lemmas = _lemmatizer(spark, comments(spark, sf_dir))
    return lemmas.lemmas(lemmas.lexicon().select("word"))


_NORMALISED = """placed AS (SELECT doc_id, category, unnest({tokens}) AS word, generate_subscripts({tokens}, 1) AS nth FROM cleaned),
 joined AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY nth) AS t FROM placed JOIN lemmas USING (word) GROUP BY 1),
 normalised AS (SELECT c.doc_id, c.category, CASE WHEN cleaned IS NOT NULL THEN coalesce(t, '') END AS normalised FROM cleaned c LEFT JOIN joined USING (doc_id))"""


def _sql_normalised() -> str:
    return f"{_CLEANED}, {_sql_lemmas()}, {_NORMALISED.format(tokens=_sql_tokens('cleaned'))}"


def normalised(spark, sf_dir) -> DataFrame:
    df = comments(spark, sf_dir)
    return _lemmatizer(spark, df).normalise(df, "clean_comment", "normalised", fitted=True).select("doc_id", "category", "normalised")


@query(lambda: f"WITH {_sql_normalised()} SELECT doc_id, normalised FROM normalised")
def t09_normalised(spark, sf_dir):
    return normalised(spark, sf_dir).select("doc_id", "normalised")


# Corpus statistics -------------------------------------------------------------------------------


@query(lambda: f"WITH {_COMMENTS} SELECT category, count(*) AS n FROM comments GROUP BY 1")
def a01_class_counts(spark, sf_dir):
    return stats.class_counts(comments(spark, sf_dir))


@query(lambda: f"WITH {_COMMENTS} SELECT category, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS share FROM comments WHERE category IS NOT NULL GROUP BY 1")
def a02_class_shares(spark, sf_dir):
    return stats.class_shares(comments(spark, sf_dir))


def _sized(spark, sf_dir):
    c = F.col("clean_comment")
    return comments(spark, sf_dir).select("doc_id", "category", T.word_count(c).alias("word_count"), F.char_length(c).alias("num_chars"), T.stop_word_count(c).alias("num_stop_words"))


_SIZED = f"""{_COMMENTS}, sized AS (SELECT doc_id, category, len({_sql_tokens(_X)}) AS word_count, length(clean_comment) AS num_chars,
  len(list_filter({_sql_tokens(_X)}, lambda t: t IN ({_listed(T.STOP_WORDS)}))) AS num_stop_words FROM comments)"""


@query(lambda: f"""WITH {_SIZED} SELECT count(word_count) AS n, round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std, CAST(min(word_count) AS INT) AS min,
 quantile_cont(word_count, 0.25) AS p25, quantile_cont(word_count, 0.5) AS p50, quantile_cont(word_count, 0.75) AS p75, CAST(max(word_count) AS INT) AS max FROM sized""")
def a03_describe(spark, sf_dir):
    return quantiles.describe(_sized(spark, sf_dir), "word_count").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(lambda: f"WITH {_SIZED} SELECT category, quantile_cont(word_count, 0.5) AS median FROM sized GROUP BY 1")
def a04_median_by_class(spark, sf_dir):
    return quantiles.quantiles(_sized(spark, sf_dir), "word_count", [0.5], ["category"], ["median"])


def _sql_drawn() -> str:
    """``medians`` (category, m) of each repetition of the bootstrap."""
    of = "CAST('0x' || substr(md5('42draw' || CAST(r // 8 AS VARCHAR) || '|' || doc_id), CAST(r % 8 * 4 + 1 AS INT), 4) AS INT)"
    times = " + ".join(f"CASE WHEN h >= {b} THEN 1 ELSE 0 END" for b in quantiles._POISSON)
    return f"""{_SIZED}, hashed AS (SELECT category, word_count, r, {of} AS h FROM sized, range({quantiles.REPEATS}) AS g(r) WHERE word_count IS NOT NULL),
 drawn AS (SELECT category, word_count, r, unnest(range({times})) FROM hashed), medians AS (SELECT category, r, quantile_cont(word_count, 0.5) AS m FROM drawn GROUP BY 1, 2)"""


@query(lambda: f"""WITH {_sql_drawn()}, ends AS (SELECT category, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM medians GROUP BY 1),
 whole AS (SELECT category, quantile_cont(word_count, 0.5) AS median FROM sized GROUP BY 1)
SELECT w.category, median, round(low, 6) AS low, round(high, 6) AS high FROM whole w LEFT JOIN ends e ON w.category IS NOT DISTINCT FROM e.category""")
def a04_median_intervals(spark, sf_dir):
    """Medians with the error bars of a bootstrap."""
    found = quantiles.median_interval(_sized(spark, sf_dir), "doc_id", "category", "word_count")
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def _sql_box(by: bool) -> str:
    key, group, join = ("category, ", "GROUP BY category", "s.category IS NOT DISTINCT FROM b.category") if by else ("", "", "true")
    pick = "s.category, " if by else ""
    return f"""WITH {_SIZED}, b AS (SELECT {key}quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS q2, quantile_cont(word_count, 0.75) AS q3 FROM sized {group})
SELECT {pick}q1, q2, q3, CAST(min(word_count) FILTER (WHERE word_count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS INT) AS low,
 CAST(max(word_count) FILTER (WHERE word_count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS INT) AS high,
 count(*) FILTER (WHERE word_count NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM sized s JOIN b ON {join} GROUP BY {pick}q1, q2, q3"""


@query(lambda: _sql_box(False))
def a05_box(spark, sf_dir):
    return quantiles.box(_sized(spark, sf_dir), "word_count")


@query(lambda: _sql_box(True))
def a05_box_by_class(spark, sf_dir):
    return quantiles.box(_sized(spark, sf_dir), "word_count", "category")


@query(lambda: f"WITH {_SIZED} SELECT CAST(floor(word_count / 50) AS BIGINT) AS bin, count(*) AS n FROM sized GROUP BY 1")
def a06_histogram(spark, sf_dir):
    return stats.histogram(_sized(spark, sf_dir), "word_count", 50)


@query(lambda: f"""WITH {_SIZED}, q AS (SELECT count(word_count) AS n, min(word_count) AS lo, max(word_count) AS hi, quantile_cont(word_count, 0.75) - quantile_cont(word_count, 0.25) AS r FROM sized),
 w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS by_count, 2 * r / pow(n, CAST(1 AS DOUBLE) / 3) AS by_range FROM q),
 b AS (SELECT *, greatest(1, CAST(ceil((hi - lo) / CASE WHEN by_range > 0 THEN least(by_range, by_count) ELSE by_count END) AS INT)) AS bins FROM w),
 g AS (SELECT CAST(unnest(range(bins)) AS INT) AS bin, lo, hi, bins FROM b), c AS (SELECT least(CAST(floor(CAST(word_count - lo AS DOUBLE) / (hi - lo) * bins) AS INT), bins - 1) AS bin, count(*) AS n FROM sized, b GROUP BY 1)
SELECT bin, round(lo + bin * (hi - lo) / bins, 6) AS low, round(lo + (bin + 1) * (hi - lo) / bins, 6) AS high, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bin)""")
def a06_automatic_bins(spark, sf_dir):
    return quantiles.automatic_bins(_sized(spark, sf_dir), "word_count").withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(lambda: f"""WITH {_SIZED}, h AS (SELECT category, count(*) AS n, stddev_samp(num_stop_words) * pow(count(*), -0.2) AS h FROM sized WHERE category IS NOT NULL GROUP BY 1),
 grid AS (SELECT unnest(range(0, 21)) * 10.0 AS x)
SELECT s.category, CAST(x AS DOUBLE) AS x, round(avg(exp(-pow((x - num_stop_words) / h.h, 2) / 2) / (h.h * sqrt(2 * pi()))), 6) AS density FROM sized s JOIN h USING (category), grid GROUP BY 1, 2""")
def a07_kde(spark, sf_dir):
    return stats.kde(_sized(spark, sf_dir).where("category is not null"), "num_stop_words", "category", 0.0, 200.0, 20).withColumn("density", F.round("density", 6))


@query(lambda: f"WITH {_SIZED} SELECT category, CAST(word_count AS INT) AS word_count FROM sized")
def a08_scatter(spark, sf_dir):
    return _sized(spark, sf_dir).select("category", "word_count")


@query(lambda: f"WITH {_COMMENTS}, w AS (SELECT unnest({_sql_tokens(_X)}) AS word FROM comments) SELECT word, count(*) AS n FROM w WHERE word IN ({_listed(T.STOP_WORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def a09_top_stop_words(spark, sf_dir):
    return stats.top_stop_words(comments(spark, sf_dir), "clean_comment")


_CHARS = f"""{_COMMENTS}, chars AS (SELECT character, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT character, count(*) AS n FROM (SELECT unnest(string_split(clean_comment, '')) AS character FROM comments) WHERE character <> '' GROUP BY 1
  UNION ALL SELECT ' ', count(*) - 1 FROM comments WHERE clean_comment IS NOT NULL) GROUP BY 1)"""


@query(lambda: f"WITH {_CHARS} SELECT * FROM chars")
def a10_characters(spark, sf_dir):
    return stats.characters(comments(spark, sf_dir), "clean_comment")


@query(lambda: f"WITH {_CHARS} SELECT * FROM chars ORDER BY n, character LIMIT 50")
def a11_rarest_characters(spark, sf_dir):
    return stats.rarest_characters(comments(spark, sf_dir), "clean_comment")


def _sql_top_ngrams(n: int, k: int) -> str:
    left = _sql_without(_sql_analyzed(_X), T.VECTORIZER_STOP_WORDS)
    return f"""WITH {_COMMENTS}, w AS (SELECT {left} AS t FROM comments), g AS (SELECT unnest({_sql_ngrams('t', n, n)}) AS ngram FROM w)
SELECT ngram, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


@query(lambda: _sql_top_ngrams(2, 25))
def a12_top_bigrams(spark, sf_dir):
    return stats.top_ngrams(comments(spark, sf_dir), "clean_comment", 2, 25)


@query(lambda: _sql_top_ngrams(3, 25))
def a13_top_trigrams(spark, sf_dir):
    return stats.top_ngrams(comments(spark, sf_dir), "clean_comment", 3, 25)


@query(lambda: f"WITH {_CLEANED}, w AS (SELECT unnest({_sql_tokens('cleaned')}) AS word FROM cleaned) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def a14_top_words(spark, sf_dir):
    return stats.top(stats.words(cleaned(spark, sf_dir), "cleaned", cleaned=True), "word", 50)


@query(lambda: f"""WITH {_CLEANED}, w AS (SELECT unnest({_sql_tokens('cleaned')}) AS word, category FROM cleaned)
SELECT word, count(*) FILTER (WHERE category = -1) AS negative, count(*) FILTER (WHERE category = 0) AS neutral, count(*) FILTER (WHERE category = 1) AS positive, count(*) AS total
FROM w GROUP BY 1 ORDER BY total DESC, word LIMIT 20 OFFSET 10""")
def a15_top_words_by_class(spark, sf_dir):
    return stats.top_words_by_class(cleaned(spark, sf_dir), "cleaned", 20, 10, cleaned=True)


def _sql_cloud(rows: str, by: str = "", pairs: bool = True) -> str:
    """``rows``: a SELECT of ``t``, the words of a text, and the class ``by``.  Case and plurals are folded."""
    of, same = (f"{by}, ", lambda a, b: f"{a}.{by} IS NOT DISTINCT FROM {b}.{by} AND ") if by else ("", lambda a, b: "")
    plural = "ends_with(lower(c.term), 's') AND NOT ends_with(lower(c.term), 'ss') AND k.low = left(lower(c.term), length(c.term) - 1)"
    k = "c.category, " if by else ""
    l = lambda k, n, x: f"(ln(greatest({x}, 1e-10)) * {k} + ln(greatest(1 - {x}, 1e-10)) * ({n} - {k}))"
    p, p1, p2 = "(1.0::DOUBLE * n2 / total)", "(1.0::DOUBLE * n / n1)", "coalesce(1.0::DOUBLE * (n2 - n) / nullif(total - n1, 0), 0)"
    ratio = f"-2 * ({l('n', 'n1', p)} + {l('(n2 - n)', '(total - n1)', p)} - {l('n', 'n1', p1)} - {l('(n2 - n)', '(total - n1)', p2)})"
    found = f"""SELECT {of}form AS term, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {of}form, n FROM words UNION ALL SELECT {of}f1, -n FROM strong UNION ALL SELECT {of}f2, -n FROM strong) GROUP BY ALL HAVING sum(n) > 0
   UNION ALL SELECT {of}f1 || ' ' || f2, CAST(n AS BIGINT) FROM strong""" if pairs else f"SELECT {of}form AS term, CAST(n AS BIGINT) AS n FROM words"
    return f"""held AS ({rows}), counted AS (SELECT {of}term, count(*) AS n FROM (SELECT {of}unnest(t) AS term FROM held) GROUP BY ALL), known AS (SELECT DISTINCT {of}lower(term) AS low FROM counted),
 rooted AS (SELECT {k}c.term, n, coalesce(k.low, lower(c.term)) AS root, CASE WHEN k.low IS NULL THEN c.term ELSE left(c.term, length(c.term) - 1) END AS spelt FROM counted c LEFT JOIN known k ON {same('c', 'k')}{plural}),
 spelt AS (SELECT {of}root, spelt, sum(n) AS m FROM rooted GROUP BY ALL), best AS (SELECT {of}root, arg_min(spelt, (-m, spelt)) AS form FROM spelt GROUP BY ALL),
 forms AS (SELECT {k}c.term, form, n FROM rooted c JOIN best b ON {same('c', 'b')}c.root = b.root), words AS (SELECT {of}form, sum(n) AS n FROM forms GROUP BY ALL),
 pairs AS (SELECT {of}t[i] AS a, t[i + 1] AS b, count(*) AS n FROM (SELECT {of}t, unnest(range(1, len(t))) AS i FROM held) GROUP BY ALL),
 both_ AS (SELECT {k}x.form AS f1, y.form AS f2, sum(c.n) AS n FROM pairs c JOIN forms x ON {same('c', 'x')}c.a = x.term JOIN forms y ON {same('c', 'y')}c.b = y.term GROUP BY ALL),
 totals AS (SELECT {of}sum(n) AS total FROM words GROUP BY ALL),
 strong AS (SELECT * FROM (SELECT c.*, u.n AS n1, v.n AS n2, total FROM both_ c JOIN words u ON {same('c', 'u')}c.f1 = u.form JOIN words v ON {same('c', 'v')}c.f2 = v.form JOIN totals z ON {same('c', 'z')}true) WHERE {ratio} > {stats.COLLOCATION}),
 clouded AS ({found}), ranked AS (SELECT *, row_number() OVER (PARTITION BY {by or 1} ORDER BY n DESC, term) AS nth FROM clouded)
SELECT {of}term AS word, n, round(n / max(n) OVER (PARTITION BY {by or 1}), 6) AS weight FROM ranked WHERE nth <= 200"""


@query(lambda: f"WITH {_CLEANED}, {_sql_cloud(f'SELECT {_sql_tokens("cleaned")} AS t FROM cleaned WHERE cleaned IS NOT NULL')}")
def a16_word_cloud(spark, sf_dir):
    """Words and collocations of all comments."""
    return stats.cloud(cleaned(spark, sf_dir), T.cleaned_words(F.col("cleaned")), pairs=True, fold=True).withColumn("weight", F.round("weight", 6))


@query(lambda: f"WITH {_CLEANED}, {_sql_cloud(f'SELECT category, {_sql_tokens("cleaned")} AS t FROM cleaned WHERE category IS NOT NULL AND cleaned IS NOT NULL', 'category')}")
def a16_word_cloud_of_class(spark, sf_dir):
    """The same for each of the three classes."""
    held = cleaned(spark, sf_dir).where("category is not null")
    return stats.cloud(held, T.cleaned_words(F.col("cleaned")), by="category", pairs=True, fold=True).withColumn("weight", F.round("weight", 6))


@query(lambda: f"WITH {_sql_normalised()}, {_sql_cloud(f'SELECT {_sql_without(_sql_tokens("normalised"), T.STOP_WORDS)} AS t FROM normalised WHERE normalised IS NOT NULL', pairs=False)}")
def a17_request_word_cloud(spark, sf_dir):
    """Normalised, without any stop word, and without collocations."""
    return stats.cloud(normalised(spark, sf_dir), T.without(T.cleaned_words(F.col("normalised")), T.STOP_WORDS), fold=True).withColumn("weight", F.round("weight", 6))


@query(lambda: """SELECT conv_id, turn, text, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY conv_id, turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM conversations WHERE text IS NOT NULL""")
def a30_concatenated(spark, sf_dir):
    return stats.concatenated(_read(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


# Indicators and trends ---------------------------------------------------------------------------


@query(lambda: f"WITH {_SCORED} SELECT count(*) FILTER (WHERE sentiment = -1) AS negative, count(*) FILTER (WHERE sentiment = 0) AS neutral, count(*) FILTER (WHERE sentiment = 1) AS positive FROM scored")
def a18_sentiment_counts(spark, sf_dir):
    return kpi.sentiment_counts(scored(spark, sf_dir))


@query(lambda: f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE sentiment = 1) AS p, count(*) FILTER (WHERE sentiment = 0) AS u, count(*) FILTER (WHERE sentiment = -1) AS g FROM scored),
 r AS (SELECT 1 AS position, 'Positive' AS label, p AS n FROM c UNION ALL SELECT 2, 'Neutral', u FROM c UNION ALL SELECT 3, 'Negative', g FROM c)
SELECT position, label, n, round(n * 100 / sum(n) OVER (), 6) AS share, printf('%.1f%%', n * 100 / sum(n) OVER ()) AS shown FROM r""")
def a19_pie(spark, sf_dir):
    return kpi.pie(scored(spark, sf_dir)).withColumn("share", F.round("share", 6))


_KPI = f"""k AS (SELECT count(*) AS total_comments, count(DISTINCT coalesce(nullif(role, ''), 'Unknown')) AS unique_commenters, CAST(sum(len({_sql_tokens('text')})) AS BIGINT) AS words,
  CAST(sum(len({_sql_tokens('text')}) % 3 - 1) AS BIGINT) AS sentiment FROM conversations)"""
_ROUNDED = "CAST(floor(abs({0}) * 100 + 0.5) / 100 * sign({0}) AS DOUBLE)"


def _kpis(spark, sf_dir):
    out = kpi.summary(dialogue(spark, sf_dir), "text", "role", "sentiment")
    return out.withColumns({c: F.col(c).cast("double") for c in ("average_words", "average_sentiment", "normalised_score")})


def _ratio(a: str) -> str:
    """Half up to two digits, from integers."""
    return f"(CASE WHEN {a} < 0 THEN -1 ELSE 1 END * ((abs({a}) * 200 + total_comments) // (2 * total_comments)))"


_AVG_WORDS, _AVG = f"{_ratio('words')} / 100", f"{_ratio('sentiment')}"


@query(lambda: f"WITH {_KPI} SELECT total_comments FROM k")
def a20_total_comments(spark, sf_dir):
    return _kpis(spark, sf_dir).select("total_comments")


@query(lambda: f"WITH {_KPI} SELECT unique_commenters FROM k")
def a21_unique_commenters(spark, sf_dir):
    return _kpis(spark, sf_dir).select("unique_commenters")


@query(lambda: f"WITH {_KPI} SELECT CAST({_AVG_WORDS} AS DOUBLE) AS average_words FROM k")
def a22_average_words(spark, sf_dir):
    return _kpis(spark, sf_dir).select("average_words")


@query(lambda: f"WITH {_KPI} SELECT CAST({_AVG} / 100 AS DOUBLE) AS average_sentiment FROM k")
def a23_average_sentiment(spark, sf_dir):
    return _kpis(spark, sf_dir).select("average_sentiment")


@query(lambda: f"WITH {_KPI} SELECT CAST(({_AVG} + 100) * 5 / 100 AS DOUBLE) AS normalised_score FROM k")
def a24_normalised_score(spark, sf_dir):
    return _kpis(spark, sf_dir).select("normalised_score")


@query(lambda: f"""WITH {_KPI} SELECT total_comments, unique_commenters, CAST({_AVG_WORDS} AS DOUBLE) AS average_words, CAST({_AVG} / 100 AS DOUBLE) AS average_sentiment,
 CAST(({_AVG} + 100) * 5 / 100 AS DOUBLE) AS normalised_score FROM k""")
def a25_summary(spark, sf_dir):
    return _kpis(spark, sf_dir)


_SQL_TREND = """counted AS (SELECT {period} AS period, count(*) FILTER (WHERE s = -1) AS negative, count(*) FILTER (WHERE s = 0) AS neutral, count(*) FILTER (WHERE s = 1) AS positive FROM {source} GROUP BY 1),
 t AS (SELECT *, negative + neutral + positive AS total FROM counted)"""
_ORDERS_TREND = _SQL_TREND.format(period="CAST(last_day(o_orderdate) AS DATE)", source="(SELECT o_orderdate, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 0 ELSE 1 END AS s FROM orders)")
_PERCENTS = "round(negative * 100 / total, 6) AS negative_percent, round(neutral * 100 / total, 6) AS neutral_percent, round(positive * 100 / total, 6) AS positive_percent"


def _rounded_trend(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_percent")})


@query(lambda: f"WITH {_ORDERS_TREND} SELECT period, negative, neutral, positive FROM t")
def a26_monthly_counts(spark, sf_dir):
    return kpi.trend(scored_orders(spark, sf_dir), "timestamp", "sentiment").select("period", "negative", "neutral", "positive")


@query(lambda: f"WITH {_ORDERS_TREND} SELECT period, negative, neutral, positive FROM t")
def a26_streamed_counts(spark, sf_dir):
    """The same as a stream with state, stopped half way and started again from its checkpoint; rows come in four parts, in order of time."""
    orders = scored_orders(spark, sf_dir)
    cuts = orders.select(F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("t")).stat.approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    part = sum((F.when(F.unix_timestamp(F.col("timestamp").cast("timestamp")) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    source, checkpoint, out = (_scratch(spark, name) for name in ("orders", "checkpoint", "days"))
    dealt, schema = orders.withColumn("_part", part), orders.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for k in range(4):
        dealt.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            monthly.advance(spark, source, schema, checkpoint, out)
    return monthly.months(spark, out)


@query(lambda: f"WITH {_ORDERS_TREND} SELECT period, total, {_PERCENTS} FROM t")
def a27_row_percentages(spark, sf_dir):
    return _rounded_trend(kpi.trend(scored_orders(spark, sf_dir), "timestamp", "sentiment")).drop("negative", "neutral", "positive")


@query(lambda: f"WITH {_SCORED}, {_SQL_TREND.format(period='CAST(ts AS DATE)', source='(SELECT timestamp AS ts, sentiment AS s FROM scored WHERE sentiment >= 0)')} SELECT period, negative, neutral, positive FROM t")
def a28_absent_class(spark, sf_dir):
    return kpi.trend(scored(spark, sf_dir).where("sentiment >= 0"), "timestamp", "sentiment", "day").select("period", "negative", "neutral", "positive")


@query(lambda: f"WITH {_ORDERS_TREND} SELECT period, negative, neutral, positive, total, {_PERCENTS} FROM t")
def a29_monthly_trend(spark, sf_dir):
    return _rounded_trend(kpi.trend(scored_orders(spark, sf_dir), "timestamp", "sentiment"))


@query(lambda: f"WITH {_SCORED}, {_SQL_TREND.format(period='CAST(ts AS DATE)', source='(SELECT timestamp AS ts, sentiment AS s FROM scored)')} SELECT period, negative, neutral, positive, total, {_PERCENTS} FROM t")
def a29_daily_trend(spark, sf_dir):
    return _rounded_trend(kpi.trend(scored(spark, sf_dir), "timestamp", "sentiment", "day"))


# Features ----------------------------------------------------------------------------------------


def _sql_terms(lo: int, hi: int, k: int) -> str:
    return f"""{_COMMENTS}, tok AS (SELECT doc_id, {_sql_analyzed(_X)} AS t FROM comments), g AS (SELECT doc_id, unnest({_sql_ngrams('t', lo, hi)}) AS term FROM tok),
 terms AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM terms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k})"""


_IDF = "idf AS (SELECT *, ln((1 + (SELECT count(*) FROM {0})) / (1 + df)) + 1 AS idf FROM vocab)"


@query(lambda: f"WITH {_sql_terms(1, 1, 5000)} SELECT doc_id, term, tf FROM terms JOIN vocab USING (term)")
def v01_bag_of_words(spark, sf_dir):
    return features.bag(comments(spark, sf_dir), "doc_id", "clean_comment", (1, 1), 5000)


@query(lambda: f"""WITH {_sql_terms(1, 3, 1000)}, {_IDF.format('comments')}, w AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def v02_tfidf(spark, sf_dir):
    return features.tfidf(comments(spark, sf_dir), "doc_id", "clean_comment").withColumn("weight", F.round("weight", 6))


@query(lambda: f"""WITH {_sql_terms(1, 1, 100000)}, tv AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM terms WHERE doc_id % 5 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM comments WHERE doc_id % 5 <> 0)) / (1 + df)) + 1 AS idf FROM tv),
 w AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN idf USING (term) WHERE doc_id % 5 = 0) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def v03_transform_only(spark, sf_dir):
    """Fitted on four fifths of the documents and applied to the rest: the split is what the operator is for."""
    df = comments(spark, sf_dir)
    model = features.fit_tfidf(df.where("doc_id % 5 <> 0"), "doc_id", "clean_comment", 1000, (1, 1))
    return features.transform_tfidf(df.where("doc_id % 5 = 0"), model, "doc_id", "clean_comment", (1, 1)).withColumn("weight", F.round("weight", 6))


@query(lambda: f"WITH {_sql_terms(1, 1, 1000000000)} SELECT term, total FROM vocab")
def v04_term_totals(spark, sf_dir):
    return features.term_totals(comments(spark, sf_dir), "doc_id", "clean_comment")


@query(lambda: f"""WITH {_sql_terms(1, 1, 100)}, {_IDF.format('comments')}, placed AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, term) - 1 AS INT) AS place FROM idf),
 w AS (SELECT doc_id, place, tf * idf AS w FROM terms JOIN placed USING (term)), u AS (SELECT doc_id, place, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
SELECT c.doc_id, place, round(coalesce(u.w, 0), 6) AS weight FROM comments c CROSS JOIN placed LEFT JOIN u USING (doc_id, place)""")
def v05_dense(spark, sf_dir):
    """Dense vectors, a row for each of their numbers."""
    df = comments(spark, sf_dir)
    held = features.dense(features.Vectorizer(100, (1, 1)).fit(df, "clean_comment").transform(df.select("doc_id", "clean_comment"), "clean_comment"))
    return held.select("doc_id", F.posexplode_outer("features").alias("place", "weight")).withColumn("weight", F.round("weight", 6))


@query(lambda: f"WITH {_sql_terms(1, 3, 1000)}, {_IDF.format('comments')} SELECT term, total, df, round(idf, 6) AS idf FROM idf")
def v06_vocabulary(spark, sf_dir):
    return features.fit_tfidf(comments(spark, sf_dir), "doc_id", "clean_comment").withColumn("idf", F.round("idf", 6))


_PARAMS = models.Params()


def _labelled_comments(spark, sf_dir):
    return cleaning.drop_null(comments(spark, sf_dir), ["clean_comment", "category"])


def _swept(spark, sf_dir, grid):
    found = models.sweep(_training_comments(spark, sf_dir), "doc_id", "clean_comment", grid, _PARAMS)
    return spark.createDataFrame([(str(s), float(a)) for s, a in found], "setting string, accuracy double")


@query()
def v07_vectorizer_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, [{"max_features": 5000, "ngram_range": r, "tfidf": w} for w in (False, True) for r in ((1, 1), (1, 2), (1, 3))])


@query()
def v08_vocabulary_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, [{"max_features": n, "ngram_range": (1, 3)} for n in range(1000, 11000, 1000)])


# Splits and resampling ---------------------------------------------------------------------------


@query(lambda: "SELECT doc_id, row_number() OVER (ORDER BY md5('42||' || doc_id), doc_id) <= ceil(count(*) OVER () * 0.2) AS is_test FROM documents")
def b01_split(spark, sf_dir):
    return sampling.split(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(lambda: f"WITH {_COMMENTS} SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42||' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY category) * 0.2) AS is_test FROM comments WHERE category IS NOT NULL")
def b02_stratified_split(spark, sf_dir):
    return sampling.split(_labelled_comments(spark, sf_dir).select("doc_id", "category"), "doc_id", stratify="category")


@query(lambda: f"WITH {_COMMENTS} SELECT category, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM comments WHERE category IS NOT NULL GROUP BY 1")
def b03_class_weights(spark, sf_dir):
    return sampling.class_weights(_labelled_comments(spark, sf_dir), "category").withColumn("weight", F.round("weight", 6))


def _sql_uniform(salt: str) -> str:
    return f"(CAST('0x' || left(md5('42{salt}|' || vec_id || '|' || i), 13) AS BIGINT) / 4503599627370496.0)"


def _sql_nearest(rows: str, k: int, same: str = "true") -> str:
    """(vec_id, rank, neighbour, other) of the k nearest other rows."""
    return f"""(SELECT * FROM (SELECT q.vec_id, p.vec_id AS neighbour, p.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, p.e), p.vec_id) AS rank
    FROM {rows} q JOIN {rows} p ON q.vec_id <> p.vec_id AND {same}) WHERE rank <= {k})"""


def _sql_grown(name: str, wanted: str) -> str:
    """Table ``name``: the rows and the synthetic ones, whose numbers are below zero; ``wanted`` has (vec_id, times)."""
    return f"""{name}_base AS (SELECT vec_id, e, label, unnest(range(1, CAST(times AS BIGINT) + 1)) AS i FROM v JOIN {wanted} USING (vec_id) WHERE times > 0),
 {name}_near AS (SELECT vec_id, list(neighbour ORDER BY rank) AS near FROM nearest_own GROUP BY 1),
 {name}_pick AS (SELECT b.*, near[CAST(floor({_sql_uniform('pick')} * len(near)) AS BIGINT) + 1] AS pick, {_sql_uniform('u')} AS u FROM {name}_base b JOIN {name}_near USING (vec_id)),
 {name} AS (SELECT vec_id, e, label FROM v UNION ALL SELECT -row_number() OVER (), list_transform(list_zip(a.e, b.e), lambda z: z[1] + a.u * (z[2] - z[1])), a.label FROM {name}_pick a JOIN v b ON b.vec_id = a.pick)"""


def _sql_resampled() -> str:
    """Tables ``smoted``, ``adapted`` and ``edited``."""
    return f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS gap FROM v GROUP BY 1),
 nearest_own AS {_sql_nearest('v', 5, 'q.label = p.label')}, nearest_any AS {_sql_nearest('v', 5)},
 evenly AS (SELECT vec_id, gap // n + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42||' || vec_id), vec_id) <= gap % n THEN 1 ELSE 0 END AS times FROM v JOIN sizes USING (label)),
 hard AS (SELECT vec_id, v.label, count(*) FILTER (WHERE other <> v.label) AS hard FROM nearest_any JOIN v USING (vec_id) GROUP BY 1, 2), whole AS (SELECT *, sum(hard) OVER (PARTITION BY label) AS whole FROM hard),
 adapting AS (SELECT vec_id, round(CASE WHEN whole > 0 THEN CAST(hard AS DOUBLE) / CAST(whole AS DOUBLE) ELSE 1.0 / CAST(n AS DOUBLE) END * gap) AS times FROM whole JOIN sizes USING (label)),
 {_sql_grown('smoted', 'evenly')}, {_sql_grown('adapted', 'adapting')},
 agree AS (SELECT g.vec_id, count(*) FILTER (WHERE other = g.label) AS agree, count(*) AS k FROM {_sql_nearest('smoted', 3)} x JOIN smoted g USING (vec_id) GROUP BY 1),
 edited AS (SELECT s.* FROM smoted s JOIN agree USING (vec_id) WHERE 2 * agree >= k)"""


def _sql_numbers(rows: str) -> str:
    return f"WITH {_sql_resampled()} SELECT CASE WHEN vec_id >= 0 THEN vec_id END AS vec_id, label, CAST(generate_subscripts(e, 1) - 1 AS INT) AS place, round(unnest(e), 6) AS value FROM {rows}"


def _numbers(df: DataFrame) -> DataFrame:
    """A row for each number of each vector; synthetic rows have no id."""
    known = F.when(F.col("vec_id") >= 0, F.col("vec_id")).alias("vec_id")
    return df.select(known, "label", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.round("value", 6))


@query(lambda: _sql_numbers("smoted"))
def b04_smote(spark, sf_dir):
    return _numbers(sampling.smote(vectors(spark, sf_dir), "vec_id", "embedding", "label"))


@query(lambda: _sql_numbers("adapted"))
def b05_adasyn(spark, sf_dir):
    return _numbers(sampling.adasyn(vectors(spark, sf_dir), "vec_id", "embedding", "label"))


@query(lambda: f"""WITH {_COMMENTS}, r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42||' || doc_id), doc_id) AS nth FROM comments WHERE category IS NOT NULL),
 least AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM r GROUP BY category)) SELECT doc_id, category FROM r, least WHERE nth <= n""")
def b06_undersample(spark, sf_dir):
    return sampling.undersample(_labelled_comments(spark, sf_dir).select("doc_id", "category"), "doc_id", "category")


@query(lambda: _sql_numbers("edited"))
def b07_smote_enn(spark, sf_dir):
    return _numbers(sampling.smote_enn(vectors(spark, sf_dir), "vec_id", "embedding", "label"))


@query(lambda: f"""WITH {_sql_resampled()} SELECT 'class_weights' AS method, label, n FROM sizes UNION ALL SELECT 'oversampling', label, count(*) FROM smoted GROUP BY 2 UNION ALL SELECT 'adasyn', label, count(*) FROM adapted GROUP BY 2
 UNION ALL SELECT 'undersampling', label, (SELECT min(n) FROM sizes) FROM sizes UNION ALL SELECT 'smote_enn', label, count(*) FROM edited GROUP BY 2""")
def b08_resample(spark, sf_dir):
    """How many rows of each class every method gives."""
    out = None
    for method in sampling.METHODS:
        n = sampling.resample(vectors(spark, sf_dir), method, "vec_id", "embedding", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(method).alias("method"), "label", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(lambda: "SELECT doc_id FROM documents ORDER BY md5('42|sample|' || doc_id), doc_id LIMIT 100")
def b09_random_rows(spark, sf_dir):
    return sampling.random_rows(_read(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


# Models ------------------------------------------------------------------------------------------


def _training_comments(spark, sf_dir):
    """Labelled comments, normalised, as the models are trained and asked."""
    return _trained_lemmas(spark, sf_dir)[1]


def _trained_lemmas(spark, sf_dir):
    df = _labelled_comments(spark, sf_dir)
    lemmas = _lemmatizer(spark, df)
    # Written once, as the split, the vocabulary and the vectors all read it.
    return lemmas, scratch.table(lemmas.normalise(df, "clean_comment", "clean_comment", fitted=True), "normalised")


def _sets(spark, sf_dir, max_features: int = 1000):
    return _sets_of(_training_comments(spark, sf_dir), max_features)


def _sets_of(normalised: DataFrame, max_features: int = 1000):
    train, test = sampling.train_test(normalised, "doc_id", stratify="category")
    vec = features.Vectorizer(max_features, (1, 3)).fit(train, "clean_comment")
    return scratch.table(models.labelled(vec.transform(train, "clean_comment")), "training"), models.labelled(vec.transform(test, "clean_comment")), vec


def _predictions(spark, sf_dir, model, max_features: int = 1000):
    train, test, _ = _sets(spark, sf_dir, max_features)
    return models.sentiment(models.trained_and_scored(model, train, test)[1]).select("doc_id", "category", "sentiment")


@query()
def m01_boosted_trees(spark, sf_dir):
    return _predictions(spark, sf_dir, models.boosted(_PARAMS))


@query()
def m02_random_forest(spark, sf_dir):
    return _predictions(spark, sf_dir, models.forest(_PARAMS), 10_000)


@query()
def m03_boosted_trees_tuned(spark, sf_dir):
    """With the parameters that the search finds best."""
    train, test, _ = _sets(spark, sf_dir)
    return models.sentiment(models.trained_and_scored(models.tuned(models.search(train)[0]), train, test)[1]).select("doc_id", "category", "sentiment")


@query()
def m04_logistic(spark, sf_dir):
    return _predictions(spark, sf_dir, models.logistic())


@query(lambda: """WITH d AS (SELECT q.vec_id, p.label AS other, p.vec_id AS pid, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist
  FROM embeddings q JOIN embeddings p ON q.vec_id % 5 = 0 AND p.vec_id % 5 <> 0),
 near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, pid) AS r FROM d), votes AS (SELECT vec_id, other, count(*) AS n FROM near WHERE r <= 5 GROUP BY 1, 2)
SELECT vec_id, other AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, other) AS b FROM votes) WHERE b = 1""")
def m05_knn(spark, sf_dir):
    """Trained on four fifths of the vectors and asked about the rest: the split is what the operator is for."""
    v = vectors(spark, sf_dir)
    return models.knn_predict(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "vec_id", "embedding", "label")


@query()
def m06_stacking(spark, sf_dir):
    train, test, _ = _sets(spark, sf_dir, 10_000)
    return models.stack(train, test, "doc_id", [models.boosted(models.Params(learning_rate=0.08081298097796712)), models.logistic()], _PARAMS).select("doc_id", "category", "prediction")


@query()
def m07_search(spark, sf_dir):
    train, _, _ = _sets(spark, sf_dir)
    best, got = models.search(train)
    return spark.createDataFrame([(best.learning_rate, best.depth, best.rounds, float(got))], "learning_rate double, depth int, rounds int, accuracy double")


@query()
def m08_train_and_score(spark, sf_dir):
    train, test, _ = _sets(spark, sf_dir)
    scored_ = models.trained_and_scored(models.logistic(), train, test)[1]
    return spark.createDataFrame([(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored_),)], "accuracy double")


@query()
def m09_batch_predict(spark, sf_dir):
    return _predictions(spark, sf_dir, models.logistic())


def _scorer(spark, sf_dir):
    lemmas, normalised = _trained_lemmas(spark, sf_dir)
    train, _, vec = _sets_of(normalised)
    return models.Scorer(lemmas, vec, models.logistic().fit(train))


@query()
def m10_score_comments(spark, sf_dir):
    return _scorer(spark, sf_dir).score(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")


@query()
def m11_score_timed_comments(spark, sf_dir):
    timed = _read(spark, sf_dir, "conversations").withColumn("at", F.lit("2024-01-01T00:00:00Z"))
    return _scorer(spark, sf_dir).score_with_timestamps(timed, "text", "at")


# Evaluation --------------------------------------------------------------------------------------

_CELLS = f"""{_PREDICTED}, cls AS (SELECT unnest([-1, 0, 1]) AS c), m AS (SELECT c, (SELECT count(*) FROM predicted WHERE label = c AND prediction = c) AS tp,
  (SELECT count(*) FROM predicted WHERE prediction = c) AS p, (SELECT count(*) FROM predicted WHERE label = c) AS n FROM cls),
 pr AS (SELECT c, n, tp, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN n = 0 THEN 0 ELSE tp / n END AS recall FROM m),
 f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
 report AS (SELECT CAST(c AS VARCHAR) AS name, precision, recall, f1, n AS support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(n), sum(tp) / sum(n), sum(tp) / sum(n), CAST(sum(n) AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(n) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * n) / sum(n), sum(recall * n) / sum(n), sum(f1 * n) / sum(n), CAST(sum(n) AS BIGINT) FROM f)"""
_REPORT = "SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"


def _rounded_report(spark, sf_dir):
    return evaluate.report(predicted(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(lambda: f"WITH {_PREDICTED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predicted")
def e01_accuracy(spark, sf_dir):
    return evaluate.accuracy(predicted(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(lambda: f"WITH {_CELLS} {_REPORT}")
def e02_report(spark, sf_dir):
    return _rounded_report(spark, sf_dir)


_MATRIX = ", ".join(f"count(*) FILTER (WHERE prediction = {c}) AS predicted_{str(c).replace('-', 'minus_')}" for c in (-1, 0, 1))


@query(lambda: f"WITH {_PREDICTED} SELECT label AS actual, {_MATRIX} FROM predicted GROUP BY 1")
def e03_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predicted(spark, sf_dir))


@query(lambda: f"WITH {_CELLS} {_REPORT} WHERE name NOT LIKE '%avg'")
def e04_evaluate(spark, sf_dir):
    return evaluate.evaluate(predicted(spark, sf_dir))[0].where("name not like '%avg'").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(lambda: f"""WITH {_CELLS}, long AS (SELECT name, 'precision' AS metric, precision AS value FROM report UNION ALL SELECT name, 'recall', recall FROM report UNION ALL SELECT name, 'f1', f1 FROM report
  UNION ALL SELECT name, 'support', support FROM report) SELECT 'test_' || name || '_' || metric AS name, round(CAST(value AS DOUBLE), 6) AS value FROM long WHERE name <> 'accuracy'""")
def e06_flat_report(spark, sf_dir):
    return evaluate.flat_report(evaluate.report(predicted(spark, sf_dir))).withColumn("value", F.round("value", 6))


@query(lambda: f"""WITH {_PREDICTED}, cls AS (SELECT unnest([-1, 0, 1]) AS c)
SELECT 'test' AS dataset, CAST(a.c AS INT) AS actual, CAST(p.c AS INT) AS predicted, (SELECT count(*) FROM predicted WHERE label = a.c AND prediction = p.c) AS n FROM cls a, cls p""")
def e05_confusion_artifact(spark, sf_dir):
    """The matrix as it is read back from a run's artifacts."""
    runs = Runs(spark, _scratch(spark, "runs"))
    path = runs.log_table("run", "confusion_matrix_test", evaluate.confusion_artifact(predicted(spark, sf_dir), "test"))
    return spark.read.schema("dataset string, actual int, predicted int, n long").parquet(path)


# Registry ----------------------------------------------------------------------------------------


@query(lambda: f"""WITH {_PREDICTED} SELECT 'run' AS run_id, 'sentiment' AS experiment, 'accuracy' AS metric, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS value FROM predicted""")
def r01_run(spark, sf_dir):
    """A run's metric as it is read back."""
    runs = Runs(spark, _scratch(spark, "runs"))
    runs.log("run", "sentiment", {"max_features": 1000}, {"accuracy": evaluate.accuracy(predicted(spark, sf_dir)).first()[0]}, {"task": "sentiment analysis"})
    return runs.table().select("run_id", "experiment", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 6))


@query(lambda: "SELECT * FROM (VALUES ('inputs', 0::INT, 'doc_id', 'bigint'), ('inputs', 1, 'label', 'int'), ('outputs', 0, 'prediction', 'int')) AS t(role, position, name, type)")
def r02_signature(spark, sf_dir):
    df = predicted(spark, sf_dir)
    return signature_rows(spark, signature(df.drop("prediction"), df.select("prediction")))


@query(lambda: "SELECT 'sentiment' AS name, CAST(row_number() OVER (ORDER BY r_regionkey) AS INT) AS version, CAST(r_regionkey AS VARCHAR) AS run_id, r_name AS model_path, 'Staging' AS stage FROM region")
def r03_registry(spark, sf_dir):
    """A registry in which a version was registered for each region; versions go up by one from one."""
    held = Models(spark, _scratch(spark, "models"))
    for r in _read(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # five rows
        held.register("sentiment", str(r["r_regionkey"]), r["r_name"])
    return held.table()
