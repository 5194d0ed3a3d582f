"""Readers that turn files and formats into the engine's tables, and writers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.ids import child_document, slug


def files(spark: SparkSession, path: str, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, name, extension, sha256, content of files under path; xlsm counts as xlsx, empty files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = df.where("length > 0").select(slug(name).alias("doc_id"), name.alias("name"), F.when(ext == "xlsm", "xlsx").otherwise(ext).alias("extension"), F.sha2("content", 256).alias("sha256"), "content")
    return out.orderBy("name").limit(limit) if limit is not None else out


def parsed(file: DataFrame, parser: Callable[[str, bytes], str], done: DataFrame | None = None) -> DataFrame:
    """doc_id, sha256, text, error by a parser hook; what `done` (doc_id, sha256) holds isn't parsed again. A file that
    the parser can't take has an error, the others go on."""
    todo = file if done is None else file.join(done.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, n, h, c in zip(b["doc_id"], b["name"], b["sha256"], b["content"], strict=True):
                try:
                    out.append((d, h, parser(n, bytes(c)), None))
                except Exception as e:
                    out.append((d, h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "sha256", "text", "error"])

    return todo.select("doc_id", "name", "sha256", "content").mapInPandas(run, "doc_id string, sha256 string, text string, error string")


def plain_text(name: str, content: bytes) -> str:
    """The parser of text files."""
    return content.decode("utf-8", errors="replace")


def html_text(html: F.Column) -> F.Column:
    """Readable text of a page: scripts, styles, comments and tags gone, block ends as line ends, the basic entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer)\b.*?</\1>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", "\n")
    text = F.regexp_replace(broken, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def squad_documents(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, text) and answers (doc_id, question, text, start) of a file of nested questions."""
    data = spark.read.option("multiLine", "true").json(path).select(F.explode("data").alias("d"))
    data = data.limit(limit) if limit is not None else data
    docs = data.select(slug(F.col("d.title")).alias("doc_id"), F.col("d.title").alias("title"), F.array_join(F.col("d.paragraphs.context"), "\n\n").alias("text"))
    qas = data.select(slug(F.col("d.title")).alias("doc_id"), F.explode("d.paragraphs").alias("p")).select("doc_id", F.explode("p.qas").alias("q"))
    answers = qas.select("doc_id", F.col("q.question").alias("question"), F.explode("q.answers").alias("a")).select("doc_id", "question", F.col("a.text").alias("text"), F.col("a.answer_start").alias("start"))
    return docs, answers


def judged_corpus(spark: SparkSession, corpus: str, queries: str, qrels: str, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (id, text), queries (id, text) that have something relevant, grades (query_id, id, grade) from JSON lines and
    a tab-separated file whose header must be query-id, corpus-id, score."""
    c = spark.read.json(corpus).select(F.col("_id").alias("id"), "text")
    q = spark.read.json(queries).select(F.col("_id").alias("id"), "text")
    r = spark.read.option("sep", "\t").option("header", "true").csv(qrels)
    if r.columns != ["query-id", "corpus-id", "score"]:
        raise ValueError(f"{qrels}: header {r.columns}")
    g = r.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("id"), F.col("score").cast("int").alias("grade"))
    return c, q.join(g.where(F.col("grade") >= least).select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), g


def regulation_sections(spark: SparkSession, path: str, source: str, cues: str) -> DataFrame:
    """doc_id, section, heading, text of sections that aren't blank and hold a cue (a regular expression)."""
    s = spark.read.option("multiLine", "true").json(path)
    kept = s.where(F.btrim("text") != "").where(F.col("text").rlike(cues))
    return kept.select(slug(F.concat(F.lit(f"{source}_"), F.col("section").cast("string"))).alias("doc_id"), F.col("section").cast("string").alias("section"), "heading", "text")


def metadata_for(spark: SparkSession, csv: str, file: DataFrame, column: str = "Filename") -> DataFrame:
    """Rows of a CSV table with the file whose stem is the same, case aside."""
    stem = lambda c: F.lower(F.regexp_replace(F.btrim(c), r"\.[A-Za-z0-9]+$", ""))
    m = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(csv).withColumn("_stem", stem(F.col(column)))
    return m.join(file.select(stem(F.col("name")).alias("_stem"), "doc_id", "sha256"), "_stem", "left").drop("_stem")


def gold_items(spark: SparkSession, path: str, mapping: Mapping[str, str], name: str) -> DataFrame:
    """item_id, input, expected, group of a CSV or JSON-lines file. mapping names the file's column of each field, case and
    spaces aside; blank rows are skipped; items without an id are numbered in the file's order. A missing column is an
    error that names the file."""
    if path.endswith((".jsonl", ".json")):
        raw = spark.read.json(path)
    else:
        raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    fold = lambda s: re.sub(r"[\s_]+", " ", s).strip().lower()
    have = {fold(c): c for c in raw.columns}
    lost = sorted(v for v in mapping.values() if fold(v) not in have)
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}; there are {', '.join(raw.columns)}")
    get = lambda f: F.col(f"`{have[fold(mapping[f])]}`") if f in mapping else F.lit(None).cast("string")
    rows = raw.withColumn("_n", F.monotonically_increasing_id())
    rows = rows.where(F.coalesce(F.btrim(get("input").cast("string")), F.lit("")) != "")
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("_n"))
    return rows.select(F.coalesce(get("id").cast("string"), F.concat(F.lit(f"{name}-"), n.cast("string"))).alias("item_id"), F.btrim(get("input").cast("string")).alias("input"), get("expected").alias("expected"), get("group").alias("grp"))


def archive_parts(file: DataFrame) -> DataFrame:
    """child_id, parent, names, sha256, content of the embedded parts of zip-based office files: equal parts once, with
    all their names in natural order; parts that can't be read are reported with an error."""
    import io
    import zipfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, c in zip(b["doc_id"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        out += [(d, i.filename, z.read(i), None) for i in z.infolist() if "/embeddings/" in i.filename and not i.is_dir()]
                except Exception as e:
                    out.append((d, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["parent", "part", "content", "error"])

    parts = file.select("doc_id", "content").mapInPandas(run, "parent string, part string, content binary, error string")
    from docloom.functions.text import natural_key

    named = F.transform(F.array_sort(F.collect_list(F.struct(natural_key(F.col("part")).alias("k"), "part"))), lambda x: x["part"])
    return parts.groupBy("parent", F.sha2("content", 256).alias("sha256"), "error").agg(named.alias("names"), F.first("content").alias("content")).withColumn("child_id", child_document(F.col("parent"), F.col("content")))


def turtle_values(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of the plain statements of a Turtle file: prefixed names, IRIs and strings, with the
    lists of ';' and ',' spelled out. Collections and blank nodes come as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|<[^>]*>|\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|[;,.](?=\s|$)|[^\s;,]+')
        for b in batches:
            out = []
            for text in b["value"]:
                body = re.sub(r"(?m)^\s*(#.*|@prefix.*|@base.*|PREFIX.*)$", "", text)
                subject = predicate = None
                for m in token.finditer(body):
                    x = m[0]
                    if x == ".":
                        subject = predicate = None
                    elif x == ";":
                        predicate = None
                    elif x == ",":
                        continue
                    elif subject is None:
                        subject = x
                    elif predicate is None:
                        predicate = "rdf:type" if x == "a" else x
                    else:
                        out.append((subject, predicate, x.strip('"') if x.startswith('"') else x))
            yield pd.DataFrame(out, columns=["subject", "predicate", "object"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "subject string, predicate string, object string")


def write_partitioned(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """df as Parquet in folders by a hash of the key, so a read of one document opens one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(path)
