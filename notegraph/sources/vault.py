"""Readers: note tables, markdown folders with frontmatter, access logs, vectors; and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions.text import without_frontmatter
from notegraph.session import cut_lineage

#: The time at which the fixed queries look at the tables, after their last event.
AS_OF = "2025-06-01 00:00:00"

ACCESS_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("intent", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [T.StructField("title", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("propensity", T.DoubleType()), T.StructField("wasExploration", T.BooleanType())]
                )
            ),
        ),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def created_at(created):
    """A note's ``created`` text as a time; null unless it is an ISO date, with or without a time."""
    return F.coalesce(F.try_to_timestamp(created, F.lit("yyyy-MM-dd")), F.when(created.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(created)))


def read_markdown(spark: SparkSession, folder: str, space: str = "notes") -> DataFrame:
    """``(title, space, content)`` of the ``*.md`` files of one folder, not its subfolders; a missing folder is empty,
    files without a byte are passed over (the file index leaves them out), bytes that are no UTF-8 become replacement characters."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "title string, space string, content string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "")
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("title"), F.lit(space).alias("space"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def parse_frontmatter(df: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, has_frontmatter, fm_json, fm_error, body)``.

    The first line must be exactly ``---``; the part up to the next such line is YAML, read without turning dates and
    numbers of text form into other types than YAML's own strings, integers, floats, booleans and nulls; what follows
    is the body. CRLF is normalised only where there is such a part. An unterminated part or bad YAML gives an error
    and null data, a scalar document gives ``{}``. Null content gives null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [frontmatter(c) for c in batch.column(1).to_pylist()]
            columns = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.bool_(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "has_frontmatter", "fm_json", "fm_error", "body"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"))
    return rows.mapInArrow(run, f"key {kind}, has_frontmatter boolean, fm_json string, fm_error string, body string").withColumnRenamed("key", key)


def frontmatter(content: str | None) -> tuple[bool | None, str | None, str | None, str | None]:
    """One text as (has frontmatter, JSON of the data, error, body)."""
    import json
    import re

    if content is None:
        return None, None, None, None
    if not re.match(r"---\r?\n|---$", content):
        return False, None, None, content
    lines = content.replace("\r\n", "\n").split("\n")
    try:
        end = lines.index("---", 1)
    except ValueError:
        return True, None, "unterminated frontmatter", content
    body = "\n".join(lines[end + 1 :])
    try:
        data = _yaml("\n".join(lines[1:end]))
    except Exception as error:  # noqa: BLE001 - any YAML error is data here
        return True, None, f"invalid frontmatter: {type(error).__name__}", body
    return True, json.dumps(data if isinstance(data, dict) else {}, ensure_ascii=False, sort_keys=True, default=str), None, body


def _yaml(text: str):
    """YAML with dates kept as text; without the YAML library, flat ``key: value`` lines and ``- item`` lists."""
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, rule) for tag, rule in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return yaml.load(text, Loader)  # noqa: S506 - a SafeLoader


def _flat_yaml(text: str) -> dict:
    data: dict = {}
    last = None
    for line in text.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and last:
            data[last] = [*(data[last] or []), line.strip()[2:]]
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("no mapping")
        value = value.strip()
        last = name.strip()
        data[last] = [v.strip() for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else value or None
    return data


def note_index(spark: SparkSession, folder: str, space: str = "notes") -> DataFrame:
    """The notes of a markdown folder as a table: ``title, space, description, type, status, project, tags, created,
    last_accessed, access_count, body, content``.

    Files whose frontmatter is missing or cannot be read are there with null fields; their body is what is left of the
    text. A scalar where a list belongs gives null, as does a text where a number belongs. Links are found in
    ``content``, the whole file, by :func:`notegraph.operators.graph.link_scan`.
    """
    files = read_markdown(spark, folder, space)
    parsed = parse_frontmatter(files, "title", "content")
    kinds = {"description": "string", "type": "string", "status": "string", "project": "array<string>", "tags": "array<string>", "created": "string", "last_accessed": "string", "access_count": "bigint"}
    fields = [(F.from_json(F.get_json_object("fm_json", f"$.{n}"), k) if k.startswith("array") else F.get_json_object("fm_json", f"$.{n}").try_cast(k)).alias(n) for n, k in kinds.items()]
    return files.join(parsed, "title").select("title", "space", *fields, "body", "content")


def write_store(df: DataFrame, folder: str, name: str) -> None:
    """Writes a store (vectors, boosts, meta) as a table of the folder, replacing it. ``df`` may read the old one: it is
    written to the shared folder first."""
    cut_lineage(df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def index_status(spark: SparkSession, folder: str, name: str = "note_vectors", model: str = "hashed-tokens") -> dict:
    """Whether the index is there, how many notes it holds, its size in bytes, the encoder and its ``meta`` entries."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return {"exists": False, "notes": 0, "bytes": 0, "model": model, "meta": {}}
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta.parquet")
    kept = {r["key"]: r["value"] for r in table(spark, folder, "meta").select("key", "value").collect()} if files.exists(meta) else {}
    return {"exists": True, "notes": table(spark, folder, name).count(), "bytes": files.getContentSummary(hadoop).getLength(), "model": kept.get("model", model), "meta": kept}


def capture(asked: DataFrame, key: str, template: str, today: str, taken: DataFrame) -> DataFrame:
    """Inbox notes from requests ``(key, title, type, content)``: ``(key, fault, title, note_type, body, status, created,
    access_count)``.

    A title that is no prose claim is refused with its fault and null fields. The heading and the content of the template
    are filled in where given; the slug of the title gets ``-2``, ``-3``, ... after the titles ``taken`` and the requests
    before it, in order of the key.
    """
    from notegraph.functions.text import slug
    from notegraph.operators.rules import title_fault

    rows = asked.select(key, F.col("title").alias("_name"), F.coalesce("type", F.lit("insight")).alias("note_type"), "content", title_fault(F.col("title")).alias("fault"))
    base = F.when(F.length(slug(F.col("_name"))) > 0, slug(F.col("_name"))).otherwise(F.concat(F.lit("note-"), F.col(key).cast("string")))
    good = rows.where("fault is null").withColumn("_slug", base)
    stem = F.regexp_extract("title", r"^(.*?)(?:-\d+)?$", 1)
    used = taken.select("title").where("title is not null").distinct().select(F.explode(F.array_distinct(F.array("title", stem))).alias("_slug"), "title").groupBy("_slug").agg(F.collect_set("title").alias("_used"))
    order = F.row_number().over(Window.partitionBy("_slug").orderBy(key))
    placed = good.withColumn("_n", order).join(used, "_slug", "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<string>")))
    names = F.transform(F.sequence(F.lit(1), F.col("_n") + F.size("_used")), lambda i: F.when(i == 1, F.col("_slug")).otherwise(F.concat_ws("-", F.col("_slug"), i.cast("string"))))
    free = F.filter(names, lambda n: ~F.array_contains("_used", n))
    line = F.concat(F.lit("# "), F.col("_name"))
    parts = F.split(F.lit(template), r"# \{[^}]+\}", 2)
    body = F.when(F.size(parts) > 1, F.concat(parts[0], line, F.element_at(parts, 2))).otherwise(F.lit(template))
    cut = F.split(body, r"\{Content[^}]*\}", 2)
    filled = F.when((F.length("content") > 0) & (F.size(cut) > 1), F.concat(cut[0], F.col("content"), F.element_at(cut, 2))).otherwise(body)
    done = placed.select(key, "fault", F.get(free, F.col("_n") - 1).alias("title"), "note_type", filled.alias("body"), F.lit("inbox").alias("status"), F.lit(today).alias("created"), F.lit(0).cast("bigint").alias("access_count"))
    return done.unionByName(rows.where("fault is not null").select(key, "fault"), allowMissingColumns=True)


def write_frontmatter(df: DataFrame, key: str, fm_json: str, body: str) -> DataFrame:
    """``(key, content)``: fenced YAML and the body less one leading newline; empty data gives the body alone."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = (text or "").removeprefix("\n")
                fields = json.loads(data) if data else {}
                dumped = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in fields.items())
                out.append(f"---\n{dumped}---\n{text}" if fields else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "content"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), fm_json, body).mapInArrow(run, f"key {kind}, content string").withColumnRenamed("key", key)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Access events of JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(ACCESS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_access_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def append_promote_log(entries: DataFrame, path: str) -> None:
    """Pipe-separated lines of (file, classification, confidence, changes)."""
    line = F.concat_ws(" | ", "file", "classification", "confidence", F.array_join("changes", "; "))
    entries.select(line.alias("value")).write.mode("append").text(path)


def access_events(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Events in the log's form from ranked rows ``(query_id, title, rank, score, was_exploration)``."""
    results = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("title"), F.col("score"), F.lit(0.0).alias("propensity"), F.col("was_exploration").alias("wasExploration"))))
    per = ranked.groupBy("query_id").agg(results.alias("results"))
    return queries.join(per, "query_id").select(F.date_format("asked_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "query", "intent", "results")


__all__ = [n for n in dir() if not n.startswith("_")] + ["without_frontmatter"]
