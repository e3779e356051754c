"""Chat-session logs of four shapes as message rows, and the session store over Parquet.

Messages: agent, session_id, ordinal, role, ts, plain_text, workspace. Parsers are DataFrame expressions over whole
directories; a line or file that is no JSON is skipped. Further shapes are added with register().
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import Folder

MESSAGES = "agent string, session_id string, ordinal int, role string, ts string, plain_text string, workspace string"
Parser = Callable[[SparkSession, str], DataFrame]
PARSERS: dict[str, Parser] = {}
BLOCK = "array<struct<type:string,text:string,thinking:string,name:string,content:string,input:map<string,string>>>"
INNER = "array<struct<type:string,text:string,thinking:string,name:string>>"
MOST_INPUT, MOST_RESULT, MOST_SNIPPET = 80, 400, 2000  # characters


def register(agent: str) -> Callable[[Parser], Parser]:
    def add(parser: Parser) -> Parser:
        PARSERS[agent] = parser
        return parser

    return add


def load(spark: SparkSession, agent: str, path: str) -> DataFrame:
    """The messages of an agent's logs under path."""
    return PARSERS[agent](spark, path)


def discovered(spark: SparkSession, roots: Mapping[str, str]) -> dict[str, str]:
    """The agents whose shape is registered and whose folder is there, in order of registration."""
    return {agent: roots[agent] for agent in PARSERS if roots.get(agent) and Folder(spark, roots[agent]).has()}


def load_all(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """The messages of all agents that are discovered under their folders; no rows without any."""
    found = spark.createDataFrame([], MESSAGES)
    for agent, path in discovered(spark, roots).items():
        found = found.unionByName(load(spark, agent, path))
    return found


def utc_time(c: Column) -> Column:
    """ISO-8601 UTC from epoch seconds or milliseconds or ISO text; other text unchanged."""
    number = c.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    made = F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(c))
    return F.coalesce(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def _inner_text(c: Column) -> Column:
    """A tool result's content: text, or blocks whose texts are joined."""
    blocks = F.from_json(c, INNER)
    parts = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", F.concat(F.lit("[Thinking] "), F.substring(b["thinking"], 1, MOST_RESULT))).otherwise(F.lit("")))
    return F.coalesce(F.when(c.startswith("["), F.array_join(F.filter(parts, lambda t: t != ""), "\n")), c, F.lit(""))


def flat_content(c: Column) -> Column:
    """Plain text of a message's content: a string, or typed blocks (tool calls with their input, results and thoughts cut short)."""
    blocks = F.from_json(c, BLOCK)
    inputs = lambda b: F.array_join(F.transform(F.map_entries(b["input"]), lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, MOST_INPUT))), ", ")
    one = lambda b: (
        F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
        .when(b["type"] == "tool_use", F.concat(F.lit("[Tool: "), F.coalesce(b["name"], F.lit("tool")), F.lit("] "), F.coalesce(inputs(b), F.lit(""))))
        .when(b["type"] == "tool_result", F.concat(F.lit("[ToolResult] "), F.substring(_inner_text(b["content"]), 1, MOST_RESULT)))
        .when(b["type"] == "thinking", F.concat(F.lit("[Thinking] "), F.substring(F.coalesce(b["thinking"], F.lit("")), 1, MOST_RESULT)))
        .otherwise(F.lit(""))
    )
    joined = F.array_join(F.filter(F.transform(blocks, one), lambda t: t != ""), "\n")
    return F.when(blocks.isNotNull(), joined).otherwise(c)


def snippets(c: Column) -> Column:
    """A message's content as an array of (kind, content, meta): meta is a tool's input; results are cut at MOST_SNIPPET characters."""
    none = F.lit(None).cast("map<string,string>")
    made = lambda kind, text, meta=none: F.struct(F.lit(kind).alias("kind"), F.coalesce(text, F.lit("")).alias("content"), meta.alias("meta"))
    one = lambda b: (
        F.when(b["type"] == "text", made("text", b["text"]))
        .when(b["type"] == "tool_use", made("tool_use", F.concat(F.lit("[Tool: "), F.coalesce(b["name"], F.lit("tool")), F.lit("]")), b["input"]))
        .when(b["type"] == "tool_result", made("tool_result", F.substring(_inner_text(b["content"]), 1, MOST_SNIPPET)))
        .when(b["type"] == "thinking", made("thinking", b["thinking"]))
    )
    blocks = F.from_json(c, BLOCK)
    plain = F.when(c != "", F.array(made("text", c))).otherwise(F.array().cast("array<struct<kind:string,content:string,meta:map<string,string>>>"))
    return F.when(blocks.isNotNull(), F.filter(F.transform(blocks, one), lambda s: s.isNotNull())).otherwise(plain)


def plain_text(raw: Column, pieces: Column) -> Column:
    """A message's raw text, or where there is none its snippets' contents, a line each."""
    return F.coalesce(F.nullif(raw, F.lit("")), F.array_join(F.transform(pieces, lambda s: s["content"]), "\n"))


def _numbered(rows: DataFrame, agent: str, order: list) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1
    return rows.select(F.lit(agent).alias("agent"), "session_id", nth.cast("int").alias("ordinal"), "role", utc_time(F.col("ts")).alias("ts"), "plain_text", "workspace")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)


@register("typed_lines")
def typed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a line with type user or assistant and a message; a file is a session."""
    ddl = "type string, message struct<role:string,content:string>, timestamp string, cwd string, sessionId string"
    r = _lines(spark, path).withColumn("r", F.from_json("value", ddl)).filter("r.type IN ('user', 'assistant') AND r.message IS NOT NULL")
    rows = r.select("file", "line", F.coalesce("r.sessionId", _stem(F.col("file"))).alias("session_id"), F.coalesce("r.message.role", "r.type").alias("role"), F.col("r.timestamp").alias("ts"), flat_content(F.col("r.message.content")).alias("plain_text"), F.col("r.cwd").alias("workspace"))
    return _numbered(rows, "typed_lines", ["file", "line"])


@register("rollout_lines")
def rollout_lines(spark: SparkSession, path: str) -> DataFrame:
    """rollout-<time>-<uuid>.jsonl: records with a payload that has a role and content, or a message."""
    ddl = "type string, timestamp string, payload struct<type:string,role:string,content:string,message:string,cwd:string>"
    r = _lines(spark, path).withColumn("r", F.from_json("value", ddl)).filter("r.payload IS NOT NULL")
    name = F.regexp_extract("file", r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl$", 1)
    text = F.coalesce(flat_content(F.col("r.payload.content")), F.col("r.payload.message"))
    role = F.coalesce("r.payload.role", F.when(F.col("r.payload.message").isNotNull(), "user"))
    rows = r.select("file", "line", F.coalesce(F.nullif(name, F.lit("")), _stem(F.col("file"))).alias("session_id"), role.alias("role"), F.col("r.timestamp").alias("ts"), text.alias("plain_text"), F.max("r.payload.cwd").over(Window.partitionBy("file")).alias("workspace"))
    return _numbered(rows.filter("role IS NOT NULL AND plain_text IS NOT NULL"), "rollout_lines", ["file", "line"])


@register("markdown")
def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Files with blocks `#### <role>` ... `</role>`."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    block = r"(?s)####\s*<(\w+)>\s*(.*?)</\1>"
    found = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").cast("string").alias("ts"), F.posexplode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("line", "b"))
    rows = found.select("file", "line", _stem(F.col("file")).alias("session_id"), F.regexp_extract("b", block, 1).alias("role"), "ts", F.regexp_replace(F.regexp_extract("b", block, 2), r"^\s+|\s+$", "").alias("plain_text"), F.lit(None).cast("string").alias("workspace"))
    return _numbered(rows, "markdown", ["file", "line"])


@register("session_json")
def session_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a session with messages."""
    ddl = "sessionId string, projectDir string, messages array<struct<role:string,content:string,timestamp:string>>"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    r = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", ddl).alias("r")).filter("r.messages IS NOT NULL")
    rows = r.select("file", F.coalesce("r.sessionId", _stem(F.col("file"))).alias("session_id"), F.col("r.projectDir").alias("workspace"), F.posexplode("r.messages").alias("line", "m"))
    rows = rows.select("file", "line", "session_id", F.col("m.role").alias("role"), F.col("m.timestamp").alias("ts"), flat_content(F.col("m.content")).alias("plain_text"), "workspace")
    return _numbered(rows, "session_json", ["file", "line"])


def sessions(messages: DataFrame) -> DataFrame:
    """One row a session: first and last time, title (first line of the first user message, 120 characters), message count."""
    first = F.min_by("plain_text", F.when(F.col("role") == "user", F.col("ordinal")))
    return messages.groupBy("agent", "session_id").agg(F.max("workspace").alias("workspace"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.substring(F.split(first, "\n")[0], 1, 120).alias("title"), F.count("*").cast("int").alias("message_count"))


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the sessions of new in place of its own: old rows of those sessions go, new ones come."""
    return store.join(new.select("agent", "session_id").distinct(), ["agent", "session_id"], "left_anti").unionByName(new)


def deleted(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("agent", "session_id").distinct(), ["agent", "session_id"], "left_anti")


def bundles(messages: DataFrame) -> DataFrame:
    """agent, session_id, bundle: a session and its messages as one JSON text (version 1)."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "role", "ts", "plain_text")))
    made = messages.groupBy("agent", "session_id", "workspace").agg(rows.alias("messages"))
    whole = F.struct(F.lit(1).alias("bundle_version"), F.struct("agent", "session_id", "workspace").alias("session"), "messages")
    return made.select("agent", "session_id", F.to_json(whole).alias("bundle"))


def from_bundles(rows: DataFrame) -> DataFrame:
    """Messages of bundles (bundle); other versions than 1 are an error."""
    ddl = "bundle_version int, session struct<agent:string,session_id:string,workspace:string>, messages array<struct<ordinal:int,role:string,ts:string,plain_text:string>>"
    r = rows.select(F.from_json("bundle", ddl).alias("r"))
    good = F.when(F.coalesce(F.col("r.bundle_version") == 1, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.lit("unknown bundle version")))
    r = r.select(good.alias("r")).select("r.session.*", F.explode("r.messages").alias("m"))
    return r.select("agent", "session_id", "m.ordinal", "m.role", "m.ts", "m.plain_text", "workspace")
