"""Command line over a session store: index, search, list, show, stats, share, ingest, agents.

    python -m lodestone.cli index typed_lines /logs --store /store
    python -m lodestone.cli search "join order" --store /store
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.search import ranked
from lodestone.sources import sessions, stores


def _store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sessions.MESSAGES).parquet(path)


def found(messages: DataFrame, text: str, limit: int, agent: str | None = None) -> DataFrame:
    """The best messages for a text by BM25, with a snippet around its first word."""
    spark = messages.sparkSession
    rows = messages if agent is None else messages.filter(F.col("agent") == agent)
    rows = rows.withColumn("id", F.concat_ws("/", "agent", "session_id", "ordinal"))
    terms = search.query_terms(spark.createDataFrame([(0, text)], "q int, text string"), "q", "text")
    scored = search.bm25(rows, terms, "id", "plain_text", "q").withColumn("score", F.round("score", 6))
    best = ranked(scored, ["q"], [F.desc("score"), "id"], limit)
    word = F.lit((text.split() or [""])[0])
    return best.join(rows, "id").select("rank", "score", "agent", "session_id", "ordinal", "role", search.snippet(F.col("plain_text"), word).alias("snippet")).orderBy("rank")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, places in {"index": ("agent", "path"), "search": ("text",), "list": (), "show": ("agent", "session"), "stats": (), "share": ("agent", "session", "path"), "ingest": ("path",), "agents": ()}.items():
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name != "agents":
            one.add_argument("--store", required=True)
        if name in ("search", "list"):
            one.add_argument("--agent-filter", default=None)
            one.add_argument("--limit", type=int, default=20)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """The rows that a command prints."""
    if args.command == "agents":
        return [{"agent": a} for a in sorted(sessions.PARSERS)]
    if args.command in ("index", "ingest"):
        new = sessions.load(spark, args.agent, args.path) if args.command == "index" else sessions.from_bundles(spark.read.text(args.path, wholetext=True).withColumnRenamed("value", "bundle"))
        new = new.select([c.split()[0] for c in sessions.MESSAGES.split(", ")]).persist()
        try:
            kept = sessions.upserted(_store(spark, args.store), new).filter(F.col("agent").isin([r[0] for r in new.select("agent").distinct().collect()]))
            if not spark.conf.get("spark.checkpoint.dir", None):
                spark.sparkContext.setCheckpointDir(f"{args.store}.checkpoints")
            kept = kept.checkpoint()  # the store is read and overwritten
        except Exception as error:  # noqa: BLE001  a store that isn't there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            kept = new
        stores.write_sessions(kept, args.store)
        return [{"sessions": new.select("agent", "session_id").distinct().count(), "messages": new.count()}]
    rows = _store(spark, args.store)
    if args.command == "search":
        out = found(rows, args.text, args.limit, args.agent_filter)
    elif args.command == "list":
        listed = sessions.sessions(rows)
        out = (listed if args.agent_filter is None else listed.filter(F.col("agent") == args.agent_filter)).orderBy(F.desc("started_at"), "session_id").limit(args.limit)
    elif args.command == "show":
        out = rows.filter((F.col("agent") == args.agent) & (F.col("session_id") == args.session)).orderBy("ordinal")
    elif args.command == "share":
        one = rows.filter((F.col("agent") == args.agent) & (F.col("session_id") == args.session))
        sessions.bundles(one).select("bundle").coalesce(1).write.mode("overwrite").text(args.path)
        out = one.groupBy("agent", "session_id").agg(F.count("*").alias("messages"))
    else:
        out = rows.groupBy("agent").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages")).orderBy("agent")
    return [r.asDict() for r in out.collect()]


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    for row in run(spark, args):
        print(json.dumps(row, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
