"""Landed JSON requests: one object a line, with the request's headers as a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED_SCHEMA = "request_id string, ts timestamp, path string, headers map<string,string>, body string, malformed string"


def header(name: str, headers: str = "headers") -> Column:
    """A header's value; names are told apart without regard to case, and of several the first counts."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(entries, F.lit(0))["value"]


def read_requests(spark: SparkSession, path: str, agent_header: str = "X-Agent", stream: bool = False) -> DataFrame:
    """JSON lines as the columns that request routing takes, and ``malformed``.

    A line that is no such object is kept: its columns are null and ``malformed`` has the
    line, so it can be counted and looked at.  Routing takes it for a request to an
    unknown provider.  A missing header is null, as a missing body is.
    """
    reader = spark.readStream if stream else spark.read
    options = {"columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"}
    lines = reader.text(path).filter(F.trim("value") != "")
    landed = lines.select(F.from_json("value", LANDED_SCHEMA, options).alias("r")).select("r.*")
    return landed.select(
        "request_id", "ts", header(agent_header).alias("agent_header"), header("User-Agent").alias("user_agent"),
        "path", "body", "malformed",
    )


def malformed_count(requests: DataFrame) -> DataFrame:
    """One row: lines read, and those of them that are malformed."""
    return requests.agg(F.count("*").alias("lines"), F.count("malformed").alias("malformed"))
