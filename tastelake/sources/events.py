"""Sinks of event lines: a broker topic or JSON files, with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOPIC = "user-events"


def write_lines(lines: DataFrame, path: str, value: str = "value", mode: str = "append") -> None:
    """JSON lines as text files."""
    lines.select(value).write.mode(mode).text(path)


def write_topic(lines: DataFrame, servers: str, topic: str = TOPIC, value: str = "value") -> None:
    """JSON lines to a topic; needs the Kafka connector on the class path. Events carry no key."""
    (lines.select(F.col(value).alias("value")).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


class SendRefused(Exception):
    """The broker was reached and did not take the lines."""


def _unreachable(error: Exception) -> bool:
    """No broker, or none configured; any other error is one of the job and is not hidden."""
    return isinstance(error, (ConnectionError, TimeoutError)) or any(
        sign in str(error) for sign in ("TimeoutException", "ConnectException", "Failed to find data source: kafka"))


def publish(lines: DataFrame, primary, logged_path: str, value: str = "value") -> str:
    """Send lines with ``primary(lines)``; while the broker is unavailable they are logged to files
    instead, which replace those of an earlier try. Returns what became of them: published, logged or
    failed (refused by the broker)."""
    try:
        primary(lines)
        return "published"
    except SendRefused:
        return "failed"
    except Exception as error:
        if not _unreachable(error):
            raise
        write_lines(lines, logged_path, value, mode="overwrite")
        return "logged"
