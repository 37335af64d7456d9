"""Scansion of streams of lines and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.engine import Engine
from cadenza.functions import text as tx
from cadenza.operators import prosody


def tokens(stream: DataFrame, engine: Engine, kind: str = "s", text: str = "text") -> DataFrame:
    """A stream of tokens with pron (null if unknown) and syllables: a stateless stream-static join with the lexicon."""
    kept = [c for c in stream.columns if c != text]
    cut = stream.select(*kept, F.posexplode(tx.tokens(F.col(text), kind)).alias("pos", "token"))
    return prosody.syllables_of(prosody.with_norm(cut, "token"), engine.lex0)


def syllables_per_window(stream: DataFrame, engine: Engine, time: str, width: str, late: str, text: str = "text") -> DataFrame:
    """Tokens and syllables per time window; rows later than ``late`` behind the newest are left out."""
    cut = tokens(stream.withWatermark(time, late), engine, "w", text)
    return cut.groupBy(F.window(time, width)).agg(F.count("*").alias("tokens"), F.sum("syllables").alias("syllables"))


def scan_stream(stream: DataFrame, engine: Engine, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "spoken") -> StreamingQuery:
    """Scan every micro-batch of lines (keys, text) and hand it to ``sink``. The order of a line's words needs the
    whole line, which one batch holds."""
    return stream.writeStream.foreachBatch(lambda df, epoch: sink(engine.scan(df, keys, mode), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_stream(stream: DataFrame, engine: Engine, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Roll up the documents of every micro-batch."""
    return stream.writeStream.foreachBatch(lambda df, epoch: sink(engine.summary(df, key), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
