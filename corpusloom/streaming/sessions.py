"""Keyed session state, in batch and as a stream, by one transition function.

State of a session: version, turn count, distinct facts in order, and a signature over its canonical
JSON.  A message appends its literal facts that are new; a state whose signature is wrong is
refused, one of another version is reset.  Limits end a session's growth, they never drop a message.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "1"
MOST_TURNS, MOST_CHARS = 24, 8192
_SENTENCE = re.compile(r"[。！？；.!?;\n]+")
_COMMAND = re.compile(r"^(?:请|麻烦|帮我|能否|可否)|总结|概括|梳理|汇总|归纳|(?i:summari[sz]e|recap)")
_QUESTION = re.compile(r"[？?]\s*$|[吗呢]$")

OUT = "session_id string, seq long, status string, turn_count int, facts array<string>, signature string"


def sign(key: bytes, state: dict) -> str:
    body = json.dumps({k: state[k] for k in sorted(state) if k != "signature"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def new_state(session_id: str) -> dict:
    return {"state_version": VERSION, "session_id": session_id, "turn_count": 0, "facts": []}


def facts_of(text: str) -> list[str]:
    """Literal statements of a message: sentences that neither command nor ask."""
    out = []
    for m in re.finditer(r"[^。！？；.!?;\n]+[。！？；.!?;\n]*", text or ""):
        clause = _SENTENCE.sub("", m.group()).strip()
        if clause and not _COMMAND.search(clause) and not _QUESTION.search(m.group().strip()):
            out.append(clause)
    return out


def restore(key: bytes, state: dict | None, session_id: str) -> tuple[dict, str | None]:
    """A usable state and what happened to the given one: None, invalid_state, or legacy_state_reset."""
    if state is None:
        return new_state(session_id), None
    if state.get("state_version") != VERSION:
        return new_state(session_id), "legacy_state_reset"
    if not hmac.compare_digest(str(state.get("signature", "")), sign(key, state)) or state.get("session_id") != session_id:
        return new_state(session_id), "invalid_state"
    return {k: v for k, v in state.items() if k != "signature"}, None


def step(state: dict, text: str, fresh: bool) -> tuple[dict, str]:
    """The next state and a status: ok, blank, turn_limit or context_limit."""
    if fresh:
        state = new_state(state["session_id"])
    if not (text or "").strip():
        return state, "blank"
    if state["turn_count"] >= MOST_TURNS:
        return state, "turn_limit"
    facts = list(dict.fromkeys([*state["facts"], *facts_of(text)]))
    if sum(map(len, facts)) + max(0, len(facts) - 1) > MOST_CHARS:
        return state | {"turn_count": state["turn_count"] + 1}, "context_limit"
    return state | {"turn_count": state["turn_count"] + 1, "facts": facts}, "ok"


def replay(messages: DataFrame, key: bytes) -> DataFrame:
    """State after every message (session_id, seq, text, new_session), sessions in order of seq.

    Sorted partitions are folded as a stream, with one state in memory: a session of any length, or
    one that holds a third of all messages, is never gathered.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        for df in batches:
            rows = []
            for sid, seq, text, fresh in zip(df["session_id"], df["seq"], df["text"], df["new_session"], strict=True):
                if state is None or state["session_id"] != sid:
                    state = new_state(sid)
                state, status = step(state, text, bool(fresh))
                rows.append((sid, seq, status, state["turn_count"], list(state["facts"]), sign(key, state)))
            yield pd.DataFrame(rows, columns=["session_id", "seq", "status", "turn_count", "facts", "signature"])

    ordered = messages.where("session_id is not null").select("session_id", "seq", "text", "new_session").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInPandas(fold, OUT)


def stream(messages: DataFrame, key: bytes, idle_hours: int | None = None) -> DataFrame:
    """The same over a stream (session_id, seq, text, new_session), with the state kept by Spark.

    ``idle_hours`` drops the state of sessions that are idle for so long, under a continuous trigger; a run
    that ends with the input (availableNow) would wait for the timeouts.
    """
    state_schema = "state string"

    def update(ids: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        sid = ids[0]
        state = json.loads(kept.get[0]) if kept.exists else new_state(sid)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")  # one micro-batch of one session
        out = []
        for seq, text, fresh in zip(rows["seq"], rows["text"], rows["new_session"], strict=True):
            state, status = step(state, text, bool(fresh))
            out.append((sid, seq, status, state["turn_count"], list(state["facts"]), sign(key, state)))
        kept.update((json.dumps(state, ensure_ascii=False),))
        if idle_hours:
            kept.setTimeoutDuration(idle_hours * 3_600_000)
        yield pd.DataFrame(out, columns=["session_id", "seq", "status", "turn_count", "facts", "signature"])

    return messages.groupBy("session_id").applyInPandasWithState(update, OUT, state_schema, "append", "ProcessingTimeTimeout" if idle_hours else "NoTimeout")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, events: an addition; batch and streams alike."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def file_stream(spark, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
