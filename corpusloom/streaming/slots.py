"""Slot-filling dialogue state: bind answers to pending slots, mark unknown, deferred and asked.

The machine is data-driven: slots and their terms come from the caller.  One answer with several
clauses can fill several pending slots; a clause binds only if exactly one slot matches it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Answers that tell nothing, and answers that put a question off.
UNKNOWN = ("不知道", "不清楚", "不晓得", "不会看", "没看", "没有看", "没注意", "没有注意", "说不清", "不确定")
DEFERRED = ("以后再说", "稍后", "待会", "等会", "先不说", "暂时不说")
#: A small vocabulary of slots as an example.
SLOTS = {"sleep": ("睡", "失眠", "多梦"), "appetite": ("胃口", "食欲", "吃饭"), "stool": ("大便", "便秘", "腹泻"), "urination": ("小便", "排尿"), "sweat": ("出汗", "盗汗"), "cold_heat": ("怕冷", "怕热", "发热"), "duration": ("多久", "天", "周", "月", "年")}


def new_state(session_id: str, slots: Mapping[str, Sequence[str]] = SLOTS) -> dict:
    return {"session_id": session_id, "turn_count": 0, "facts": dict.fromkeys(slots), "unknown": [], "deferred": [], "asked": dict.fromkeys(slots, 0), "pending": [], "history": [], "complete": False, "last_action": None}


def clauses(text: str) -> list[str]:
    return [c.strip() for c in re.split(r"[，,；;。！？!?\n]+", text or "") if c.strip()]


def matching(clause: str, pending: Sequence[str], slots: Mapping[str, Sequence[str]] = SLOTS) -> list[str]:
    return [s for s in pending if any(t in clause for t in slots[s])]


def begin(state: dict, text: str) -> dict:
    """A user's turn: counted and kept; a completed summary is opened again."""
    return state | {"turn_count": state["turn_count"] + 1, "history": [*state["history"], ("user", text)], "complete": False}


def bind(state: dict, text: str, slots: Mapping[str, Sequence[str]] = SLOTS) -> dict:
    """Fill pending slots from an answer; with one pending slot, the whole answer belongs to it."""
    facts, unknown, deferred, pending = dict(state["facts"]), list(state["unknown"]), list(state["deferred"]), list(state["pending"])

    def settle(slot: str, said: str) -> None:
        if any(p in said for p in UNKNOWN):
            unknown.append(slot)
        elif any(p in said for p in DEFERRED):
            deferred.append(slot)
        else:
            facts[slot] = said
        pending.remove(slot)

    if len(pending) == 1 and (text or "").strip():
        settle(pending[0], text.strip())
    else:
        for c in clauses(text):
            found = matching(c, pending, slots)
            if len(found) == 1:
                settle(found[0], c)
    return state | {"facts": facts, "unknown": list(dict.fromkeys(unknown)), "deferred": list(dict.fromkeys(deferred)), "pending": pending}


def ask(state: dict, fields: Sequence[str]) -> dict:
    """Mark known fields as asked and pending."""
    known = [f for f in fields if f in state["facts"]]
    asked = state["asked"] | {f: state["asked"][f] + 1 for f in known}
    return state | {"asked": asked, "pending": list(dict.fromkeys([*state["pending"], *known])), "last_action": "ask"}


def should_ask(state: dict, field: str, most: int = 2) -> bool:
    """Not yet filled, not unknown, and asked less than ``most`` times."""
    return field in state["facts"] and not state["facts"][field] and field not in state["unknown"] and state["asked"][field] < most


def summarized(state: dict) -> dict:
    return state | {"complete": True, "pending": [], "last_action": "summarize"}


def snapshot(state: dict) -> dict:
    """What a summary may show: filled slots, unknown and deferred ones."""
    return {"facts": {k: v for k, v in state["facts"].items() if v}, "unknown": sorted(state["unknown"]), "deferred": sorted(state["deferred"]), "turn_count": state["turn_count"]}


def turn(state: dict, text: str, slots: Mapping[str, Sequence[str]] = SLOTS, at_once: int = 2) -> dict:
    """One message: counted, bound to what was asked, then the next open fields are asked, or the summary is made."""
    state = bind(begin(state, text), text, slots)
    fields = [f for f in slots if f not in state["pending"] and should_ask(state, f)][:at_once]
    return ask(state, fields) if fields or state["pending"] else summarized(state)


def replay(messages: DataFrame, slots: Mapping[str, Sequence[str]] = SLOTS) -> DataFrame:
    """session_id, seq, filled, unknown, deferred, pending, complete, snapshot after every message (session_id, seq, text).

    Sorted partitions are folded as a stream with one state in memory, the history of which is not kept.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        names = ["session_id", "seq", "filled", "unknown", "deferred", "pending", "complete", "snapshot"]
        for df in batches:
            out = []
            for sid, seq, text in zip(df["session_id"], df["seq"], df["text"], strict=True):
                if state is None or state["session_id"] != sid:
                    state = new_state(sid, slots)
                state = turn(state, text or "", slots) | {"history": []}
                shown = snapshot(state)
                out.append((sid, seq, len(shown["facts"]), len(state["unknown"]), len(state["deferred"]), len(state["pending"]), state["complete"], json.dumps(shown, ensure_ascii=False, sort_keys=True)))
            yield pd.DataFrame(out, columns=names)

    ordered = messages.where("session_id is not null").select("session_id", "seq", "text").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInPandas(fold, "session_id string, seq long, filled int, unknown int, deferred int, pending int, complete boolean, snapshot string")
