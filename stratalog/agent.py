"""The agent vocabulary: bodies of session events, and a session's state from a log."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Database
from .operators import session
from .operators.folds import last_writer_wins
from .plans.replay import ReplayPlan, StreamSet

ROLES = ("System", "User", "Assistant", "Tool")


def put(key: str, value: Any) -> dict[str, Any]:
    return {"kind": "Put", "key": key, "value": value}


def delete(key: str) -> dict[str, Any]:
    return {"kind": "Delete", "key": key}


def session_started(agent_id: str) -> dict[str, Any]:
    return {"kind": "SessionStarted", "agent_id": agent_id}


def model_turn(role: str, content: str) -> dict[str, Any]:
    if role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    return {"kind": "ModelTurn", "role": role, "content": content}


def tool_call(call_id: str, tool: str, arguments: Any = None) -> dict[str, Any]:
    return {"kind": "ToolCall", "call_id": call_id, "tool": tool, "arguments": arguments}


def tool_result(call_id: str, output: Any = None) -> dict[str, Any]:
    return {"kind": "ToolResult", "call_id": call_id, "output": output}


def decision(text: str) -> dict[str, Any]:
    return {"kind": "Decision", "text": text}


def session_ended(reason: str = "") -> dict[str, Any]:
    return {"kind": "SessionEnded", "reason": reason}


@dataclass(frozen=True)
class SessionState:
    status: str
    agent_id: str | None
    transcript: list[dict[str, Any]]
    pending: list[str]
    cursor: int


def events(
    db: Database, namespace: str | None = None, branch: str | None = "main", until: int | None = None,
) -> DataFrame:
    """Agent events with their fields as columns; with branch None, of all branches."""
    plan = ReplayPlan(
        branch and db.branch(branch).id, db.store.floor, until=until,
        streams=StreamSet(names=[namespace]) if namespace else ReplayPlan().streams,
    )
    rows = db.frame(plan)
    get = lambda f: F.get_json_object("body", f"$.{f}").alias(f)
    return rows.select("position", "stream_name", "body", *map(get, ("kind", "key", "value", "call_id", "agent_id")))


def session_view(db: Database, namespace: str, branch: str = "main", until: int | None = None) -> SessionState:
    """One session's state; its transcript is the result, so it comes to the driver."""
    import json

    rows = events(db, namespace, branch, until)
    state = session.status(rows).first()
    agent = rows.where("kind = 'SessionStarted'").agg(F.max_by("agent_id", "position")).first()[0]
    entries = [json.loads(r["body"]) for r in session.transcript(rows).orderBy("position").select("body").collect()]
    pending = [r["call_id"] for r in session.pending_calls(rows).orderBy("position").collect()]
    return SessionState(
        state["status"] if state else "NotStarted", agent, entries, pending, db.head() if until is None else until,
    )


def kv_view(db: Database, branch: str | None = "main", until: int | None = None) -> DataFrame:
    """Key/value state of Put and Delete events: key, value (JSON text), position."""
    rows = events(db, None, branch, until).where("kind in ('Put', 'Delete')")
    return last_writer_wins(rows, ["key"], ["value"], F.col("kind") == "Delete")
