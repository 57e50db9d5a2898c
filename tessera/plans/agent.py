"""The operational assistant: extract, resolve, plan tools, run them, remember. Tools are named queries over tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.context import TenantContext, scoped
from tessera.functions import extract
from tessera.operators import bm25, graph, logs, resolve

MOST_TOOLS, MOST_FINDINGS, TTL_SECONDS = 5, 5, 30 * 60
Tool = Callable[..., DataFrame]
# The tools each intent asks for, first the most telling.
PLANS = {
    "order_status": ["logs", "search", "graph"],
    "robot_status": ["logs", "pods", "search"],
    "task_allocation": ["logs", "search"],
    "system_error": ["logs", "pods", "deployments", "search"],
    "deployment": ["deployments", "search"],
    "general": ["search"],
}


@dataclass
class Registry:
    """Tools by name."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, name: str, tool: Tool) -> "Registry":
        self.tools[name] = tool
        return self


def standard_tools(chunks: DataFrame, context: TenantContext, log_table: DataFrame, pod_lines: DataFrame, deployment_lines: DataFrame, edges: DataFrame, entities: DataFrame, customers: DataFrame, as_of: Column) -> Registry:
    """The six tools over tables: knowledge search, logs, pods, deployments, graph, customers."""
    words = lambda q: [w for w in q.lower().split() if w.isalnum()]
    return (
        Registry()
        .add("search", lambda question, **_: bm25.scores(scoped(chunks, context), words(question), "chunk_id", "chunk_text").orderBy(F.desc("score"), "chunk_id").limit(20))
        .add("logs", lambda env, **_: logs.newest(logs.relaxed(log_table, as_of, env or "", minutes=60)))
        .add("pods", lambda **_: logs.unhealthy(logs.pods(pod_lines)))
        .add("deployments", lambda customer, env, **_: logs.deployments(deployment_lines).filter((F.col("customer") == customer) & (F.lit(env).isNull() | (F.col("env") == env))))
        .add("graph", lambda customer, **_: graph.traverse(edges, entities, context.tenant_id, "customer", customer or ""))
        .add("customers", lambda customer, **_: customers.filter(F.col("id") == customer))
    )


@dataclass
class Session:
    """What a conversation knows; kept by the caller between turns."""

    customer: str | None = None
    env: str | None = None
    pending: str | None = None
    candidates: list[str] = field(default_factory=list)
    findings: list[str] = field(default_factory=list)
    history: list[tuple[str, str]] = field(default_factory=list)
    active: float = 0.0

    def expired(self, now: float) -> bool:
        return bool(self.active) and now - self.active > TTL_SECONDS


@dataclass(frozen=True)
class Turn:
    kind: str  # answer, clarify, refuse
    text: str
    tools: list[str]
    results: dict[str, list]


def extracted(spark: SparkSession, question: str) -> dict:
    """What the question names, in one row."""
    q = F.col("question")
    row = spark.createDataFrame([(question,)], "question string").select(
        extract.customer_hint(q).alias("customer"), extract.env_question(q).alias("env"), extract.product_hint(q).alias("product"), extract.entity_ids(q).alias("ids"), extract.intent(q).alias("intent"), extract.operational(q).alias("operational")
    )
    return row.first().asDict()


def planned(found: dict, available: set[str]) -> list[str]:
    """The intent's tools that exist; knowledge search alone for a question that is not operational."""
    names = PLANS.get(found["intent"], PLANS["general"]) if found["operational"] else ["search"]
    return [n for n in names if n in available][:MOST_TOOLS]


def _clarified(session: Session, message: str, spark: SparkSession) -> Turn | None:
    """Settle an open question; a message that settles nothing is taken as a new one."""
    meaning = spark.createDataFrame([(message,)], "m string").select(extract.reply(F.col("m"))).first()[0]
    match session.pending, meaning:
        case "confirm", "yes":
            session.customer, session.pending = session.candidates[0], None
            return Turn("answer", f"Using {session.customer}.", [], {})
        case "confirm", "no":
            session.pending, session.candidates = None, []
            return Turn("clarify", "Which customer do you mean?", [], {})
        case "choose", number if number.isdigit() and 1 <= int(number) <= len(session.candidates):
            session.customer, session.pending = session.candidates[int(number) - 1], None
            return Turn("answer", f"Using {session.customer}.", [], {})
    session.pending = None
    return None


def turn(spark: SparkSession, session: Session, message: str, customers: DataFrame, allowed: list[str], registry: Registry, now: float | None = None, **arguments) -> Turn:
    """One message: the customer is resolved and allowed before any tool runs."""
    now = time.time() if now is None else now
    if session.expired(now):
        session.__init__()
    session.active = now
    session.history.append(("user", message))
    if session.pending and (settled := _clarified(session, message, spark)):
        return settled
    found = extracted(spark, message)
    session.env = found["env"] or session.env
    question = spark.createDataFrame([(1, message, found["customer"])], "question_id long, question string, hint string")
    best = resolve.resolved(question, resolve.scored(question, customers)).first()
    if best and best["decision"] in ("resolved", "resolved_confirm"):
        session.customer = best["customer_id"]
    elif best and best["decision"] == "assumed_confirm" and found["operational"]:
        session.pending, session.candidates = "confirm", [best["customer_id"]]
        return Turn("clarify", f"Do you mean {best['customer_id']}?", [], {})
    elif best and best["decision"] == "ask" and found["operational"] and not session.customer:
        session.pending, session.candidates = "choose", list(best["candidates"])
        return Turn("clarify", "Which one: " + ", ".join(f"{i}. {c}" for i, c in enumerate(session.candidates, 1)), [], {})
    if session.customer and "*" not in allowed and session.customer not in allowed:
        return Turn("refuse", "This key may not read that customer.", [], {})
    names = planned(found, set(registry.tools))
    results: dict[str, list] = {}
    for name in names:
        try:
            results[name] = registry.tools[name](customer=session.customer, env=session.env, question=message, **arguments).limit(50).collect()  # a page for the reader
        except Exception as error:  # noqa: BLE001  one failing tool leaves the others
            results[name] = [str(error)[:256]]
    session.findings = list(dict.fromkeys([*session.findings, *(f"{n}: {len(r)} rows" for n, r in results.items())]))[-MOST_FINDINGS:]
    text = "; ".join(f"{n}: {len(r)} rows" for n, r in results.items()) or "Nothing to report."
    session.history.append(("assistant", text))
    return Turn("answer", text, names, results)
