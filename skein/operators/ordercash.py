"""Order-to-cash investigations: snapshots, access before reading, contracts in force, service levels, and one decision a question, all in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import lexical as L
from skein.operators import memory as Y

#: What a question asks for, by the words it has.
TOPICS = {
    "finance": ("payment", "credit", "finance", "hold reason"),
    "contract": ("sla", "breach", "commitment", "contract"),
    "status": ("status", "eta", "state", "delivered", "transit"),
    "cause": ("why", "cause", "exception", "delay", "investigate"),
    "action": ("action", "procedure", "escalat", "do next"),
}
PROGRESS = ("PICKED_UP", "LINEHAUL", "OUT_FOR_DELIVERY", "ARRIVED_CUSTOMS")


def asks(text: Column, topic: str) -> Column:
    out, t = F.lit(False), F.lower(text)
    for word in TOPICS[topic]:
        out = out | F.contains(t, F.lit(word))
    return out


def snapshot(base: DataFrame, operations: DataFrame, to: str, key: str) -> DataFrame:
    """base after the operations (columns of base, to_snapshot) that lead to a snapshot: rows with a known key replace, others are appended."""
    ops = operations.where(F.col("to_snapshot") == to).drop("to_snapshot")
    return base.join(ops.select(key), key, "left_anti").unionByName(ops)


def can_read(requests: DataFrame, users: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (user_id, family, ...) with authorized: one of the user's roles is among those that the family's policy allows; unknown users and families are denied."""
    r = requests.join(users.select("user_id", "roles"), "user_id", "left").join(policies.select("family", "allowed_roles"), "family", "left")
    return r.withColumn("authorized", F.coalesce(F.arrays_overlap("roles", "allowed_roles"), F.lit(False))).drop("roles", "allowed_roles")


def finance_context(requests: DataFrame, orders: DataFrame, finance: DataFrame, users: DataFrame, policies: DataFrame) -> DataFrame:
    """request_id, order_id, authorized and the columns of finance (invoice_id, ...): rows are read for authorized requests only, the filter stands before the join."""
    judged = can_read(requests.withColumn("family", F.lit("finance")), users, policies).drop("family")
    may = judged.where("authorized").join(orders.select("order_id", "invoice_id"), "order_id", "left").join(finance, "invoice_id", "left")
    return judged.where("not authorized").unionByName(may, allowMissingColumns=True)


def active_contract(contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, contract_id, stale_ids, untrusted_ids for requests (request_id, customer_id, as_of).

    Of the customer's trusted contracts that are in force at as_of (both days included, an open end is none) that with the latest
    start, then the highest version, counts; trusted ones out of force are stale, the others untrusted, in any case.
    """
    j = requests.join(contracts, "customer_id", "left")
    trusted = F.coalesce("trusted", F.lit(False))
    live = trusted & Y.effective(F.col("effective_from"), F.col("effective_to"), F.col("as_of"))
    ids = lambda c: F.sort_array(F.collect_list(F.when(F.col("contract_id").isNotNull() & c, F.col("contract_id"))))
    best = F.max(F.when(live, F.struct("effective_from", "version", "contract_id")))
    return j.groupBy("request_id").agg(best["contract_id"].alias("contract_id"), ids(trusted & ~F.coalesce(live, F.lit(False))).alias("stale_ids"), ids(~trusted).alias("untrusted_ids"))


def policy_for(requests: DataFrame, policies: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, policy_id, action, denied_id, untrusted_id for requests (request_id, user_id, code): a policy that isn't trusted, or not allowed to the user, gives its id only."""
    j = requests.join(policies, "code", "left").join(users.select("user_id", "roles"), "user_id", "left")
    trusted, allowed = F.coalesce("trusted", F.lit(False)), F.coalesce(F.arrays_overlap("roles", "allowed_roles"), F.lit(False))
    ok = trusted & allowed
    return j.select("request_id", F.when(ok, F.col("policy_id")).alias("policy_id"), F.when(ok, F.col("action")).alias("action"), F.when(trusted & ~allowed, F.col("policy_id")).alias("denied_id"), F.when(~trusted, F.col("policy_id")).alias("untrusted_id"))


def commitment_hours(text: Column) -> Column:
    """The first number of hours that a contract's text promises."""
    t = F.lower(text)
    return F.when(F.rlike(t, F.lit(r"\b\d+\s+hours?\b")), F.regexp_extract(t, r"\b(\d+)\s+hours?\b", 1).cast("int"))


def order_context(orders: DataFrame, shipments: DataFrame, events: DataFrame) -> DataFrame:
    """order_id, customer_id, shipment_status, code (of the last trusted event), picked_up, delivered: one row an order, each source grouped before it is joined."""
    t = events.where(F.coalesce("trusted", F.lit(False)))
    e = t.groupBy("shipment_id").agg(F.max(F.struct("ts", "event_id", "code"))["code"].alias("code"), F.min(F.when(F.col("code") == "PICKED_UP", F.col("ts"))).alias("picked_up"), F.bool_or(F.col("code") == "DELIVERED").alias("delivered"))
    s = shipments.select("shipment_id", F.col("status").alias("shipment_status"))
    return orders.join(s, "shipment_id", "left").join(e, "shipment_id", "left").select("order_id", "customer_id", "shipment_status", "code", "picked_up", F.coalesce("delivered", F.lit(False)).alias("delivered"))


def investigate(questions: DataFrame, orders: DataFrame, shipments: DataFrame, events: DataFrame, contracts: DataFrame, finance: DataFrame, users: DataFrame, access: DataFrame, policies: DataFrame) -> DataFrame:
    """request_id, decision, payment_status, credit_hold, contract_id, stale_ids, untrusted_ids, commitment_hours, sla_breached, root_cause, recommended_action, stop_reason, evidence.

    questions: request_id, text, user_id, order_id, as_of. A question gets only what it asks for. Finance that the user may not read ends the
    investigation before anything else is told; a carrier that delivered what the order says is on its way is a conflict; a cause is told only
    if a trusted event that isn't mere progress confirms it, and only then is there an action.
    """
    q = questions.select("request_id", "text", "user_id", "order_id", "as_of", *[asks(F.col("text"), t).alias(f"asks_{t}") for t in TOPICS])
    base = q.join(order_context(orders, shipments, events), "order_id", "left")
    fin = finance_context(q.where("asks_finance").select("request_id", "user_id", "order_id"), orders, finance, users, access).select("request_id", "authorized", "invoice_id", "payment_status", "credit_hold")
    con = active_contract(contracts, base.where("asks_contract").select("request_id", "customer_id", F.to_date("as_of").alias("as_of")))
    con = con.join(contracts.select("contract_id", commitment_hours(F.col("terms")).alias("hours")), "contract_id", "left")
    confirmed = F.col("code").isNotNull() & ~F.col("code").isin(*PROGRESS)
    pol = policy_for(base.where(F.col("asks_action") & confirmed).select("request_id", "user_id", "code"), policies, users)
    j = base.join(fin, "request_id", "left").join(con, "request_id", "left").join(pol, "request_id", "left")
    denied = F.coalesce(~F.col("authorized"), F.lit(False))
    told = lambda c: F.when(~denied, c)
    conflict = F.col("delivered") & F.coalesce(F.col("shipment_status") != "DELIVERED", F.lit(False)) & F.col("asks_status")
    cause = F.when(F.col("asks_cause"), F.when(confirmed & (F.col("code") != "DELAY_NOTICE"), F.col("code")).otherwise("UNKNOWN"))
    breached = F.when(F.col("asks_contract"), Y.breached(F.col("picked_up"), F.col("as_of"), F.col("hours")))
    action = F.when(F.col("asks_action"), F.coalesce("action", F.when(~confirmed, "NONE_YET")))
    some = F.col("payment_status").isNotNull() | F.col("hours").isNotNull() | (F.col("asks_status") & F.col("shipment_status").isNotNull()) | cause.isNotNull() | action.isNotNull()
    stop = F.when(denied, "authorization_denied").when(conflict, "authoritative_source_conflict").when(cause == "UNKNOWN", "insufficient_confirmed_cause").when(some, "requested_fields_supported").otherwise("insufficient_evidence")
    found = F.array_compact(F.array(F.when(F.col("shipment_status").isNotNull() | F.col("code").isNotNull(), F.concat(F.lit("order:"), F.col("order_id").cast("string"))), told(F.concat(F.lit("finance:"), F.col("invoice_id").cast("string"))), told(F.concat(F.lit("contract:"), F.col("contract_id").cast("string"))), told(F.concat(F.lit("policy:"), F.col("policy_id").cast("string")))))
    return j.select("request_id", F.when(denied, "DENIED").when(conflict, "CONFLICT").alias("decision"), told(F.col("payment_status")).alias("payment_status"), told(F.col("credit_hold")).alias("credit_hold"), told(F.col("contract_id")).alias("contract_id"), told(F.col("stale_ids")).alias("stale_ids"), told(F.col("untrusted_ids")).alias("untrusted_ids"), told(F.col("hours")).alias("commitment_hours"), told(breached).alias("sla_breached"), told(cause).alias("root_cause"), told(action).alias("recommended_action"), stop.alias("stop_reason"), found.alias("evidence"))


def baseline(name: str, questions: DataFrame, orders: DataFrame, shipments: DataFrame, events: DataFrame, contracts: DataFrame) -> DataFrame:
    """request_id, commitment_hours, shipment_status, root_cause of a system that reads less: no_retrieval, document_only, structured_only or fixed_mixed."""
    if name not in ("no_retrieval", "document_only", "structured_only", "fixed_mixed"):
        raise ValueError("no such baseline")
    out = questions.select("request_id")
    doc = out.select("request_id", F.lit(None).cast("int").alias("commitment_hours"))
    if name in ("document_only", "fixed_mixed"):
        hit = L.bm25(contracts.select("contract_id", F.col("terms").alias("text")), questions.select("request_id", "text"), 1, doc="contract_id", query="request_id")
        doc = hit.join(contracts.select("contract_id", "terms"), "contract_id").select("request_id", commitment_hours(F.col("terms")).alias("commitment_hours"))
    row = out.select("request_id", F.lit(None).cast("string").alias("shipment_status"), F.lit(None).cast("string").alias("root_cause"))
    if name in ("structured_only", "fixed_mixed"):
        row = questions.select("request_id", "order_id").join(order_context(orders, shipments, events), "order_id", "left").select("request_id", "shipment_status", F.when(~F.col("code").isin(*PROGRESS), F.col("code")).alias("root_cause"))
    return out.join(doc, "request_id", "left").join(row, "request_id", "left").select("request_id", "commitment_hours", "shipment_status", "root_cause")


class GuardedInvestigations:
    """investigate() behind a cache by question, user, roles, snapshot and generation; a denial is never cached. tables: the arguments of investigate() after questions."""

    def __init__(self, tables: dict[str, DataFrame], snapshot_id: str = "g0"):
        self.tables, self.snapshot_id, self.generation, self.cache, self.requests = dict(tables), snapshot_id, 0, {}, 0

    def roles(self, user_id: str) -> tuple[str, ...]:
        row = self.tables["users"].where(F.col("user_id") == user_id).first()
        return tuple(sorted(row["roles"])) if row else ()

    def mutate(self, to: str, shipments: DataFrame, events: DataFrame) -> None:
        """Moves on to a snapshot with replaced shipments and further events; a second time it does nothing."""
        if to == self.snapshot_id:
            return
        t = self.tables
        t["shipments"] = t["shipments"].join(shipments.select("shipment_id"), "shipment_id", "left_anti").unionByName(shipments)
        t["events"] = t["events"].join(events.select("event_id"), "event_id", "left_anti").unionByName(events)
        self.snapshot_id, self.generation = to, self.generation + 1

    def query(self, text: str, user_id: str, order_id, as_of) -> tuple[dict, bool]:
        """The answer, and whether it came from the cache."""
        key = text, user_id, self.roles(user_id), order_id, as_of, self.snapshot_id, self.generation
        self.requests += 1
        if key in self.cache:
            return dict(self.cache[key]), True
        kind = dict(self.tables["orders"].dtypes)["order_id"]
        q = self.tables["orders"].sparkSession.createDataFrame([(0, text, user_id, order_id, as_of)], f"request_id int, text string, user_id string, order_id {kind}, as_of timestamp")
        answer = investigate(q, **self.tables).first().asDict()
        if answer["decision"] != "DENIED":
            self.cache[key] = answer
        return dict(answer), False
