"""Users, keys, invitations and request modes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.names import email
from papyrine.operators.request_log import page_bounds
from papyrine.streaming.fold import State, batch_fold

MAX_ACTIVE_KEYS = 20
INVITATION_DAYS = 30


def request_mode(auth: Column, has_key: Column, unlimited: Column, used: Column, cap: Column) -> Column:
    """local, byok, trial or exhausted."""
    return F.when(auth == "none", "local").when(has_key, "byok").when(unlimited | (used < cap), "trial").otherwise("exhausted")


def trial_left(total: Column, used: Column) -> Column:
    return F.greatest(total - used, F.lit(0))


def is_unlimited(role: Column, flag: Column) -> Column:
    return (role == "admin") | F.coalesce(flag, F.lit(False))


def model_parts(text: Column) -> Column:
    """Struct (backend, model) of ``backend/model``; the model keeps its later slashes."""
    return F.struct(F.split_part(text, F.lit("/"), F.lit(1)).alias("backend"), F.regexp_replace(text, "^[^/]*/?", "").alias("model"))


def budget_key(bucket: Column, key_id: Column, user_id: Column) -> Column:
    return F.when(key_id.isNotNull(), F.concat_ws(":", bucket, F.lit("key"), key_id)).otherwise(F.concat_ws(":", bucket, F.lit("user"), user_id))


def resolve_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Live keys with their users; a key without a user never resolves."""
    return keys.filter(F.col("revoked_at").isNull()).join(users, "user_id")


def key_outcomes(events: DataFrame, cap: int = MAX_ACTIVE_KEYS) -> DataFrame:
    """What each event of a user's keys (user_id, seq, key_id, kind: create or revoke) did: created,
    refused (``cap`` keys are live), revoked, or not_found (no such live key, so a key is revoked
    once); with the live keys after it. The state of a user is at most ``cap`` identifiers."""

    def apply(state: State, event: dict[str, Any]) -> tuple[State, list[dict[str, Any]]]:
        live, key = state["live"], event["key_id"]
        if event["kind"] == "create":
            outcome = "created" if len(live) < cap else "refused"
            live = [*live, key] if outcome == "created" else live
        else:
            outcome = "revoked" if key in live else "not_found"
            live = [k for k in live if k != key]
        return {"live": live}, [{"seq": event["seq"], "key_id": key, "outcome": outcome, "active": len(live)}]

    types = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "seq", "key_id")}
    schema = f"user_id {types['user_id']}, seq {types['seq']}, key_id {types['key_id']}, outcome string, active int"
    return batch_fold(events.select("user_id", "seq", "key_id", "kind"), "user_id", ["seq"], lambda: {"live": []}, apply, schema)


def key_listing(keys: DataFrame) -> DataFrame:
    """Each user's keys without their hashes, newest first by ``position``; ``active`` counts the live ones."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    active = F.count_if(F.col("revoked_at").isNull()).over(Window.partitionBy("user_id"))
    return keys.drop("hash").withColumns({"position": F.row_number().over(newest), "active": active})


def admin_count(users: DataFrame) -> DataFrame:
    """One row: users and admins."""
    return users.agg(F.count("*").alias("users"), F.count_if(F.col("role") == "admin").alias("admins"))


def public_settings(settings: DataFrame, single_user: Column, default_model: str, for_keys: bool = False) -> DataFrame:
    """Settings as their user sees them: that a key is stored and its last characters, never the
    key. The backend and the local model show only where one user runs the service alone; requests
    made with an API key (``for_keys``) see no trace of the stored key."""
    local = {c: F.when(single_user, F.col(c)) for c in ("backend", "local_model")}
    traces = [] if for_keys else [F.col("key_last4"), F.col("key_enc").isNotNull().alias("has_key")]
    shown = settings.withColumns(local)
    return shown.select("user_id", "store_results", "check_registries", "model", "local_model", "backend", F.lit(default_model).alias("default_model"), *traces)


def user_listing(users: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page of all users, newest first, with their ``total``."""
    size, skip = page_bounds(limit, offset)
    page = users.orderBy(F.desc("created_at"), F.desc("user_id")).offset(skip).limit(size)
    return page.join(F.broadcast(users.agg(F.count("*").alias("total"))))  # a single row


def with_inviter(invitations: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Invitations with the inviter's address (or null) and the status as of ``now``."""
    inviters = users.select(F.col("user_id").alias("invited_by"), F.col("email").alias("inviter_email"))
    status = F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status"))
    return invitations.join(inviters, "invited_by", "left").withColumn("status", status)


def user_page(users: DataFrame, aggregates: DataFrame, keys: DataFrame) -> DataFrame:
    """Users with their aggregates (0 or null without requests) and whether they stored a key."""
    stored = keys.filter(F.col("key_enc").isNotNull()).select("user_id").distinct().withColumn("has_key", F.lit(True))
    joined = users.join(aggregates, "user_id", "left").join(stored, "user_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("docs", "ok", "this_month")}
    return joined.withColumns(zeros | {"has_key": F.coalesce("has_key", F.lit(False))})


def registered(sign_ins: DataFrame) -> DataFrame:
    """Users of a stream of sign-ins (user_id, email, at): the first ever is admin; the first
    address that a user came with stays."""
    first = sign_ins.groupBy("user_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_seen_at"), F.min_by(email(F.col("email")), "at").alias("email"))
    founder = sign_ins.agg(F.min(F.struct("at", "user_id")).alias("f")).select("f.user_id").withColumn("role", F.lit("admin"))
    return first.join(F.broadcast(founder), "user_id", "left").withColumn("role", F.coalesce("role", F.lit("user")))  # one row


def _met(requests: DataFrame, invitations: DataFrame) -> DataFrame:
    """(email, user_id, at, invitation_id) of verified sign-ups with a user, each with the newest
    pending invitation of its address that lives at its moment; one row a user, of all that match the
    newest and of those the earliest. A fold over each address's invitations and sign-ups in order of
    time keeps the invitations that no newer one outlives, so each row is taken up and laid off once,
    however many there are of an address."""
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    user, number = requests.schema["user_id"].dataType, invitations.schema["id"].dataType
    # no nulls: pandas would make numbers with nulls doubles
    none = lambda kind: F.lit(0).cast(kind)
    live = invitations.filter((F.col("status") == "pending") & F.col("id").isNotNull())
    sent = live.select(email(F.col("email")).alias("email"), micros("created_at").alias("us"), F.lit(0).alias("place"), F.col("id").alias("invitation_id"), none(user).alias("user_id"), micros("expires_at").alias("until"))
    asked = requests.filter(F.col("verified") & F.col("user_id").isNotNull())
    asked = asked.select(email(F.col("email")).alias("email"), micros("at").alias("us"), F.lit(1).alias("place"), none(number).alias("invitation_id"), "user_id", micros("at").alias("until"))
    moments = sent.unionByName(asked).filter("email is not null and us is not null and until is not null")

    def moment(state: State, event: dict[str, Any]) -> tuple[State, list[dict[str, Any]]]:
        held = state["held"]  # oldest first; each ends later than the newer ones after it
        # what ended by now goes, and at a sending what the new one outlives
        while held and held[-1][0] <= max(event["us"], event["until"]):
            held.pop()
        if not event["place"]:
            held.append((event["until"], event["us"], event["invitation_id"]))
            return state, []
        return state, [{"user_id": event["user_id"], "us": event["us"], "sent_us": held[-1][1], "invitation_id": held[-1][2]}] if held else []

    schema = f"email string, user_id {user.simpleString()}, us long, sent_us long, invitation_id {number.simpleString()}"
    found = batch_fold(moments, "email", ["us", "place", "invitation_id"], lambda: {"held": []}, moment, schema)
    newest = Window.partitionBy("user_id").orderBy(F.desc("sent_us"), F.desc("invitation_id"), "us")
    at = F.timestamp_micros("us").cast(requests.schema["at"].dataType).alias("at")
    return found.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("email", "user_id", at, "invitation_id")


def admitted(requests: DataFrame, invitations: DataFrame) -> DataFrame:
    """Sign-ups (user_id, email, verified, at) with the newest invitation that admits each."""
    return _met(requests, invitations).select("user_id", "invitation_id", "at")


def current_invitations(events: DataFrame) -> DataFrame:
    """Latest pending invitation of each address; later ones close earlier ones."""
    newest = Window.partitionBy(email(F.col("email"))).orderBy(F.desc("created_at"), F.desc("id"))
    status = F.when((F.col("status") == "pending") & (F.col("_n") > 1), "revoked").otherwise(F.col("status"))
    return events.withColumn("_n", F.row_number().over(newest)).withColumn("status", status).drop("_n")


def invitation_states(events: DataFrame) -> DataFrame:
    """Current row of each invitation from its events (id, email, kind: sent, resent, accepted or
    revoked, at). Each sending moves both dates; the first of acceptance, revocation and a later
    invitation of the same address ends it, which only an acceptance does not call revoked."""
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("at"))
    rows = events.groupBy("id").agg(
        F.min_by(email(F.col("email")), at("sent")).alias("email"), F.min(at("sent")).alias("_sent"), F.max(at("sent", "resent")).alias("created_at"),
        F.min(at("accepted")).alias("_accepted"), F.min(at("revoked")).alias("_revoked"),
    )
    later = F.lead("_sent").over(Window.partitionBy("email").orderBy("_sent", "id"))
    rows = rows.withColumn("_closed", F.least("_revoked", later))
    accepted = F.col("_accepted") <= F.coalesce("_closed", "_accepted")
    return rows.select(
        "id", "email", "created_at", (F.col("created_at") + F.expr(f"INTERVAL {INVITATION_DAYS} DAYS")).alias("expires_at"),
        F.when(accepted, "accepted").when(F.col("_closed").isNotNull(), "revoked").otherwise("pending").alias("status"), F.when(accepted, F.col("_accepted")).alias("accepted_at"),
    )


def invitation_listing(invitations: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Invitations with inviters and status as of ``now``, newest first."""
    return with_inviter(invitations, users, now).orderBy(F.desc("created_at"), F.desc("id"))


def admitted_accounts(sign_ups: DataFrame, invitations: DataFrame, users: DataFrame, admin_email: str | None) -> DataFrame:
    """New accounts (user_id, role, email, invitation_id, created_at) of sign-ups (user_id, email,
    verified, at): the first with the configured admin's verified address becomes admin while there
    is none, and takes the newest pending invitation of it, expired or not; others need a live one,
    which one sign-up uses. Known users and the rest get no row."""
    fresh = sign_ups.join(users.select("user_id"), "user_id", "left_anti")
    once = Window.partitionBy("invitation_id").orderBy("at", "user_id")
    invited = _met(fresh, invitations).withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    guests = invited.select("user_id", F.lit("user").alias("role"), "email", "invitation_id", F.col("at").alias("created_at"))
    if admin_email is None:
        return guests
    mine = fresh.filter(F.col("verified") & (email(F.col("email")) == admin_email))
    founder = mine.agg(F.min(F.struct("at", "user_id")).alias("f")).filter("f is not null").select("f.user_id", F.col("f.at").alias("created_at"))
    founder = founder.join(F.broadcast(users.agg(F.count_if(F.col("role") == "admin").alias("_admins")))).filter("_admins = 0")  # single rows
    own = invitations.filter((F.col("status") == "pending") & (email(F.col("email")) == admin_email)).select(F.col("id").alias("_id"), F.col("created_at").alias("_sent"))
    own = own.join(F.broadcast(founder.select("created_at")), F.col("_sent") <= F.col("created_at"))  # a single row
    newest = own.agg(F.max(F.struct("_sent", "_id"))["_id"].alias("invitation_id"))
    admin = founder.join(F.broadcast(newest)).select("user_id", F.lit("admin").alias("role"), F.lit(admin_email).alias("email"), "invitation_id", "created_at")
    left = guests.join(admin.select("user_id"), "user_id", "left_anti").join(admin.select("invitation_id"), "invitation_id", "left_anti")
    return admin.unionByName(left)


def upserted(current: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with later patches over it; null in a patch leaves the value."""
    base = current.withColumn(order, F.lit(None).cast(patches.schema[order].dataType))
    both = base.unionByName(patches, allowMissingColumns=True)
    at = F.coalesce(F.col(order), F.lit(0))
    columns = [c for c in current.columns if c != key]
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def without_user(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted users (user_id)."""
    return {name: df.join(gone, "user_id", "left_anti").select(*df.columns) for name, df in tables.items()}


def unlinked_invitations(invitations: DataFrame, gone: DataFrame) -> DataFrame:
    """Invitations that the deleted users (user_id) accepted stay as records without their user."""
    left = gone.select(F.col("user_id").alias("accepted_user_id"), F.lit(True).alias("_gone")).distinct()
    rows = invitations.join(left, "accepted_user_id", "left")
    return rows.withColumn("accepted_user_id", F.when(F.col("_gone").isNull(), F.col("accepted_user_id"))).select(*invitations.columns)


def throttled_last_seen(events: DataFrame, seconds: int = 60) -> DataFrame:
    """The visits (user_id, at) that rewrite ``last_seen``: each at least a minute after the last
    that did; a fold over one user's visits in order, which keeps the last one alone."""

    def visit(state: State, event: dict[str, Any]) -> tuple[State, list[dict[str, Any]]]:
        if state["last"] is not None and event["us"] - state["last"] < seconds * 1_000_000:
            return state, []
        return {"last": event["us"]}, [{"us": event["us"]}]

    visits = events.select("user_id", F.unix_micros("at").alias("us")).filter("us is not null")
    schema = f"user_id {events.schema['user_id'].dataType.simpleString()}, us long"
    kept = batch_fold(visits, "user_id", ["us"], lambda: {"last": None}, visit, schema)
    return kept.select("user_id", F.timestamp_micros("us").alias("written_at"))
