"""State machines of memories, actors, claims and agents, over their histories.

Amounts are whole numbers of 1e-10 (``ONE`` is 1), so that each step rounds exactly, ties to even.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.folds import folded

ONE = 10**10
#: First confidence, share of the way to 1, promotion; the share of the second rule.
FIRST, ALPHA, PROMOTION, SECOND_ALPHA = ONE // 2, Fraction(1, 4), 3 * ONE // 4, Fraction(1, 5)
#: Fixed values of the controller: smoothing, enter, leave, least improvement, stagnation.
BETA, ENTER, LEAVE, IMPROVEMENT, STAGNATION = Fraction(1, 4), Fraction(3, 5), Fraction(2, 5), Fraction(1, 100), 5
#: Fixed values of spike-timing: strengthening, weakening, bounds, pruning.
STRONGER, WEAKER, MOST, PRUNED = 0.10, 0.02, 2.0, 1e-9


def rounded(x: Fraction) -> int:
    """The nearest whole number, ties to even."""
    return round(x)


def shown(units: int) -> str:
    return f"{units // ONE}.{units % ONE:010d}"


def reinforced(units: int, alpha: Fraction = ALPHA) -> int:
    return rounded(units + (ONE - units) * alpha)


def _custody_step(status: str, kind: str) -> tuple[str, str | None]:
    """The next status and what is wrong, if anything."""
    if kind == "QUARANTINED":
        return "QUARANTINED", None
    if kind == "SUPERSEDED_BY":
        return "SUPERSEDED", None
    if kind == "TAINT_FLAGGED":
        return ("TAINT_FLAGGED" if status == "CLEAN" else status), None
    if kind == "REHABILITATED":
        return "CLEAN", None if status == "TAINT_FLAGGED" else "NOT_TAINTED"
    return status, None


def legal_events(chain: DataFrame) -> DataFrame:
    """The events with legal and status after them: a taint only from CLEAN, a rehabilitation only from TAINT_FLAGGED; others change nothing."""

    def step(status, row):
        k = row["kind"]
        ok = not (k == "TAINT_FLAGGED" and status != "CLEAN" or k == "REHABILITATED" and status != "TAINT_FLAGGED")
        status = _custody_step(status, k)[0] if ok else status
        return status, (ok, status)

    return folded(chain, "subject", ["seq"], lambda: "CLEAN", step, "legal boolean, status string")


def replayed(chain: DataFrame) -> DataFrame:
    """subject, status, field_state, confidence, errors (codes with their seq) of recorded chains.

    A reinforcement must name the confidence it starts from; a promotion must be due and, once due, must follow; a change
    of state must start from the state that holds.
    """

    def step(s, row):
        status, state, conf, due, errors = s
        k, p = row["kind"], row["payload"] or {}
        status, wrong = _custody_step(status, k)
        if wrong:
            errors = [*errors, f"{row['seq']}:{wrong}"]
        if k == "STATE_CHANGED":
            if p.get("to") == "REINFORCED" and p.get("from") == "NEUTRAL" and conf < PROMOTION:
                errors = [*errors, f"{row['seq']}:NOT_DUE"]
            due = False
            if p.get("from") != state:
                errors = [*errors, f"{row['seq']}:WRONG_STATE"]
            if p.get("to") in ("REINFORCED", "NEUTRAL", "FORGOTTEN"):
                state = p["to"]
            else:
                errors = [*errors, f"{row['seq']}:UNKNOWN_STATE"]
        elif k == "REINFORCED":
            if p.get("before") != shown(conf):
                errors = [*errors, f"{row['seq']}:WRONG_BEFORE"]
            after = p.get("after")
            if after is None:
                errors = [*errors, f"{row['seq']}:NO_AFTER"]
            else:
                conf = int(after.replace(".", ""))
                due = due or state == "NEUTRAL" and conf >= PROMOTION
        return (status, state, conf, due, errors), None

    def end(s):
        status, state, conf, due, errors = s
        return status, state, shown(conf), [*errors, *(["end:PROMOTION_MISSING"] if due else [])]

    return folded(chain, "subject", ["seq"], lambda: ("CLEAN", "NEUTRAL", FIRST, False, []), step, "status string, field_state string, confidence string, errors array<string>", end)


def reinforcements(chain: DataFrame, alpha: Fraction = ALPHA, promote: bool = True) -> DataFrame:
    """subject, seq, before, after, promoted of the reinforcements of memories that are CLEAN at that point."""

    def step(s, row):
        status, conf, state = s
        status = _custody_step(status, row["kind"])[0]
        if row["kind"] != "REINFORCED" or status != "CLEAN":
            return (status, conf, state), None
        after = reinforced(conf, alpha)
        up = promote and state == "NEUTRAL" and after >= PROMOTION
        return (status, after, "REINFORCED" if up else state), (shown(conf), shown(after), up)

    return folded(chain.select("subject", "seq", "kind"), "subject", ["seq"], lambda: ("CLEAN", FIRST, "NEUTRAL"), step, "before string, after string, promoted boolean").drop("kind")


CLAIM_FROM = {"CLAIM_VALIDATED": ("ASSERTED",), "CLAIM_REFUTED": ("ASSERTED", "VALIDATED"), "CLAIM_WITHDRAWN": ("ASSERTED",), "CLAIM_SUPERSEDED": ("ASSERTED", "VALIDATED")}


def claim_states(events: DataFrame) -> DataFrame:
    """The claim events (claim_id, seq, kind) with state after them and error (the state that an event may not start from).

    Evidence, relations and memberships change no state; a transition from a wrong state is an error and still holds. So
    the state is that of the last transition, which a window finds without a fold.
    """
    w = W.partitionBy("claim_id").orderBy("seq")
    move = F.when(F.col("kind").isin(*CLAIM_FROM), F.substring_index("kind", "_", -1))
    df = events.withColumn("state", F.coalesce(F.last(move, True).over(w), F.lit("ASSERTED"))).withColumn("from", F.coalesce(F.lag("state").over(w), F.lit("ASSERTED")))
    wrong = F.lit(None).cast("string")
    for k, ok in CLAIM_FROM.items():
        wrong = F.when((F.col("kind") == k) & ~F.col("from").isin(*ok), F.col("from")).otherwise(wrong)
    return df.withColumn("error", wrong).drop("from")


def state_before(events: DataFrame, instants: DataFrame) -> DataFrame:
    """instants (claim_id, at, ...) with the claim's state strictly before ``at``: one sort of events and instants together."""
    e = claim_states(events).select("claim_id", F.col("created_at").alias("at"), "seq", "state", F.lit(1).alias("order"), F.lit(None).cast(instants.select(F.struct("*")).schema[0].dataType).alias("row"))
    i = instants.select("claim_id", "at", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("state"), F.lit(0).alias("order"), F.struct(*instants.columns).alias("row"))
    w = W.partitionBy("claim_id").orderBy("at", "order", "seq")
    both = e.unionByName(i).withColumn("state", F.coalesce(F.last("state", True).over(w), F.lit("ASSERTED")))
    return both.where("order = 0").select("row.*", "state")


def constraint(kind: Column, held: Column, open_: Column, n: Column) -> Column:
    """SATISFIED, VIOLATED or UNDETERMINED: held are VALIDATED members, open are ASSERTED ones."""
    settled = F.when(open_ == 0, "SATISFIED").otherwise("UNDETERMINED")
    return (
        F.when(kind == "AT_MOST_ONE", F.when(held > 1, "VIOLATED").otherwise(settled))
        .when(kind == "EXACTLY_ONE", F.when(held > 1, "VIOLATED").when(held == 1, settled).when(open_ == 0, "VIOLATED").otherwise("UNDETERMINED"))
        .otherwise(F.when(held == n, "VIOLATED").otherwise(settled))
    )


def evaluated(members: DataFrame, states: DataFrame) -> DataFrame:
    """set_id, kind, held, open, n, status of sets (set_id, kind, claim_id) by the states (claim_id, state) of their members."""
    per = members.join(states, "claim_id", "left").groupBy("set_id", "kind").agg(F.count_if(F.col("state") == "VALIDATED").alias("held"), F.count_if(F.col("state") == "ASSERTED").alias("open"), F.count("*").alias("n"))
    return per.withColumn("status", constraint(F.col("kind"), F.col("held"), F.col("open"), F.col("n")))


def grants(events: DataFrame) -> DataFrame:
    """subject, grant_id, capability, issuer, granted_at, revoked_at of authority events (subject, seq, kind, grant_id, capability, issuer, at).

    A grant id counts once, at its first GRANTED; its first REVOKED after that ends it.
    """
    first = events.where("kind = 'GRANTED'").groupBy("subject", "grant_id").agg(F.min_by(F.struct("seq", "capability", "issuer", "at"), "seq").alias("g"))
    ends = events.where("kind = 'REVOKED'").select("subject", "grant_id", "seq", "at")
    both = first.select("subject", "grant_id", "g").join(ends, ["subject", "grant_id"], "left").groupBy("subject", "grant_id").agg(F.first("g").alias("g"), F.min(F.when(F.col("seq") > F.col("g.seq"), F.struct("seq", "at"))).alias("r"))
    return both.select("subject", "grant_id", "g.capability", "g.issuer", F.col("g.at").alias("granted_at"), F.col("r.at").alias("revoked_at"))


def quarantines(events: DataFrame) -> DataFrame:
    """subject, opened, closed (null while open): each quarantine up to the first reinstatement after it."""
    w = W.partitionBy("subject").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    freed = F.min(F.when(F.col("kind") == "ACTOR_REINSTATED", F.struct("seq", "at"))).over(w)
    last = F.min(F.when(F.col("kind") == "ACTOR_QUARANTINED", F.col("seq"))).over(w)
    found = events.withColumn("freed", freed).withColumn("next", last).where("kind = 'ACTOR_QUARANTINED'")
    return found.select("subject", F.col("at").alias("opened"), F.when(F.col("next").isNull() | (F.col("freed.seq") < F.col("next")), F.col("freed.at")).alias("closed"))


def live_signals(signals: DataFrame, now_us: int, scale_s: int, floor: float = 0.05) -> DataFrame:
    """The signals (strength, created_us, expires_us) that still count at an instant, with vigor, their strength by then.

    Strength decays exponentially from creation, with a scale in seconds; a signal counts while it is not expired and its vigor
    is at least the floor. Without a strength it does not count.
    """
    age = (F.lit(now_us) - F.col("created_us")) / 1e6
    told = signals.withColumn("vigor", F.col("strength") * F.exp(-age / scale_s))
    return told.where((F.col("expires_us") > now_us) & (F.col("vigor") >= floor))


def control_step(state: tuple[int, str, int], units: int) -> tuple[tuple[int, str, int], str | None]:
    """(average, mode, stagnation) after an observation, and what made the mode change; the average is rounded to 1e-10."""
    ema, mode, still = state
    exact = BETA * units + (1 - BETA) * ema
    still = (0 if exact >= ema + IMPROVEMENT * ONE else still + 1) if mode == "DWELLING" else 0
    new, trigger = mode, None
    if mode == "ROAMING" and exact >= ENTER * ONE:
        new, trigger = "DWELLING", "ENTER"
    elif mode == "DWELLING" and exact <= LEAVE * ONE:
        new, trigger = "ROAMING", "LEAVE"
    elif mode == "DWELLING" and still >= STAGNATION:
        new, trigger = "ROAMING", "STAGNATION"
    return (rounded(exact), new, 0 if new != mode else still), trigger


def controlled(observations: DataFrame) -> DataFrame:
    """The observations (agent, seq, units of 1e-10) with ema, mode, trigger and stagnation after each step."""

    def step(s, row):
        (ema, mode, still), trigger = control_step(s, row["units"])
        return (ema, mode, still), (shown(ema), mode, trigger, still)

    return folded(observations, "agent", ["seq"], lambda: (0, "ROAMING", 0), step, "ema string, mode string, trigger string, stagnation int")


def learned(turns: DataFrame) -> DataFrame:
    """session, from_id, to_id, weight of the synaptic links after all turns (session, turn, ids array<string>).

    Every id of a turn strengthens its link to each id of the next one, and weakens its others; weak ones go.
    """

    def step(s, row):
        links, before = s
        now = set(row["ids"] or [])
        for p in before:
            own = dict(links.get(p, {}))
            for c in sorted(now - {p}):
                own[c] = min(MOST, own.get(c, 0.0) + STRONGER)
            for e in [e for e in own if e not in now and e != p]:
                own[e] = max(0.0, own[e] - WEAKER)
                if own[e] <= PRUNED:
                    del own[e]
            links = {**links, p: own}
        return (links, list(dict.fromkeys(row["ids"] or []))), None

    def end(s):
        return ([{"from_id": p, "to_id": c, "weight": w} for p, own in sorted(s[0].items()) for c, w in sorted(own.items())],)

    out = folded(turns, "session", ["turn"], lambda: ({}, []), step, "links array<struct<from_id:string,to_id:string,weight:double>>", end)
    return out.select("session", F.explode("links").alias("l")).select("session", "l.*")


def limited(hits: DataFrame, most: int, window_s: int = 60) -> DataFrame:
    """The hits (client, at in microseconds) with accepted: fewer than ``most`` accepted ones in the window before; refused ones do not count."""

    def step(log, row):
        log = [t for t in log if t > row["at"] - window_s * 1_000_000]
        ok = len(log) < most
        return ([*log, row["at"]] if ok else log), (ok,)

    return folded(hits, "client", ["at", "id"], list, step, "accepted boolean")


def cached(requests: DataFrame, ttl_s: int = 300, most: int = 512) -> DataFrame:
    """The requests (session, at, id, key, generation, degraded) with hit: an entry of that key and generation that is young enough.

    Least recently used entries go beyond ``most``; degraded results are not kept.
    """

    def step(entries, row):
        entries = dict(entries)
        key = (row["key"], row["generation"])
        if key in entries and entries[key] > row["at"] - ttl_s * 1_000_000:
            entries[key] = entries.pop(key)
            return entries, (True,)
        entries.pop(key, None)
        if not row["degraded"]:
            entries[key] = row["at"]
            if len(entries) > most:
                entries.pop(next(iter(entries)))
        return entries, (False,)

    return folded(requests, "session", ["at", "id"], dict, step, "hit boolean")
