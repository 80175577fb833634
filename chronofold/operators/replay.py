"""Custody replay of chains given as kinds only, and of chains without some of their events."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.folds import folded
from chronofold.operators.states import FIRST, ONE, PROMOTION, _custody_step, reinforced

STATES = ("NEUTRAL", "REINFORCED", "FORGOTTEN")


def custody_replay(chain: DataFrame) -> DataFrame:
    """subject, status, confidence, field_state by an ordered fold of (subject, seq, kind).

    TAINT_FLAGGED acts on CLEAN only, QUARANTINED and REHABILITATED on any status; a reinforcement moves the
    confidence a quarter of the way to 1, rounded to ten digits at each step, and promotes at three quarters.
    """

    def step(s, row):
        status, conf = s
        return (_custody_step(status, row["kind"])[0], reinforced(conf) if row["kind"] == "REINFORCED" else conf), None

    def end(s):
        return s[0], s[1] / ONE, "REINFORCED" if s[1] >= PROMOTION else "NEUTRAL"

    return folded(chain.select("subject", "seq", "kind"), "subject", ["seq"], lambda: ("CLEAN", FIRST), step, "status string, confidence double, field_state string", end)


def excised_replay(chain: DataFrame, excised: DataFrame) -> DataFrame:
    """custody_replay of the chains without the events of ``excised`` (subject, seq): what if they had not been."""
    return custody_replay(chain.join(excised, ["subject", "seq"], "left_anti"))


def lived(chain: DataFrame, recorded: bool = False) -> DataFrame:
    """memory_id, custody_status, field_state, confidence of chains (memory_id, seq, kind, to), replayed without rounding.

    A chain without its birth is not there. A reinforcement of a CLEAN memory moves its confidence a quarter of the way to
    1 and promotes it at three quarters. With ``recorded``, recorded promotions hold too, and a chain that cannot have
    happened stops the job: one that does not begin with STORED, is born twice, or rehabilitates what was not flagged.
    """

    def step(s, row):
        born, status, state, conf = s
        k = row["kind"]
        if recorded and born == (k == "STORED"):
            raise ValueError(f"memory {row['memory_id']}: event {row['seq']} is {k}, and the chain {'is born twice' if born else 'does not begin with STORED'}")
        status, wrong = _custody_step(status, k)
        if recorded and wrong:
            raise ValueError(f"memory {row['memory_id']}: event {row['seq']} does not replay: {wrong}")
        if k == "REINFORCED" and status == "CLEAN":
            conf += (1 - conf) / 4
            if state == "NEUTRAL" and conf >= Fraction(3, 4):
                state = "REINFORCED"
        elif k == "STATE_CHANGED" and row["to"] in STATES and (recorded or row["to"] != "REINFORCED"):
            state = row["to"]
        return (born or k == "STORED", status, state, conf), None

    end = lambda s: (s[0], s[1], s[2], float(s[3]))
    to = F.col("to") if "to" in chain.columns else F.lit(None).cast("string").alias("to")
    told = folded(chain.select("memory_id", "seq", "kind", to), "memory_id", ["seq"], lambda: (False, "CLEAN", "NEUTRAL", Fraction(1, 2)), step, "born boolean, custody_status string, field_state string, confidence double", end)
    return told.where("born").drop("born")


def state_at(chain: DataFrame, at) -> DataFrame:
    """custody_status, field_state and confidence of every memory born by an instant, from chains cut off there (created_at)."""
    return lived(chain.where(F.col("created_at") <= F.lit(at)), recorded=True)
