"""Emotional state of many users at once: a relation of coefficients by stance and reaction, and one matrix step for a turn of each user.

A state is a row of eight channels. Rules of a turn (survey, A9): channels decay to their rest by half-lives; the reaction moves the six
mood channels by the pair's coefficients, in the room they had before the decay; trust and attachment gain or suffer; opposite
channels hold each other down; all end within 0 and 1. The k-th turns of all users are one step, so a fold takes as many steps as
the longest history has turns, each over all users that have as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import CHANNELS, EVENT_MOODS, HALF_LIFE, IMPLIED, MOOD, REACTIONS, RESONANCE, RESTING, STANCES

AT = {c: k for k, c in enumerate(CHANNELS)}
REACTION, STANCE = {r: k for k, r in enumerate(REACTIONS)}, {s: k for k, s in enumerate(STANCES)}
PLAIN, NEUTRAL, COLD, HOSTILE, POUT, CARE = REACTION["calm_warmth"], STANCE["neutral"], REACTION["guarded_cold"], STANCE["hostile"], REACTION["playful_pout"], REACTION["melancholic_care"]
REST = np.array([RESTING[c] for c in CHANNELS])
LIVES = np.array([HALF_LIFE[c] for c in CHANNELS])


def relation() -> dict[str, np.ndarray]:
    """Coefficients by (stance, reaction): of the mood channels as arrays over channels, the others as numbers; ``shield`` is 1, 0 or -1 for never."""
    shape = len(STANCES), len(REACTIONS)
    out = {"push": np.zeros((*shape, len(CHANNELS))), "bonus": np.zeros((*shape, len(CHANNELS))), **{c: np.ones(shape) for c in ("trust", "trust_penalty", "attachment", "attachment_penalty")}, "shield": np.zeros(shape)}
    for s, i in STANCE.items():
        for r, j in REACTION.items():
            fit = RESONANCE.get((s, r), {})
            for c in MOOD:
                out["push"][i, j, AT[c]] = REACTIONS[r].get(c, 0.0) * fit.get(c, 1.0)
                out["bonus"][i, j, AT[c]] = fit.get(f"{c}_gain", 0.0)
            for c in ("trust", "trust_penalty", "attachment", "attachment_penalty"):
                out[c][i, j] = fit.get(c, 1.0)
            out["shield"][i, j] = {True: 1, False: -1, None: 0}[fit.get("shield")] if s != "hostile" else -1
    return out


RELATION = relation()
RATES = np.array([STANCES[s] for s in STANCES])


def turn(now: np.ndarray, seconds: np.ndarray, reaction: np.ndarray, stance: np.ndarray, power: np.ndarray, swing: np.ndarray) -> np.ndarray:
    """States after one turn of each row. Reaction and stance are codes, all inputs as ``inputs`` makes them."""
    own = {c: v[stance, reaction] for c, v in RELATION.items()}
    joy, grief, trust, _, bond, *_ = now.T
    cold, foe = reaction == COLD, stance == HOSTILE
    shield = (own["shield"] == 1) | ((own["shield"] == 0) & (reaction == POUT) & (trust >= 0.65) & (bond >= 0.25))
    wary, stress = 1.5 - trust, 1.0 + np.abs(swing)

    # moods: what moves them, what dampens that, and the room left for it
    moved = own["push"] * power[:, None] + own["bonus"]
    moved[:, AT["joy"]] += 0.15 * swing
    moved[:, AT["sadness"]] += 0.15 * np.maximum(0.0, -swing)
    damp = np.ones_like(now)
    damp[:, AT["joy"]] = (0.5 + trust) * np.maximum(0.2, 1.0 - grief)
    damp[:, AT["sadness"]] = wary * np.maximum(0.2, 1.0 - joy)
    damp[:, AT["irritation"]] = np.where(cold, wary, 1.0)
    moved *= damp
    after = REST + (now - REST) * np.exp2(-seconds[:, None] / LIVES) + moved * np.where(moved >= 0, 1.0 - now, now)

    # trust and attachment: the first case that holds
    rate, closer = RATES[stance].T
    weight, pull, hurt = own["trust"], own["attachment"], own["attachment_penalty"]
    guarded = cold | (~shield & (foe | (weight < 0)))
    after[:, AT["trust"]] += np.select(
        [foe & ~shield, (weight < 0) | cold, (rate > 0) & ~guarded],
        [rate * power * own["trust_penalty"] * wary * trust, -0.035 * power * np.where(weight < 0, np.abs(weight), 1.0) * wary * stress * trust, rate * power * weight * (1.0 - trust)],
    )
    warmth = np.clip(after[:, [AT["shyness"], AT["comfort"], AT["joy"]]], 0.0, 1.0) @ np.array([0.015, 0.010, 0.005]) * (1.0 - bond)
    after[:, AT["attachment"]] += np.select(
        [guarded | (pull <= 0), closer > 0, foe],
        [
            np.where(cold | foe | (hurt > 1.0), -0.015 * power * hurt * wary * stress, 0.0),
            np.where(trust >= 0.35, np.minimum(0.03, (closer * power * pull + warmth) * (1.0 - bond)), 0.0),
            closer * power * hurt * wary,
        ],
    )
    return np.clip(held_down(after, shield, cold, foe, reaction == CARE, stress), 0.0, 1.0)


def held_down(x: np.ndarray, shield: np.ndarray, cold: np.ndarray, foe: np.ndarray, care: np.ndarray, stress: np.ndarray) -> np.ndarray:
    """The five inhibitions in their order; the first four see joy, sadness and irritation as the turn has left them."""
    joy, grief, anger = (x[:, AT[c]].copy() for c in ("joy", "sadness", "irritation"))
    overlap = np.where((joy > 0.15) & (grief > 0.15), 0.5 * np.minimum(joy, grief), 0.0)
    x[:, [AT["joy"], AT["sadness"]]] -= overlap[:, None]
    x[:, AT["shyness"]] *= np.where((anger > 0.35) & ~shield, np.maximum(0.0, 1.0 - 2.0 * anger), 1.0)
    x[:, AT["comfort"]] *= np.where(((anger > 0.25) & ~shield) | ((grief > 0.35) & ~care), np.maximum(0.0, 1.0 - (anger + 0.8 * grief)), 1.0)
    x[:, AT["curiosity"]] *= np.where(grief > 0.30, np.maximum(0.2, 1.0 - 0.75 * grief), 1.0)
    left = x[:, AT["sadness"]]
    withdraws = (cold | foe | (anger >= 0.30)) & ~shield & ((left > 0.08) | (anger > 0.15))
    x[:, AT["attachment"]] -= np.where(withdraws, np.minimum(0.08, (0.5 * left + anger) * 0.04 * stress), 0.0)
    return x


def inputs(kinds: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of reaction and stance, intensity and variance of events; what is unknown is a calm reaction, and its stance is the one it implies."""
    given = kinds.map(EVENT_MOODS)
    reaction = np.array([REACTION[g[0]] if isinstance(g, tuple) else PLAIN for g in given], dtype=np.int64)
    stance = np.array([STANCE[g[1]] if isinstance(g, tuple) else NEUTRAL for g in given], dtype=np.int64)
    value = values.astype("float64")
    power, swing = (value / 100.0).clip(0.0, 1.0).fillna(0.5), (value / 50.0 - 1.0).clip(-1.0, 1.0).fillna(0.0)
    return reaction, stance, power.to_numpy(), swing.to_numpy()


def implied(reaction: str, swing: float) -> str:
    """The stance of who says nothing of it."""
    return "hostile" if reaction == "guarded_cold" and swing < -0.5 else IMPLIED.get(reaction, "neutral")


def emotion_states(events: DataFrame) -> DataFrame:
    """Each user's channels after all events in order, rounded to six places. A task holds a state for each of its users and one batch of events."""
    turns = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.where("user_id is not null").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", F.row_number().over(turns).alias("k"))
    columns = ", ".join(f"{c} double" for c in CHANNELS)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot: dict[int, int] = {}
        now, last, n = np.empty((0, len(CHANNELS))), np.empty(0), np.empty(0, dtype=np.int64)
        for pdf in batches:
            for _, part in pdf.groupby("k", sort=False):  # each user once
                new = [u for u in part["user_id"] if u not in slot]
                slot.update({u: len(slot) + k for k, u in enumerate(new)})
                now = np.vstack([now, np.tile(REST, (len(new), 1))])
                last, n = np.append(last, np.full(len(new), np.nan)), np.append(n, np.zeros(len(new), dtype=np.int64))
                at = part["user_id"].map(slot).to_numpy()
                us = part["us"].to_numpy(dtype=np.float64)
                seconds = np.nan_to_num(np.maximum(0.0, us - last[at]) / 1e6)
                now[at] = turn(now[at], seconds, *inputs(part["event_type"], part["value"]))
                last[at] = us
                n[at] += 1
        out = pd.DataFrame(np.round(now, 6), columns=[*CHANNELS])
        out.insert(0, "user_id", np.array(list(slot), dtype=np.int64))
        out.insert(1, "n", n)
        yield out

    ordered = rows.repartition("user_id").sortWithinPartitions("k", "user_id")
    return ordered.mapInPandas(fold, f"user_id long, n long, {columns}")


def stream_emotions(events: DataFrame) -> DataFrame:
    """The same as a streaming operator: a user's channels after each micro-batch."""
    columns = ", ".join(f"{c} double" for c in CHANNELS)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        n, last, *values = held.get if held.exists else (0, None, *REST)
        now = np.array([values], dtype=np.float64)
        codes = inputs(pdf["event_type"], pdf["value"])
        for k, us in enumerate(pdf["us"]):
            seconds = 0.0 if last is None else max(0.0, (us - last) / 1e6)
            now = turn(now, np.array([seconds]), *(c[k : k + 1] for c in codes))
            last = float(us)
        n += len(pdf)
        held.update((n, last, *now[0].tolist()))
        yield pd.DataFrame([[int(key[0]), n, *np.round(now[0], 6)]], columns=["user_id", "n", *CHANNELS])

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value").groupBy("user_id")
    return rows.applyInPandasWithState(run, f"user_id long, n long, {columns}", f"n long, last double, {columns}", "update", "NoTimeout")


def _number(x: float) -> str:
    return repr(float(x))


def oracle() -> str:
    """The fold in SQL: a recursive step over each user's events, with the relation as a table."""
    kinds = {kind: (REACTION[r], STANCE[s]) for kind, (r, s) in EVENT_MOODS.items()} | {"": (PLAIN, NEUTRAL)}
    rows = []
    for kind, (r, s) in kinds.items():
        moods = [_number(RELATION[t][s, r, AT[c]]) for t in ("push", "bonus") for c in MOOD]
        rest = [_number(RELATION[c][s, r]) for c in ("trust", "trust_penalty", "attachment", "attachment_penalty", "shield")] + [_number(x) for x in RATES[s]]
        rows.append(f"('{kind}', {', '.join(moods + rest)}, {r == COLD}, {s == HOSTILE}, {r == POUT}, {r == CARE})")
    names = [f"{t}_{c}" for t in ("p", "b") for c in MOOD] + ["tw", "tp", "aw", "ap", "sh", "rate", "closer", "cold", "foe", "pout", "care"]
    tilt = {"joy": "+ 0.15 * swing", "sadness": "+ 0.15 * greatest(0.0, -swing)"}
    damp = {"joy": "* (0.5 + trust) * greatest(0.2, 1 - sadness)", "sadness": "* wary * greatest(0.2, 1 - joy)", "irritation": "* CASE WHEN cold THEN wary ELSE 1 END"}
    moved = ", ".join(f"(p_{c} * power + b_{c} {tilt.get(c, '')}) {damp.get(c, '')} AS m_{c}" for c in MOOD)

    def decayed(c: str) -> str:
        rest = _number(RESTING[c])
        return f"{rest} + ({c} - {rest}) * pow(2.0, -sec / {_number(HALF_LIFE[c])})" if np.isfinite(HALF_LIFE[c]) else c

    after = ", ".join(f"{decayed(c)} + m_{c} * CASE WHEN m_{c} >= 0 THEN 1 - {c} ELSE {c} END AS a_{c}" for c in MOOD)
    unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
    keep = ", ".join(CHANNELS)
    return f"""WITH RECURSIVE rel(kind, {", ".join(names)}) AS (VALUES {", ".join(rows)}),
e AS (SELECT user_id AS u, epoch_us(ts) AS us, CASE WHEN event_type IN ({", ".join(f"'{k}'" for k in EVENT_MOODS)}) THEN event_type ELSE '' END AS kind,
  coalesce({unit("value / 100.0")}, 0.5) AS power, coalesce(least(1.0, greatest(-1.0, value / 50.0 - 1.0)), 0.0) AS swing, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
r AS (
  SELECT u, 0::BIGINT AS k, NULL::BIGINT AS us, {", ".join(f"{_number(RESTING[c])}::DOUBLE AS {c}" for c in CHANNELS)} FROM (SELECT DISTINCT u FROM e)
  UNION ALL
  SELECT u, k, us, {unit("a_joy - both_")}, {unit("grief")}, {unit("a_trust")}, {unit("a_irritation")},
    {unit("a_attachment - CASE WHEN (cold OR foe OR a_irritation >= 0.3) AND NOT shield AND (grief > 0.08 OR a_irritation > 0.15) THEN least(0.08, (0.5 * grief + a_irritation) * 0.04 * stress) ELSE 0 END")},
    {unit("a_shyness * CASE WHEN a_irritation > 0.35 AND NOT shield THEN greatest(0.0, 1 - 2 * a_irritation) ELSE 1 END")},
    {unit("a_curiosity * CASE WHEN a_sadness > 0.3 THEN greatest(0.2, 1 - 0.75 * a_sadness) ELSE 1 END")},
    {unit("a_comfort * CASE WHEN (a_irritation > 0.25 AND NOT shield) OR (a_sadness > 0.35 AND NOT care) THEN greatest(0.0, 1 - (a_irritation + 0.8 * a_sadness)) ELSE 1 END")}
  FROM (SELECT *, a_sadness - both_ AS grief FROM (
    SELECT *, CASE WHEN a_joy > 0.15 AND a_sadness > 0.15 THEN 0.5 * least(a_joy, a_sadness) ELSE 0 END AS both_,
      {decayed("trust")} + CASE WHEN foe AND NOT shield THEN rate * power * tp * wary * trust WHEN tw < 0 OR cold THEN -0.035 * power * CASE WHEN tw < 0 THEN -tw ELSE 1 END * wary * stress * trust
        WHEN rate > 0 AND NOT guarded THEN rate * power * tw * (1 - trust) ELSE 0 END AS a_trust,
      attachment + CASE WHEN guarded OR aw <= 0 THEN CASE WHEN cold OR foe OR ap > 1 THEN -0.015 * power * ap * wary * stress ELSE 0 END
        WHEN closer > 0 THEN CASE WHEN trust >= 0.35 THEN least(0.03, (closer * power * aw + (0.015 * {unit("a_shyness")} + 0.01 * {unit("a_comfort")} + 0.005 * {unit("a_joy")}) * (1 - attachment)) * (1 - attachment)) ELSE 0 END
        WHEN foe THEN closer * power * ap * wary ELSE 0 END AS a_attachment
    FROM (SELECT *, {after}, cold OR (NOT shield AND (foe OR tw < 0)) AS guarded FROM (SELECT *, {moved} FROM (
      SELECT e.u, e.k, e.us, {keep}, rel.* EXCLUDE kind, e.power, e.swing, greatest(0, coalesce(e.us - r.us, 0)) / 1e6 AS sec, 1.5 - trust AS wary, 1 + abs(e.swing) AS stress,
        sh = 1 OR (sh = 0 AND pout AND trust >= 0.65 AND attachment >= 0.25) AS shield
      FROM r JOIN e ON e.u = r.u AND e.k = r.k + 1 JOIN rel ON rel.kind = e.kind))))))
SELECT u AS user_id, k AS n, {", ".join(f"round({c}, 6) AS {c}" for c in CHANNELS)} FROM r JOIN (SELECT u, max(k) AS k FROM e GROUP BY u) USING (u, k)"""
