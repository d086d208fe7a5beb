"""Causal arms over answer tables: smoothing, voting, patience, stopping; baselines and controls.

A (system, clip) trajectory is bounded by the stored grid. Arms whose state is a function of the
inputs are windows; the two whose state depends on their own output (smoothing, hysteresis) are
folds over the trajectory's array, still inside the JVM.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exprs import BOT, N_CLASSES, TOL, uniform, wrong_class
from holdfast.operators.trajectory import pack, stored

# Parameters swept for each arm.
SWEEPS = {"ema": [0.2, 0.35, 0.5, 0.7], "majority": [2, 3, 5, 7, 9], "hysteresis": [0.05, 0.10, 0.20, 0.30], "patience": [2, 3, 4, 6]}

# Fixed value: confidence a control states for its chosen class.
CONTROL_CONFIDENCE = 0.9

CLIP = ["system_id", "video_id"]


def by_clip():
    return Window.partitionBy(*CLIP).orderBy("j")


def argmax(probs: Column) -> Column:
    """Most probable class, lowest index on ties; no answer where probabilities are absent."""
    return F.coalesce(F.array_position(probs, F.array_max(probs)).cast("int") - 1, F.lit(BOT))


def dense_steps(answers: DataFrame, j_min: int, j_max: int) -> DataFrame:
    """Every stored step of every trajectory as one array, absent cells with null probabilities."""
    def step(j):
        return F.struct(j.alias("j"), stored(j).getField("probs").alias("probs"))
    return pack(answers, ["probs"]).select(*CLIP, F.transform(F.sequence(F.lit(j_min), F.lit(j_max)), step).alias("steps"))


def long_steps(dense: DataFrame) -> DataFrame:
    return dense.select(*CLIP, F.explode("steps").alias("s")).select(
        *CLIP, "s.j", "s.probs", argmax(F.col("s.probs")).alias("base"))


def ema_fold(steps: Column, alpha: float) -> Column:
    """Smoothed probabilities (j, probs) at every step of an array of steps (j, probs)."""
    def blend(state, x):
        both = F.zip_with(x["probs"], state["q"], lambda p, q: F.lit(alpha) * p + F.lit(1.0 - alpha) * q)
        q = F.when(x["probs"].isNull(), state["q"]).when(state["q"].isNull(), x["probs"]).otherwise(both)
        return F.struct(q.alias("q"), F.concat(state["out"], F.array(F.struct(x["j"].alias("j"), q.alias("probs")))).alias("out"))
    zero = F.expr("struct(cast(null as array<double>) as q, cast(array() as array<struct<j:int,probs:array<double>>>) as out)")
    return F.aggregate(steps, zero, blend, lambda s: s["out"])


def ema(dense: DataFrame, alpha: float) -> DataFrame:
    """Exponential smoothing of the probabilities; a cell without evidence holds the state."""
    out = dense.select(*CLIP, F.explode(ema_fold(F.col("steps"), alpha)).alias("s"))
    return out.select(*CLIP, "s.j", "s.probs", argmax(F.col("s.probs")).alias("pred"))


def hysteresis_fold(steps: Column, margin: float) -> Column:
    """Held label (j, pred) at every step."""
    def move(state, x):
        k = argmax(x["probs"])
        def p(c):
            return F.coalesce(F.get(x["probs"], F.greatest(c, F.lit(0))), F.lit(0.0))
        first = F.size(state["out"]) == 0
        switch = (k != state["cur"]) & (k != BOT) & (p(k) - p(state["cur"]) > margin)
        adopt = (state["cur"] == BOT) & (k != BOT)
        cur = F.when(first | switch | adopt, k).otherwise(state["cur"])
        return F.struct(cur.alias("cur"), F.concat(state["out"], F.array(F.struct(x["j"].alias("j"), cur.alias("pred")))).alias("out"))
    zero = F.expr(f"struct({BOT} as cur, cast(array() as array<struct<j:int,pred:int>>) as out)")
    return F.aggregate(steps, zero, move, lambda s: s["out"])


def hysteresis(dense: DataFrame, margin: float) -> DataFrame:
    """Switch only when the new label leads the held one by more than ``margin``."""
    out = dense.select(*CLIP, F.explode(hysteresis_fold(F.col("steps"), margin)).alias("s"))
    return out.select(*CLIP, "s.j", "s.pred")


def patience_fold(steps: Column, n: int) -> Column:
    """Label (j, pred) that switches after ``n`` agreeing steps, at every step; the first step starts no run."""
    def move(state, x):
        k = argmax(x["probs"])
        first = F.size(state["out"]) == 0
        run = F.when(first, 0).when(k == state["cand"], state["run"] + 1).otherwise(1)
        switch = (k != BOT) & ((state["cur"] == BOT) | ((k != state["cur"]) & (run >= n)))
        cur = F.when(first | switch, k).otherwise(state["cur"])
        cand = F.when(first, F.lit(BOT)).otherwise(k)
        return F.struct(cur.alias("cur"), cand.alias("cand"), run.alias("run"), F.concat(state["out"], F.array(F.struct(x["j"].alias("j"), cur.alias("pred")))).alias("out"))
    zero = F.expr(f"struct({BOT} as cur, {BOT} as cand, 0 as run, cast(array() as array<struct<j:int,pred:int>>) as out)")
    return F.aggregate(steps, zero, move, lambda s: s["out"])


def majority(steps: DataFrame, width: int, n_classes: int = N_CLASSES) -> DataFrame:
    """Vote over the last ``width`` steps; a tie goes to the current label, else to the lowest class.

    Votes are counted over the labels in the window, whatever their codes; ``probs`` covers at least ``n_classes`` of them.
    """
    frame = by_clip().rowsBetween(-(width - 1), 0)
    s = steps.withColumn("_in", F.collect_list(F.when(F.col("base") != BOT, F.col("base"))).over(frame))
    def count(c):
        return F.size(F.filter("_in", lambda x: x == c))
    s = s.withColumn("_votes", F.transform(F.array_sort(F.array_distinct("_in")), lambda c: F.struct(count(c).alias("n"), c.alias("c"))))
    s = s.withColumn("_best", F.array_max(F.transform("_votes", lambda v: v["n"])))
    pick = F.get(F.filter("_votes", lambda v: v["n"] == F.col("_best")), F.lit(0))["c"]
    pred = F.when(F.col("base") == BOT, BOT).when(count(F.col("base")) == F.col("_best"), F.col("base")).otherwise(pick)
    top = F.greatest(F.lit(n_classes - 1), F.array_max("_in"))
    freq = F.when((pred != BOT) & (F.size("_in") > 0), F.transform(F.sequence(F.lit(0), top), lambda c: count(c) / F.size("_in")))
    return s.select(*CLIP, "j", pred.cast("int").alias("pred"), freq.alias("probs"))


def patience(steps: DataFrame, n: int) -> DataFrame:
    """Switch after ``n`` consecutive agreeing steps; the first step starts no run."""
    first = F.min("j").over(Window.partitionBy(*CLIP))
    s = steps.withColumn("_start", F.col("j") == first)
    before = F.lag("base").over(by_clip())
    fresh = F.col("_start") | F.coalesce(F.lag("_start").over(by_clip()), F.lit(False)) | (before != F.col("base"))
    s = s.withColumn("_isle", F.sum(fresh.cast("int")).over(by_clip()))
    run = F.row_number().over(Window.partitionBy(*CLIP, "_isle").orderBy("j"))
    s = s.withColumn("_run", F.when(~F.col("_start"), run).otherwise(0))
    upto = by_clip().rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("base") != BOT, F.col("base"))
    switched = F.last(F.when(F.col("_run") >= n, label), ignorenulls=True).over(upto)
    started = F.first(label, ignorenulls=True).over(upto)
    return s.select(*CLIP, "j", F.coalesce(switched, started, F.lit(BOT)).alias("pred"))


def commitment_score(probs: Column, rule: str) -> Column:
    """Largest probability, or its lead over the second; a cell without probabilities scores 0."""
    if rule == "msp":
        return F.coalesce(F.array_max(probs), F.lit(0.0))
    order = F.sort_array(probs, asc=False)
    return F.coalesce(F.get(order, F.lit(0)) - F.get(order, F.lit(1)), F.lit(0.0))


def irrevocable(steps: DataFrame, fires: Column) -> DataFrame:
    """Freeze the label at the first firing step after the anchor; no answer before, raw before the anchor."""
    valid = F.col("probs").isNotNull()
    s = steps.withColumn("_f", F.when(fires & valid & (F.col("j") >= 0), F.col("j")))
    whole = Window.partitionBy(*CLIP)
    s = s.withColumn("_first", F.min("_f").over(whole)).withColumn("_label", F.min_by("base", F.col("_f")).over(whole))
    on = F.coalesce(F.col("j") >= F.col("_first"), F.lit(False))
    pred = F.when(on, F.col("_label")).when(F.col("j") < 0, F.col("base")).otherwise(BOT)
    return s.select(*CLIP, "j", pred.alias("pred"), on.alias("committed"), F.col("_first").alias("first_j"))


def threshold_commit(steps: DataFrame, rule: str, threshold: float) -> DataFrame:
    return irrevocable(steps, commitment_score(F.col("probs"), rule) >= threshold)


def scheduled_stop(steps: DataFrame, thresholds: list[float | None], force_j: int) -> DataFrame:
    """A threshold per step after the anchor (null never fires) and a forced stop at the horizon."""
    table = F.array(*[F.lit(t).cast("double") for t in thresholds])
    due = commitment_score(F.col("probs"), "msp") >= F.get(table, F.greatest(F.col("j"), F.lit(0)))
    return irrevocable(steps, F.coalesce(due, F.lit(False)) | (F.col("j") == force_j))


def consecutive_accept(steps: DataFrame, reliable: Column, v: int) -> DataFrame:
    """Stop after ``v`` consecutive reliable steps, all with the same label, counted from the anchor."""
    s = steps.withColumn("_good", reliable & (F.col("base") >= 0) & (F.col("j") >= 0))
    prev_good, prev = F.coalesce(F.lag("_good").over(by_clip()), F.lit(False)), F.lag("base").over(by_clip())
    fresh = ~F.col("_good") | ~prev_good | (prev != F.col("base"))
    s = s.withColumn("_isle", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(by_clip()))
    s = s.withColumn("_run", F.when(F.col("_good"), F.row_number().over(Window.partitionBy(*CLIP, "_isle").orderBy("j"))).otherwise(0))
    return irrevocable(s, F.col("_run") >= v)


# ---------------------------------------------------------------- baselines and controls
def baseline_answers(manifest: DataFrame, fine: float, j_min: int, j_max: int) -> DataFrame:
    """Train-majority, random, truth and never-answer tables on the real clip axis."""
    counts = manifest.filter("split = 'train'").groupBy("class_code").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by("class_code", F.struct(-F.col("n"), "class_code"))).scalar()
    grid = manifest.select("video_id", "class_code", F.explode(F.sequence(F.lit(j_min), F.lit(j_max))).alias("j"))
    kinds = F.array(*[F.lit(k) for k in ("majority", "random", "oracle", "constbot")])
    g = grid.withColumn("kind", F.explode(kinds))
    draw = F.floor(uniform(F.concat_ws("|", F.lit("random"), "video_id", "j")) * N_CLASSES)
    pred = (F.when(F.col("kind") == "majority", top).when(F.col("kind") == "random", draw)
            .when(F.col("kind") == "oracle", F.col("class_code")).otherwise(BOT).cast("int"))
    return g.select(F.concat(F.lit("trivial__"), "kind").alias("system_id"), "video_id", "j", F.lit(fine).alias("delta_s"),
                    pred.alias("pred"), F.lit(False).alias("committed"))


@dataclass(frozen=True)
class Control:
    """A rule whose metrics are known on paper: lock, osc, frac, rand or oracle."""
    family: str
    d0: float = 0.0
    p: float = 1.0
    c: float = 0.0
    eta: float = 0.0
    commit_after: float | None = None

    @property
    def system_id(self) -> str:
        used = {"lock": ["d0"], "osc": ["d0", "p"], "frac": ["c"], "rand": ["eta"], "oracle": []}[self.family]
        parts = {k: getattr(self, k) for k in used}
        if self.commit_after is not None:
            parts["commit"] = self.commit_after
        body = "_".join(f"{k}-{parts[k]:g}" for k in sorted(parts)) or "default"
        return f"block__{self.family}__{body}"


CONTROLS = [
    Control("oracle"), Control("lock", d0=1.0), Control("lock", d0=2.5), Control("lock", d0=2.5, commit_after=2.5), Control("lock", d0=8.0),
    Control("osc", p=1.0, d0=3.5), Control("osc", p=0.5, d0=6.0), Control("frac", c=0.6), Control("rand", eta=0.5), Control("rand", eta=0.9),
]


def _with_controls(manifest: DataFrame, controls: list[Control]) -> DataFrame:
    spec = F.array(*[F.struct(
        F.lit(k.system_id).alias("system_id"), F.lit(k.family).alias("family"), F.lit(k.d0).alias("d0"), F.lit(k.p).alias("p"), F.lit(k.c).alias("c"),
        F.lit(k.eta).alias("eta"), F.lit(k.commit_after).cast("double").alias("commit")) for k in controls])
    return manifest.select("video_id", "class_code", "anchor_s", "duration_s", F.explode(spec).alias("k")).select("*", "k.*")


def _control_cell(j: Column, fine: float) -> tuple[Column, Column]:
    """Answer and commitment of a control at a stored step; it knows absolute time, not the protocol."""
    y, w = F.col("class_code"), wrong_class(F.col("class_code"))
    end = F.col("anchor_s") + j * fine
    d = j * F.lit(fine)
    odd_phase = F.pmod(F.floor(d / F.col("p") + TOL), F.lit(2)) == 1
    key = F.concat_ws("|", F.lit("rand"), "video_id", F.col("eta").cast("string"), F.rint(end * 1000).cast("bigint").cast("string"))
    other = F.floor(uniform(key, 2) * (N_CLASSES - 1))
    other = F.when(other >= y, other + 1).otherwise(other)
    pred = (F.when(F.col("family") == "oracle", y)
            .when(F.col("family") == "lock", F.when(d >= F.col("d0") - TOL, y).otherwise(w))
            .when(F.col("family") == "osc", F.when((d >= F.col("d0") - TOL) | odd_phase, y).otherwise(w))
            .when(F.col("family") == "frac", F.when(end >= F.col("c") * F.col("duration_s") - TOL, y).otherwise(w))
            .otherwise(F.when(uniform(key, 1) < F.col("eta"), y).otherwise(other)).cast("int"))
    return pred, F.coalesce(d >= F.col("commit") - TOL, F.lit(False))


def control_answers(manifest: DataFrame, controls: list[Control], fine: float, j_min: int, j_max: int) -> DataFrame:
    """Control answers on real anchors and durations, as a long answer table."""
    g = _with_controls(manifest, controls).withColumn("j", F.explode(F.sequence(F.lit(j_min), F.lit(j_max))))
    pred, committed = _control_cell(F.col("j"), fine)
    rest = (1.0 - CONTROL_CONFIDENCE) / (N_CLASSES - 1)
    return g.select("system_id", "video_id", "j", F.lit(fine).alias("delta_s"), pred.alias("pred"), committed.alias("committed")).withColumn(
        "probs", F.array(*[F.when(F.col("pred") == c, CONTROL_CONFIDENCE).otherwise(rest) for c in range(N_CLASSES)]))


def packed_controls(manifest: DataFrame, controls: list[Control], fine: float, j_min: int, j_max: int) -> DataFrame:
    """The same answers packed per (system, clip): arrays made in place, nothing is shuffled."""
    def cell(j):
        pred, committed = _control_cell(j, fine)
        return F.struct(pred.alias("pred"), committed.alias("committed"))
    return _with_controls(manifest, controls).select("system_id", "video_id", F.lit(j_min).alias("j0"), F.transform(F.sequence(F.lit(j_min), F.lit(j_max)), cell).alias("cells"))


def control_expectation(cohort: DataFrame, controls: list[Control], h: float, delta: float, eps: float = 0.0) -> DataFrame:
    """Closed-form first stable step, delay and flips of the deterministic controls on a cohort."""
    det = [k for k in controls if k.family != "rand"]
    spec = F.array(*[F.struct(F.lit(k.system_id).alias("system_id"), F.lit(k.family).alias("family"), F.lit(k.d0).alias("d0"), F.lit(k.p).alias("p"), F.lit(k.c).alias("c")) for k in det])
    g = cohort.withColumn("k", F.explode(spec)).select("*", "k.*")
    inf = F.lit(float("inf"))
    d0, p = F.col("d0"), F.col("p")
    seen = F.lit(h + eps)
    # last wrong phase of an alternating control; inside the window it may close on a correct phase
    q = F.ceil(d0 / p - TOL) - 1
    q = F.when(F.pmod(q, F.lit(2)) == 0, q).otherwise(q - 1)
    settled = F.when((d0 <= 0) | (q < 0), -inf).otherwise(F.least((q + 1) * p, d0))
    closing = F.floor(seen / p + TOL)
    osc = F.when(d0 <= seen + TOL, settled).when(F.pmod(closing, F.lit(2)) == 1, closing * p).otherwise(inf)
    tau = (F.when(F.col("family") == "oracle", -inf).when(F.col("family") == "lock", d0 - eps)
           .when(F.col("family") == "osc", osc - eps).otherwise(F.col("c") * F.col("duration_s") - F.col("anchor_s") - eps))
    steps = int(h / delta + TOL)
    m = F.when(tau == -inf, 0.0).when(tau == inf, float(steps + 1)).otherwise(F.greatest(F.ceil(tau / delta - TOL).cast("double"), F.lit(0.0)))
    delay = F.when(m <= 0, 0.0).when(m > steps, steps * delta).otherwise((m - 0.5) * delta)
    return g.withColumn("tau", tau).withColumn("m", m).withColumn("expected_delay", delay).withColumn(
        "expected_flips", F.when(F.col("family") == "oracle", 0).when(F.col("family") != "osc", ((m >= 1) & (m <= steps)).cast("int")))
