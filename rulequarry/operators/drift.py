"""Drift detectors as folds over ordered observations, the same for a batch and for streaming state."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.operators.candidates import checkpoint_dir

LAMBDA, DELTA, ALPHA, WARM_UP = 8.0, 0.005, 0.05, 30
TARGET, SLACK, LIMIT, CUSUM_WARM_UP = 0.95, 0.05, 4.0, 20


#: Rows that a block of a long history holds, on average.
BLOCK = 1_000_000


def _tie(obs: DataFrame) -> list[str]:
    """The column that orders observations of one `ord`, if there is one."""
    return ["tie"] if "tie" in obs.columns else []


def _blocks(obs: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """key, block, xs: the observations of a key in order, and the most blocks that a key has.

    A key of up to `rows` rows is one block. A longer one, of which there are no more than `rows` goes into all rows, is cut into
    as many equally wide stretches of its `ord` as `rows` goes into it. `ord` is a number; what shares one shares a block, in
    order of the column `tie` if there is one.
    """
    long = obs.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.min("ord").alias("__low"), F.max("ord").alias("__high")).filter(F.col("__n") > rows)
    many = long.agg(F.max(F.ceil(F.col("__n") / rows))).first()[0] or 1
    order = ["ord", *_tie(obs)]
    place = F.lit(0)
    if many > 1:
        obs = obs.join(F.broadcast(long), F.col(key).eqNullSafe(F.col("__key")), "left")
        place = F.coalesce(F.floor((F.col("ord") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1.0) * F.ceil(F.col("__n") / rows)), F.lit(0))
    dealt = obs.select(key, *order, F.col("x").cast("double").alias("x"), place.cast("long").alias("block"))
    return dealt.groupBy(key, "block").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "x"))), lambda o: o["x"]).alias("xs")), many


def _before(sums: DataFrame, key: str, given: list[str], state: dict[str, float], step) -> DataFrame:
    """key, block and the state that a key's earlier blocks leave; step(state, *given) takes a block's summary.

    Summaries are a row a block, read in order and one at a time.
    """
    names = [key, "block", *given]
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = tuple(state.values())
    schema = sums.select(key, "block", *[F.lit(v).cast("long" if isinstance(v, int) else "double").alias(c) for c, v in state.items()]).schema

    def run(batches):
        import pyarrow as pa

        at, now = object(), start
        for batch in batches:
            out = []
            for k, block, *values in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if k != at:
                    at, now = k, start
                out.append((k, block, *now))
                now = step(now, *values)
            kept = [batch.schema.field(c) for c in (key, "block")] + [pa.field(c, pa.int64() if isinstance(v, int) else pa.float64()) for c, v in state.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(kept), kept)], schema=pa.schema(kept))

    return sums.select(*names).repartition(n, key).sortWithinPartitions(key, "block").mapInArrow(run, schema)


def _with(blocks: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Blocks beside the state before them; a null key is a key."""
    b = before.withColumnsRenamed({key: "__key", "block": "__block"})
    return blocks.join(b, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block"))).drop("__key", "__block")


def _settled(blocks: DataFrame, guess: DataFrame, key: str, names: list[str], fold: Column) -> DataFrame:
    """Blocks folded from the very state that the block before leaves: (key, block, names with a 0 behind, s), s being the fold.

    They start from a guess that may be off by the last bits. Where the block before has left another state, the fold is made
    again from that, until nothing moves before a key's first firing, behind which states don't matter. Two states that both return to
    zero are one from there on, so that is soon.
    """
    start = [f"{c}0" for c in names]
    w = Window.partitionBy(key).orderBy("block")
    checkpoint_dir(blocks.sparkSession)
    states = _with(blocks, guess, key).select(key, "block", *start, fold.alias("s")).checkpoint()
    while True:
        before = F.max("s.fired").over(w.rowsBetween(Window.unboundedPreceding, -1))  # null in a key's first block
        left = states.withColumns({f"__{c}": F.lag(f"s.{c}").over(w) for c in names}).withColumn("__fired", before)
        moved = reduce(lambda a, b: a | b, [~F.col(f"__{c}").eqNullSafe(F.col(f"{c}0")) for c in names])
        wrong = left.filter((F.col("__fired") == 0) & moved).select(key, "block", *[F.col(f"__{c}").alias(f"{c}0") for c in names])
        if wrong.isEmpty():
            return states
        again = _with(blocks, wrong, key).select(key, "block", *start, fold.alias("s"))
        other = wrong.select(F.col(key).alias("__key"), F.col("block").alias("__block"))
        kept = states.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")), "left_anti")
        states = kept.unionByName(again).checkpoint()


def page_hinkley(obs: DataFrame, key: str, threshold: float = LAMBDA, delta: float = DELTA, alpha: float = ALPHA, warm_up: int = WARM_UP, rows: int = BLOCK) -> DataFrame:
    """(key, ord, x) -> key, n, fired_at: the first observation at which the cumulated fall of the mean passes the threshold, or 0.

    A history of several blocks is folded block by block in parallel: the mean after a block is an affine map of the mean before
    it, and with the mean known, so is the excursion e = sum - low, as e' = max(0, e + d) composes to max(e + D, E). A last fold
    starts from the state before each block. Sums of several blocks are added in another order than those of one, so an
    excursion that meets the threshold to the last bits may fire on either side.
    """
    blocks, many = _blocks(obs, key, rows)
    mean = f"IF(s.n = 0, x, s.mean + {alpha}D * (x - s.mean))"
    total = f"s.sum + ({mean} - x) - {delta}D"

    def fold(start: str) -> str:
        return f"""aggregate(xs, {start},
        (s, x) -> named_struct('n', s.n + 1, 'mean', {mean}, 'sum', {total}, 'low', least(s.low, {total}),
          'fired', CASE WHEN s.fired > 0 THEN s.fired WHEN s.n + 1 >= {warm_up} AND {total} - least(s.low, {total}) > {threshold}D THEN s.n + 1 ELSE 0L END))"""

    start = "named_struct('n', {}, 'mean', {}, 'sum', {}, 'low', {}, 'fired', 0L)"
    if many == 1:
        states = blocks.select(key, "block", F.expr(fold(start.format("0L", "0D", "0D", "0D"))).alias("s"))
    else:
        keep = 1 - alpha
        means = blocks.select(key, "block", F.size("xs").cast("long").alias("m"), F.expr(f"aggregate(xs, 0D, (a, x) -> a + {alpha}D * (x - a))").alias("offset"), F.col("xs")[0].alias("first"))
        # the first observation is the mean itself, so its share in a key's first block is 1, not alpha
        known = _before(means, key, ["m", "offset", "first"], {"n0": 0, "mean0": 0.0}, lambda s, m, offset, first: (s[0] + m, offset + keep**m * (s[1] if s[0] else first)))
        part = _with(blocks, known, key).select(key, "block", F.expr(fold(start.format("n0", "mean0", "0D", "0D"))).alias("s"), "n0", "mean0")
        sums = part.select(key, "block", "n0", "mean0", F.col("s.sum").alias("d"), F.expr("s.sum - s.low").alias("e"))
        held = _before(sums, key, ["d", "e"], {"sum0": 0.0, "e0": 0.0}, lambda s, d, e: (s[0] + d, max(s[1] + d, e)))
        states = _with(_with(blocks, known, key), held, key).select(key, "block", F.expr(fold(start.format("n0", "mean0", "sum0", "sum0 - e0"))).alias("s"))
    fired = F.coalesce(F.min(F.when(F.col("s.fired") > 0, F.col("s.fired"))), F.lit(0).cast("long"))
    return states.groupBy(key).agg(F.max("s.n").alias("n"), fired.alias("fired_at"), F.round(F.max_by("s.sum", "block"), 6).alias("cumulated"))


def cusum(obs: DataFrame, key: str, target: float = TARGET, slack: float = SLACK, limit: float = LIMIT, warm_up: int = CUSUM_WARM_UP, rows: int = BLOCK) -> DataFrame:
    """(key, ord, x) -> key, n, fired_at, direction of a two-sided cumulative sum; blocks as in page_hinkley(), one map for each side.

    Sums of fixed steps meet the limit often, so the last bits count: blocks end up folded from exactly what is before them.
    """
    blocks, many = _blocks(obs, key, rows)
    rise, fall = f"(x - {target}D) - {slack}D", f"(x - {target}D) + {slack}D"
    up, down = f"greatest(0D, s.up + (x - {target}D) - {slack}D)", f"least(0D, s.down + (x - {target}D) + {slack}D)"

    def fold(start: str) -> str:
        return f"""aggregate(xs, {start},
        (s, x) -> named_struct('n', s.n + 1, 'up', {up}, 'down', {down},
          'fired', CASE WHEN s.fired > 0 THEN s.fired WHEN s.n + 1 >= {warm_up} AND ({up} > {limit}D OR {down} < -{limit}D) THEN s.n + 1 ELSE 0L END,
          'direction', CASE WHEN s.fired > 0 THEN s.direction WHEN s.n + 1 >= {warm_up} AND {up} > {limit}D THEN 'up' WHEN s.n + 1 >= {warm_up} AND {down} < -{limit}D THEN 'down' ELSE '' END))"""

    start = "named_struct('n', {}, 'up', {}, 'down', {}, 'fired', 0L, 'direction', '')"
    if many == 1:
        states = blocks.select(key, "block", F.expr(fold(start.format("0L", "0D", "0D"))).alias("s"))
    else:
        sums = blocks.select(key, "block", F.expr(fold(start.format("0L", "0D", "0D"))).alias("s"), F.expr(f"aggregate(xs, 0D, (a, x) -> a + {rise})").alias("du"), F.expr(f"aggregate(xs, 0D, (a, x) -> a + {fall})").alias("dd"))
        sums = sums.select(key, "block", "s.n", "s.up", "s.down", "du", "dd")
        held = _before(sums, key, ["n", "up", "down", "du", "dd"], {"n0": 0, "up0": 0.0, "down0": 0.0}, lambda s, n, u, d, du, dd: (s[0] + n, max(s[1] + du, u), min(s[2] + dd, d)))
        states = _settled(blocks, held, key, ["n", "up", "down"], F.expr(fold(start.format("n0", "up0", "down0"))))
    first = F.min(F.when(F.col("s.fired") > 0, F.struct("s.fired", "s.direction")))
    return states.groupBy(key).agg(F.max("s.n").alias("n"), F.coalesce(first["fired"], F.lit(0).cast("long")).alias("fired_at"), F.coalesce(first["direction"], F.lit("")).alias("direction"))


@dataclass
class Detector:
    """Both detectors of one (agent, rule), for streaming state; the target is the mean of the first 64 observations."""

    n: int = 0
    mean: float = 0.0
    sum: float = 0.0
    low: float = 0.0
    total: float = 0.0
    up: float = 0.0
    down: float = 0.0
    ph_fired: bool = False
    cusum_fired: bool = False

    def add(self, x: float, threshold: float = LAMBDA) -> list[str]:
        self.n += 1
        self.mean = x if self.n == 1 else self.mean + ALPHA * (x - self.mean)
        self.sum += (self.mean - x) - DELTA
        self.low = min(self.low, self.sum)
        if self.n <= 64:
            self.total += x
        d = x - self.total / min(self.n, 64)
        self.up, self.down = max(0.0, self.up + d - SLACK), min(0.0, self.down + d + SLACK)
        out = []
        if not self.ph_fired and self.n >= WARM_UP and self.sum - self.low > threshold:
            self.ph_fired = True
            out.append("page_hinkley")
        if not self.cusum_fired and self.n >= CUSUM_WARM_UP and (self.up > LIMIT or self.down < -LIMIT):
            self.cusum_fired = True
            out.append("cusum_up" if self.up > LIMIT else "cusum_down")
        return out

    def state(self) -> tuple:
        return tuple(asdict(self).values())


STATE = "n long, mean double, sum double, low double, total double, up double, down double, ph_fired boolean, cusum_fired boolean"
EVENT = "key string, n long, detector string"


def drift_events(obs: DataFrame, key: str) -> DataFrame:
    """(key, ord, x) -> an event for each detector that fires, in a fold over each key's observations.

    The rows of a key come in order and a batch at a time, so none is held whole.
    """
    at, text = F.to_timestamp(F.lit("1970-01-01")), F.lit(None).cast("string")
    rows = obs.select(F.col(key).cast("string").alias("agent"), text.alias("rule"), at.alias("at"), "ord", *_tie(obs), F.col("x").cast("double").alias("x"), text.alias("control"))
    return _folded(rows, float("inf"), EVENT, lambda k, s, at, fired: [(k[0], s.detector.n, e) for e in fired or []])


#: Observations and controls: x is null in a control row, control is 'reset' in one.
OBSERVED = "agent string, rule string, at timestamp, ord long, x double, control string"
KEPT = STATE + ", last timestamp, resets long, expiries long"
DRIFTED = "agent string, rule string, at timestamp, n long, detector string"
STATS = "agent string, rule string, n long, mean double, excursion double, fired boolean, resets long, expiries long"


@dataclass
class Session:
    """The detectors of one (agent, rule) with what clears them: a reset, or `idle` seconds without a row."""

    detector: Detector
    last: object = None
    resets: int = 0
    expiries: int = 0

    def row(self, at, x, control, idle: float) -> list[str]:
        """Take a row in event order; gives the detectors that fire."""
        if self.last is not None and (at - self.last).total_seconds() > idle:
            self.expiries += self.detector.n > 0
            self.detector = Detector()
        self.last = at if self.last is None else max(self.last, at)
        if control == "reset":
            self.resets += 1
            self.detector = Detector()
            return []
        return self.detector.add(float(x)) if x == x and x is not None else []

    def stats(self) -> tuple:
        d = self.detector
        return d.n, d.mean, d.sum - d.low, d.ph_fired or d.cusum_fired, self.resets, self.expiries


def for_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """OBSERVED rows with controls that name no rule given to each of `rules` (rule), as a registry clears all of an agent's detectors.

    The rules are few and broadcast after a check of their number.
    """
    few = rules.select(F.col("rule").alias("__rule")).distinct()
    if few.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 rules: name the rule in each control row")
    named = rows.filter("control IS NULL OR rule IS NOT NULL")
    every = rows.filter("control IS NOT NULL AND rule IS NULL").crossJoin(F.broadcast(few)).withColumn("rule", F.col("__rule")).drop("__rule")
    return named.unionByName(every)


def _folded(rows: DataFrame, idle: float, schema: str, give) -> DataFrame:
    """Rows of a key in event order through one Session, a batch at a time; give(key, session, fired) makes rows, and once more with fired None at the key's end."""
    names = ["agent", "rule", "at", "ord", "x", "control"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = _tie(rows)
    dealt = rows.select(*names, *tie).repartition(n, "agent", "rule").sortWithinPartitions("agent", "rule", "at", "ord", *tie).select(*names)

    def fold(batches):
        import pandas as pd

        columns = [c.split(" ")[0] for c in schema.split(", ")]
        key, session = None, None
        for batch in batches:
            out = []
            for agent, rule, at, _, x, control in batch.itertuples(index=False):
                if session is None or key != (agent, rule):
                    if session is not None:
                        out += give(key, session, None, None)
                    key, session = (agent, rule), Session(Detector())
                fired = session.row(at, x, control, idle)
                out += give(key, session, at, fired)
            yield pd.DataFrame(out, columns=columns)
        if session is not None:
            yield pd.DataFrame(give(key, session, None, None), columns=columns)

    return dealt.mapInPandas(fold, schema)


def replay(rows: DataFrame, idle: float) -> DataFrame:
    """OBSERVED rows -> the events that streaming.pipelines.drift_sessions() gives for them."""
    return _folded(rows, idle, DRIFTED, lambda key, s, at, fired: [(*key, at, s.detector.n, e) for e in fired or []])


def stats(rows: DataFrame, idle: float) -> DataFrame:
    """OBSERVED rows -> each key's state after its last row."""
    return _folded(rows, idle, STATS, lambda key, s, at, fired: [] if fired is not None else [(*key, *s.stats())])
